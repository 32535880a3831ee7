"""Command line: `python -m rankloom.cli -i log.csv [-o out] pairwise bradley-terry` or `... alpha -d ordinal`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import ranking, reliability, report
from .operators.log import prepare
from .sources import io


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """The result table of a command line; written if it names an output, else printed as CSV."""
    parser = argparse.ArgumentParser(prog="rankloom")
    parser.add_argument("-i", "--input", required=True)
    parser.add_argument("-o", "--output")
    parser.add_argument("--sep", default=",")
    parser.add_argument("--version", action="version", version=f"rankloom {__version__}")
    commands = parser.add_subparsers(required=True, dest="command")
    commands.add_parser("pairwise").add_argument("algorithm", choices=[m.replace("_", "-") for m in ranking.METHODS])
    commands.add_parser("alpha").add_argument("-d", "--distance", choices=list(reliability.DISTANCES), default="nominal")
    args = parser.parse_args(arguments)
    if args.command == "pairwise":
        log = prepare(io.with_file_order(io.read_comparisons_csv(spark, args.input, args.sep)), order="ord")
        scores = ranking.METHODS[args.algorithm.replace("-", "_")](log)
        out = report.with_rank(scores.select("item", "score")).orderBy(F.desc("score"), "item")
    else:
        out = report.alpha_report(reliability.alpha(io.read_ratings_csv(spark, args.input, args.sep), args.distance), 15)
    if args.output:
        io.write_csv(out, args.output)
    else:
        print(",".join(out.columns))
        for row in out.toLocalIterator():
            print(",".join("" if v is None else str(v) for v in row))
    return out


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
