"""Setting unparseable rows apart while loading the rest.

Blocks of records go through a columnar path that accepts or refuses a block as a whole: one pattern over all its records, Arrow's CSV reader and
checks of whole columns. A refused block is halved again and again, down to a few records, and only those are read by the strict
parser, which either loads a record (it was merely unusual) or names the reason. Nothing is tested record by record before. How many records a
block starts with follows what the last blocks did, so input with many bad records is not read over and over.

Reasons, the first that applies: ``quoting``, ``column_count``, ``value``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t"
#: parts the records of a block while their structure is tested; a block with one inside is refused
PART = "\x1e"


@dataclass(frozen=True)
class FieldRule:
    """A field: its name, the pattern its trimmed content must match in full (RE2 and `re` syntax), and whether it is a timestamp."""

    name: str
    pattern: str
    timestamp: bool = False
    ignore_case: bool = False

    @cached_property
    def whole(self) -> re.Pattern:
        """The pattern, for `fullmatch`; letter case of plain letters only."""
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    @property
    def regex(self) -> str:
        """The same in RE2."""
        return ("(?i)" if self.ignore_case else "") + rf"\A(?:{self.pattern})\z"


@dataclass(frozen=True)
class Grammar:
    """Delimited records with double quotes; at most `block` records are read at once, and up to `strict` of a refused block one by one."""

    rules: tuple[FieldRule, ...]
    delimiter: str = ","
    block: int = 4096
    strict: int = 8
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(r.name for r in self.rules))

    def __getstate__(self) -> dict:
        """What goes to the tasks: not what is worked out from it."""
        return {k: v for k, v in self.__dict__.items() if k not in ("structure", "options")}

    @cached_property
    def structure(self) -> re.Pattern:
        """A block of records, parted by `PART`, all without blanks outside quotes, quotes in unquoted fields or unquoted line ends. Never steps back."""
        one = rf'(?:"(?:[^"{PART}]++|"")*+"|[^"{self.delimiter}\r\n{PART}]*+)'
        record = rf"(?:{one}{self.delimiter}){{{len(self.rules) - 1}}}{one}\r?"
        return re.compile(rf"{record}(?:{PART}{record})*+")

    @cached_property
    def options(self) -> tuple[pacsv.ParseOptions, pacsv.ConvertOptions]:
        return (
            pacsv.ParseOptions(delimiter=self.delimiter, newlines_in_values=True, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types=dict.fromkeys(self.names, pa.string()), null_values=[], strings_can_be_null=False),
        )


COMPARISON_RECORD = Grammar(
    (
        FieldRule("ord", r"[0-9]+"),
        FieldRule("left", r"(?s:.+)"),
        FieldRule("right", r"(?s:.+)"),
        FieldRule("winner", r"left|right|tie", ignore_case=True),
        FieldRule("weight", r"(?:[0-9]+(?:\.[0-9]+)?)?"),
        FieldRule("judged_at", r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", timestamp=True),
    )
)
WINNER_RULE = COMPARISON_RECORD.rules[3]


def real_time(text: str) -> bool:
    """Whether `YYYY-MM-DD HH:MM:SS` (already of that shape) is a real date and time of day."""
    y, mo, d, h, mi, s = (int(text[a:b]) for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    if not (1 <= mo <= 12 and 1 <= d and h < 24 and mi < 60 and s < 60):
        return False
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[mo - 1]


def split_strictly(record: str, delimiter: str = ",") -> list[str] | None:
    """The trimmed fields of one record, or None if its quoting is broken."""
    if record.endswith("\r"):
        record = record[:-1]
    fields, at, end = [], 0, len(record)
    while True:
        while at < end and record[at] in BLANKS:
            at += 1
        if at < end and record[at] == '"':
            at, parts = at + 1, []
            while True:
                close = record.find('"', at)
                if close < 0:
                    return None
                parts.append(record[at:close])
                if record[close + 1 : close + 2] != '"':
                    break
                parts.append('"')
                at = close + 2
            at = close + 1
            while at < end and record[at] in BLANKS:
                at += 1
            if at < end and record[at] != delimiter:
                return None
            fields.append("".join(parts).strip(BLANKS))
        else:
            comma = record.find(delimiter, at)
            stop = end if comma < 0 else comma
            if '"' in record[at:stop]:
                return None
            fields.append(record[at:stop].strip(BLANKS))
            at = stop
        if at >= end:
            return fields
        at += 1


def diagnose(record: str | None, grammar: Grammar) -> tuple[list[str] | None, str | None]:
    """The fields of a record and no reason, or no fields and the reason. A null record has a wrong number of fields."""
    if record is None:
        return None, "column_count"
    fields = split_strictly(record, grammar.delimiter)
    if fields is None:
        return None, "quoting"
    if len(fields) != len(grammar.rules):
        return None, "column_count"
    for rule, value in zip(grammar.rules, fields):
        if not rule.whole.fullmatch(value) or (rule.timestamp and not real_time(value)):
            return None, "value"
    return fields, None


def all_valid(values: pa.Array, rule: FieldRule) -> bool:
    """Whether every trimmed value of a block follows the rule; a null does not. Each different value is looked at once."""
    if values.null_count:
        return False
    different = values.unique()
    # Arrow prepares a pattern anew for each call, which pays for many values only
    if len(different) < 256:
        if not all(map(rule.whole.fullmatch, different.to_pylist())):
            return False
    elif not pc.all(pc.match_substring_regex(different, rule.regex)).as_py():
        return False
    if rule.timestamp:
        try:
            different.cast(pa.timestamp("s"))
        except pa.ArrowInvalid:
            return False
    return True


def read_block(records: pa.Array, grammar: Grammar) -> list[pa.Array] | None:
    """The trimmed columns of a block, or None if it is refused: not all records are plain, Arrow cannot read them, or a column has an invalid value."""
    texts = records.to_pylist()
    if records.null_count or not grammar.structure.fullmatch(PART.join(texts)):
        return None
    data = "\n".join(texts).encode()
    if data.startswith(b"\xef\xbb\xbf"):
        return None
    names = grammar.names
    try:
        read = pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
            *grammar.options,
        )
    except pa.ArrowInvalid:
        return None
    if read.num_rows != len(texts):
        return None
    columns = [pc.utf8_trim(read.column(k).combine_chunks(), BLANKS) for k in range(len(names))]
    return columns if all(all_valid(c, rule) for c, rule in zip(columns, grammar.rules)) else None


def bisect(low: int, high: int, accept: Callable[[int, int], object], least: int = 1) -> Iterator[tuple]:
    """Halve [low, high) until `accept(low, high)` takes a block or the block has at most `least` rows.

    In order: (low, high, what accept returned, None if it refused). The stack holds at most log2 of the rows.
    """
    todo = [(low, high)] if high > low else []
    while todo:
        i, j = todo.pop()
        if (found := accept(i, j)) is not None or j - i <= least:
            yield i, j, found
        else:
            half = (i + j) // 2
            todo += [(half, j), (i, half)]


def bisect_all(n: int, accept: Callable[[int, int], object], most: int, least: int) -> Iterator[tuple]:
    """`bisect` over n rows in blocks: twice as many rows after an accepted one, half as many after a refused one, from 4 x `least` to `most`."""
    at, size = 0, most
    while at < n:
        size = min(max(size, 4 * least), most)
        stop, parts = min(n, at + size), 0
        for part in bisect(at, stop, accept, least):
            parts += 1
            yield part
        at, size = stop, size * 2 if parts == 1 else size // 2


def read_batch(texts: pa.Array, grammar: Grammar, read: Callable[[pa.Array, Grammar], list[pa.Array] | None] = read_block) -> tuple[list[pa.Array], pa.Array]:
    """The fields of a batch of records, each a column with nulls where a record is set apart, and the reasons.

    Blocks are read by `read` and halved where it refuses; up to `grammar.strict` records that remain are diagnosed one by one.
    """
    lists: list[list[pa.Array]] = [[pa.array([], pa.string())] for _ in grammar.names]
    reasons: list[str | None] = []
    for low, high, columns in bisect_all(len(texts), lambda i, j: read(texts.slice(i, j - i), grammar), grammar.block, grammar.strict):
        if columns is None:
            told = [diagnose(text, grammar) for text in texts.slice(low, high - low).to_pylist()]
            columns = [pa.array([fields and fields[k] for fields, _ in told], pa.string()) for k in range(len(lists))]
            reasons += [reason for _, reason in told]
        else:
            reasons += [None] * (high - low)
        for out, column in zip(lists, columns):
            out.append(column)
    return [pa.concat_arrays(x) for x in lists], pa.array(reasons, pa.string())


def parse_records(df: DataFrame, text: str, keys: Sequence[str], grammar: Grammar = COMPARISON_RECORD) -> DataFrame:
    """Every row of `df` as `keys`, the grammar's fields as strings, and `reason` (null for a loaded record).

    Rows are neither lost nor merged: a repeated record yields a row each time. A null or empty text has the
    reason ``column_count``; an empty table gives an empty result. Other columns of `df` are not carried, so they may
    have any name; a key named like a field or ``reason`` is refused.
    """
    if clash := {*keys} & {*grammar.names, "reason"}:
        raise ValueError(f"keys named like result columns: {sorted(clash)}")
    source = df.select(*keys, F.col(text).cast("string").alias("__text"))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{n}` string" for n in grammar.names] + ["reason string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at = batch.num_columns - 1
            fields, reasons = read_batch(batch.column(text_at).cast(pa.string()), grammar)
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], *fields, reasons], [*batch.schema.names[:text_at], *grammar.names, "reason"])

    return source.mapInArrow(run, types)


def typed(parsed: DataFrame) -> DataFrame:
    """The loaded comparison records with their types. `ord` is null beyond bigint; `ord_text` has its digits as they came in, whatever their number."""
    return parsed.filter("reason is null").drop("reason").withColumns(
        {
            "ord_text": F.col("ord"),
            "ord": F.col("ord").try_cast("bigint"),
            "winner": F.lower("winner"),
            "weight": F.col("weight").try_cast("double"),
            "judged_at": F.try_to_timestamp("judged_at", F.lit("yyyy-MM-dd HH:mm:ss")),
        }
    )


def check_column(df: DataFrame, column: str, keys: Sequence[str], rule: FieldRule = WINNER_RULE, block: int = 4096, strict: int = 8) -> DataFrame:
    """`keys` of the rows whose `column`, blanks around it aside, breaks the rule, with the reason ``value``.

    Same path as for records, of one column: a block passes as a whole or is halved, and what is left is looked at one by one. Null breaks
    the rule. A repeated row comes out each time.
    """
    if "reason" in keys:
        raise ValueError("a key named reason")
    source = df.select(*keys, F.col(column).cast("string").alias("__value"))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["reason string"])

    def breaks(value: str | None) -> bool:
        return value is None or not rule.whole.fullmatch(value) or (rule.timestamp and not real_time(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            values, bad = pc.utf8_trim(batch.column(at).cast(pa.string()), BLANKS), []
            for low, high, fine in bisect_all(batch.num_rows, lambda i, j, v=values: all_valid(v.slice(i, j - i), rule) or None, block, strict):
                if not fine:
                    bad += [low + k for k, value in enumerate(values.slice(low, high - low).to_pylist()) if breaks(value)]
            if bad:
                out = batch.select(list(range(at))).take(pa.array(bad))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(["value"] * len(bad), pa.string())], [*out.schema.names, "reason"])

    return source.mapInArrow(run, types)


def rejected(parsed: DataFrame) -> DataFrame:
    """The rows set apart, with their reason."""
    return parsed.filter("reason is not null")
