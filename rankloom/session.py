"""Session helpers: reading tables and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and nothing on a cluster, which needs a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there.

    Used where a result is read more than once and must be the same each time (assignments, iterations):
    the files are on shared storage, so losing an executor does not lose them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, for files that all executors write and read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def discard(*done: DataFrame) -> None:
    """Delete the files of frames that `cut` returned and nothing will read again, so that iterations do not pile them up."""
    for df in done:
        where = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if where.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    """Number of tasks that wide stages are planned for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
