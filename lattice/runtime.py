"""Session helpers: durable cuts of lineage in a shared folder, and finding this package on executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver does."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local run without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(sc, "_lattice_folder", None) or f"file://{tempfile.mkdtemp(prefix='lattice-')}"
        sc._lattice_folder = folder
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path in its file system, both as Hadoop has them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def session_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    sc = spark.sparkContext
    folder = f"{shared_folder(spark)}/lattice-{sc.applicationId}"
    if getattr(sc, "_lattice_session", None) != folder:
        files, at = _path(spark, folder)
        files.mkdirs(at)
        files.deleteOnExit(at)
        sc._lattice_session = folder
    return folder


#: Rows of a file that cut() writes, where it is told how many rows there are at most.
FILE_ROWS = 25_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive lost executors and don't run it again.

    With rows, the most that df can have, few rows go to few files, instead of one from each task."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    if rows is not None and (files := rows // FILE_ROWS + 1) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(files)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


#: Bytes of tables that are read for one task.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns over so many tasks as the files that it reads ask for, so that a task's rows don't grow with them."""
    return df.repartition(tasks(df), *by)


def tasks(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    known = sum(n for n in sizes if n < 1 << 50)  # what has no known size says a number near 2^63
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known // TASK_BYTES, 20_000))


def release(*cuts: DataFrame) -> None:
    """Delete what cut() wrote for these; nothing that is still to be read may come from them."""
    for df in cuts:
        if path := getattr(df, "_cut_path", None):
            files, at = _path(df.sparkSession, path)
            files.delete(at, True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a file or folder of files from a later version of it: names, sizes and times."""
    files, at = _path(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(at)))
