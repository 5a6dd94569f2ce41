"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and everything is one process, a new local folder, which on a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trialframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of costly work that go to one task.
ROWS = 20_000


def dealt(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` dealt out by the number of its rows, ``rows`` to a task, before costly work on each: a packed file, or one group of its rows, may hold millions of short ones."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: the lineage ends, a lost executor costs nothing that was written.

    The table goes when the driver's JVM ends; ``instead_of``, a table of an earlier call that nothing will read again, goes now.
    Its joins are merged: by the size of its files, which are packed far below what their rows take, Spark would
    send millions of rows through the driver as a broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tf-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place(path))
    if instead_of is not None:
        files.delete(place(instead_of._stored_path), True)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._stored_path = path
    return out
