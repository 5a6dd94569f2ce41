"""What the operators share: reading tables, writing shared intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; every other character belongs to a word.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows up to which the smaller side of a join is broadcast; past it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``.

    A file of one row group is one task whatever the cluster; where the scan has fewer tasks than
    there are cores, rows are dealt to all of them first.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and driver and executors are one process, a new local folder; on a cluster
    that is an error, as every machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trialframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, which cuts the lineage.

    Lost executors cost nothing that was written.  The folder goes when the driver's JVM ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tf-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    for made in _SCRATCH:
        made.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those taken from the list that it gives."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.pop()
        for df in made:
            discard(df)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read again."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_of(keep: tuple[str, ...], *added: str) -> None:
    """Kept columns must not have the name of one that an operator adds."""
    if both := sorted({k.lower() for k in keep} & set(added)):
        raise ValueError(f"keep names columns that are added: {', '.join(both)}")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, what is written hands Python workers batches of ``rows`` rows: long texts and their copies then fit beside the JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
