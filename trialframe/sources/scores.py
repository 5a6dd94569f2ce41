"""Readers of score records, ledgers and text artifacts, with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the tag of a score record.  Files may call the field otherwise, see ``tag_field``.
TAG_FIELD = "record_format"
SCORE_TAG = "scorer-result-v1"
SCORE_SCHEMA = (
    "record_format string, func_id string, task string, condition string, model_id string, response_ref string, ground_truth_ref string, "
    "score double, status string, subscores map<string,int>, failure_reason struct<code:string,message:string,details:map<string,string>>, evidence string"
)


def _schema(tag_field: str) -> str:
    return SCORE_SCHEMA.replace(TAG_FIELD, f"`{tag_field}`", 1)


def scan_scores(spark: SparkSession, runs_dir: str, run_ids: Sequence[str] = (), tag_field: str = TAG_FIELD) -> DataFrame:
    """Score records below ``runs_dir`` (run/scores/file), with ``run_id`` and ``file`` for their order.

    Broken files and other tags are passed over.  ``run_ids`` reads those runs only: the path is
    the partition, so nothing else is listed.  ``tag_field`` names the field that holds the tag in
    the files; the result calls it ``record_format``.
    """
    paths = [f"{runs_dir}/{r}/scores/*.json" for r in run_ids] or [f"{runs_dir}/*/scores/*.json"]
    rows = spark.read.schema(_schema(tag_field)).option("mode", "PERMISSIVE").option("multiLine", True).json(paths)
    path = F.col("_metadata.file_path")
    rows = rows.select("*", F.regexp_extract(path, "([^/]+)/scores/[^/]+$", 1).alias("run_id"), F.regexp_extract(path, "([^/]+)$", 1).alias("file"))
    return rows.withColumnRenamed(tag_field, TAG_FIELD).where(F.col(TAG_FIELD) == SCORE_TAG)


def scan_scores_strict(spark: SparkSession, runs_dir: str, expected: int | None = None, tag_field: str = TAG_FIELD) -> DataFrame:
    """As ``scan_scores``, but a broken file, another tag or another number of records raises."""
    rows = spark.read.schema(_schema(tag_field)).option("mode", "FAILFAST").option("multiLine", True).json(f"{runs_dir}/*/scores/*.json").withColumnRenamed(tag_field, TAG_FIELD)
    wrong = F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce(TAG_FIELD, F.lit("none"))))
    rows = rows.withColumn(TAG_FIELD, F.when(F.col(TAG_FIELD) == SCORE_TAG, F.col(TAG_FIELD)).otherwise(wrong))
    if expected is not None and (found := rows.count()) != expected:
        raise ValueError(f"{found} score records, not {expected}")
    return rows


def for_task(scores: DataFrame, task: str, models: Sequence[str] = ()) -> DataFrame:
    return scores.where((F.col("task") == task) & (F.col("model_id").isin(*models) if models else F.lit(True)))


def answered(scores: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records whose response exists."""
    return scores.join(responses.select(*keys).distinct(), list(keys), "left_semi")


def scan_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files as rows (name, text)."""
    return spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(?:\\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def repo_path(root: str, path: str) -> str:
    """``path`` below ``root``; absolute and escaping paths raise."""
    parts = path.split("/")
    if not path or path.startswith("/") or ".." in parts:
        raise ValueError(f"not a path below the root: {path!r}")
    return "/".join([root.rstrip("/"), *(p for p in parts if p not in ("", "."))])


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, empty where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
