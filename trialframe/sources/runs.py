"""Score files of many runs as one table: a folder for each run, broken files as rows, and gates on status and tag."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialframe.operators.workflow import demand_none
from trialframe.sources.scores import SCORE_SCHEMA, SCORE_TAG

CORRUPT = "corrupt"
TRACKER_TAG = "candidate-tracker-v1"


def write_runs(scores: DataFrame, path: str) -> None:
    """Adds score records to a folder for each run; rows of a run are spread over the tasks that have them, nothing is shuffled."""
    scores.write.mode("append").partitionBy("run_id").json(path)


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path`` (run_id=<run>/...), one JSON object a line, with run_id, file and the text of lines that are no record (``corrupt``).

    A filter on run_id prunes folders before anything is read; a choice of columns is pushed into the reader.
    """
    schema = StructType.fromDDL(f"{SCORE_SCHEMA}, {CORRUPT} string, run_id string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"))


def usable(rows: DataFrame) -> DataFrame:
    """Records of the right tag; broken lines and other tags are passed over."""
    return rows.where(F.col(CORRUPT).isNull() & (F.col("record_format") == SCORE_TAG)).drop(CORRUPT)


def unusable(rows: DataFrame) -> DataFrame:
    """What ``usable`` passes over, as rows (rule_id, key: run and file)."""
    why = F.when(F.col(CORRUPT).isNotNull(), "corrupt").when(~F.col("record_format").eqNullSafe(F.lit(SCORE_TAG)), "tag")
    return rows.select(why.alias("rule_id"), F.concat_ws("/", "run_id", "file").alias("key")).where("rule_id IS NOT NULL")


def not_ok(rows: DataFrame) -> DataFrame:
    """Records whose scorer failed, as rows (rule_id ``scorer_failed``, key, code)."""
    return usable(rows).where(~F.col("status").eqNullSafe(F.lit("ok"))).select(F.lit("scorer_failed").alias("rule_id"), F.concat_ws("/", "run_id", "file").alias("key"), F.coalesce("failure_reason.code", F.lit("no failure_reason")).alias("code"))


def strict(rows: DataFrame) -> DataFrame:
    """The records; raises if any is broken, of another tag, or of a scorer that failed."""
    demand_none(unusable(rows))
    demand_none(not_ok(rows))
    return usable(rows)


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document as a table; None if it is missing or isn't a document of the schema."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path).cache()
    broken = rows.where(F.col(CORRUPT).isNotNull()).isEmpty()
    rows.unpersist()
    return rows.drop(CORRUPT) if broken else None


def load_tracker(spark: SparkSession, path: str, row: str, tag_field: str = "record_format") -> DataFrame:
    """The candidates of a tracker file (tag, candidates: array of ``row``); raises if it is missing, broken or of another tag."""
    found = read_or_none(spark, path, f"`{tag_field}` string, candidates array<struct<{StructType.fromDDL(row).simpleString()[7:-1]}>>")
    if found is None:
        raise ValueError(f"no tracker at {path}, or not JSON")
    tags = [r[0] for r in found.select(tag_field).distinct().take(2)]
    if tags != [TRACKER_TAG]:
        raise ValueError(f"unexpected tracker tag {tags}, expected {TRACKER_TAG!r}")
    return found.select(F.explode("candidates").alias("c")).select("c.*")


def save_tracker(rows: DataFrame, broken: DataFrame, path: str) -> None:
    """Writes candidates as one record a line, if no rule is broken; else raises and leaves what is there."""
    demand_none(broken)
    rows.write.mode("overwrite").json(path)


def analysis_rows(spark: SparkSession, path: str, row: str, list_field: str = "tests", **wanted: str) -> DataFrame:
    """The rows of a list in an analysis document, those whose fields equal ``wanted``."""
    rows = spark.read.schema(f"`{list_field}` array<struct<{StructType.fromDDL(row).simpleString()[7:-1]}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.explode(list_field).alias("r")).select("r.*")
    for k, v in wanted.items():
        out = out.where(F.col(k) == v)
    return out


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """Adds ``value`` of the table by key; a key that the table lacks raises when its row is read."""
    known = table.select(F.col(key).alias("__key"), F.col(value), F.lit(True).alias("__known"))
    met = rows.join(known, rows[key] == F.col("__key"), "left")
    lost = F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return met.withColumn(value, F.when(F.col("__known"), F.col(value)).otherwise(lost)).drop("__key", "__known")


def dispatched(inputs: DataFrame, scorers: Mapping[str, Callable[[DataFrame], DataFrame]], task: str = "task") -> DataFrame:
    """Each task's inputs through its scorer, put together by name; inputs of no known task come back as ``scoring_error`` rows.

    Scorers give key, score, status; each reads its own rows of ``inputs`` only.
    """
    out = None
    for name, scorer in scorers.items():
        own = scorer(inputs.where(F.col(task) == name)).select("key", F.lit(name).alias(task), F.col("score").cast("double").alias("score"), "status")
        out = own if out is None else out.unionByName(own)
    rest = inputs.where(~F.coalesce(F.col(task).isin(*scorers), F.lit(False))).select("key", task, F.lit(0.0).alias("score"), F.lit("scoring_error").alias("status"))
    return rest if out is None else out.unionByName(rest)


def backend(model: Column) -> Column:
    """The service that answers for a model, by the beginning of its name; null for none."""
    starts = lambda *names: F.greatest(*(model.startswith(n) for n in names))
    return F.when(model.startswith("claude-"), "anthropic").when(starts("gpt-", "o1", "o3", "o4-"), "openai")
