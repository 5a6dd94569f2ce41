"""The corpus pipeline: toxic documents go, one of each group of near copies stays, documents with
benchmark passages go, personal data is masked, and what is left is packed into bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import decontaminate, jaccard, packing, pii, toxicity
from trialframe.llm.common import BROADCAST_ROWS, scratch, table, written

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most ``rows`` texts at once, also in what a stage returns and its caller writes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(rows, int(spark.conf.get(name))))


def _without(docs: DataFrame, gone: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of ``docs`` that match no row of ``gone``; nulls match nulls.  ``keys``: expression of docs to column of gone."""
    few = gone.count() <= BROADCAST_ROWS
    on = None
    for mine, theirs in keys.items():
        same = F.expr(mine).eqNullSafe(F.col(theirs))
        on = same if on is None else on & same
    return docs.join(F.broadcast(gone) if few else gone, on, "left_anti")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer where ``docs`` has columns of these names."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in range(len(taken) + 1) if (n := name + "_" * k).lower() not in taken) for name in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among them, rejects go.

    Empty and null texts stay (score 0), repeated rows go or stay together, null ids are rows like
    others; without labels of both kinds nothing goes.
    """
    _small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.rejected(model)(F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the smallest id, or any one if none has an id.

    Rows are told apart by a number written with them, so what goes and what stays doesn't hang
    on ids, which may be null or repeat.  Rows without words link with nothing; of those that
    repeat both id and text one stays.  Other columns are kept, whatever their names.
    """
    row, out = _free(docs, "__row", "__gone")
    whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-numbered")
    numbered = whole.select(F.col(row).alias("__row"), "doc_id", "text")
    with scratch() as made:
        judged = jaccard.jaccard_join(numbered, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__class"), "class_rows")
        judged = written(judged, "pipeline-near")
        made.remove(judged)
    ids = numbered.select("__row", F.col("doc_id").alias("__id"))
    linked = judged.where("class_rows > 1").select("__row", "__class").join(ids, "__row")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    bare = numbered.where(wordless).select("__row", F.col("doc_id").alias("__id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__class"))
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")

    def others(rows: DataFrame, *keys: str) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
        return rows.select("__row").join(first, "__row", "left_anti")

    gone = written(others(linked, "__class").unionByName(others(bare, "__id", "__class")), "pipeline-gone")
    return _without(whole, gone.withColumnRenamed("__row", out), {row: out}).drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    What goes is told by id and text, so rows that repeat both go together and another text under
    the same id stays; null ids are matched like others, empty and null texts stay, and without
    benchmark items all do.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), keep=("doc_id", "__hash"))
    key, out = _free(docs, "__id", "__gone")
    gone = written(found.select(F.col("doc_id").alias(key), F.col("__hash").alias(out)).distinct(), "pipeline-leaks")
    return _without(docs, gone, {"doc_id": key, "xxhash64(text)": out})


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind; ``n_chars`` becomes the new length.

    Every row stays, repeated ones and those without an id too; a text without personal data, also
    a null one, stays as it is.
    """
    _small_batches(spark)
    names, (told,) = docs.columns, _free(docs, "__spans")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own = f"c{names.index('text')}"
    found = pii.find(numbered, keep=tuple(numbered.columns), text=own)
    masked = F.when(F.col("spans") == "", F.col(own)).otherwise(pii.redacted()(F.col(own), F.col("spans")))
    out = found.select(*(masked.alias(n) if f"c{i}" == own else F.col(f"c{i}").alias(n) for i, n in enumerate(names)), F.col("spans").alias(told))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(told) == "", F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.drop(told)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left.

    One document of each class of near copies is left, so classes need not be told to the packer;
    empty and null texts are pieces of length 0, repeated rows pieces of their own.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("pii", mask_private), ("packing", pack_bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
