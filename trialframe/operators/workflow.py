"""Planning, ledger, tracker and constraint operators over plain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STATUSES = ("planned", "running", "completed", "failed", "skipped")


def plan_items(units: DataFrame, unit: str, tasks: Sequence[str], conditions: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row for each unit, task, condition and model, named unit::task::condition::model, with its place in the plan.

    The short lists are exploded in the row of the unit; no join is needed.
    """
    def listed(name: str, values: Sequence[str]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("o"), F.lit(v).alias("v")) for i, v in enumerate(values)))

    out = units.select(F.col(unit).alias("unit_id"), F.explode(listed("task", tasks)).alias("t"))
    out = out.select("*", F.explode(listed("condition", conditions)).alias("c"))
    out = out.select("*", F.explode(listed("model", models)).alias("m"))
    place = (F.col("t.o") * len(conditions) + F.col("c.o")) * len(models) + F.col("m.o")
    out = out.select("unit_id", F.col("t.v").alias("task"), F.col("c.v").alias("condition"), F.col("m.v").alias("model_id"), place.alias("place"))
    return out.withColumn("item_id", F.concat_ws("::", F.col("unit_id").cast("string"), "task", "condition", "model_id"))


def smoke_items(plan: DataFrame) -> DataFrame:
    """The first item of each model and task, by unit, then place."""
    return plan.groupBy("model_id", "task").agg(F.min_by("item_id", F.struct("unit_id", "place")).alias("item_id"))


def preflight_items(plan: DataFrame, tier: Column) -> DataFrame:
    """All items of the first unit by tier, with the first model."""
    ranked = plan.withColumn("__t", tier)
    first = ranked.agg(F.min(F.struct("__t", "unit_id")).alias("f"), F.min(F.struct("place", "model_id")).alias("m"))
    return plan.join(F.broadcast(first), (F.col("unit_id") == F.col("f.unit_id")) & (F.col("model_id") == F.col("m.model_id"))).select(plan["*"])


def merge_ledger(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """The plan with each item's last known state; items without one are planned, with no attempt."""
    return plan.join(ledger, "item_id", "left").withColumns({"status": F.coalesce("status", F.lit("planned")), "attempt_count": F.coalesce("attempt_count", F.lit(0))})


def normal_status(status: Column) -> Column:
    """Old and unknown states are failures."""
    return F.when(status.isin(*STATUSES), status).otherwise("failed")


def repair(ledger: DataFrame, complete: Column) -> DataFrame:
    """Running items were interrupted, completed items without their files are failures."""
    status = F.when(F.col("status") == "running", "failed").when((F.col("status") == "completed") & ~complete, "failed").otherwise(F.col("status"))
    error = F.when(F.col("status") == "running", "interrupted").when((F.col("status") == "completed") & ~complete, "missing_artifact")
    return ledger.withColumns({"error": error, "status": status})


def should_run(status: Column, mode: str) -> Column:
    """``overwrite`` runs everything, ``resume`` what isn't completed, ``skip`` only what was never started."""
    return {"overwrite": F.lit(True), "resume": status != "completed", "skip": status == "planned"}[mode]


def status_summary(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of every state, zeros included, of started items and of all."""
    return ledger.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count_if(F.col("status") != "planned").alias("started"), F.count("*").alias("total"))


def count_by(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(F.coalesce(key, F.lit("missing")).alias("key")).agg(F.count("*").alias("n"))


def first_seen(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the place at which each is first seen."""
    return df.groupBy(value).agg(F.min(pos).alias("first_pos"))


def slug(*parts: Column) -> Column:
    return F.replace(F.concat_ws("_", *parts), F.lit("+"), F.lit("plus"))


def model_slug(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of ``changes`` in place of rows with the same key."""
    rank = lambda df, k: df.withColumn("__k", F.lit(k))
    both = rank(table, 0).unionByName(rank(changes, 1))
    row = F.struct(*table.columns)
    return both.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, "__k").alias("r")).select("r.*")


def same_plan(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of one plan that the other lacks, repeats counted; empty when the plans agree."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def score_band(score: Column) -> Column:
    return F.when(score >= 3, "EXCLUDE").when(score >= 1, "INCLUDE").otherwise("DEFER")


def ceiling_band(score: Column) -> Column:
    return F.when(score >= 1.0, "ceiling_risk").otherwise("preferred")


def workflow_state(final: Column, stage2: Column, ready: Column, stage3: Column, anchor: Column) -> Column:
    """The first of seven states that fits."""
    return (
        F.when(anchor, "anchor")
        .when(final == "EXCLUDE", "excluded")
        .when(stage2.isNull() & ~ready, "awaiting_material")
        .when(stage2.isNull(), "ready_for_stage2")
        .when(stage3.isNull() & (final == "INCLUDE"), "ready_for_stage3")
        .when(final == "INCLUDE", "included")
        .otherwise("deferred")
    )


def violations(df: DataFrame, key: Column, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """A row (rule_id, key) for each rule that a row breaks; a rule whose test is null is broken.  One pass, no shuffle."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules))
    return df.select(key.cast("string").alias("key"), F.explode(F.array_compact(found)).alias("rule_id"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def demand_none(broken: DataFrame) -> None:
    """Strict mode: raises if there is a violation."""
    first = broken.take(1)
    if first:
        raise ValueError(f"constraint broken: {first[0].asDict()}")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def dense_place(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


# What an item in a state must have written.
EXPECTED = {"completed": ("prompt", "response", "score"), "running": ("prompt",)}


def sorted_json(m: Column) -> Column:
    """A map of numbers as JSON with its keys in order; null for null."""
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(": "), e["value"].cast("string")))
    return F.when(m.isNotNull(), F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")))


def export_table(run_id: Column, ledger: DataFrame, payloads: DataFrame, files: DataFrame, expected: dict[str, Sequence[str]] = EXPECTED) -> DataFrame:
    """The long export, 26 columns: each item with its state, the files it should have and what its score file says.

    ``payloads`` (path, status, failure_reason, subscores, evidence) are the score files that could be read, ``files`` (path) all that exist.
    The files of an item are met by one join over (item, kind, path), its score file by another.
    """
    kinds = ("prompt", "response", "score")
    paths = ledger.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_path").alias("path")) for k in kinds))).alias("x")).select("item_id", "x.*").where("path IS NOT NULL")
    there = paths.join(files.select("path").distinct(), "path", "left_semi").groupBy("item_id").agg(F.collect_set("kind").alias("__there"))
    score = payloads.select(F.col("path").alias("score_path"), F.struct("status", "failure_reason", "subscores", "evidence").alias("__score"))
    rows = ledger.join(there, "item_id", "left").join(score, "score_path", "left").withColumn("__there", F.coalesce("__there", F.array().cast("array<string>")))
    should = F.coalesce(*(F.when(F.col("status") == s, F.array(*map(F.lit, ks))) for s, ks in expected.items()), F.array().cast("array<string>"))
    missing = F.filter(should, lambda k: ~F.array_contains(F.col("__there"), k))
    return rows.select(
        run_id.alias("run_id"), "item_id", "model", F.col("func_id").alias("function"), "task", "condition", F.col("status").alias("item_status"), "started_at", "finished_at", "attempt_count",
        *(F.col(f"{k}_path").alias(f"{k}_artifact_path") for k in kinds), *(F.array_contains("__there", k).alias(f"{k}_artifact_exists") for k in kinds), "score",
        F.col("__score.status").alias("scorer_status"), F.col("__score.failure_reason.code").alias("scorer_failure_reason_code"), F.col("__score.failure_reason.message").alias("scorer_failure_reason_message"),
        sorted_json(F.col("__score.subscores")).alias("score_subscores_json"), F.col("__score.evidence").alias("score_evidence_json"),
        F.col("failure_reason.code").alias("execution_failure_reason_code"), F.col("failure_reason.message").alias("execution_failure_reason_message"), "skip_reason", F.to_json(missing).alias("missing_expected_artifacts_json"),
    )


def tracker_report(rows: DataFrame) -> DataFrame:
    """The tracker in 14 fields, one row: counts of all, of anchors and others, of each stage's results and final decisions (maps), who waits for a stage, and the diversity of families.

    Who waits is listed: the ids are what the report is for; everything else is counted where the rows are.
    """
    anchor = F.coalesce("is_anchor", F.lit(False))
    inn = ~anchor & (F.col("stage2_result") == "INCLUDE")
    wait2 = ~anchor & (F.col("stage1_result") == "PASS") & (F.col("stage2_result") == "not_run")
    wait3 = inn & (F.col("stage3_result") == "not_run")

    def counts(name: str, of: Column = F.lit(True)) -> DataFrame:
        held = rows.where(of).groupBy(F.coalesce(name, F.lit("missing")).alias("k")).agg(F.count("*").alias("n"))
        return held.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    ids = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("candidate_id").cast("string"))))
    one = rows.agg(
        F.count("*").alias("total"), F.count_if(anchor).alias("anchors"), F.count_if(~anchor).alias("non_anchors"), F.count_if(inn).alias("screened_in_non_anchor"), F.count_if(wait2).alias("stage2_eligible_awaiting"), ids(wait2).alias("stage2_eligible_ids"),
        F.count_if(wait3).alias("stage3_eligible_awaiting"), ids(wait3).alias("stage3_eligible_ids"))
    for name, column, of in (("stage1_counts", "stage1_result", F.lit(True)), ("stage2_counts", "stage2_result", F.lit(True)), ("stage3_counts", "stage3_result", ~anchor), ("final_decision_counts", "final_decision", F.lit(True)), ("t2_family_diversity", "t2_bug_family_draft", inn), ("t3_family_diversity", "t3_transform_family_draft", inn)):
        one = one.crossJoin(counts(column, of).withColumnRenamed(column, name))  # one row each
    return one


def add_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with new rows; raises if a key is there already or stands twice."""
    demand_none(rows.join(table.select(key), key, "left_semi").select(F.lit("exists").alias("rule_id"), key))
    demand_none(duplicate_keys(rows, [key]))
    return table.unionByName(rows.select(table.columns))


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of ``changes`` set where they aren't null; raises for a key that the table lacks."""
    demand_none(changes.join(table.select(key), key, "left_anti").select(F.lit("missing").alias("rule_id"), key))
    new = [c for c in changes.columns if c != key]
    met = table.join(changes.select(key, *(F.col(c).alias(f"__{c}") for c in new)), key, "left")
    return met.select(*(F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in table.columns))


def listed(table: DataFrame, **wanted: str) -> DataFrame:
    """The rows whose columns have the wanted values."""
    for name, value in wanted.items():
        table = table.where(F.col(name) == value)
    return table


def readiness_lines(counts: DataFrame) -> DataFrame:
    """A line of text for each state (state, n), in their order; a report of a few rows."""
    return counts.orderBy("state").select(F.format_string("  %-20s %5d", "state", "n").alias("line"))
