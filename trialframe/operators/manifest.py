"""The manifest of units against the tables it refers to; everything that is wrong as rows (rule_id, key).

Items have func_id, source_hash, inclusion_status, dataset_tier, eligibility struct<non_recursive, single_function>, artifacts
map<string,string>, representations map<string,boolean>, tasks map<string,struct<available,ground_truth_ref>> and lineage map<string,string>.
Joins are merged: by the size of packed files tables of millions of rows would be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators.constraints import ARTIFACTS, CONDITIONS, TASKS, filled, implies
from trialframe.operators.workflow import demand_none, violations

# Fixed values of the manifest's format.
SCHEMA = (
    "func_id string, source_hash string, inclusion_status string, dataset_tier string, eligibility struct<non_recursive:string,single_function:string>, artifacts map<string,string>, "
    "representations map<string,boolean>, tasks map<string,struct<available:boolean,ground_truth_ref:string>>, lineage map<string,string>"
)
TAG = "dataset-manifest-v1"
STATUSES, TIERS, ELIGIBLE = ("included", "excluded", "deferred"), ("pilot", "full"), ("eligible", "ineligible", "unknown")
LINEAGE = ("raw_source_hash", "ast_source_hash", "typed_ast_source_hash", "ir_source_hash", "t1_source_hash")
TRUTH_FORMATS = {"T1": "t1-checklist-v1", "T2": "t2-bug-v1", "T3": "t3-transform-v1"}
INPUT_TAG = "scorer-input-v1"

c = F.col


def _has(map_: str, keys) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(map_))) == 0


def _text_or_null(map_: str) -> Column:
    return F.forall(F.map_values(map_), lambda v: v.isNull() | (F.length(F.trim(v)) > 0))


def item_rules() -> list[tuple[str, Column]]:
    """Of one item by itself."""
    task = lambda t, f: F.element_at("tasks", F.lit(t))[f]
    ref = lambda t: F.length(F.trim(F.coalesce(task(t, "ground_truth_ref"), F.lit("")))) > 0
    shown = lambda k: F.element_at("representations", F.lit(k))
    held = lambda k: F.element_at("artifacts", F.lit(ARTIFACTS[k])).isNotNull()
    can = lambda k: c(f"eligibility.{k}") == "eligible"
    return [
        *filled("func_id", "source_hash"),
        ("inclusion_known", c("inclusion_status").isin(*STATUSES)),
        ("tier_known", c("dataset_tier").isin(*TIERS)),
        *((f"{k}_known", c(f"eligibility.{k}").isin(*ELIGIBLE)) for k in ("non_recursive", "single_function")),
        ("artifacts_listed", _has("artifacts", ARTIFACTS.values())),
        ("artifacts_text", _text_or_null("artifacts")),
        ("raw_source_set", F.element_at("artifacts", F.lit("raw_source")).isNotNull()),
        ("representations_listed", _has("representations", CONDITIONS) & F.forall(F.map_values("representations"), lambda v: v.isNotNull())),
        *((f"shown_iff_held_{k}", shown(k) == held(k)) for k in ARTIFACTS),
        ("tasks_listed", _has("tasks", TASKS)),
        *((f"truth_iff_available_{t}", (task(t, "available") & ref(t)) | (~task(t, "available") & task(t, "ground_truth_ref").isNull())) for t in TASKS),
        ("lineage_listed", _has("lineage", LINEAGE)),
        ("lineage_text", _text_or_null("lineage")),
        *((f"included_is_{k}", implies(c("inclusion_status") == "included", can(k))) for k in ("non_recursive", "single_function")),
    ]


def item_violations(items: DataFrame) -> DataFrame:
    """Items that break a rule by themselves, and func_ids that stand twice (``duplicate``)."""
    twice = items.groupBy("func_id").agg(F.count("*").alias("n")).where("n > 1")
    return violations(items, c("func_id"), item_rules()).unionByName(twice.select(c("func_id").alias("key"), F.lit("duplicate").alias("rule_id")))


def _refs(items: DataFrame) -> DataFrame:
    """Artifacts that are shown: func_id, what, path."""
    own = F.filter(F.map_entries("artifacts"), lambda e: e["value"].isNotNull())
    return items.select("func_id", F.explode(own).alias("e")).select("func_id", c("e.key").alias("what"), c("e.value").alias("path"))


def reference_violations(items: DataFrame, sources: DataFrame, artifacts: DataFrame, truths: DataFrame, facts: DataFrame) -> DataFrame:
    """Items against the tables they refer to, by one join each.

    ``sources`` (path, text), ``artifacts`` (path, source_hash) and ``truths`` (path, record_format, func_id, source_hash) are what lies at the paths;
    ``facts`` (func_id, non_recursive, single_function) is what the sources' trees tell.  Rules: path_<artifact>, source_hash,
    claims_<fact>, truth_missing_<task>, truth_format_<task>, truth_unit_<task> and truth_hash_<task>.
    """
    known = sources.select("path").unionByName(artifacts.select("path")).distinct().hint("merge")
    lost = _refs(items).join(known, "path", "left_anti").select(c("func_id").alias("key"), F.concat(F.lit("path_"), "what").alias("rule_id"))
    raw = items.select("func_id", "source_hash", F.element_at("artifacts", F.lit("raw_source")).alias("path")).join(sources.hint("merge"), "path")
    hashes = raw.where(~c("source_hash").eqNullSafe(F.sha2(F.coalesce("text", F.lit("")), 256))).select(c("func_id").alias("key"), F.lit("source_hash").alias("rule_id"))
    told = items.select("func_id", "eligibility").join(facts.select("func_id", "non_recursive", "single_function").hint("merge"), "func_id")
    claim = lambda k: (f"claims_{k}", (c(f"eligibility.{k}") == "unknown") | ((c(f"eligibility.{k}") == "eligible") == c(k)))
    claims = violations(told, c("func_id"), [claim("non_recursive"), claim("single_function")])
    entries = F.filter(F.map_entries("tasks"), lambda e: e["value"]["available"] & e["value"]["ground_truth_ref"].isNotNull())
    asked = items.select("func_id", "source_hash", F.explode(entries).alias("e")).select("func_id", "source_hash", c("e.key").alias("task"), c("e.value.ground_truth_ref").alias("path"))
    t = truths.select("path", c("record_format").alias("__format"), c("func_id").alias("__unit"), c("source_hash").alias("__hash"), F.lit(True).alias("__there")).hint("merge")
    met = asked.join(t, "path", "left")
    there = c("__there").isNotNull()
    formats = F.create_map(*(F.lit(x) for kv in TRUTH_FORMATS.items() for x in kv))
    rules = [("truth_missing", there), ("truth_format", ~there | c("__format").eqNullSafe(formats[c("task")])), ("truth_unit", ~there | c("__unit").eqNullSafe(c("func_id"))), ("truth_hash", ~there | c("__hash").eqNullSafe(c("source_hash")))]
    wrong = violations(met, F.concat_ws("\x1f", "func_id", "task"), rules)
    split = F.split("key", "\x1f")
    wrong = wrong.select(split[0].alias("key"), F.concat_ws("_", "rule_id", split[1]).alias("rule_id"))
    return reduce(DataFrame.unionByName, (lost, hashes, claims, wrong))


def lineage_violations(items: DataFrame, artifacts: DataFrame, truths: DataFrame) -> DataFrame:
    """Lineage that isn't the hash of what it names: lineage_<key>; an artifact that is not shown has no hash."""
    held = _refs(items).join(artifacts.hint("merge"), "path").groupBy("func_id").pivot("what", ["ast", "typed_ast", "ir"]).agg(F.max("source_hash")).hint("merge")
    first = F.element_at("tasks", F.lit("T1"))
    t1 = items.where(first["available"]).select("func_id", first["ground_truth_ref"].alias("path")).join(truths.select("path", c("source_hash").alias("t1")).hint("merge"), "path").select("func_id", "t1").hint("merge")
    both = items.select("func_id", "source_hash", "lineage").join(held, "func_id", "left").join(t1, "func_id", "left")
    own = {"raw_source_hash": "source_hash", "ast_source_hash": "ast", "typed_ast_source_hash": "typed_ast", "ir_source_hash": "ir", "t1_source_hash": "t1"}
    return violations(both, c("func_id"), [(f"lineage_{k}", F.element_at("lineage", F.lit(k)).eqNullSafe(c(v))) for k, v in own.items()])


def scorer_inputs(inputs: DataFrame, items: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs of a scorer with ground_truth_ref and source_hash from the manifest, and why others can't be scored (rule_id, key: the response's path).

    ``inputs`` have record_format, func_id, task, condition, model_id, response_ref; ``responses`` (path) are those that exist.
    """
    known = items.select("func_id", "source_hash", "tasks", F.lit(True).alias("__known")).hint("merge")
    there = responses.select(c("path").alias("response_ref"), F.lit(True).alias("__there")).distinct().hint("merge")
    met = inputs.join(known, "func_id", "left").join(there, "response_ref", "left").withColumn("__t", F.try_element_at("tasks", c("task")))
    unit = c("__known").isNotNull()
    rules = [
        *filled("func_id", "task", "condition", "model_id", "response_ref"), ("tag", c("record_format") == INPUT_TAG), ("task_known", c("task").isin(*TASKS)), ("condition_known", c("condition").isin(*CONDITIONS)),
        ("unit_unknown", unit), ("task_unavailable", ~unit | F.coalesce(c("__t.available"), F.lit(False))), ("truth_unset", ~unit | ~F.coalesce(c("__t.available"), F.lit(False)) | c("__t.ground_truth_ref").isNotNull()), ("response_missing", c("__there").isNotNull()),
    ]
    fit = F.forall(F.array(*(F.coalesce(ok, F.lit(False)) for _, ok in rules)), lambda x: x)
    return met.where(fit).select(*inputs.columns, c("__t.ground_truth_ref").alias("ground_truth_ref"), "source_hash"), violations(met, c("response_ref"), rules)


def load_manifest(spark: SparkSession, path: str, tag_field: str = "record_format", strict: bool = True) -> DataFrame:
    """The items of a manifest file (an object with its tag, protocol_scope and items).

    A file that is no JSON object of that tag, has no scope or no items raises; ``strict`` raises for items that break a rule by themselves, too.
    """
    found = spark.read.schema(f"`{tag_field}` string, protocol_scope string, items array<struct<{_struct()}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    demand_none(violations(found, c(tag_field), [("tag", c(tag_field) == TAG), ("scope", F.length(F.trim("protocol_scope")) > 0), ("items", F.size("items") > 0)]))
    items = found.select(F.explode("items").alias("i")).select("i.*")
    if strict:
        demand_none(item_violations(items))
    return items


def _struct() -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA).simpleString()[len("struct<") : -1]


def manifest_item(items: DataFrame, func_id: str) -> DataFrame:
    """The item of a unit; raises if there is none."""
    one = items.where(c("func_id") == func_id)
    if one.isEmpty():
        raise ValueError(f"the manifest has no unit {func_id!r}")
    return one
