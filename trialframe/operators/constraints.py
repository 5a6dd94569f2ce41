"""Constraints of the study's records, each a list of (rule_id, test) for ``workflow.violations``.

A record that breaks a rule gives a row; a test that is null is broken.  Rules across rows are
functions that return the offending keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.workflow import violations

# Fixed values of the record formats.
TASKS = ("T1", "T2", "T3")
CONDITIONS = ("C1", "C1+", "C2", "C3", "C4")
SCORE_STATUSES = ("ok", "parse_failure", "execution_failure", "invalid_response", "scoring_error")
PROPERTY_CATEGORIES = ("inputs", "outputs", "behavior", "edge_case")
BUG_CATEGORIES = ("off_by_one", "wrong_comparison_operator", "missing_boundary_check", "incorrect_variable_reference", "swapped_arguments")
COMPLEXITIES = ("trivial", "low", "medium", "high")
STAGE1 = ("PASS", "EXCLUDE", "DEFER")
STAGE2 = ("INCLUDE", "EXCLUDE", "DEFER", "not_run")
STAGE3 = ("preferred", "acceptable", "ceiling_risk", "not_run")
DECISIONS = ("INCLUDE", "EXCLUDE", "DEFER")
ANCHORS = ("clamp", "count_vowels", "is_sorted")
# The artifact that shows a unit in each condition.
ARTIFACTS = {"C1": "raw_source", "C1+": "annotated_text", "C2": "ast", "C3": "typed_ast", "C4": "ir"}
# Words in a test's name that make it an edge case.
EDGE_WORDS = (
    "empty edge boundary single zero negative large huge big unicode overflow invalid raise error exception duplicate dup unsorted "
    "precondition out_of_range nan inf deep nested wide stress tie reverse alternating identity idempot acronym min max one_element two_element"
).split()

c = F.col


def filled(*names: str) -> list[tuple[str, Column]]:
    return [(f"{n}_filled", F.length(F.trim(c(n))) > 0) for n in names]


def implies(condition: Column, then: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | then


def score_rules() -> list[tuple[str, Column]]:
    """Of a score record (see ``sources.scores``)."""
    ok, part = c("status") == "ok", lambda k: c("subscores")[k]
    t2 = c("task") == "T2"
    return [
        *filled("func_id", "task", "condition", "model_id", "response_ref", "ground_truth_ref"),
        ("tag", c("record_format") == "scorer-result-v1"),
        ("task_known", c("task").isin(*TASKS)),
        ("condition_known", c("condition").isin(*CONDITIONS)),
        ("score_present", c("score").isNotNull()),
        ("status_known", c("status").isin(*SCORE_STATUSES)),
        ("reason_iff_failed", ok == c("failure_reason").isNull()),
        ("unit_range", implies(c("task").isin("T1", "T3"), c("score").between(0.0, 1.0))),
        ("t2_score", implies(t2, c("score").isin(0.0, 1.0, 2.0, 3.0))),
        ("t2_parts", implies(t2, part("location").isin(0, 1) & part("diagnosis").isin(0, 1) & part("fix").isin(0, 1))),
        ("t2_sum", implies(t2, c("score") == part("location") + part("diagnosis") + part("fix"))),
        ("t3_failure_is_zero", implies((c("task") == "T3") & c("status").isin("parse_failure", "execution_failure"), c("score") == 0.0)),
    ]


def checklist_rules() -> list[tuple[str, Column]]:
    """Of a checklist with its properties as an array of structs."""
    p = c("properties")
    return [
        *filled("func_id", "source_hash"),
        ("tag", c("record_format") == "t1-checklist-v1"),
        ("has_properties", F.size(p) > 0),
        ("category_known", F.forall(p, lambda x: F.coalesce(x["category"].isin(*PROPERTY_CATEGORIES), F.lit(False)))),
        ("id_prefix", F.forall(p, lambda x: F.coalesce(x["property_id"].startswith(F.concat(c("func_id"), F.lit("."))), F.lit(False)))),
        ("id_unique", F.size(F.array_distinct(F.transform(p, lambda x: x["property_id"]))) == F.size(p)),
        ("statement_filled", F.forall(p, lambda x: F.coalesce(F.length(F.trim(x["statement"])) > 0, F.lit(False)))),
        ("required_set", F.forall(p, lambda x: x["required"].isNotNull())),
    ]


def span_ok(span: str) -> Column:
    return (c(f"{span}.start_line") >= 1) & (c(f"{span}.end_line") >= c(f"{span}.start_line"))


def bug_rules() -> list[tuple[str, Column]]:
    return [
        *filled("func_id", "source_hash", "bug_id", "bug_description", "test_suite_ref", "location.path", "reference_fix.replacement"),
        ("tag", c("record_format") == "t2-bug-v1"),
        ("id_prefix", c("bug_id").startswith(F.concat(c("func_id"), F.lit(".B")))),
        ("category_known", c("bug_category").isin(*BUG_CATEGORIES)),
        ("location_span", span_ok("location")),
        ("fix_span", span_ok("reference_fix")),
    ]


def transform_rules() -> list[tuple[str, Column]]:
    return [*filled("func_id", "source_hash", "transform_id", "instruction", "test_suite_ref"), ("tag", c("record_format") == "t3-transform-v1"), ("id_prefix", c("transform_id").startswith(F.concat(c("func_id"), F.lit(".TR"))))]


def manifest_rules() -> list[tuple[str, Column]]:
    """Of a unit with its tasks as a map of struct<available, ground_truth_ref>."""
    entries = F.map_entries("tasks")
    return [
        *filled("func_id", "source_hash"),
        ("tasks_known", F.forall(F.map_keys("tasks"), lambda k: k.isin(*TASKS))),
        ("truth_iff_available", F.forall(entries, lambda e: e["value"]["available"] == e["value"]["ground_truth_ref"].isNotNull())),
    ]


def candidate_rules() -> list[tuple[str, Column]]:
    """Of a tracker row: known values, gates between stages, and scores exactly where a stage ran."""
    s1, s2, s3, final = c("stage1_result"), c("stage2_result"), c("stage3_result"), c("final_decision")
    ran2, ran3 = s2 != "not_run", s3 != "not_run"
    open2 = s2.isin("INCLUDE", "not_run") | c("is_anchor")
    return [
        ("complexity_known", c("estimated_complexity").isin(*COMPLEXITIES)),
        ("stage1_known", s1.isin(*STAGE1)),
        ("stage2_known", s2.isin(*STAGE2)),
        ("stage3_known", s3.isin(*STAGE3)),
        ("decision_known", final.isin(*DECISIONS)),
        ("anchor_named", implies(c("is_anchor"), c("candidate_id").isin(*ANCHORS))),
        ("stage2_after_pass", implies(ran2, s1 == "PASS")),
        ("stage3_after_include", implies(ran3, open2)),
        ("include_after_pass", implies(final == "INCLUDE", s1 == "PASS")),
        ("include_screened", implies(final == "INCLUDE", open2)),
        ("stage2_score", ran2 == c("stage2_t2_c1_screen_score").isNotNull()),
        ("stage2_parts", ran2 == c("stage2_t2_subscores").isNotNull()),
        ("stage3_score", ran3 == c("stage3_t3_c2_screen_score").isNotNull()),
    ]


def tracker_violations(rows: DataFrame) -> DataFrame:
    """Candidates that break a rule, whose id or another required field is missing, and ids that stand twice (``duplicate``)."""
    twice = rows.groupBy("candidate_id").agg(F.count("*").alias("n")).where("n > 1").select(c("candidate_id").cast("string").alias("key"), F.lit("duplicate").alias("rule_id"))
    return broken(rows, c("candidate_id"), [*filled("candidate_id"), ("anchor_set", c("is_anchor").isNotNull()), *candidate_rules()]).unionByName(twice)


def broken(records: DataFrame, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    return violations(records, key, rules)


def unknown_units(records: DataFrame, manifest: DataFrame, key: str = "func_id") -> DataFrame:
    """Keys of records that the manifest lacks."""
    return records.select(key).distinct().join(manifest.select(key), key, "left_anti")


def hash_mismatches(records: DataFrame, manifest: DataFrame, key: str = "func_id") -> DataFrame:
    """Records whose source hash is not the manifest's."""
    known = manifest.select(key, c("source_hash").alias("expected_hash"))
    return records.join(known, key).where(~c("source_hash").eqNullSafe(c("expected_hash"))).select(key, "source_hash", "expected_hash")


def tier(test_id: Column) -> Column:
    """``edge`` if the method's name holds an edge word, else ``base``."""
    return F.when(F.lower(F.substring_index(test_id, ".", -1)).rlike("|".join(EDGE_WORDS)), "edge").otherwise("base")


def representation_path(unit: Column, condition: Column, task: Column) -> Column:
    """Where the artifact of a condition lies; the second task shows the faulty variant.  Null for an unknown condition."""
    faulty = F.when(task == "T2", "_buggy").otherwise("")
    folder = F.create_map(*(F.lit(x) for k, v in ARTIFACTS.items() for x in (k, "raw" if v == "raw_source" else v)))[condition]
    suffix = F.when(condition.isin("C1", "C1+"), ".py").otherwise(".json")
    bug = (task == "T2") & (condition == "C1")
    return F.when(bug, F.concat(F.lit("data/ground_truth/bugs/"), unit, F.lit("_buggy.py"))).otherwise(F.concat(F.lit("data/functions/"), folder, F.lit("/"), unit, faulty, suffix))


def best_fix_line(fixes: Column, reference: Column, preferred: list[tuple[Column, str]] = ()) -> Column:
    """The fix line that equals the reference, else the first that a (condition, pattern) rule prefers, else the first line of code."""
    even = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    found = [F.get(F.filter(fixes, lambda x: even(x) == even(reference)), 0)]
    fits = lambda pattern: F.get(F.filter(fixes, lambda x: x.rlike(pattern)), 0)
    found += [F.when(when, fits(pattern)) for when, pattern in preferred]
    return F.coalesce(*found, F.get(F.filter(fixes, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), 0))
