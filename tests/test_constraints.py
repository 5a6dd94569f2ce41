"""Record rules, published statistics, sampling and small resolvers."""

import pytest
from pyspark.sql import functions as F

from trialframe.functions import kernels as k
from trialframe.functions import sampling
from trialframe.operators import constraints as c
from trialframe.sources.scores import SCORE_SCHEMA

# Published paired differences of thirty units, in the units' order, and their results
# (pairs, W, one-sided p, rank-biserial, interval).
PUBLISHED = {
    "H1": ([0, 0, 1, 0, 0, -0.5, 0.5, 0, 0, 0, 1.5, 0, 0.5, -0.5, 0, 0.5, 0, 0, 0, 0.5, 1, 0.5, 1, -0.5, 0.5, 0, 0, 0, -0.5, 0], 83.0, 0.022765, 0.580952, (0.076923, 0.916667)),
    "H2": ([0, 0, 0, 0, -0.5, 0, 0, -0.5, 0, 0, 0.5, 0.5, 0.5, -0.5, 0, 0, 0, 0, 0, 0.5, 0.5, 0.5, 1.5, -0.5, 0, 0.5, -0.5, 0, -0.5, 0], 63.0, 0.233427, 0.2, (-0.333333, 0.700044)),
    "H3": ([0, 0, -1, 0, -0.5, 0.5, -0.5, -0.5, 0, 0, -1, 0.5, 0, 0, 0, -0.5, 0, 0, 0, 0, -0.5, 0, 0.5, 0, -0.5, 0.5, -0.5, 0, 0, 0], 24.0, 0.96875, -0.472527, (-0.884643, 0.076923)),
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_published(name):
    d, w, p, r, interval = PUBLISHED[name]
    got_w, got_p = k.signed_rank_p(d)
    assert (got_w, round(got_p, 6), round(k.rank_biserial(d), 6)) == (w, p, r)
    assert tuple(round(x, 6) for x in k.bootstrap_interval(d)) == interval


def test_published_in_spark(spark):
    from trialframe.operators import stats

    rows = [(h, u, float(x)) for h, (d, *_) in PUBLISHED.items() for u, x in enumerate(d)]
    out = stats.signed_rank_tests(spark.createDataFrame(rows, "h string, u int, d double"), ["h"]).collect()
    assert {r.h: (r.w_plus, round(r.p, 6)) for r in out} == {h: (w, p) for h, (_, w, p, *_) in PUBLISHED.items()}


def ids(df):
    return sorted(r.rule_id for r in df.collect())


def test_score_rules(spark):
    good = dict(record_format="scorer-result-v1", func_id="f", task="T2", condition="C1+", model_id="m", response_ref="r", ground_truth_ref="g", score=2.0, status="ok", subscores={"location": 1, "diagnosis": 1, "fix": 0}, failure_reason=None, evidence=None)
    check = lambda **x: ids(c.broken(spark.createDataFrame([good | x], SCORE_SCHEMA), F.col("func_id"), c.score_rules()))
    assert check() == []
    assert check(score=3.0) == ["t2_sum"] and check(score=2.5) == ["t2_score", "t2_sum"]
    assert check(status="parse_failure") == ["reason_iff_failed"] and check(condition="C9", model_id=" ") == ["condition_known", "model_id_filled"]
    assert check(task="T3", score=0.5, status="parse_failure", failure_reason=("x", "y", None)) == ["t3_failure_is_zero"]
    assert check(task="T1", score=1.5) == ["unit_range"] and check(subscores=None) == ["t2_parts", "t2_sum"]


def test_truth_rules(spark):
    prop = "array<struct<property_id:string,category:string,statement:string,required:boolean>>"
    rows = [("a", "h", "t1-checklist-v1", [("a.P1", "inputs", "x", True)]), ("b", "h", "t1-checklist-v1", [("b.P1", "odd", "x", True), ("b.P1", "inputs", " ", None)]), ("d", "h", "t1-checklist-v1", [])]
    df = spark.createDataFrame(rows, f"func_id string, source_hash string, record_format string, properties {prop}")
    out = c.broken(df, F.col("func_id"), c.checklist_rules())
    assert ids(out.where("key = 'a'")) == [] and ids(out.where("key = 'b'")) == ["category_known", "id_unique", "required_set", "statement_filled"] and ids(out.where("key = 'd'")) == ["has_properties"]
    bug = "func_id string, source_hash string, record_format string, bug_id string, bug_category string, bug_description string, test_suite_ref string, location struct<path:string,start_line:int,end_line:int>, reference_fix struct<start_line:int,end_line:int,replacement:string>"
    rows = [("f", "h", "t2-bug-v1", "f.B1", "off_by_one", "d", "t", ("p", 1, 2), (1, 1, "x")), ("f", "h", "t2-bug-v1", "g.B1", "odd", "d", "t", ("p", 3, 2), (0, 1, "x"))]
    out = [ids(c.broken(spark.createDataFrame([r], bug), F.col("func_id"), c.bug_rules())) for r in rows]
    assert out == [[], ["category_known", "fix_span", "id_prefix", "location_span"]]
    df = spark.createDataFrame([("f", "h", "t3-transform-v1", "f.TR1", " ", "t")], "func_id string, source_hash string, record_format string, transform_id string, instruction string, test_suite_ref string")
    assert ids(c.broken(df, F.col("func_id"), c.transform_rules())) == ["instruction_filled"]
    man = spark.createDataFrame([("f", "h", {"T1": (True, "x"), "T2": (False, None)}), ("g", "h", {"T9": (True, None)})], "func_id string, source_hash string, tasks map<string,struct<available:boolean,ground_truth_ref:string>>")
    assert ids(c.broken(man, F.col("func_id"), c.manifest_rules())) == ["tasks_known", "truth_iff_available"]
    other = spark.createDataFrame([("f", "x"), ("z", "h")], "func_id string, source_hash string")
    assert [r.func_id for r in c.unknown_units(other, man).collect()] == ["z"] and c.hash_mismatches(other, man).count() == 1


def test_candidate_rules(spark):
    schema = "candidate_id string, estimated_complexity string, stage1_result string, stage2_result string, stage3_result string, final_decision string, is_anchor boolean, stage2_t2_c1_screen_score double, stage2_t2_subscores map<string,int>, stage3_t3_c2_screen_score double"
    rows = [("x", "low", "PASS", "INCLUDE", "preferred", "INCLUDE", False, 2.0, {"fix": 1}, 0.5), ("y", "low", "PASS", "EXCLUDE", "preferred", "INCLUDE", True, None, {"fix": 1}, None), ("clamp", "low", "PASS", "EXCLUDE", "not_run", "INCLUDE", True, 3.0, {}, None)]
    out = c.broken(spark.createDataFrame(rows, schema), F.col("candidate_id"), c.candidate_rules())
    assert ids(out) == ["anchor_named", "stage2_score", "stage3_score"]


def test_resolvers(spark):
    row = spark.range(1)
    path = lambda u, cond, task: row.select(c.representation_path(F.lit(u), F.lit(cond), F.lit(task)).alias("p")).first().p
    assert path("clamp", "C1", "T2") == "data/ground_truth/bugs/clamp_buggy.py" and path("clamp", "C4", "T2") == "data/functions/ir/clamp_buggy.json"
    assert path("clamp", "C1", "T1") == "data/functions/raw/clamp.py" and path("clamp", "C1+", "T3") == "data/functions/annotated_text/clamp.py" and path("clamp", "C7", "T1") is None
    assert [r.t for r in spark.createDataFrame([("a.b.test_Empty_list",), ("a.edge.test_plain",)], "x string").select(c.tier(F.col("x")).alias("t")).collect()] == ["edge", "base"]
    fix = lambda fixes, ref, *rules: row.select(c.best_fix_line(F.array(*map(F.lit, fixes)), F.lit(ref), list(rules)).alias("f")).first().f
    assert fix(["# no", "y = 1", "x  =  2"], "x = 2") == "x  =  2" and fix(["# no", "y = 1"], "z") == "y = 1"
    assert fix(["y = 1", "if a > b:"], "z", (F.lit(True), "^if")) == "if a > b:"


def test_sampling():
    assert sampling.sample([]) == [[]] and sampling.sample(["builtins.dict[a, b]"]) is None
    rows = sampling.sample(["builtins.list[builtins.int]", "builtins.bool", "builtins.tuple[builtins.str, ...]"])
    assert len(rows) == 42 and rows[:2] == [[[], True, []], [[0], False, [""]]] and rows == sampling.sample(["builtins.list[builtins.int]", "builtins.bool", "builtins.tuple[builtins.str, ...]"])
    assert all(-25 <= x <= 25 for r in rows for x in r[0])
