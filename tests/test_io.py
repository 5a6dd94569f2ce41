"""Readers, writers, constraints, trees and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trialframe.operators import stats, trees, workflow
from trialframe.sources import scores, sinks
from trialframe.streaming import events as ev


def record(path, **more):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"record_format": scores.SCORE_TAG, "func_id": "f", "task": "T1", "condition": "C1", "model_id": "m", "score": 0.5, "status": "ok"} | more))


def test_score_scan(spark, tmp_path):
    record(tmp_path / "r1/scores/score_0001.json")
    record(tmp_path / "r2/scores/score_0001.json", score=1.0)
    record(tmp_path / "r2/scores/score_0002.json", record_format="other")
    (tmp_path / "r2/scores/score_0003.json").write_text("{broken")
    rows = scores.scan_scores(spark, str(tmp_path))
    assert sorted((r.run_id, r.score) for r in rows.collect()) == [("r1", 0.5), ("r2", 1.0)]
    assert stats.last_wins(rows, ["func_id", "task"], ["run_id", "file"]).first().score == 1.0
    assert scores.scan_scores(spark, str(tmp_path), ["r1"]).count() == 1
    record(tmp_path / "r4/scores/score_0001.json", record_format=None, other_tag=scores.SCORE_TAG)
    assert scores.scan_scores(spark, str(tmp_path), ["r4"], tag_field="other_tag").first().record_format == scores.SCORE_TAG
    with pytest.raises(Exception):
        scores.scan_scores_strict(spark, str(tmp_path)).collect()
    assert scores.for_task(rows, "T1", ["m"]).count() == 2 and scores.for_task(rows, "T2").count() == 0


def test_paths_and_texts(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    assert [(r.name, r.text) for r in scores.scan_texts(spark, f"{tmp_path}/*.py").collect()] == [("a", "x = 1\ny = 2\n")]
    assert scores.repo_path("/r", "a/./b") == "/r/a/b"
    for bad in ("/x", "a/../b", ""):
        with pytest.raises(ValueError):
            scores.repo_path("/r", bad)
    assert scores.read_if_exists(spark, f"{tmp_path}/none", "a int").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, {"a": 1}), ("r2", 2, {})], "run_id string, x int, m map<string,int>")
    sinks.write_artifacts(df, f"{tmp_path}/art")
    assert spark.read.json(f"{tmp_path}/art").where("run_id = 'r1'").count() == 1
    sinks.write_ledger(df, f"{tmp_path}/led")
    sinks.write_ledger(df.limit(1), f"{tmp_path}/led")
    assert spark.read.parquet(f"{tmp_path}/led").count() == 1
    sinks.write_csv(df, f"{tmp_path}/csv", ["x", "m"], single=True)
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/csv", header=True, escape="\\").collect())[0][0] == "1"
    row = spark.createDataFrame([(float("nan"), 1 / 3)], "a double, b double").select(sinks.nan_text(F.col("a")), sinks.nan_null(F.col("a")), sinks.nan_null(F.col("b")), sinks.null_nan(F.lit(None).cast("double"))).first()
    assert row[0] == "nan" and row[1] is None and row[2] == 0.333333 and math.isnan(row[3])


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    broken = workflow.violations(df, F.col("k"), [("has_s", F.col("s").isNotNull()), ("small", F.col("k") < 2), ("null_test", F.col("s") == "a")])
    assert sorted((r.key, r.rule_id) for r in broken.collect()) == [("2", "has_s"), ("2", "null_test"), ("2", "small")]
    with pytest.raises(ValueError):
        workflow.demand_none(broken)
    workflow.demand_none(broken.where("false"))
    assert workflow.duplicate_keys(df.unionAll(df), ["k"]).count() == 2


def test_trees(spark):
    df = spark.createDataFrame([("a", "def f(n):\n    return f(n - 1)\n"), ("b", "def g():\n    return 1\n"), ("c", "def (")], "t string, s string")
    nodes = trees.parse(df, "t", "s")
    assert {r.tree_id: r.recursive for r in trees.direct_recursion(nodes).collect()} == {"a": True, "b": False}
    own = nodes.where("tree_id = 'a'")
    again = {r.node_id: r.d2 for r in trees.depths(own.withColumnRenamed("depth", "was"), 4).withColumnRenamed("depth", "d2").collect()}
    assert all(again[r.node_id] == r.depth for r in own.collect())
    assert trees.smallest_covering(spark.createDataFrame([("a", 2)], "tree_id string, line int"), own).count() == 1
    assert [r.x for r in df.select(trees.normal_source()("s").alias("x")).collect()][1:] == ["def g():\n    return 1", None]


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    src.repartition(3).write.parquet(f"{tmp_path}/in")

    def run(df, mode):
        name = f"t{abs(hash((str(tmp_path), mode))) % 10**8}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, run(ev.tumbling(stream, "1 hour"), "complete").select("start", "event_type", "n").collect()))
    assert got == sorted(map(tuple, ev.tumbling(src, "1 hour").select("start", "event_type", "n").collect()))
    last = {}
    for r in run(ev.running_totals(stream), "update").collect():
        if r.n >= last.get(r.user_id, (0,))[0]:
            last[r.user_id] = (r.n, round(r.mean, 9), round(r.var_pop, 6))
    want = src.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect()
    assert last == {r.user_id: (r.n, round(r.m, 9), round(r.v, 6)) for r in want}
    again = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    assert run(ev.without_repeats(again.unionByName(again), "1 hour").select("event_id"), "append").count() == 300


def test_summary_lines(spark):
    df = spark.createDataFrame([("H2", "T1", 30, 80.5, -0.5), ("H1", "T1", 3, 6.0, 1.0)], "hypothesis string, task string, n_pairs int, w_plus double, r_rb double")
    assert [r.line for r in sinks.summary_lines(df).collect()] == ["H1   T1   n=  3  W=     6.0  r=+1.000", "H2   T1   n= 30  W=    80.5  r=-0.500"]


def test_trees_of_any_depth(spark):
    from trialframe.operators import trees

    chain = spark.createDataFrame([("t", k, k - 1 if k else None) for k in range(20)], "tree_id string, node_id long, parent_id long")
    assert {r.node_id: r.depth for r in trees.depths(chain, 2).collect()} == {k: k for k in range(20)}
    pairs = spark.createDataFrame([("t", 0, 19), ("t", 3, 18)], "tree_id string, a long, b long")
    assert {(r.a, r.b): r.distance for r in trees.tree_distance(pairs, chain, 2).collect()} == {(0, 19): 19, (3, 18): 15}
