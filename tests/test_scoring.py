"""Runs as a table, strict reads, rules, scores and refusals by hand."""

import json

import pytest
from pyspark.sql import functions as F

from trialframe.functions import text as t
from trialframe.operators import manifest, rules, stages, workflow
from trialframe.sources import runs


def test_runs(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "scorer-result-v1", "f", 1.0, "ok"), ("r1", "odd", "g", 1.0, "ok"), ("r2", "scorer-result-v1", "h", 0.0, "parse_failure"), ("r3", "scorer-result-v1", "i", 0.5, "ok")], "run_id string, record_format string, func_id string, score double, status string")
    runs.write_runs(rows, str(tmp_path / "runs"))
    (tmp_path / "runs/run_id=r1/broken.json").write_text('{"score": \nnot json\n')
    own = runs.scan_runs(spark, str(tmp_path / "runs"))
    one = runs.usable(own.where("run_id = 'r3'")).select("func_id", "score")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and [tuple(r) for r in one.collect()] == [("i", 0.5)]
    assert sorted(r.rule_id for r in runs.unusable(own).collect()) == ["corrupt", "corrupt", "tag"]
    assert [(r.key.split("/")[0], r.code) for r in runs.not_ok(own).collect()] == [("r2", "no failure_reason")]
    assert runs.strict(own.where("run_id = 'r3'")).count() == 1
    for run in ("r1", "r2"):
        with pytest.raises(ValueError, match="constraint broken"):
            runs.strict(own.where(F.col("run_id") == run))


def test_documents(spark, tmp_path):
    row = "candidate_id string, is_anchor boolean"
    good = tmp_path / "tracker.json"
    good.write_text(json.dumps({"record_format": runs.TRACKER_TAG, "candidates": [{"candidate_id": "a", "is_anchor": True}]}, indent=1))
    assert [tuple(r) for r in runs.load_tracker(spark, str(good), row).collect()] == [("a", True)]
    (tmp_path / "bad.json").write_text("{]")
    (tmp_path / "odd.json").write_text(json.dumps({"record_format": "other", "candidates": []}))
    for name in ("none.json", "bad.json", "odd.json"):
        with pytest.raises(ValueError, match="tracker"):
            runs.load_tracker(spark, str(tmp_path / name), row)
    assert runs.read_or_none(spark, str(tmp_path / "bad.json"), "a int") is None and runs.read_or_none(spark, str(tmp_path / "none.json"), "a int") is None
    (tmp_path / "analysis.json").write_text(json.dumps({"tests": [{"hypothesis": "H1", "task": "T1", "p": 0.1}, {"hypothesis": "H2", "task": "T1", "p": 0.2}]}))
    assert [r.p for r in runs.analysis_rows(spark, str(tmp_path / "analysis.json"), "hypothesis string, task string, p double", hypothesis="H2", task="T1").collect()] == [0.2]
    table = spark.createDataFrame([("a", "do it")], "unit string, instruction string")
    ask = lambda u: runs.looked_up(spark.createDataFrame([(u,)], "unit string"), table, "unit", "instruction", "instruction").collect()
    assert ask("a")[0].instruction == "do it"
    with pytest.raises(Exception, match="no instruction for b"):
        ask("b")
    rows = spark.createDataFrame([(1,)], "x int")
    runs.save_tracker(rows, rows.where("false"), str(tmp_path / "saved"))
    with pytest.raises(ValueError):
        runs.save_tracker(rows, rows, str(tmp_path / "saved"))
    assert spark.read.json(str(tmp_path / "saved")).count() == 1


def test_manifest_file(spark, tmp_path):
    item = {"func_id": "f", "source_hash": "h", "inclusion_status": "included", "dataset_tier": "full", "eligibility": {"non_recursive": "eligible", "single_function": "eligible"}, "artifacts": {"raw_source": "p", "annotated_text": None, "ast": None, "typed_ast": None, "ir": None}, "representations": {"C1": True, "C1+": False, "C2": False, "C3": False, "C4": False}, "tasks": {k: {"available": k == "T1", "ground_truth_ref": "q" if k == "T1" else None} for k in ("T1", "T2", "T3")}, "lineage": {k: None for k in manifest.LINEAGE}}
    path = tmp_path / "manifest.json"

    def load(**x):
        path.write_text(json.dumps({"record_format": manifest.TAG, "protocol_scope": "s", "items": [item]} | x, indent=1))
        return manifest.load_manifest(spark, str(path))

    assert manifest.manifest_item(load(), "f").count() == 1
    with pytest.raises(ValueError, match="no unit"):
        manifest.manifest_item(load(), "g")
    for wrong in ({"record_format": "x"}, {"protocol_scope": " "}, {"items": []}, {"items": [item, item]}, {"items": [item | {"dataset_tier": "odd"}]}, {"items": [item | {"lineage": {"raw_source_hash": "h"}}]}, {"items": [item | {"artifacts": item["artifacts"] | {"ir": " "}}]}):
        with pytest.raises(ValueError, match="constraint broken"):
            load(**wrong)


def test_fix_and_candidates(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    lit = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    fixes = F.array(F.struct(F.lit(0).alias("priority"), F.lit("fix_block").alias("kind"), F.lit("^for x").alias("pattern")))
    assert one(rules.fix_line(lit("y", "  for x in z:", "    a", "      b", "  c"), F.lit("q"), fixes)) == "      for x in z:\n        a\n          b"
    assert one(rules.fix_line(lit("# no", "y", "for x"), F.lit("q"), fixes)) == "y" and one(rules.fix_line(lit(), F.lit("q"), fixes)) is None and one(rules.fix_line(lit("# no"), F.lit("q"), F.lit(None).cast("array<struct<priority:int,kind:string,pattern:string>>"))) is None
    said = lambda s: one(t.code_candidate(F.lit(s), F.lit("f.x")))
    assert said("so def f.x(a):\n  return\ndef g(): 1") == "def f.x(a):\n  return" and said("def fzx(a): 1") is None
    assert one(workflow.sorted_json(F.create_map(F.lit("b"), F.lit(1), F.lit('a"'), F.lit(2)))) == '{"a\\"": 2, "b": 1}' and one(workflow.sorted_json(F.lit(None).cast("map<string,int>"))) is None
    names = spark.createDataFrame([("claude-x",), ("o1",), ("O1",), ("gpt4",), ("o4-m",), (None,)], "m string")
    assert [r.b for r in names.select(runs.backend(F.col("m")).alias("b")).collect()] == ["anthropic", "openai", None, None, "openai", None]


def test_stages(spark):
    """Refusals, anchors, a deferral that leaves the decision, and a second ingest that changes nothing."""
    rows = [("a", "PASS", "not_run", "not_run", "DEFER", False), ("b", "EXCLUDE", "not_run", "not_run", "EXCLUDE", False), ("clamp", "PASS", "not_run", "not_run", "INCLUDE", True), ("d", "PASS", "INCLUDE", "preferred", "INCLUDE", False)]
    cand = spark.createDataFrame(rows, "candidate_id string, stage1_result string, stage2_result string, stage3_result string, final_decision string, is_anchor boolean")
    ev = [("a", 0, 3, 0.5), ("a", 1, 2, 2.0), ("a", 2, 3, 1.0), ("a", 3, 2, 3.0), ("b", 0, 2, 1.0), ("clamp", 0, 3, 0.2), ("clamp", 1, 2, 3.0), ("d", 0, 2, 0.5), ("d", 1, 3, 0.1), ("x", 0, 2, 1.0), ("a", 4, 7, 1.0), ("a", 5, 2, None)]
    events = spark.createDataFrame(ev, "candidate_id string, pos long, stage int, score double")
    log = {(r.candidate_id, r.pos): (r.outcome, r.result) for r in stages.stage_log(cand, events).collect()}
    assert log == {("a", 0): ("not_included", None), ("a", 1): ("applied", "INCLUDE"), ("a", 2): ("applied", "ceiling_risk"), ("a", 3): ("already_run", None), ("b", 0): ("stage1_not_passed", None), ("clamp", 0): ("applied", "preferred"), ("clamp", 1): ("applied", "EXCLUDE"), ("d", 0): ("already_run", None), ("d", 1): ("already_run", None), ("x", 0): ("unknown_candidate", None), ("a", 4): ("unknown_stage", None), ("a", 5): ("no_score", None)}
    again = stages.stage_log(cand, events, overwrite=True)
    after = {r.candidate_id: (r.stage2_result, r.stage3_result, r.stage2_score, r.final_decision) for r in stages.apply_log(cand, again).collect()}
    assert after == {"a": ("EXCLUDE", "ceiling_risk", 3.0, "EXCLUDE"), "b": ("not_run", "not_run", None, "EXCLUDE"), "clamp": ("EXCLUDE", "preferred", 3.0, "INCLUDE"), "d": ("DEFER", "preferred", 0.5, "INCLUDE")}
    files = spark.createDataFrame([("a_T2_C1_m.json", "ok", 2.5), ("clamp_T2_C1_m.json", "parse_failure", 0.0)], "file string, status string, score double")
    once, log = stages.ingest(cand, files, 2, F.lit("m"))
    twice, second = stages.ingest(once, files, 2, F.lit("m"))
    assert {r.candidate_id: r.outcome for r in log.collect()} == {"a": "hit", "clamp": "scorer_failed", "d": "skip"} and {r.candidate_id: r.outcome for r in second.collect()} == {"a": "skip", "clamp": "scorer_failed", "d": "skip"}
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    table, new = stages.seed(cand, cand.where("candidate_id = 'a'").unionByName(cand.where("candidate_id = 'a'").withColumn("candidate_id", F.lit("n"))))
    assert table.count() == 5 and [r.candidate_id for r in new.collect()] == ["n"]


def test_stage_stream(spark, tmp_path):
    """A stream in three starts says what the batch says, with far fewer states than candidates; odd rows are refused and not lost."""
    size = F.col("id") % 7
    cand = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("candidate_id"), F.when(size == 0, "EXCLUDE").when(size > 1, "PASS").alias("stage1_result"), F.when(F.col("id") % 5 == 0, "INCLUDE").otherwise("not_run").alias("stage2_result"), F.when(F.col("id") % 11 == 0, "other").otherwise("not_run").alias("stage3_result"), F.lit("DEFER").alias("final_decision"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("is_anchor"))
    h = F.xxhash64("id")
    name = F.when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3300))
    events = spark.range(16_500).select(name.alias("candidate_id"), F.when(F.col("id") % 97 == 0, F.col("id")).otherwise((F.col("id") / 3300).cast("long")).alias("pos"), F.when(h % 13 == 0, None).otherwise(2 + F.abs(h % 5) % 3).alias("stage"), F.when(h % 17 == 0, None).otherwise(F.abs(h % 9) / 2).alias("score"))
    stored = events.localCheckpoint()
    states, at = [], f"{tmp_path}"
    for when in ("pos < 2", "pos = 2", "pos > 2"):
        stored.where(when).repartition(3).write.mode("append").parquet(f"{at}/in")
        out = stages.stage_stream(cand, spark.readStream.schema(stored.schema).parquet(f"{at}/in"), 8)
        run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = lambda df: sorted(map(str, df.select("candidate_id", "pos", F.col("stage").cast("long").alias("stage"), F.col("score").cast("double").alias("score"), "outcome", "result").collect()))
    got = spark.read.parquet(f"{at}/out")
    assert rows(got) == rows(stages.stage_log(cand, stored)) and max(states) <= 9
    assert {r.outcome for r in got.select("outcome").distinct().collect()} == set(stages.OUTCOMES)


def test_stage_stream_odd_rows(spark, tmp_path):
    """Large ids beside one that is null, a score that is no number, results that are null as if not run."""
    big = 2**53 + 1
    cand = spark.createDataFrame([(big, "PASS", None, None, "DEFER", None)], "candidate_id long, stage1_result string, stage2_result string, stage3_result string, final_decision string, is_anchor boolean")
    ev = [(big, 0, 2, float("nan")), (big, 2, 2, 1.0), (big, 1, 3, 1.0), (big, 3, 3, 0.5), (big, 4, 2, 3.0), (None, 0, 2, 1.0), (big + 1, 0, 2, 1.0)]
    spark.createDataFrame(ev, "candidate_id long, pos int, stage int, score double").write.parquet(f"{tmp_path}/in")
    out = stages.stage_stream(cand, spark.readStream.schema("candidate_id long, pos int, stage int, score double").parquet(f"{tmp_path}/in"), 1)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.candidate_id, r.pos): (r.outcome, r.result) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(big, 0): ("no_score", None), (big, 1): ("not_included", None), (big, 2): ("applied", "INCLUDE"), (big, 3): ("applied", "preferred"), (big, 4): ("already_run", None), (None, 0): ("unknown_candidate", None), (big + 1, 0): ("unknown_candidate", None)}


def test_run_report(spark):
    """Counts of any length, statuses, the places where a summary is looked for, cut lists."""
    texts = [
        None, "", "# A\n#b", "Summary: one. two? three! four.", "**Summary**\n\n", "12345678901234567890 passed", "1 passed, 0 failed", "2 failed", "unable to go",
        "".join(f"Created f{i}/a.py\n" for i in range(30)) + "`no dot` `two.dots.py` `x y.py` `x/y.tar.gz`", "Issue: a\nissue: a\nBug: " + "z" * 200 + "\nTODO: t\n[BLOCKING] b", "cannot proceed, because: of it\nBLOCKER: that",
    ]
    r = [x.r for x in spark.createDataFrame(list(enumerate(texts)), "n int, s string").orderBy("n").select(t.run_report(F.col("s")).alias("r")).collect()]
    assert [x.summary for x in r[:5]] == ["No summary available."] * 3 + ["one. two? three!", "**Summary**"]
    assert r[5].status == "success" and (r[6].tests_run, r[6].passed, r[6].failed, r[6].status) == (1, 1, 0, "success") and (r[7].tests_run, r[7].passed, r[7].status) == (2, None, "partial") and r[8].status == "partial"
    assert r[9].files == [f"f{i}/a.py" for i in range(20)] and r[10].issues == ["a".replace("a", "t"), "b", "a", "z" * 120] and r[10].blocker == "b" and r[11].blocker == "of it" and r[11].status == "partial"


def test_structure_and_edits(spark):
    from trialframe.functions import kernels

    rows = [("def f(a):\n  'd'\n", "@x\ndef f(a) -> int:\n    pass", "f"), ("def f(a): return 1", "def f(a): return 2", "f"), ("x(", "def f(): 1", "f"), (None, "def f(): 1", "f"), ("class C:\n  def f(self): 1", "def f(self): 1", "f")]
    got = [tuple(r.s) for r in spark.createDataFrame(rows, "a string, b string, n string").select(kernels.structure_column()(F.col("a"), F.col("b"), F.col("n")).alias("s")).collect()]
    assert got[0] == ("ok", True, 1.0) and got[1][:2] == ("ok", False) and 0.9 < got[1][2] < 1 and got[2] == got[3] == ("not_applicable", None, None) and got[4] == ("ok", True, 1.0)
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError, match="exists"):
        workflow.add_rows(table, table, "k")
    with pytest.raises(ValueError, match="missing"):
        workflow.update_rows(table, spark.createDataFrame([("z", 1)], "k string, v int"), "k")
    assert sorted(map(tuple, workflow.update_rows(table, spark.createDataFrame([("a", None), ("b", 5)], "k string, v int"), "k").collect())) == [("a", 1), ("b", 5)]
    assert workflow.listed(table, k="b").count() == 1
    errors = [r.e for r in spark.createDataFrame([('{"preconditions": ["a \\"q\\""], "postconditions": ["é, b"], "invariants": [ ]}',), ("[1]",), ('{"preconditions": [null], "postconditions": {}, "invariants": []}',), (None,)], "s string").select(t.contract_errors(F.col("s")).alias("e")).collect()]
    assert errors[0] == [] and errors[1] == ["response is not a JSON object"] and errors[2] == ["'preconditions' contains non-string items", "'postconditions' is not a JSON array"] and errors[3] == ["response is not a JSON object"]


def test_result_files(spark, tmp_path):
    """Columns in their order, undefined numbers as the files have them."""
    from trialframe.operators import stats
    from trialframe.plans import scoring_queries
    from trialframe.sources import sinks

    diffs = spark.createDataFrame([("H1", "T1", "m", float(x)) for x in (1, 2, -1, 3)] + [("H1", "T2", "m", 0.0)], "hypothesis string, task string, model_id string, d double")
    hyp = spark.createDataFrame([("H1", "A", "B")], "hypothesis string, cond_a string, cond_b string")
    sinks.write_confirmatory(stats.decisions(stats.signed_rank_tests(diffs, ["hypothesis", "task"]), hyp), str(tmp_path / "c"))
    lines = next((tmp_path / "c").glob("part-*")).read_text().splitlines()
    assert lines[0] == ",".join(sinks.CONFIRMATORY) and lines[1].startswith("H1,T1,A,B,4,8.5,0.1875,0.7,false,") and lines[2] == "H1,T2,A,B,1,nan,nan,0.0,false,Insufficient data"
    rows = stats.exploratory(diffs, ["hypothesis", "task", "model_id"], hyp)
    sinks.write_exploratory(rows, str(tmp_path / "e"))
    lines = next((tmp_path / "e").glob("part-*")).read_text().splitlines()
    assert lines[0] == ",".join(sinks.EXPLORATORY) and lines[2].endswith(",insufficient_data") and len(lines) == 3
    shown = [r.line for r in sinks.exploratory_lines(rows).collect()]
    assert shown[0].startswith("H1   T1    A     B     m                    4   3   1   0    1.500     8.500   0.375   0.750   0.700     nan     nan ok") and "insufficient_data" in shown[1]
    export = scoring_queries.QUERIES["export_table"](spark, "/root/testdata/sf0.001")
    assert tuple(export.columns) == sinks.EXPORT and len(sinks.EXPORT) == 26
    sinks.write_run(export.select("item_id"), export.where("missing_expected_artifacts_json <> '[]'").select("item_id"), export, str(tmp_path / "run"))
    assert spark.read.option("header", True).csv(str(tmp_path / "run/export")).count() == spark.read.parquet(str(tmp_path / "run/index")).count() == 200


def test_dealt(spark, monkeypatch):
    """Costly work on the rows of one packed file is dealt out by their number, with the same rows."""
    from places import SF

    from trialframe.plans import registry
    from trialframe.sources import scratch

    for name in ("structural_similarity", "contract_shapes"):
        run = lambda: registry.queries()[name](spark, SF)  # noqa: B023, E731
        want = sorted(map(str, run().collect()))
        monkeypatch.setattr(scratch.dealt, "__defaults__", (30,))
        assert run().rdd.getNumPartitions() > 1 and sorted(map(str, run().collect())) == want


@pytest.mark.parametrize("name", ["stage_log", "stage_log_overwriting", "manifest_lineage", "manifest_references", "scorer_input_lookup"])
def test_packed_tables_are_merged(spark, name):
    """No table is broadcast by the size of its packed file."""
    from places import SF

    from trialframe.plans import registry

    assert "BroadcastExchange" not in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_where_they_are(spark):
    """Rules go to the texts: no text is shuffled by its unit."""
    from places import SF

    from trialframe.plans import registry

    assert "SortMergeJoin" not in registry.queries()["rule_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
