"""Queries of planning, ledger, tracker, constraints and event-time windows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators import constraints as rows_rules
from trialframe.operators import manifest as mf
from trialframe.operators import workflow as wf
from trialframe.plans.trials import HYPOTHESES, ORDER, hypotheses, scores, trials
from trialframe.plans.trials import _SCORES, _TRIALS
from trialframe.sources.scratch import stored
from trialframe.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TASKS, CONDITIONS, MODELS = ("A", "N", "R"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ("F", "O")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _plan(spark, d) -> DataFrame:
    units = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal >= 0")
    plan = wf.plan_items(units, "s_suppkey", TASKS, CONDITIONS, MODELS)
    able = units.where("s_nationkey < 13").select(F.col("s_suppkey").alias("unit_id"))
    return plan.where("task <> 'R'").unionByName(plan.where("task = 'R'").join(able, "unit_id", "left_semi"))


def _values(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({i}, {chr(39)}{v}{chr(39)})' for i, v in enumerate(values))}) {name}(o{name}, {name})"


_PLAN = f"""plan AS (SELECT s_suppkey AS unit_id, t AS task, c AS condition, m AS model_id, (ot * 5 + oc) * 2 + om AS place, s_suppkey || '::' || t || '::' || c || '::' || m AS item_id
 FROM supplier, {_values('t', TASKS)}, {_values('c', CONDITIONS)}, {_values('m', MODELS)} WHERE s_acctbal >= 0 AND (t <> 'R' OR s_nationkey < 13))"""


@query(f"WITH {_PLAN} SELECT unit_id, task, condition, model_id, place::BIGINT AS place, item_id FROM plan")
def plan_items(spark, d):
    return _plan(spark, d)


@query(f"WITH {_PLAN} SELECT model_id, task, item_id FROM (SELECT *, row_number() OVER (PARTITION BY model_id, task ORDER BY unit_id, place) AS n FROM plan) WHERE n = 1")
def smoke_items(spark, d):
    return wf.smoke_items(_plan(spark, d))


@query(f"WITH {_PLAN}, f AS (SELECT unit_id FROM plan ORDER BY CASE WHEN unit_id % 10 = 3 THEN 0 ELSE 1 END, unit_id LIMIT 1) SELECT item_id FROM plan WHERE unit_id = (SELECT unit_id FROM f) AND model_id = 'F'")
def preflight_items(spark, d):
    return wf.preflight_items(_plan(spark, d), F.when(F.col("unit_id") % 10 == 3, 0).otherwise(1)).select("item_id")


# the ledger: the last attempt of each cell, its state from the order
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'error' END"
_LEDGER = f"""ledger AS (SELECT l_suppkey || '::' || l_returnflag || '::' || o_orderpriority || '::' || l_linestatus AS item_id, {_STATE} AS status, count(*) OVER w AS attempt_count, l_quantity AS score,
 row_number() OVER (w ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_returnflag = 'R' AND o_orderpriority LIKE '5%') WINDOW w AS (PARTITION BY l_suppkey, l_returnflag, o_orderpriority, l_linestatus)),
 last AS (SELECT item_id, CASE WHEN status = 'error' THEN 'failed' ELSE status END AS status, attempt_count, score FROM ledger WHERE rn = 1),
 merged AS (SELECT plan.*, coalesce(status, 'planned') AS status, coalesce(attempt_count, 0) AS attempt_count, score FROM plan LEFT JOIN last USING (item_id)),
 fixed AS (SELECT *, CASE WHEN status = 'running' THEN 'interrupted' WHEN status = 'completed' AND score < 10 THEN 'missing_artifact' END AS error,
  CASE WHEN status = 'running' OR (status = 'completed' AND score < 10) THEN 'failed' ELSE status END AS state FROM merged)"""


def _ledger(spark, d) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("NOT (l_returnflag = 'R' AND o_orderpriority LIKE '5%')")
    rows = rows.withColumn("item_id", F.concat_ws("::", F.col("l_suppkey").cast("string"), "l_returnflag", "o_orderpriority", "l_linestatus"))
    last = F.max_by(F.struct(status.alias("status"), F.col("l_quantity").alias("score")), F.struct(*ORDER)).alias("r")
    held = rows.groupBy("item_id").agg(last, F.count("*").alias("attempt_count"))
    return held.select("item_id", wf.normal_status(F.col("r.status")).alias("status"), "attempt_count", F.col("r.score").alias("score"))


def _merged(spark, d) -> DataFrame:
    return wf.merge_ledger(_plan(spark, d), _ledger(spark, d))


def _repaired(spark, d) -> DataFrame:
    return wf.repair(_merged(spark, d), F.col("score") >= 10)


@query(f"WITH {_PLAN}, {_LEDGER} SELECT item_id, status, attempt_count, score FROM merged")
def merge_ledger(spark, d):
    return _merged(spark, d).select("item_id", "status", "attempt_count", "score")


@query(f"WITH {_PLAN}, {_LEDGER} SELECT item_id, state AS status, error FROM fixed")
def integrity_repair(spark, d):
    return _repaired(spark, d).select("item_id", "status", "error")


@query(f"WITH {_PLAN}, {_LEDGER} SELECT task, {', '.join(f'count(*) FILTER (state = {chr(39)}{s}{chr(39)}) AS {s}' for s in wf.STATUSES)}, count(*) FILTER (state <> 'planned') AS started, count(*) AS total FROM fixed GROUP BY ALL")
def ledger_counts(spark, d):
    return wf.status_summary(_repaired(spark, d), ["task"])


@query(f"WITH {_PLAN}, {_LEDGER} SELECT item_id, state <> 'completed' AS resume, state = 'planned' AS skip, true AS overwrite FROM fixed")
def run_modes(spark, d):
    return _repaired(spark, d).select("item_id", *(wf.should_run(F.col("status"), m).alias(m) for m in ("resume", "skip", "overwrite")))


@query(f"WITH {_PLAN}, {_LEDGER} SELECT item_id, list_aggregate(list_filter(['prompt', CASE WHEN attempt_count = 0 THEN 'response' END, CASE WHEN score IS NULL THEN 'score' END], lambda x: x IS NOT NULL AND x <> 'prompt'), 'string_agg', ',') AS missing FROM merged WHERE score IS NULL")
def run_audit(spark, d):
    missing = F.array_compact(F.array(F.when(F.col("attempt_count") == 0, "response"), F.when(F.col("score").isNull(), "score")))
    return _merged(spark, d).withColumn("m", missing).where(F.size("m") > 0).select("item_id", F.array_join("m", ",").alias("missing"))


@query(f"""WITH {_PLAN}, {_LEDGER} SELECT item_id, replace(unit_id || '_' || task || '_' || condition || '_' || model_id, '+', 'plus') AS slug, state AS status, attempt_count, CASE WHEN error IS NULL THEN NULL ELSE '{{"code":"' || error || '"}}' END AS failure FROM fixed""")
def export_rows(spark, d):
    failure = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.col("error").alias("code"))))
    return _repaired(spark, d).select("item_id", wf.slug(F.col("unit_id").cast("string"), F.col("task"), F.col("condition"), F.col("model_id")).alias("slug"), "status", "attempt_count", failure.alias("failure"))


@query(f"WITH {_PLAN} SELECT item_id FROM plan WHERE task = 'R' AND condition = '5-LOW'")
def plan_difference(spark, d):
    a = _plan(spark, d).select("item_id", "task", "condition")
    return wf.same_plan(a.select("item_id"), a.where("task <> 'R' OR condition <> '5-LOW'").select("item_id"))


@query("SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY ALL")
def first_seen(spark, d):
    return wf.first_seen(spark.read.parquet(f"{d}/events.parquet"), "event_type", "event_id")


@query("SELECT coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END, 'missing') AS key, count(*) AS n FROM part GROUP BY ALL")
def count_by(spark, d):
    return wf.count_by(spark.read.parquet(f"{d}/part.parquet"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")))


@query("SELECT p_partkey, replace(replace(p_brand || '/' || p_size || ':x', '/', '_'), ':', '_') AS slug FROM part")
def model_slugs(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", wf.model_slug(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"), F.lit(":x"))).alias("slug"))


# the tracker: a candidate for each part
_CAND = """cand AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 5 END AS s2, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size % 4) / 2.0 END AS s3, p_partkey % 50 = 1 AS anchor, p_retailprice > 1000 AS ready FROM part),
 dec AS (SELECT *, CASE WHEN anchor THEN 'INCLUDE' WHEN s2 IS NULL THEN NULL WHEN s2 >= 3 THEN 'EXCLUDE' WHEN s2 >= 1 THEN 'INCLUDE' ELSE 'DEFER' END AS final FROM cand),
 st AS (SELECT *, CASE WHEN anchor THEN 'anchor' WHEN final = 'EXCLUDE' THEN 'excluded' WHEN s2 IS NULL AND NOT ready THEN 'awaiting_material' WHEN s2 IS NULL THEN 'ready_for_stage2' WHEN s3 IS NULL AND final = 'INCLUDE' THEN 'ready_for_stage3' WHEN final = 'INCLUDE' THEN 'included' ELSE 'deferred' END AS state FROM dec)"""


def _candidates(spark, d) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size")
    own = p.select("p_partkey", F.when(size % 4 != 0, size % 5).alias("s2"), F.when(size % 3 != 0, (size % 4) / 2.0).alias("s3"), (F.col("p_partkey") % 50 == 1).alias("anchor"), (F.col("p_retailprice") > 1000).alias("ready"))
    final = F.when(F.col("anchor"), "INCLUDE").when(F.col("s2").isNotNull(), wf.score_band(F.col("s2")))
    own = own.withColumn("final", final)
    return own.withColumn("state", wf.workflow_state(F.col("final"), F.col("s2"), F.col("ready"), F.col("s3"), F.col("anchor")))


@query(f"WITH {_CAND} SELECT p_partkey, final, CASE WHEN s3 >= 1 THEN 'ceiling_risk' WHEN s3 IS NOT NULL THEN 'preferred' END AS band, state FROM st")
def tracker_states(spark, d):
    return _candidates(spark, d).select("p_partkey", "final", F.when(F.col("s3").isNotNull(), wf.ceiling_band(F.col("s3"))).alias("band"), "state")


@query(f"WITH {_CAND} SELECT state, count(*) AS n FROM st GROUP BY ALL UNION ALL SELECT s, 0 FROM (VALUES ('anchor'), ('excluded'), ('awaiting_material'), ('ready_for_stage2'), ('ready_for_stage3'), ('included'), ('deferred')) v(s) WHERE s NOT IN (SELECT state FROM st)")
def workflow_summary(spark, d):
    counts = _candidates(spark, d).groupBy("state").agg(F.count("*").alias("n"))
    states = spark.sql("SELECT explode(array('anchor', 'excluded', 'awaiting_material', 'ready_for_stage2', 'ready_for_stage3', 'included', 'deferred')) AS state")
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_CAND} SELECT final, anchor, count(*) AS n, count(s2) AS n_stage2, count(s3) AS n_stage3 FROM st GROUP BY GROUPING SETS ((final, anchor), (final), ())")
def tracker_summary(spark, d):
    own = _candidates(spark, d)
    out = own.groupingSets([[F.col("final"), F.col("anchor")], [F.col("final")], []], "final", "anchor").agg(F.count("*").alias("n"), F.count("s2").alias("n_stage2"), F.count("s3").alias("n_stage3"))
    return out.select("final", "anchor", "n", "n_stage2", "n_stage3")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, 0.0 FROM supplier WHERE s_suppkey % 10 = 0")
def upsert_rows(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
    changed = s.where("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(0.0))
    new = s.where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_name", F.lit(0.0).alias("s_acctbal"))
    return wf.upsert(s, changed.unionByName(new), "s_suppkey")


@query(f"WITH {_PLAN}, c AS (SELECT DISTINCT unit_id FROM plan WHERE task = 'R') SELECT p_partkey, CASE WHEN s_suppkey IS NULL THEN 'unknown_unit' WHEN c.unit_id IS NULL THEN 'task_missing' ELSE 'ready' END AS readiness FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 120 LEFT JOIN c ON c.unit_id = s_suppkey")
def stage_readiness(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 120).alias("unit_id"))
    known = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("unit_id"), F.lit(True).alias("known"))
    having = _plan(spark, d).where("task = 'R'").select("unit_id").distinct().withColumn("has", F.lit(True))
    return parts.join(known, "unit_id", "left").join(having, "unit_id", "left").select("p_partkey", F.when(F.col("known").isNull(), "unknown_unit").when(F.col("has").isNull(), "task_missing").otherwise("ready").alias("readiness"))


@query("""SELECT 'price_positive' AS rule_id, p_partkey::VARCHAR AS key FROM part WHERE NOT coalesce(p_retailprice > 1100, false) UNION ALL SELECT 'small_needs_brand', p_partkey::VARCHAR FROM part WHERE NOT (p_size >= 10 OR p_brand IN ('Brand#11', 'Brand#12'))
 UNION ALL SELECT 'name_not_empty', p_partkey::VARCHAR FROM part WHERE NOT coalesce(length(trim(p_name)) > 0, false)""")
def constraint_violations(spark, d):
    rules = [("price_positive", F.col("p_retailprice") > 1100), ("small_needs_brand", (F.col("p_size") >= 10) | F.col("p_brand").isin("Brand#11", "Brand#12")), ("name_not_empty", F.length(F.trim("p_name")) > 0)]
    return wf.violations(spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey"), rules).select("rule_id", "key")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return wf.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {_SCORES}, h(hypothesis, cond_a, cond_b) AS (VALUES {', '.join(map(str, HYPOTHESES))}, ('H9', 'none', '5-LOW')) SELECT hypothesis, task, model_id, count(score) AS n FROM h CROSS JOIN (SELECT DISTINCT task FROM scores) t CROSS JOIN (SELECT DISTINCT model_id FROM scores) m LEFT JOIN scores USING (task, model_id) WHERE condition = cond_a GROUP BY ALL UNION ALL SELECT 'H9', task, model_id, 0 FROM (SELECT DISTINCT task FROM scores) CROSS JOIN (SELECT DISTINCT model_id FROM scores)")
def hypothesis_grid(spark, d):
    """Every hypothesis with every task and model; combinations without a score count 0."""
    # a few rows, written as the grid is made of them, too
    held = stored(scores(spark, d).groupBy("task", "model_id", "condition").agg(F.count("score").alias("n")), "held")
    asked = hypotheses(spark, [*HYPOTHESES, ("H9", "none", "5-LOW")])
    # hypotheses, tasks and models are few by the study's design
    grid = asked.crossJoin(F.broadcast(held.select("task").distinct())).crossJoin(F.broadcast(held.select("model_id").distinct()))
    met = grid.join(held.withColumnRenamed("condition", "cond_a"), ["task", "model_id", "cond_a"], "left")
    return met.select("hypothesis", "task", "model_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_TRIALS} SELECT unit_id, model_id, min(l_orderkey) AS first_order FROM trials WHERE status = 'parse_failure' AND unit_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL")
def model_membership(spark, d):
    rich = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("unit_id"))
    return trials(spark, d).where("status = 'parse_failure'").join(rich, "unit_id", "left_semi").groupBy("unit_id", "model_id").agg(F.min("l_orderkey").alias("first_order"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


# -- event time, as batch: the same plans run over streams ---------------------------------------
@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return ev.tumbling(spark.read.parquet(f"{d}/events.parquet"), "1 hour").select(_stamp("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 4) r(k) GROUP BY ALL")
def sliding_window(spark, d):
    return ev.tumbling(spark.read.parquet(f"{d}/events.parquet"), "1 hour", "15 minutes").select(_stamp("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM s GROUP BY user_id, s.s""")
def session_windows(spark, d):
    return ev.sessions(spark.read.parquet(f"{d}/events.parquet"), "6 hours").select("user_id", _stamp("start"), _stamp("end"), "n")


@query("SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM events GROUP BY ALL")
def event_dedup(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(f"WITH {_PLAN} SELECT task, count(DISTINCT unit_id) AS n_units, count(*) AS n_items FROM plan GROUP BY ALL")
def manifest_task_counts(spark, d):
    return _plan(spark, d).groupBy("task").agg(F.count_distinct("unit_id").alias("n_units"), F.count("*").alias("n_items"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(name, 'empty|edge|boundary|single|zero|negative|large|huge|big|unicode|overflow|invalid|raise|error|exception|duplicate|dup|unsorted|precondition|out_of_range|nan|inf|deep|nested|wide|stress|tie|reverse|alternating|identity|idempot|acronym|min|max|one_element|two_element') THEN 'edge' ELSE 'base' END AS tier FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'test_empty_' || o_orderkey WHEN 1 THEN 'test_plain' ELSE lower(o_orderpriority) END AS name FROM orders)")
def tier_of_tests(spark, d):
    from trialframe.operators.constraints import tier

    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("edge.Suite.Test_Empty_"), F.col("o_orderkey").cast("string"))).when(k == 1, "max.test_plain").otherwise(F.col("o_orderpriority"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", tier(name).alias("tier"))


@query("SELECT p_partkey, 'data/functions/' || CASE p_size % 3 WHEN 0 THEN 'ast/u' || p_partkey || '.json' WHEN 1 THEN 'annotated_text/u' || p_partkey || '_buggy.py' ELSE 'raw/u' || p_partkey || '.py' END AS path FROM part")
def representation_paths(spark, d):
    from trialframe.operators.constraints import representation_path

    k = F.col("p_size") % 3
    condition = F.when(k == 0, "C2").when(k == 1, "C1+").otherwise("C1")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", representation_path(F.concat(F.lit("u"), F.col("p_partkey").cast("string")), condition, F.when(k == 1, "T2").otherwise("T1")).alias("path"))


# -- the manifest: a unit for each part; what is wrong follows from sizes and prices ----------------
def _manifest(spark, d) -> dict[str, DataFrame]:
    p = spark.read.parquet(f"{d}/part.parquet")
    size, unit = F.col("p_size"), F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    own = F.sha2(F.col("p_name"), 256)
    stored = F.when(size % 11 == 0, "wrong").otherwise(own)
    path = lambda what: F.concat(F.lit(f"{what}/"), unit)
    m = lambda **x: F.map_from_arrays(F.array(*(F.lit(k.replace("1p", "1+")) for k in x)), F.array(*x.values()))
    typed = size % 3 != 0
    task = lambda able, ref: F.struct(able.alias("available"), ref.alias("ground_truth_ref"))
    none = F.lit(None).cast("string")
    can = lambda bad, word: F.when(bad, word).otherwise("eligible")
    items = p.select(
        unit.alias("func_id"), stored.alias("source_hash"), F.when(size == 50, "odd").when(size % 4 < 2, "included").when(size % 4 == 2, "excluded").otherwise("deferred").alias("inclusion_status"), F.when(size < 10, "pilot").otherwise("full").alias("dataset_tier"),
        F.struct(can(size % 5 == 0, "ineligible").alias("non_recursive"), can(size % 6 == 0, "unknown").alias("single_function")).alias("eligibility"),
        m(raw_source=path("raw"), annotated_text=F.when(size % 2 == 0, path("annotated")), ast=path("ast"), typed_ast=F.when(typed, path("typed")), ir=F.when(typed, path("ir"))).alias("artifacts"),
        m(C1=F.lit(True), C1p=(size % 2 == 0) | (size % 13 == 0), C2=F.lit(True), C3=typed, C4=typed).alias("representations"),
        m(T1=task(F.lit(True), path("t1")), T2=task((size % 2 == 0) | (size % 17 == 0), F.when(size % 2 == 0, path("t2"))), T3=task(F.lit(False), none)).alias("tasks"),
        m(raw_source_hash=stored, ast_source_hash=own, typed_ast_source_hash=F.when(typed, own), ir_source_hash=F.when(typed, own), t1_source_hash=F.when(size % 19 != 0, stored)).alias("lineage"),
    )
    made = [p.where(keep).select(path(w).alias("path"), own.alias("source_hash")) for w, keep in (("annotated", size % 2 == 0), ("ast", size % 23 != 0), ("typed", typed), ("ir", typed & (size % 7 != 0)))]
    artifacts = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    truth = lambda task, keep, kind, of: p.where(keep).select(path(task).alias("path"), F.lit(kind).alias("record_format"), of.alias("func_id"), own.alias("source_hash"))
    truths = truth("t1", size > 0, "t1-checklist-v1", F.when(size % 29 == 0, "other").otherwise(unit)).unionByName(truth("t2", (size % 2 == 0) & (size % 31 != 0), "t3-transform-v1", unit))
    facts = p.select(unit.alias("func_id"), (size % 10 != 0).alias("non_recursive"), F.lit(True).alias("single_function"))
    return {"items": items, "sources": p.select(path("raw").alias("path"), F.col("p_name").alias("text")), "artifacts": artifacts, "truths": truths, "facts": facts}


def _rules_sql(*rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule_id, 'u' || p_partkey AS key FROM part WHERE {when}" for n, when in rules)


@query(_rules_sql(("inclusion_known", "p_size = 50"), ("shown_iff_held_C1+", "p_size % 13 = 0 AND p_size % 2 = 1"), ("truth_iff_available_T2", "p_size % 17 = 0 AND p_size % 2 = 1"),
    ("included_is_non_recursive", "p_size <> 50 AND p_size % 4 < 2 AND p_size % 5 = 0"), ("included_is_single_function", "p_size <> 50 AND p_size % 4 < 2 AND p_size % 6 = 0")))
def manifest_items(spark, d):
    """Items that break a rule by themselves."""
    return mf.item_violations(_manifest(spark, d)["items"]).select("rule_id", "key")


@query(_rules_sql(("path_ast", "p_size % 23 = 0"), ("path_ir", "p_size % 3 <> 0 AND p_size % 7 = 0"), ("source_hash", "p_size % 11 = 0"), ("claims_non_recursive", "p_size % 5 = 0 AND p_size % 10 <> 0"), ("truth_unit_T1", "p_size % 29 = 0"), ("truth_hash_T1", "p_size % 11 = 0"),
    ("truth_missing_T2", "p_size % 62 = 0"), ("truth_format_T2", "p_size % 2 = 0 AND p_size % 31 <> 0"), ("truth_hash_T2", "p_size % 22 = 0 AND p_size % 31 <> 0")))
def manifest_references(spark, d):
    """Items against the sources, artifacts, truths and facts they name."""
    m = _manifest(spark, d)
    return mf.reference_violations(m["items"], m["sources"], m["artifacts"], m["truths"], m["facts"]).select("rule_id", "key")


@query(_rules_sql(("lineage_ast_source_hash", "p_size % 23 = 0"), ("lineage_ir_source_hash", "p_size % 3 <> 0 AND p_size % 7 = 0"), ("lineage_t1_source_hash", "p_size % 19 = 0 OR p_size % 11 = 0")))
def manifest_lineage(spark, d):
    """Lineage hashes that aren't those of what they name."""
    m = _manifest(spark, d)
    return mf.lineage_violations(m["items"], m["artifacts"], m["truths"]).select("rule_id", "key")


# an input for every lineitem: its part is the unit, its return flag the task; quantities say which responses exist
_INPUTS = """i AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS ref, 'u' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END) AS unit, CASE l_returnflag WHEN 'A' THEN 'T1' WHEN 'N' THEN 'T2' ELSE 'T3' END AS task, l_quantity AS q, p_size, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _scorer_inputs(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    ref = F.concat_ws("-", *(F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")))
    unit = F.concat(F.lit("u"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).cast("string"))
    task = F.when(F.col("l_returnflag") == "A", "T1").when(F.col("l_returnflag") == "N", "T2").otherwise("T3")
    inputs = x.select(F.lit(mf.INPUT_TAG).alias("record_format"), unit.alias("func_id"), task.alias("task"), F.lit("C1+").alias("condition"), F.col("l_linestatus").alias("model_id"), ref.alias("response_ref"))
    return mf.scorer_inputs(inputs, _manifest(spark, d)["items"], x.where("l_quantity >= 5").select(ref.alias("path")))


@query(f"""WITH {_INPUTS}, a AS (SELECT *, task = 'T1' OR task = 'T2' AND (p_size % 2 = 0 OR p_size % 17 = 0) AS able FROM i),
 r AS (SELECT ref AS key, unnest([CASE WHEN l_linenumber = 7 THEN 'unit_unknown' END, CASE WHEN l_linenumber <> 7 AND NOT able THEN 'task_unavailable' END, CASE WHEN l_linenumber <> 7 AND task = 'T2' AND able AND p_size % 2 = 1 THEN 'truth_unset' END, CASE WHEN q < 5 THEN 'response_missing' END]) AS rule_id FROM a)
 SELECT rule_id, count(*) AS n, min(key) AS first_key FROM r WHERE rule_id IS NOT NULL GROUP BY ALL""")
def scorer_input_violations(spark, d):
    """Why inputs can't be scored, with counts."""
    return _scorer_inputs(spark, d)[1].groupBy("rule_id").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query(f"WITH {_INPUTS} SELECT ref AS response_ref, lower(task) || '/' || unit AS ground_truth_ref, CASE WHEN p_size % 11 = 0 THEN 'wrong' ELSE sha256(p_name) END AS source_hash FROM i JOIN part USING (p_size) WHERE l_linenumber <> 7 AND q >= 5 AND 'u' || p_partkey = unit AND (task = 'T1' OR task = 'T2' AND p_size % 2 = 0)")
def scorer_input_lookup(spark, d):
    """Inputs that can be scored, with their truth and source hash from the manifest."""
    return _scorer_inputs(spark, d)[0].select("response_ref", "ground_truth_ref", "source_hash")


# a tracker row for each supplier; account balances and nations say what is wrong
@query("""WITH t AS (SELECT CASE WHEN s_acctbal > 9000 THEN 'same' ELSE 'c' || s_suppkey END AS id, s_nationkey AS n, s_acctbal AS b FROM supplier),
 r AS (SELECT id, unnest([CASE WHEN n = 0 THEN 'complexity_known' END, CASE WHEN n = 1 THEN 'stage1_known' END, CASE WHEN n IN (1, 2, 3) THEN 'stage2_after_pass' END, CASE WHEN n = 4 THEN 'anchor_named' END, CASE WHEN n = 5 THEN 'stage2_score' END, CASE WHEN n = 6 THEN 'stage3_score' END, CASE WHEN n = 7 THEN 'stage3_after_include' END, CASE WHEN n = 7 THEN 'include_screened' END, CASE WHEN n IN (1, 2, 3) THEN 'include_after_pass' END]) AS rule_id FROM t)
 SELECT rule_id, id AS key FROM r WHERE rule_id IS NOT NULL UNION ALL SELECT 'duplicate', id FROM t GROUP BY id HAVING count(*) > 1""")
def tracker_violations(spark, d):
    """Rules that rows of the tracker break, and ids that stand twice."""
    n, null = F.col("s_nationkey"), F.lit(None).cast("double")
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.when(F.col("s_acctbal") > 9000, "same").otherwise(F.concat(F.lit("c"), F.col("s_suppkey").cast("string"))).alias("candidate_id"), F.when(n == 0, "odd").otherwise("low").alias("estimated_complexity"),
        F.when(n == 1, "ODD").when(n.isin(2, 3), "EXCLUDE").otherwise("PASS").alias("stage1_result"), F.when(n == 7, "DEFER").otherwise("INCLUDE").alias("stage2_result"), F.lit("preferred").alias("stage3_result"), F.lit("INCLUDE").alias("final_decision"), (n == 4).alias("is_anchor"),
        F.when(n != 5, 2.0).otherwise(null).alias("stage2_t2_c1_screen_score"), F.create_map(F.lit("fix"), F.lit(1)).alias("stage2_t2_subscores"), F.when(n != 6, 0.5).otherwise(null).alias("stage3_t3_c2_screen_score"))
    return rows_rules.tracker_violations(rows).select("rule_id", "key")
