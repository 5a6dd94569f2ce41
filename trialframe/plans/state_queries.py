"""Queries of stages, ingest and streams with state, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trialframe.operators import stages
from trialframe.sources.scratch import shared_dir, stored
from trialframe.streaming import events as ev

#: Candidates whose results a stream keeps in one state.
CANDIDATES = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# a candidate for each part, an event for each of its lineitems in the order of shipping
def _candidates(spark, d) -> DataFrame:
    size = F.col("p_size")
    first = F.when(size % 6 == 0, "EXCLUDE").when(size % 6 == 1, "DEFER").otherwise("PASS")
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("candidate_id"), first.alias("stage1_result"), F.when(size % 9 == 0, "INCLUDE").otherwise("not_run").alias("stage2_result"), F.lit("not_run").alias("stage3_result"), F.lit("DEFER").alias("final_decision"), (size == 50).alias("is_anchor"))


def _events(spark, d) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    order = W.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    key = F.when(F.col("l_linenumber") == 7, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey"))
    stage = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_linestatus") == "F", 4).otherwise(2)
    score = F.when(F.col("l_quantity") > 45, None).otherwise(F.floor(F.col("l_quantity") / 10) / 2)
    return x.select(key.alias("candidate_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), stage.alias("stage"), score.alias("score"))


_CAND = """c AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'EXCLUDE' WHEN 1 THEN 'DEFER' ELSE 'PASS' END AS s1, CASE WHEN p_size % 9 = 0 THEN 'INCLUDE' ELSE 'not_run' END AS s2, p_size = 50 AS anchor FROM part),
 e AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 - l_partkey ELSE l_partkey END AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
  CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_linestatus = 'F' THEN 4 ELSE 2 END AS stage, CASE WHEN l_quantity <= 45 THEN floor(l_quantity / 10) / 2 END AS score FROM lineitem),
 n AS (SELECT e.*, c.id AS known, s1, s2, anchor, row_number() OVER (PARTITION BY e.id ORDER BY pos) AS k FROM e LEFT JOIN c ON c.id = e.id)"""
# one event after another: the state of a candidate is carried from each of its events to the next
_STEP = """CASE WHEN known IS NULL THEN 'unknown_candidate' WHEN stage NOT IN (2, 3) THEN 'unknown_stage' WHEN score IS NULL THEN 'no_score' WHEN stage = 2 AND s1 <> 'PASS' THEN 'stage1_not_passed'
  WHEN stage = 3 AND NOT (anchor OR two = 'INCLUDE') THEN 'not_included' WHEN {again} AND (CASE WHEN stage = 2 THEN two ELSE three END) <> 'not_run' THEN 'already_run' ELSE 'applied' END"""


def _fold(again: str) -> str:
    band = "CASE WHEN stage = 2 THEN CASE WHEN score >= 3 THEN 'EXCLUDE' WHEN score >= 1 THEN 'INCLUDE' ELSE 'DEFER' END ELSE CASE WHEN score >= 1 THEN 'ceiling_risk' ELSE 'preferred' END END"
    step = lambda before: f"SELECT id, pos, stage, score, k, outcome, r, CASE WHEN outcome = 'applied' AND stage = 2 THEN r ELSE two END AS two, CASE WHEN outcome = 'applied' AND stage = 3 THEN r ELSE three END AS three FROM (SELECT *, {_STEP.format(again=again)} AS outcome, {band} AS r FROM ({before}))"
    first = "SELECT *, coalesce(s2, 'not_run') AS two, 'not_run' AS three FROM n WHERE k = 1"
    return f"WITH RECURSIVE {_CAND}, f AS ({step(first)} UNION ALL {step('SELECT n.*, f.two, f.three FROM f JOIN n ON n.id = f.id AND n.k = f.k + 1')})"


_LOG = " SELECT id AS candidate_id, pos, stage, score, outcome, CASE WHEN outcome = 'applied' THEN r END AS result FROM f"


@query(_fold("true") + _LOG)
def stage_log(spark, d):
    """Every event's outcome, a result being kept once it is set."""
    return stages.stage_log(_candidates(spark, d), _events(spark, d))


@query(_fold("false") + _LOG)
def stage_log_overwriting(spark, d):
    """Every event's outcome if later results replace earlier ones."""
    return stages.stage_log(_candidates(spark, d), _events(spark, d), overwrite=True)


@query(_fold("false") + """, a AS (SELECT id, arg_max(r, pos) FILTER (stage = 2) AS r2, arg_max(score, pos) FILTER (stage = 2) AS sc2, arg_max(r, pos) FILTER (stage = 3) AS r3, arg_max(r, pos) FILTER (stage = 2 AND r <> 'DEFER') AS d, count(*) FILTER (stage = 2) AS n2 FROM f WHERE outcome = 'applied' GROUP BY id)
 SELECT c.id AS candidate_id, coalesce(r2, s2) AS stage2_result, coalesce(r3, 'not_run') AS stage3_result, sc2 AS stage2_score, CASE WHEN anchor AND n2 > 0 THEN 'INCLUDE' ELSE coalesce(d, 'DEFER') END AS final_decision, CASE WHEN coalesce(r2, s2) = 'EXCLUDE' THEN format('T2 C1 score={:.1f} (>= 3.0; too easy for discriminative T2)', sc2) END AS reason FROM c LEFT JOIN a USING (id)""")
def stage_application(spark, d):
    """The candidates after all events."""
    own = _candidates(spark, d)
    out = stages.apply_log(own, stages.stage_log(own, _events(spark, d), overwrite=True))
    return out.select("candidate_id", "stage2_result", "stage3_result", "stage2_score", "final_decision", stages.exclusion_reason(F.col("stage2_result"), F.col("stage2_score")).alias("reason"))


def _fed(spark: SparkSession, parts: list[DataFrame], plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a streaming plan gives for parts that arrive one after the other: the query is started anew on its checkpoint for each, and runs to the end of what is there."""
    at = f"{shared_dir(spark)}/tf-{name}-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        out = plan(spark.readStream.schema(part.schema).parquet(f"{at}/in"))
        run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(_fold("true") + _LOG)
def stage_stream(spark, d):
    """The same log from a stream that gets each candidate's events in three parts, its state being kept from start to start."""
    own, x = _candidates(spark, d), stored(_events(spark, d), "stages")
    states = -(-own.count() // CANDIDATES) or 1
    parts = [x.where(when) for when in ("pos < 8", "pos >= 8 AND pos < 20", "pos >= 20")]
    return _fed(spark, parts, lambda s: stages.stage_stream(own, s, states), "stages")


@query("SELECT DISTINCT click_id FROM clicks")
def click_dedup(spark, d):
    """First arrivals of a stream of clicks in three parts by time; repeats are known across parts, as the watermark outlasts the table."""
    clicks = spark.read.parquet(f"{d}/clicks.parquet").select("click_id", F.col("arrived_at").alias("ts"))
    parts = [clicks.where(when) for when in ("ts < '2024-02-10'", "ts >= '2024-02-10' AND ts < '2024-03-20'", "ts >= '2024-03-20'")]
    return _fed(spark, parts, lambda s: ev.without_repeats(s, "200 days", "click_id"), "clicks").select("click_id")


# a run's score files: one for each part that has a lineitem, its status by discount, its score by quantity
_FILES = """s AS (SELECT l_partkey || '_{t}_{c}_m1.json' AS file, arg_max(CASE WHEN l_discount > 0.08 THEN 'parse_failure' ELSE 'ok' END, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS status, arg_max(floor(l_quantity / 10) / 2, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS score FROM lineitem WHERE l_linenumber = {n} GROUP BY l_partkey)"""


def _files(spark, d, task: str, condition: str, line: int) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").where(F.col("l_linenumber") == line)
    last = F.max_by(F.struct(F.when(F.col("l_discount") > 0.08, "parse_failure").otherwise("ok").alias("status"), (F.floor(F.col("l_quantity") / 10) / 2).alias("score")), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"))
    held = x.groupBy("l_partkey").agg(last.alias("r"))
    return held.select(F.concat(F.col("l_partkey").cast("string"), F.lit(f"_{task}_{condition}_m1.json")).alias("file"), "r.status", "r.score")


_HIT = "CASE WHEN {ran} THEN 'skip' WHEN s.file IS NULL THEN 'miss' WHEN status <> 'ok' THEN 'scorer_failed' ELSE 'hit' END"
_INGEST = f"""WITH {_CAND.split(',' + chr(10) + ' e AS')[0]}, {_FILES.format(t='T2', c='C1', n=1)},
 o AS (SELECT id, s2, anchor, score, {_HIT.format(ran="s2 <> 'not_run'")} AS first FROM c LEFT JOIN s ON file = id || '_T2_C1_m1.json' WHERE s1 = 'PASS')"""


@query(_INGEST + " SELECT id AS candidate_id, first AS outcome, CASE first WHEN 'hit' THEN 'skip' ELSE first END AS again, CASE WHEN first <> 'hit' THEN s2 WHEN score >= 3 THEN 'EXCLUDE' WHEN score >= 1 THEN 'INCLUDE' ELSE 'DEFER' END AS stage2_result FROM o")
def ingest_twice(spark, d):
    """A run's scores taken in, and once more: the second time every hit is skipped and no result changes."""
    own, files = _candidates(spark, d), stored(_files(spark, d, "T2", "C1", 1), "files")
    once, log = stages.ingest(own, files, 2, F.lit("m1"))
    once = stored(once, "once")
    twice, again = stages.ingest(once, files, 2, F.lit("m1"))
    return log.select("candidate_id", "outcome").join(again.select("candidate_id", F.col("outcome").alias("again")), "candidate_id").join(twice.select("candidate_id", "stage2_result"), "candidate_id")


@query(_INGEST + f""", t AS (SELECT c.id, c.anchor, CASE WHEN o.first IS DISTINCT FROM 'hit' THEN c.s2 WHEN score >= 3 THEN 'EXCLUDE' WHEN score >= 1 THEN 'INCLUDE' ELSE 'DEFER' END AS two FROM c LEFT JOIN o USING (id)), s3 AS (SELECT * FROM ({_FILES.format(t='T3', c='C2', n=2)[6:-1]}))
 SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'hit' AND score >= 1) AS ceiling_risk FROM (SELECT t.*, s.score, {_HIT.format(ran='false')} AS outcome FROM t LEFT JOIN s3 s ON file = id || '_T3_C2_m1.json' WHERE two = 'INCLUDE' OR anchor) GROUP BY ALL""")
def ingest_stage3(spark, d):
    """Outcomes of the advisory stage after the second one."""
    once, _ = stages.ingest(_candidates(spark, d), _files(spark, d, "T2", "C1", 1), 2, F.lit("m1"))
    after, log = stages.ingest(stored(once, "once"), _files(spark, d, "T3", "C2", 2), 3, F.lit("m1"))
    both = log.join(after.select("candidate_id", "stage3_result"), "candidate_id")
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if((F.col("outcome") == "hit") & (F.col("stage3_result") == "ceiling_risk")).alias("ceiling_risk"))


@query("SELECT count(*) AS n, count(*) FILTER (candidate_id > 1000000) AS added FROM (SELECT p_partkey AS candidate_id FROM part UNION SELECT CASE WHEN s_suppkey <= 5 THEN s_suppkey ELSE 1000000 + s_suppkey END FROM supplier)")
def seed_rows(spark, d):
    """Rows that are added only where their key is new."""
    own = _candidates(spark, d)
    key = F.when(F.col("s_suppkey") <= 5, F.col("s_suppkey")).otherwise(1_000_000 + F.col("s_suppkey"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(key.alias("candidate_id"), F.lit("PASS").alias("stage1_result"), F.lit("not_run").alias("stage2_result"), F.lit("not_run").alias("stage3_result"), F.lit("INCLUDE").alias("final_decision"), F.lit(True).alias("is_anchor"))
    table, _ = stages.seed(own, rows)
    return table.agg(F.count("*").alias("n"), F.count_if(F.col("candidate_id") > 1_000_000).alias("added"))
