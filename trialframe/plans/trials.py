"""The trial cube over the star schema, and the queries of the statistics layer with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.operators import stats
from trialframe.sources.scratch import stored

KEYS = ["unit_id", "task", "condition", "model_id"]
# the first two are an order's, by which lineitems were joined
ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
HYPOTHESES = [("H1", "1-URGENT", "2-HIGH"), ("H2", "1-URGENT", "5-LOW"), ("H3", "2-HIGH", "5-LOW")]
LADDER = [("E1", "2-HIGH", "1-URGENT"), ("E2", "3-MEDIUM", "2-HIGH"), ("E3", "4-NOT SPECIFIED", "3-MEDIUM")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt: unit, task, condition, model, status, score and the run order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "parse_failure").otherwise("ok")
    # merged at any size: by the size of its packed file a table of orders would be broadcast
    return items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("unit_id"), F.col("l_returnflag").alias("task"), F.col("o_orderpriority").alias("condition"), F.col("l_linestatus").alias("model_id"), status.alias("status"), F.col("l_quantity").alias("score"), *ORDER
    )


def scores(spark: SparkSession, sf_dir: str, conditions: Sequence[str] | None = None) -> DataFrame:
    """The score table: the last successful attempt of every cell and model; of the ``conditions`` that are asked for, or of all."""
    own = trials(spark, sf_dir).where("status = 'ok'")
    if conditions is not None:
        own = own.where(F.col("condition").isin(*conditions))
    return stats.last_wins(own, KEYS, ORDER, together=2)


def _conditions(rows) -> list[str]:
    return sorted({c for _, *pair in rows for c in pair})


def hypotheses(spark: SparkSession, rows=HYPOTHESES) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{a}', '{b}')" for h, a, b in rows) + " AS t(hypothesis, cond_a, cond_b)")


def _differences(spark: SparkSession, sf_dir: str, rows=HYPOTHESES, required: int | None = None) -> DataFrame:
    cells = stats.cell_means(scores(spark, sf_dir, _conditions(rows)), ["unit_id", "task", "condition"], required=required)
    return stats.paired_differences(cells, hypotheses(spark, rows), ["unit_id", "task"])


# -- SQL building blocks ------------------------------------------------------------------------
_TRIALS = """trials AS (SELECT l_suppkey AS unit_id, l_returnflag AS task, o_orderpriority AS condition, l_linestatus AS model_id,
 CASE o_orderstatus WHEN 'P' THEN 'parse_failure' ELSE 'ok' END AS status, l_quantity AS score, o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_SCORES = _TRIALS + """, scores AS (SELECT unit_id, task, condition, model_id, score FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, task, condition, model_id
 ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM trials WHERE status = 'ok') WHERE rn = 1)"""
_CELLS = _SCORES + ", cells AS (SELECT unit_id, task, condition, avg(score) AS score FROM scores GROUP BY ALL)"


def _hyp(rows) -> str:
    return "hyp(hypothesis, cond_a, cond_b) AS (VALUES " + ", ".join(str(r) for r in rows) + ")"


def _diffs(rows=HYPOTHESES, cells: str = _CELLS) -> str:
    return f"""WITH {cells}, {_hyp(rows)}, diffs AS (SELECT hypothesis, a.task, a.unit_id, a.score - b.score AS d FROM hyp
 JOIN cells a ON a.condition = cond_a JOIN cells b ON b.condition = cond_b AND b.task = a.task AND b.unit_id = a.unit_id WHERE a.score IS NOT NULL AND b.score IS NOT NULL)"""


def _tests(by: str = "hypothesis, task") -> str:
    return f""", nz AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {by}, abs(d)) AS t FROM diffs WHERE d <> 0),
 w AS (SELECT {by}, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, sum(t * t - 1)::BIGINT AS tie_term FROM nz GROUP BY ALL),
 n AS (SELECT {by}, count(*) AS n_pairs, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) FILTER (d = 0) AS n_tie FROM diffs GROUP BY ALL),
 tests AS (SELECT {by}, n_pairs, n_pos, n_neg, n_tie, coalesce(w_plus, 0)::DOUBLE AS w_plus, coalesce(w_minus, 0)::DOUBLE AS w_minus, coalesce(tie_term, 0)::BIGINT AS tie_term,
  CASE WHEN coalesce(w_plus + w_minus, 0) = 0 THEN 0.0::DOUBLE ELSE (w_plus - w_minus) / (w_plus + w_minus) END AS r_rb FROM n LEFT JOIN w USING ({by}))"""


def _rounded(tests: DataFrame) -> DataFrame:
    return tests.withColumn("r_rb", F.round("r_rb", 6))


@query(_diffs() + _tests() + " SELECT hypothesis, task, n_pairs, n_pos, n_neg, n_tie, w_plus, w_minus, tie_term, round(r_rb, 6) AS r_rb FROM tests")
def paired_signed_rank(spark, sf_dir):
    return _rounded(stats.signed_rank(_differences(spark, sf_dir), ["hypothesis", "task"]))


@query(f"WITH {_SCORES} SELECT task, condition, model_id, count(*) AS n, sum(score) AS total FROM scores GROUP BY ALL")
def last_wins_dedup(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("task", "condition", "model_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"WITH {_CELLS} SELECT unit_id, task, condition, score FROM cells")
def cell_means(spark, sf_dir):
    return stats.cell_means(scores(spark, sf_dir), ["unit_id", "task", "condition"])


@query(f"WITH {_SCORES} SELECT unit_id, task, condition, CASE WHEN count(*) = 2 THEN avg(score) END AS score FROM scores GROUP BY ALL")
def cell_means_all_models(spark, sf_dir):
    return stats.cell_means(scores(spark, sf_dir), ["unit_id", "task", "condition"], required=2)


@query(_diffs() + " SELECT hypothesis, task, unit_id, d FROM diffs")
def paired_differences(spark, sf_dir):
    return _differences(spark, sf_dir)


@query(_diffs() + _tests() + ", r AS (SELECT hypothesis, task, unit_id, d, r FROM nz) SELECT hypothesis, task, unit_id, d, r::DOUBLE AS r FROM r")
def mid_ranks(spark, sf_dir):
    return stats.mid_ranks(_differences(spark, sf_dir), ["hypothesis", "task"]).select("hypothesis", "task", "unit_id", "d", "r")


@query(f"WITH {_CELLS}, u AS (SELECT count(DISTINCT unit_id) AS total FROM trials) SELECT task, condition, count(score) || '/' || any_value(total) AS completeness FROM cells, u GROUP BY ALL")
def completeness_grid(spark, sf_dir):
    cells = stats.cell_means(scores(spark, sf_dir), ["unit_id", "task", "condition"])
    total = trials(spark, sf_dir).agg(F.count_distinct("unit_id").alias("total"))
    have = cells.groupBy("task", "condition").agg(F.count("score").alias("have"))
    return have.crossJoin(F.broadcast(total)).select("task", "condition", F.concat_ws("/", F.col("have").cast("string"), F.col("total").cast("string")).alias("completeness"))


@query(_diffs() + " SELECT hypothesis, task, count(*) AS n, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) FILTER (d = 0) AS n_tie, median(d) AS median_diff FROM diffs GROUP BY ALL")
def diff_summary(spark, sf_dir):
    return _differences(spark, sf_dir).groupBy("hypothesis", "task").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("n_pos"), F.count_if(F.col("d") < 0).alias("n_neg"), F.count_if(F.col("d") == 0).alias("n_tie"), F.percentile("d", 0.5).alias("median_diff"))


# p by other ways than ``stats``: the normal tail by Simpson's rule over 2,000 steps up to 9, exact p by a fold over the doubled ranks
_P = """, z AS (SELECT *, n_pos + n_neg AS m FROM tests),
 z2 AS (SELECT *, CASE WHEN m >= 2 THEN (w_plus - m * (m + 1) / 4.0::DOUBLE) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0::DOUBLE - tie_term / 48.0::DOUBLE) END AS z FROM z),
 z3 AS (SELECT *, least(abs(z), 9) / 2000 AS h FROM z2),
 z4 AS (SELECT *, 0.5::DOUBLE - h / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * h) * (i * h) / 2))) AS half FROM z3),
 nv AS (SELECT *, CASE WHEN z >= 0 THEN half ELSE 1 - half END AS normal FROM z4),
 ex AS (SELECT {by}, list_reduce(list_prepend([1.0::DOUBLE], list([2 * r]::DOUBLE[])), lambda c, x: list_transform(range(1, len(c) + x[1]::BIGINT + 1), lambda i: (coalesce(c[i], 0) + CASE WHEN i > x[1] THEN coalesce(c[i - x[1]::BIGINT], 0) ELSE 0 END) / 2)) AS c
  FROM nz JOIN (SELECT {by} FROM z WHERE m BETWEEN 2 AND 13 OR m BETWEEN 2 AND 50 AND tie_term = 0) USING ({by}) GROUP BY ALL),
 pv AS (SELECT nv.*, CASE WHEN m < 2 THEN NULL WHEN c IS NOT NULL THEN list_sum(c[(2 * w_plus)::BIGINT + 1:]) ELSE normal END AS p, CASE WHEN m < 2 THEN NULL ELSE least(1, 2 * least(CASE WHEN c IS NOT NULL THEN list_sum(c[(2 * w_plus)::BIGINT + 1:]) ELSE normal END, CASE WHEN c IS NOT NULL THEN list_sum(c[:(2 * w_plus)::BIGINT + 1]) ELSE 1 - normal END)) END AS p_two_sided FROM nv LEFT JOIN ex USING ({by}))"""


@query(_diffs() + _tests() + _P.format(by="hypothesis, task") + """, k AS (SELECT *, coalesce(p, 1) AS q, count(*) OVER () - row_number() OVER (ORDER BY coalesce(p, 1), hypothesis, task) + 1 AS rest FROM pv)
 SELECT hypothesis, task, round(p, 6) AS p, round(max(least(1.0::DOUBLE, q * rest)) OVER (ORDER BY q, hypothesis, task ROWS UNBOUNDED PRECEDING), 6) AS holm_p,
 min(CASE WHEN q <= 0.45 / rest THEN 1 ELSE 0 END) OVER (ORDER BY q, hypothesis, task ROWS UNBOUNDED PRECEDING) = 1 AS holm_rejected FROM k""")
def holm_family(spark, sf_dir):
    """Corrected p-values and decisions at a level that some of the tests pass."""
    tests = stats.signed_rank_tests(_differences(spark, sf_dir), ["hypothesis", "task"]).select("hypothesis", "task", "p")
    return stats.holm(tests, "p", ["hypothesis", "task"], alpha=0.45).withColumns({"p": F.round("p", 6), "holm_p": F.round("holm_p", 6)})


@query(_diffs() + _tests() + _P.format(by="hypothesis, task") + f""", k AS (SELECT *, coalesce(p, 1) AS q, count(*) OVER () - row_number() OVER (ORDER BY coalesce(p, 1), hypothesis, task) + 1 AS rest FROM pv)
 SELECT hypothesis, task, cond_a AS condition_A, cond_b AS condition_B, n_pairs AS n_complete_pairs, CASE WHEN m >= 2 THEN w_plus END AS wilcoxon_statistic, round(p, 6) AS p_value_one_sided, round(r_rb, 6) AS rank_biserial_r, round(max(least(1.0::DOUBLE, q * rest)) OVER o, 6) AS holm_p,
 min(CASE WHEN q <= 0.05 / rest THEN 1 ELSE 0 END) OVER o = 1 AS holm_bonferroni_rejected, CASE WHEN m < 2 THEN '{stats.INSUFFICIENT}' WHEN holm_bonferroni_rejected THEN '{stats.REJECT}' ELSE '{stats.KEEP}' END AS interpretation FROM k JOIN (VALUES {", ".join(map(str, HYPOTHESES))}) v(hypothesis, cond_a, cond_b) USING (hypothesis) WINDOW o AS (ORDER BY q, hypothesis, task ROWS UNBOUNDED PRECEDING)""")
def confirmatory_family(spark, sf_dir):
    """From the scores to the corrected decisions: paired differences, signed ranks, p, Holm over all tests."""
    return stats.decisions(stats.signed_rank_tests(_differences(spark, sf_dir), ["hypothesis", "task"]), hypotheses(spark))


_BY_NATION = _diffs().replace("SELECT hypothesis, a.task, a.unit_id", "SELECT hypothesis, a.task, s_nationkey AS nation, a.unit_id").replace("WHERE a.score IS NOT NULL", "JOIN supplier ON s_suppkey = a.unit_id WHERE a.score IS NOT NULL")


@query(_BY_NATION + _tests("hypothesis, task, nation") + _P.format(by="hypothesis, task, nation") + " SELECT hypothesis, task, nation, n_pairs, n_pos, n_neg, w_plus, tie_term, round(p, 9) AS p_one_sided, round(p_two_sided, 9) AS p_two_sided, CASE WHEN m < 2 THEN 'insufficient_data' ELSE 'ok' END AS status FROM pv")
def exact_signed_rank(spark, sf_dir):
    """A test for each nation: small ones, whose p is exact."""
    units = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("unit_id"), F.col("s_nationkey").alias("nation"))
    by = ["hypothesis", "task", "nation"]
    d = _differences(spark, sf_dir).join(units, "unit_id")
    both = stats.signed_rank_tests(d, by, also=["two-sided"])
    return both.select(*by, "n_pairs", "n_pos", "n_neg", "w_plus", "tie_term", F.round("p", 9).alias("p_one_sided"), F.round("p_two_sided", 9).alias("p_two_sided"), "status")


_PER_MODEL = _diffs().replace("SELECT hypothesis, a.task, a.unit_id", "SELECT hypothesis, a.task, a.model_id, a.unit_id").replace("JOIN cells a", "JOIN scores a").replace("JOIN cells b", "JOIN scores b").replace("AND b.task = a.task", "AND b.model_id = a.model_id AND b.task = a.task")


def _per_model(spark, sf_dir):
    return stats.signed_rank(stats.paired_differences(scores(spark, sf_dir, _conditions(HYPOTHESES)), hypotheses(spark), ["unit_id", "task", "model_id"]), ["hypothesis", "task", "model_id"])


@query(_PER_MODEL + _tests("hypothesis, task, model_id") + " SELECT hypothesis, task, model_id, n_pairs, n_pos, n_neg, n_tie, w_plus, w_minus, tie_term, round(r_rb, 6) AS r_rb FROM tests")
def per_model_split(spark, sf_dir):
    return _rounded(_per_model(spark, sf_dir))


@query(_PER_MODEL + _tests("hypothesis, task, model_id") + _P.format(by="hypothesis, task, model_id") + """, k AS (SELECT *, coalesce(p, 1) AS q, count(*) OVER (PARTITION BY model_id) - row_number() OVER (PARTITION BY model_id ORDER BY coalesce(p, 1), hypothesis, task) + 1 AS rest FROM pv)
 SELECT hypothesis, task, model_id, round(max(least(1.0::DOUBLE, q * rest)) OVER (PARTITION BY model_id ORDER BY q, hypothesis, task ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM k""")
def holm_per_model(spark, sf_dir):
    by = ["hypothesis", "task", "model_id"]
    tests = stats.signed_rank_tests(stats.paired_differences(scores(spark, sf_dir, _conditions(HYPOTHESES)), hypotheses(spark), ["unit_id", "task", "model_id"]), by)
    return stats.holm(tests, "p", ["hypothesis", "task"], family=["model_id"]).select(*by, F.round("holm_p", 6).alias("holm_p"))


@query(_PER_MODEL + _tests("hypothesis, task, model_id") + " SELECT hypothesis, task, bool_and(r_rb < 0) AS all_negative, bool_and(r_rb > 0) AS all_positive FROM tests GROUP BY ALL")
def sign_survival(spark, sf_dir):
    return _per_model(spark, sf_dir).groupBy("hypothesis", "task").agg(F.bool_and(F.col("r_rb") < 0).alias("all_negative"), F.bool_and(F.col("r_rb") > 0).alias("all_positive"))


@query(_diffs(LADDER) + _tests() + " SELECT hypothesis, task, n_pairs, n_pos, n_neg, n_tie, w_plus, w_minus, tie_term, round(r_rb, 6) AS r_rb FROM tests")
def ladder_decomposition(spark, sf_dir):
    return _rounded(stats.signed_rank(_differences(spark, sf_dir, LADDER), ["hypothesis", "task"]))


# half of the cells miss a model here, so that the policies for missing data differ
_GAPS = _SCORES.replace("WHERE rn = 1)", "WHERE rn = 1 AND NOT (model_id = 'F' AND unit_id % 3 = 0 AND condition = '5-LOW'))")
_GAP_CELLS = _GAPS + ", cells AS (SELECT unit_id, task, condition, CASE WHEN count(*) = 2 THEN avg(score) END AS score FROM scores GROUP BY ALL)"


def _gaps(spark, sf_dir):
    return scores(spark, sf_dir).where("NOT (model_id = 'F' AND unit_id % 3 = 0 AND condition = '5-LOW')")


@query(_diffs(cells=_GAP_CELLS) + """ SELECT hypothesis, task, count(*) AS n, count(*) FILTER (d <> 0) AS effective_n, round(avg(d), 6) AS mean_diff, list_sort(list(d))[len(list(d)) // 2 + 1] AS upper_median FROM diffs GROUP BY ALL""")
def sensitivity_complete_case(spark, sf_dir):
    cells = stats.cell_means(_gaps(spark, sf_dir), ["unit_id", "task", "condition"], required=2)
    d = stats.paired_differences(cells, hypotheses(spark), ["unit_id", "task"])
    return d.groupBy("hypothesis", "task").agg(F.count("*").alias("n"), F.count_if(F.col("d") != 0).alias("effective_n"), F.round(F.avg("d"), 6).alias("mean_diff"), stats.upper_median("d").alias("upper_median"))


@query(f"""WITH {_GAPS}, grid AS (SELECT u.unit_id, t.task, c.condition, m.model_id FROM (SELECT DISTINCT unit_id FROM scores) u, (SELECT DISTINCT task FROM scores) t, (VALUES ('1-URGENT'), ('5-LOW')) c(condition), (SELECT DISTINCT model_id FROM scores) m),
 filled AS (SELECT unit_id, task, condition, model_id, coalesce(score, CASE WHEN condition = '1-URGENT' THEN 0.0 ELSE 50.0 END) AS score FROM grid LEFT JOIN scores USING (unit_id, task, condition, model_id)),
 diffs AS (SELECT task, unit_id, avg(score) FILTER (condition = '1-URGENT') - avg(score) FILTER (condition = '5-LOW') AS d FROM filled GROUP BY ALL)
 SELECT task, count(*) AS n, count(*) FILTER (d <> 0) AS effective_n, round(avg(d), 6) AS mean_diff, median(d) AS median_diff FROM diffs GROUP BY ALL""")
def sensitivity_worst_case(spark, sf_dir):
    # written, as the grid reads it three times and is then filled from it
    own = stored(_gaps(spark, sf_dir), "scores")
    dims = [own.select(c).distinct() for c in ("unit_id", "task", "model_id")]
    conds = spark.sql("SELECT * FROM VALUES ('1-URGENT'), ('5-LOW') AS t(condition)")
    # tasks, conditions and models are few by the study's design; units stay distributed
    grid = dims[0].crossJoin(F.broadcast(dims[1])).crossJoin(F.broadcast(dims[2])).crossJoin(F.broadcast(conds))
    filled = stats.worst_case(own, grid, KEYS, "1-URGENT", F.lit(50.0))
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("score")))
    d = filled.groupBy("task", "unit_id").agg((mean("1-URGENT") - mean("5-LOW")).alias("d"))
    return d.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("d") != 0).alias("effective_n"), F.round(F.avg("d"), 6).alias("mean_diff"), F.percentile("d", 0.5).alias("median_diff"))


@query(f"WITH {_TRIALS} SELECT task, condition, round(avg(CASE WHEN status = 'ok' THEN score ELSE 0 END), 6) AS score FROM trials GROUP BY ALL")
def zero_imputed(spark, sf_dir):
    return trials(spark, sf_dir).groupBy("task", "condition").agg(F.round(F.avg(F.when(F.col("status") == "ok", F.col("score")).otherwise(0.0)), 6).alias("score"))


@query(f"WITH {_SCORES}, c AS (SELECT task, score, count(*) AS c FROM scores GROUP BY ALL) SELECT task, sum(c)::BIGINT AS n, count(*) AS n_distinct, round(sum(c * (c - 1) / 2) / (sum(c) * (sum(c) - 1) / 2), 4) AS tie_mass FROM c GROUP BY task")
def tie_mass(spark, sf_dir):
    return stats.tie_mass(scores(spark, sf_dir), ["task"])


@query(f"WITH {_SCORES} SELECT task, count(*) AS n, count(DISTINCT score) AS n_distinct, min(score) AS lowest, max(score) AS highest, round(avg(CASE WHEN score = 50 THEN 1.0 ELSE 0.0 END), 4) AS at_ceiling, round(avg(score), 4) AS mean FROM scores GROUP BY ALL")
def score_distribution(spark, sf_dir):
    at = F.avg(F.when(F.col("score") == 50, 1.0).otherwise(0.0))
    return scores(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("score").alias("n_distinct"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.round(at, 4).alias("at_ceiling"), F.round(F.avg("score"), 4).alias("mean"))


@query(f"WITH {_TRIALS} SELECT score, count(*) AS n FROM trials WHERE status = 'ok' GROUP BY ALL")
def histogram_raw(spark, sf_dir):
    return trials(spark, sf_dir).where("status = 'ok'").groupBy("score").agg(F.count("*").alias("n"))


@query(f"WITH {_CELLS} SELECT score, count(*) AS n FROM cells GROUP BY ALL")
def histogram_averaged(spark, sf_dir):
    return stats.cell_means(scores(spark, sf_dir), ["unit_id", "task", "condition"]).groupBy("score").agg(F.count("*").alias("n"))


@query(f"WITH {_TRIALS} SELECT task, condition, model_id, count(*) FILTER (status <> 'ok') AS n_failed, count(*) AS n, round(avg(CASE WHEN status <> 'ok' THEN 1.0 ELSE 0.0 END), 4) AS rate FROM trials GROUP BY GROUPING SETS ((task, condition, model_id), (condition), ())")
def parse_failures(spark, sf_dir):
    sets = [[F.col("task"), F.col("condition"), F.col("model_id")], [F.col("condition")], []]
    failed = F.col("status") != "ok"
    out = trials(spark, sf_dir).groupingSets(sets, "task", "condition", "model_id").agg(F.count_if(failed).alias("n_failed"), F.count("*").alias("n"), F.round(F.avg(F.when(failed, 1.0).otherwise(0.0)), 4).alias("rate"))
    return out.select("task", "condition", "model_id", "n_failed", "n", "rate")


@query(f"WITH {_TRIALS} SELECT condition, model_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'parse_failure') AS parse_failure FROM trials GROUP BY ALL")
def status_counts(spark, sf_dir):
    return trials(spark, sf_dir).groupBy("condition", "model_id").pivot("status", ["ok", "parse_failure"]).agg(F.count("unit_id"))


@query(f"WITH {_TRIALS} SELECT task, condition, model_id, count(*) FILTER (status = 'parse_failure') AS latest_failed FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, task, condition, model_id ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM trials) WHERE rn = 1 GROUP BY ALL")
def latest_status(spark, sf_dir):
    return stats.last_wins(trials(spark, sf_dir), KEYS, ORDER, "status").groupBy("task", "condition", "model_id").agg(F.count_if(F.col("status") == "parse_failure").alias("latest_failed"))


@query(f"WITH {_TRIALS} SELECT count(*) AS n_records, count(*) FILTER (status <> 'ok') AS n_not_ok, array_to_string(list_sort(list(DISTINCT task)), ',') AS tasks, array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions, array_to_string(list_sort(list(DISTINCT model_id)), ',') AS models, count(DISTINCT unit_id) AS n_units FROM trials")
def input_summary(spark, sf_dir):
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return trials(spark, sf_dir).agg(F.count("*").alias("n_records"), F.count_if(F.col("status") != "ok").alias("n_not_ok"), names("task").alias("tasks"), names("condition").alias("conditions"), names("model_id").alias("models"), F.count_distinct("unit_id").alias("n_units"))


@query()
def signed_rank_p_values(spark, sf_dir):
    """p and the bootstrap interval of every test, from counts of differences."""
    # written, as p and intervals both read it
    d, by = stored(_differences(spark, sf_dir), "differences"), ["hypothesis", "task"]
    tests = stats.signed_rank_tests(d, by).select(*by, F.col("n_pairs").alias("n"), F.col("w_plus").alias("statistic"), "p", "r_rb")
    return tests.join(kernels.bootstrap_intervals(d, by), by)


# the closed form by fixed values: quantiles of the normal distribution at 0.95 and 0.8
_Z = "(1.6448536269514715::DOUBLE + 0.8416212335729144::DOUBLE)"


def _designs(spark, sf_dir) -> DataFrame:
    d = _differences(spark, sf_dir).groupBy("hypothesis", "task").agg(F.count("*").alias("n"), (F.avg("d") / F.stddev_samp("d")).alias("dz"))
    return d.withColumn("dz", F.round(F.abs("dz"), 3))


@query(_diffs() + f""", x AS (SELECT hypothesis, task, count(*) AS n, round(abs(avg(d) / stddev_samp(d)), 3) AS dz FROM diffs GROUP BY ALL)
 SELECT hypothesis, task, n, dz, CASE WHEN dz <> 0 THEN ceil(({_Z} / dz) ** 2 / (3 / pi())) END AS required, round({_Z} / sqrt(n * (3 / pi())), 9) AS detectable FROM x""")
def power_closed_form(spark, sf_dir):
    """Pairs that each test's own effect would need, and the effect that its pairs can show."""
    return _designs(spark, sf_dir).withColumns({"required": kernels.required_pairs(F.col("dz")).cast("double"), "detectable": F.round(kernels.detectable(F.col("n")), 9)})


@query()
def power_simulation(spark, sf_dir):
    """The power of each test for its own effect, by 200 drawn samples of its size."""
    # written, as the draws and the result both read them
    own = stored(_designs(spark, sf_dir), "designs")
    return own.join(kernels.power_simulation(own, ["hypothesis", "task"], draws=200), ["hypothesis", "task"])


@query(_PER_MODEL + _tests("hypothesis, task, model_id") + _P.format(by="hypothesis, task, model_id") + """, md AS (SELECT hypothesis, task, model_id, median(d) AS median_diff FROM diffs GROUP BY ALL),
 k AS (SELECT *, coalesce(p_two_sided, 1) AS q, count(*) OVER (PARTITION BY model_id) - row_number() OVER (PARTITION BY model_id ORDER BY coalesce(p_two_sided, 1), hypothesis, task) + 1 AS rest FROM pv)
 SELECT 'per_model' AS analysis, hypothesis, task, cond_a, cond_b, model_id AS model, n_pairs, n_pos, n_neg, n_tie, median_diff, CASE WHEN m >= 2 THEN w_plus END AS statistic, round(p_two_sided, 6) AS raw_p, round(max(least(1.0::DOUBLE, q * rest)) OVER (PARTITION BY model_id ORDER BY q, hypothesis, task ROWS UNBOUNDED PRECEDING), 6) AS holm_p, round(r_rb, 6) AS r_rb, CASE WHEN m < 2 THEN 'insufficient_data' ELSE 'ok' END AS status
 FROM k JOIN md USING (hypothesis, task, model_id) JOIN (VALUES """ + ", ".join(map(str, HYPOTHESES)) + """) v(hypothesis, cond_a, cond_b) USING (hypothesis)""")
def exploratory_family(spark, sf_dir):
    """Two-sided tests of each model, corrected in the model's family: the columns of an exploratory result but the intervals, which are in ``signed_rank_p_values``."""
    by = ["hypothesis", "task", "model_id"]
    # written, as tests and medians both read them
    d = stored(stats.paired_differences(scores(spark, sf_dir, _conditions(HYPOTHESES)), hypotheses(spark), ["unit_id", "task", "model_id"]), "differences")
    return stats.exploratory(d, by, hypotheses(spark)).drop("ci_low", "ci_high")


@query(f"""WITH {_SCORES}, x AS (SELECT task, round(score / 50, 4) AS v FROM scores), c AS (SELECT task, v, count(*) AS c FROM x GROUP BY ALL)
 SELECT task, sum(c)::BIGINT AS n, count(*) AS n_distinct, round(sum(c * (c - 1) / 2) / greatest(sum(c) * (sum(c) - 1) / 2, 1), 4) AS tie_mass, min(v) AS lowest, max(v) AS highest, bool_and(v = 0) AS all_zero, bool_and(v = 1) AS saturated FROM c GROUP BY task""")
def rubric_summary(spark, sf_dir):
    own = scores(spark, sf_dir).select("task", F.round(F.col("score") / 50, 4).alias("score"))
    spread = own.groupBy("task").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.bool_and(F.col("score") == 0).alias("all_zero"), F.bool_and(F.col("score") == 1).alias("saturated"))
    return stats.tie_mass(own, ["task"]).join(spread, "task")


@query(f"WITH {_SCORES}, c AS (SELECT unit_id, task, condition, max(score) AS top, avg(score) AS mean FROM scores GROUP BY ALL) SELECT task, count(*) FILTER (top = 50) AS at_ceiling, count(*) FILTER (top = 50 AND mean < 50) AS pulled_below FROM c GROUP BY ALL")
def pulled_below_ceiling(spark, sf_dir):
    cells = scores(spark, sf_dir).groupBy("unit_id", "task", "condition").agg(F.max("score").alias("top"), F.avg("score").alias("mean"))
    return cells.groupBy("task").agg(F.count_if(F.col("top") == 50).alias("at_ceiling"), F.count_if((F.col("top") == 50) & (F.col("mean") < 50)).alias("pulled_below"))


@query(f"WITH {_SCORES}, u AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), w AS (SELECT unit_id, task, condition, count(*) AS n, avg(score) AS score FROM scores WHERE unit_id IN (SELECT s_suppkey FROM u) GROUP BY ALL) SELECT unit_id, task, condition, score FROM w WHERE n = 2")
def demanded_models(spark, sf_dir):
    """Means of the chosen units' cells that have both models; a cell without would raise, so those are left out first."""
    units = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("unit_id"))
    own, by = stats.restrict_units(scores(spark, sf_dir), units), ["unit_id", "task", "condition"]
    whole = own.groupBy(*by).agg(F.count("score").alias("n")).where("n = 2").select(*by)
    return stats.demand_models(own.join(whole, by, "left_semi"), by, 2)
