"""Published figures and hand-made cases of the statistics layer."""

import itertools
import math
import random

import pytest
from places import SF
from pyspark.sql import functions as F

from trialframe.functions import kernels as k
from trialframe.operators import stats
from trialframe.plans import registry
from trialframe.plans.trials import QUERIES


def test_rank_biserial():
    assert k.rank_biserial([1, 1, -1, 0, 1]) == 0.5
    assert k.rank_biserial([0, 0]) == k.rank_biserial([]) == 0.0


def test_signed_rank_p():
    assert all(map(math.isnan, k.signed_rank_p([0, 0, 1])))
    assert k.signed_rank_p([1, 2, 3]) == (6.0, 0.125)
    # fourteen tied differences: the normal approximation without correction
    w, p = k.signed_rank_p([1] * 10 + [-1] * 4)
    z = (w - 52.5) / math.sqrt(14 * 15 * 29 / 24 - (14**3 - 14) / 48)
    assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    for d in ([1, -2, 3, 4, -5, 6], [0.5] * 20 + [-1] * 3):
        assert k.signed_rank_p(d, "two-sided")[1] <= 1 and k.signed_rank_p(d, "greater")[1] + k.signed_rank_p(d, "less")[1] >= 1


def test_bootstrap_and_power():
    assert all(map(math.isnan, k.bootstrap_interval([0, 0, 1])))
    low, high = k.bootstrap_interval([1, 2, -1, 3, 0, 2], 500)
    assert -1 <= low <= k.rank_biserial([1, 2, -1, 3, 0, 2]) <= high <= 1
    assert k.bootstrap_interval([1, 2, -1, 3], 200) == k.bootstrap_interval([1, 2, -1, 3], 200)
    n = k.required_n(0.5)
    assert k.detectable_effect(n) <= 0.5 < k.detectable_effect(n - 1)
    assert k.simulated_power(20, 1.0, draws=200) > k.simulated_power(20, 0.1, draws=200)


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.5)], "t string, p double")
    out = {r.t: (round(r.holm_p, 6), r.holm_rejected) for r in stats.holm(rows, "p", ["t"]).collect()}
    assert out == {"a": (0.03, True), "b": (0.08, False), "c": (0.5, False)}
    rows = spark.createDataFrame([("a", 0.01), ("b", float("nan")), ("c", 0.5), ("d", None)], "t string, p double")
    out = {r.t: round(r.holm_p, 6) for r in stats.holm(rows, "p", ["t"]).collect()}
    assert out == {"a": 0.04, "b": 1.0, "c": 1.0, "d": 1.0}


def test_signed_rank_and_ranks(spark):
    rows = spark.createDataFrame([("x", float(d)) for d in (1, 1, -1, 0, 1)] + [("y", 0.0)], "t string, d double")
    out = {r.t: r for r in stats.signed_rank(rows, ["t"]).collect()}
    assert (out["x"].w_plus, out["x"].w_minus, out["x"].r_rb, out["x"].tie_term) == (7.5, 2.5, 0.5, 60)
    assert (out["y"].n_pairs, out["y"].r_rb) == (1, 0.0)
    ranks = sorted(r.r for r in stats.mid_ranks(spark.createDataFrame([("x", v) for v in (1.0, -1.0, 2.0)], "t string, d double"), ["t"]).collect())
    assert ranks == [1.5, 1.5, 3.0]


def test_last_wins_and_medians(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (2, 1, 3.0)], "u int, o int, score double")
    assert {r.u: r.score for r in stats.last_wins(rows, ["u"], ["o"]).collect()} == {1: 7.0, 2: 3.0}
    even = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "d double")
    assert even.agg(stats.upper_median("d").alias("m")).first().m == 3.0
    assert even.agg(F.percentile("d", 0.5).alias("m")).first().m == 2.5
    one = spark.createDataFrame([("a", 1.0)], "g string, score double")
    assert stats.tie_mass(one, ["g"]).first().tie_mass == 0.0


def test_normal_p_from_counts(spark):
    """Against the kernel, which sees every difference; ties and zeros included."""
    rng = random.Random(4)
    rows = [(t, u, rng.choice((0.0, 0.25, 0.5, -0.25, 1.0, -0.75))) for t in ("a", "b") for u in range(80)] + [("c", 0, 0.0), ("d", 0, 1.0)]
    tests = stats.normal_p(stats.signed_rank(spark.createDataFrame(rows, "t string, u int, d double"), ["t"]))
    got = {r.t: r.p for r in tests.collect()}
    assert got["c"] is None and got["d"] is None
    for t in ("a", "b"):
        assert abs(got[t] - k.signed_rank_p([d for x, _, d in rows if x == t])[1]) < 2e-7


def _scans(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet")


@pytest.mark.parametrize("name", ["confirmatory_family", "holm_family", "ladder_decomposition", "paired_signed_rank", "sign_survival", "holm_per_model", "per_model_split", "exact_signed_rank"])
def test_scores_once(spark, name):
    """The scores are computed once, for a test's signs and its ranks."""
    assert _scans(QUERIES[name](spark, SF), "lineitem") == 1


@pytest.mark.parametrize("name", ["exploratory_family", "sensitivity_worst_case", "hypothesis_grid"])
def test_scores_written(spark, name):
    """What reads the scores several times reads them, or what it needs of them, from a table."""
    assert _scans(registry.queries()[name](spark, SF), "lineitem") == 0


def test_last_wins_together(spark):
    """Taking an order's last row first gives the last row of all, ties in every column but the last one included."""
    rows = [("u", c, d, o, n, p, float(i)) for i, (c, d, o, n, p) in enumerate(itertools.product("xy", (1, 2), (5, 6, 7), (1, 2), (3, 9)))]
    df = spark.createDataFrame(rows, "unit string, cond string, day int, number int, line int, price int, score double").repartition(5)
    keys, order = ["unit", "cond"], ["day", "number", "line", "unit", "price"]
    want = {(r.unit, r.cond, r.score) for r in stats.last_wins(df, keys, order).collect()}
    for together in (1, 2):
        assert {(r.unit, r.cond, r.score) for r in stats.last_wins(df, keys, order, together=together).collect()} == want and len(want) == 2


def test_signs_of_sizes(spark):
    """Zeros and nulls count where they did: nulls as pairs, zeros as ties, neither in ranks."""
    df = spark.createDataFrame([("a", x) for x in (0.0, -0.0, 1.0, -1.0, 2.0, None)] + [("b", 0.0), ("c", None)], "t string, d double")
    out = {r.t: r for r in stats.signed_rank(df, ["t"]).collect()}
    assert [out["a"][c] for c in ("n_pairs", "n_pos", "n_neg", "n_tie", "w_plus", "w_minus", "tie_term")] == [6, 2, 1, 2, 4.5, 1.5, 6]
    assert [out["b"][c] for c in ("n_pairs", "n_tie", "w_plus", "tie_term", "r_rb")] == [1, 1, 0.0, 0, 0.0] and [out["c"][c] for c in ("n_pairs", "n_tie", "r_rb")] == [1, 0, 0.0]
