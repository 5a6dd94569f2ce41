"""The published family of nine tests, exact p from counts, intervals and power without a test's differences in one task."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from test_constraints import PUBLISHED

from trialframe.functions import kernels as k
from trialframe.operators import stats

# The published results (statistic, one-sided p, rank-biserial) and, for the third task, the non-zero differences
# of its 26 units.  The first task's differences are not published: its tests have 17 differences and the ties that their p tells.
RESULTS = {
    ("H1", "T1"): (84.0, 0.360757, 0.098039), ("H1", "T2"): (83.0, 0.022765, 0.580952), ("H1", "T3"): (15.0, 0.21875, 0.428571),
    ("H2", "T1"): (80.5, 0.258532, 0.183824), ("H2", "T2"): (63.0, 0.233427, 0.2), ("H2", "T3"): (0.0, 1.0, -1.0),
    ("H3", "T1"): (92.0, 0.388015, 0.076023), ("H3", "T2"): (24.0, 0.96875, -0.472527), ("H3", "T3"): (1.0, 0.9375, -0.8),
}
THIRD = {"H1": [7 / 9, -5 / 9, -1 / 22, -1 / 12, 1.0, 10 / 11], "H2": [-1 / 22, -1 / 12], "H3": [-7 / 9, 5 / 9, -1.0, -10 / 11]}
HYPOTHESES = [("H1", "C4", "C1+"), ("H2", "C4", "C1"), ("H3", "C1+", "C1")]


@pytest.fixture(scope="module")
def diffs(spark):
    rows = [(h, "T2", u, float(x)) for h, (d, *_) in PUBLISHED.items() for u, x in enumerate(d)]
    rows += [(h, "T3", u, x) for h, d in THIRD.items() for u, x in enumerate(d + [0.0] * (26 - len(d)))]
    return spark.createDataFrame(rows, "hypothesis string, task string, u int, d double")


def test_published_family(spark, diffs):
    """Six tests from their differences and three from their counts: all nine rows of the published result."""
    from pyspark.sql.types import DoubleType, IntegerType

    tests = stats.signed_rank_tests(diffs, ["hypothesis", "task"])
    n = {"H1": 17, "H2": 16, "H3": 18}
    first = []
    for h in n:
        w, p, r = RESULTS[h, "T1"]
        total = n[h] * (n[h] + 1) / 2
        # the ties are a multiple of six; the one whose p is nearest to the published
        at = lambda t: k.NormalDist().cdf(-(w - total / 2) / math.sqrt(n[h] * (n[h] + 1) * (2 * n[h] + 1) / 24 - t / 48))  # noqa: B023, E731
        ties = min(range(0, 3000, 6), key=lambda t: abs(at(t) - p))  # noqa: B023
        first.append((h, "T1", 30, 10, n[h] - 10, 30 - n[h], w, total - w, ties, (2 * w - total) / total))
    counted = spark.createDataFrame(first, "hypothesis string, task string, n_pairs long, n_pos long, n_neg long, n_tie long, w_plus double, w_minus double, tie_term long, r_rb double")
    family = tests.unionByName(stats.normal_p(counted).withColumn("status", F.lit("ok")))
    out = stats.decisions(family, spark.createDataFrame(HYPOTHESES, "hypothesis string, cond_a string, cond_b string"))
    assert out.columns[:10] == ["hypothesis", "task", "condition_A", "condition_B", "n_complete_pairs", "wilcoxon_statistic", "p_value_one_sided", "rank_biserial_r", "holm_bonferroni_rejected", "interpretation"]
    rows = out.collect()
    assert {(r.hypothesis, r.task): (r.wilcoxon_statistic, r.p_value_one_sided, r.rank_biserial_r) for r in rows} == RESULTS
    assert {(r.holm_bonferroni_rejected, r.interpretation) for r in rows} == {(False, stats.KEEP)} and {r.n_complete_pairs for r in rows if r.task == "T3"} == {26}
    assert {f.name for f in out.schema if isinstance(f.dataType, DoubleType | IntegerType)} == {"wilcoxon_statistic", "p_value_one_sided", "rank_biserial_r", "holm_p"}


def test_p_against_all_flips(spark):
    """Exact for small tests, with ties or without; the other sides; null for fewer than two."""
    rng = random.Random(8)
    own = {"a": [1.0, 2, -3, 4, 4, 0], "b": [float(rng.randint(-3, 3)) for _ in range(13)], "c": [rng.uniform(-1, 2) for _ in range(12)], "d": [0.0, 0.0, 1.0], "e": [2.0, 2.0], "f": [], "g": [rng.uniform(-1, 1.2) for _ in range(50)], "h": [rng.uniform(-1, 1.2) for _ in range(51)], "i": [rng.choice((-1.0, 0.5, 2.0)) for _ in range(14)]}
    df = spark.createDataFrame([(t, float(x)) for t, d in own.items() for x in d], "t string, d double")
    for side in ("greater", "less", "two-sided"):
        got = {r.t: r for r in stats.signed_rank_tests(df, ["t"], alternative=side).collect()}
        assert got["d"].p is None and got["d"].status == "insufficient_data" and "f" not in got
        for t in "abceghi":
            assert got[t].p == pytest.approx(k.signed_rank_p(own[t], side)[1], rel=1e-9), (t, side)
    d = [x for x in own["b"] if x]
    r = k.ranks(d)
    w = sum(x for x, y in zip(r, d) if y > 0)
    flips = [sum(x for x, up in zip(r, f) if up) >= w for f in itertools.product((0, 1), repeat=len(d))]
    assert stats.signed_rank_tests(df.where("t = 'b'"), ["t"]).first().p == pytest.approx(sum(flips) / len(flips))


def test_tail(spark):
    z = [-40.0, -9.5, -3.6, -3.5, -1.0, 0.0, 1e-9, 0.3, 2.0, 3.5, 3.6, 5.0, 12.0, 37.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.upper_tail(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-11)


def test_intervals(diffs, monkeypatch):
    """Near the published intervals, whose resamples are drawn by another order; the same rows at any partitioning; blocks of sizes are put together right."""
    got = {r.hypothesis: r for r in k.bootstrap_intervals(diffs.where("task = 'T2'").repartition(5), ["hypothesis"]).collect()}
    for h, (*_, (low, high)) in PUBLISHED.items():
        assert abs(got[h].ci_low - low) < 0.03 and abs(got[h].ci_high - high) < 0.03
    again = {r.hypothesis: r for r in k.bootstrap_intervals(diffs.where("task = 'T2'").coalesce(1), ["hypothesis"]).collect()}
    assert got == again
    spark = diffs.sparkSession
    rng = random.Random(1)
    many = [rng.gauss(0.2, 1) for _ in range(400)] + [0.0] * 20
    df = spark.createDataFrame([("x", d) for d in many] + [("y", 0.0), ("y", 0.0), ("y", 3.0), ("z", None)], "t string, d double")
    want = k.bootstrap_interval(many, 4000)
    for block in (5000, 37):
        monkeypatch.setattr(k, "BLOCK", block)
        out = {r.t: r for r in k.bootstrap_intervals(df, ["t"], resamples=4000).collect()}
        assert abs(out["x"].ci_low - want[0]) < 0.02 and abs(out["x"].ci_high - want[1]) < 0.02
        assert out["y"].ci_low is None and out["z"].ci_high is None


def test_power(spark):
    """Near the closed form; the columns agree with the functions."""
    df = spark.createDataFrame([("a", 28, 0.5), ("b", 60, 0.0), ("c", 12, 1.2)], "t string, n int, dz double")
    out = {r.t: r.power for r in k.power_simulation(df, ["t"], draws=400).collect()}
    assert abs(out["a"] - 0.8) < 0.08 and out["b"] < 0.1 and out["c"] > 0.9
    assert out == {r.t: r.power for r in k.power_simulation(df.repartition(7), ["t"], draws=400).collect()}
    row = spark.createDataFrame([(28, 0.5, 0.0)], "n int, dz double, z double").select(k.required_pairs(F.col("dz")).alias("r"), k.detectable(F.col("n")).alias("d"), k.required_pairs(F.col("z")).alias("none")).first()
    assert (row.r, row.none) == (k.required_n(0.5), None) and row.d == pytest.approx(k.detectable_effect(28))


def test_power_by_ranges(spark, monkeypatch):
    """A sample that is larger than what a task holds is summed up by ranges of sizes, with the result of the whole sample."""
    import numpy as np

    d = np.random.default_rng([5, 3]).normal(-0.3, 1.0, 200)
    df = spark.createDataFrame([("a", 200, 0.12), ("b", 20, 0.4), ("c", 1, None)], "t string, n int, dz double")
    want = {t: np.mean([k.signed_rank_p(np.random.default_rng([k.POWER_SEED, i]).normal(dz, 1.0, n))[1] < 0.05 for i in range(60)]) for t, n, dz in (("a", 200, 0.12), ("b", 20, 0.4))}
    for most in (1_000_000, 64, 7):
        monkeypatch.setattr(k, "SAMPLE", most)
        parts = [k._sample_sums([5, 3], 200, -0.3, i) for i in range(-(-200 // most))]
        assert sum(p[0] for p in parts) == 200 and sum(p[1] for p in parts) == (d > 0).sum() and sum(p[2] for p in parts) == k.signed_rank_p(d)[0]
        assert max(p[0] for p in parts) < 3 * most
        out = {r.t: r.power for r in k.power_simulation(df.where("n <> 20"), ["t"], draws=60).collect()}
        assert out["a"] == pytest.approx(want["a"]) and out["c"] == 0.0
    monkeypatch.setattr(k, "SAMPLE", 1_000_000)
    assert {r.t: r.power for r in k.power_simulation(df, ["t"], draws=60).collect()}["b"] == pytest.approx(want["b"])


def test_exploratory(spark, diffs):
    hyp = spark.createDataFrame(HYPOTHESES, "hypothesis string, cond_a string, cond_b string")
    d = diffs.withColumn("model_id", F.lit("m"))
    by = ["hypothesis", "task", "model_id"]
    out = stats.exploratory(d, by, hyp, k.bootstrap_intervals(d, by, resamples=500))
    assert out.columns == ["analysis", "hypothesis", "task", "cond_a", "cond_b", "model", "n_pairs", "n_pos", "n_neg", "n_tie", "median_diff", "statistic", "raw_p", "holm_p", "r_rb", "ci_low", "ci_high", "status"]
    row = {(r.hypothesis, r.task): r for r in out.collect()}
    assert row["H1", "T2"].raw_p == round(k.signed_rank_p(PUBLISHED["H1"][0], "two-sided")[1], 6) and row["H1", "T2"].ci_low < row["H1", "T2"].r_rb < row["H1", "T2"].ci_high
