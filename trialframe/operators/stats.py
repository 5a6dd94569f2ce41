"""Paired non-parametric statistics as lazy plans: dedup, cells, pairs, ranks, tests, corrections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def last_wins(scores: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "score", together: int = 0) -> DataFrame:
    """One row for each key: the value of the last row by ``order``.

    Partial results combine before the shuffle.  Where rows that agree in the first ``together`` columns of ``order`` lie in
    one task already, as after a join by one of them, their last row is taken there, and only those columns are shuffled with the value.
    """
    if together:
        near, order = order[:together], order[together:]
        # columns that are keys or near are the same in a group
        rest = [c for c in order if c not in keys]
        scores = scores.groupBy(*keys, *near).agg(F.max_by(value, F.struct(*rest)).alias(value))
        order = near
    return scores.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def cell_means(scores: DataFrame, keys: Sequence[str], value: str = "score", required: int | None = None) -> DataFrame:
    """Mean over the remaining keys (models); with ``required``, null unless so many are present."""
    mean = F.avg(value)
    if required is not None:
        mean = F.when(F.count(value) == required, mean)
    return scores.groupBy(*keys).agg(mean.alias(value))


def paired_differences(cells: DataFrame, hypotheses: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """hypothesis, keys and d = A - B for every key that has both conditions.

    ``hypotheses`` (hypothesis, cond_a, cond_b) is a short literal table; one pass over the cells
    and one aggregation replace the self-join.
    """
    both = cells.join(F.broadcast(hypotheses), (F.col("condition") == F.col("cond_a")) | (F.col("condition") == F.col("cond_b")))
    a = F.max(F.when(F.col("condition") == F.col("cond_a"), F.col(value)))
    b = F.max(F.when(F.col("condition") == F.col("cond_b"), F.col(value)))
    return both.groupBy("hypothesis", *keys).agg((a - b).alias("d")).where("d IS NOT NULL")


def mid_ranks(diffs: DataFrame, by: Sequence[str], d: str = "d") -> DataFrame:
    """Non-zero differences with the average rank ``r`` of their size.

    Sizes are counted first, so a window only sees distinct sizes, not rows.
    """
    sized = diffs.where(F.col(d) != 0).withColumn("__a", F.abs(d))
    counts = sized.groupBy(*by, "__a").agg(F.count("*").alias("__t"))
    upto = W.partitionBy(*by).orderBy("__a").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("r", F.sum("__t").over(upto) - (F.col("__t") - 1) / F.lit(2.0)).drop("__t")
    return sized.join(ranked, [*by, "__a"]).drop("__a")


def _sizes(diffs: DataFrame, by: Sequence[str], d: str) -> DataFrame:
    """Distinct sizes (__a, zero and null among them) with how many there are (__c), how many of them are positive (__up); and of those that rank, their number (__t), mid-rank (__r) and how many are not larger (__upto)."""
    t, x = F.col("__t"), F.col(d)
    sizes = diffs.groupBy(*by, F.abs(x).alias("__a")).agg(F.count("*").alias("__c"), F.count_if(x > 0).alias("__up"))
    upto = W.partitionBy(*by).orderBy("__a").rowsBetween(W.unboundedPreceding, 0)
    sizes = sizes.withColumn("__t", F.when(F.col("__a") > 0, F.col("__c")).otherwise(0))
    return sizes.withColumn("__upto", F.sum(t).over(upto)).withColumn("__r", F.col("__upto") - (t - 1) / F.lit(2.0))


def signed_rank(diffs: DataFrame, by: Sequence[str], d: str = "d") -> DataFrame:
    """Per test: n_pairs, n_pos, n_neg, n_tie, w_plus, w_minus, tie_term (sum of t^3 - t) and the rank-biserial r_rb (0 without a difference).

    Everything comes from the counts of distinct differences.
    """
    return _signed_rank(diffs, by, d).drop("__steps")


#: Up to so many differences p is exact if none tie, or in any case.
EXACT_UNTIED, EXACT_TIED = 50, 13


def _signed_rank(diffs: DataFrame, by: Sequence[str], d: str) -> DataFrame:
    """``signed_rank`` and __steps: the doubled ranks of the smallest ``EXACT_UNTIED`` differences, with repeats, all that an exact p needs."""
    t, up, r, c, a = (F.col(n) for n in ("__t", "__up", "__r", "__c", "__a"))
    steps = F.sort_array(F.collect_list(F.when((t > 0) & (F.col("__upto") <= EXACT_UNTIED), F.struct((2 * r).cast("int").alias("r"), t.cast("int").alias("t")))))
    # one pass over the sizes: a second one would compute the differences again
    out = _sizes(diffs, by, d).groupBy(*by).agg(
        F.sum(c).alias("n_pairs"), F.sum(up).alias("n_pos"), F.sum(t - up).alias("n_neg"), F.sum(F.when(a == 0, c).otherwise(0)).alias("n_tie"),
        F.sum(r * up).alias("w_plus"), F.sum(r * (t - up)).alias("w_minus"), F.sum(t * t * t - t).alias("tie_term"), steps.alias("__steps"))
    total = F.col("w_plus") + F.col("w_minus")
    r_rb = F.when(total == 0, 0.0).otherwise((F.col("w_plus") - F.col("w_minus")) / F.when(total == 0, 1.0).otherwise(total))
    return out.select(*by, "n_pairs", "n_pos", "n_neg", "n_tie", "w_plus", "w_minus", "tie_term", r_rb.alias("r_rb"), "__steps")


def _sided(above: Column, below: Column, alternative: str) -> Column:
    return {"greater": above, "less": below, "two-sided": F.least(F.lit(1.0), 2 * F.least(above, below))}[alternative]


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal variable is above z, to about fifteen digits: near 0 by the error function's series, beyond by its continued fraction."""
    x = F.abs(z) / 2**0.5
    start = F.struct(x.alias("sum"), x.alias("term"))
    step = lambda a, k: F.struct((a["sum"] + a["term"] * 2 * x * x / (2 * k + 3)).alias("sum"), (a["term"] * 2 * x * x / (2 * k + 3)).alias("term"))
    near = 0.5 - F.aggregate(F.sequence(F.lit(0), F.lit(70)), start, step)["sum"] * F.exp(-x * x) / math.pi**0.5
    far = F.exp(-x * x) / (2 * math.pi**0.5 * F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda a, k: x + k / 2.0 / a))
    half = F.when(x < 2.5, near).otherwise(far)
    return F.when(z >= 0, half).otherwise(1 - half)


def _z() -> Column:
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    return F.when((n >= 2) & (spread > 0), (F.col("w_plus") - n * (n + 1) / 4) / F.when(spread > 0, spread))


def normal_p(tests: DataFrame, alternative: str = "greater") -> DataFrame:
    """Adds p under the normal approximation with the tie term, from the counts alone, so a study of any size is tested where it lies; without two differences p is null."""
    return tests.withColumn("p", _sided(upper_tail(_z()), upper_tail(-_z()), alternative))


def _exact(steps: Column, w_plus: Column, alternative: str) -> Column:
    """p over all sign flips: the distribution of the doubled rank sum grows by one difference after another."""
    each = F.flatten(F.transform(steps, lambda s: F.array_repeat(s["r"], s["t"])))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    chances = F.aggregate(each, F.array(F.lit(1.0)), lambda have, r: F.zip_with(F.concat(have, zeros(r)), F.concat(zeros(r), have), lambda a, b: (a + b) / 2))
    at = (2 * w_plus).cast("int")
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    # the array of one element binds the distribution, which both tails read
    return F.transform(F.array(chances), lambda c: _sided(add(F.slice(c, at + 1, F.size(c))), add(F.slice(c, F.lit(1), at + 1)), alternative))[0]


def signed_rank_tests(diffs: DataFrame, by: Sequence[str], d: str = "d", alternative: str = "greater", also: Sequence[str] = ()) -> DataFrame:
    """``signed_rank`` with p and status (``ok``, or ``insufficient_data`` and a null p without two differences); p_<name> for each further alternative in ``also``.

    Up to 13 differences, or 50 without ties, p is exact over all sign flips, by a fold over at most
    50 ranks in the test's own row; beyond, it is the normal approximation with the tie term.  No task sees a test's differences, only counts of them.
    """
    n = F.col("n_pos") + F.col("n_neg")
    exact = (n <= EXACT_TIED) | ((n <= EXACT_UNTIED) & (F.col("tie_term") == 0))
    out = _signed_rank(diffs, by, d)
    for name, side in (("p", alternative), *((f"p_{x.replace('-', '_')}", x) for x in also)):
        p = F.when(n < 2, None).when(exact, _exact(F.col("__steps"), F.col("w_plus"), side)).otherwise(_sided(upper_tail(_z()), upper_tail(-_z()), side))
        out = out.withColumn(name, p)
    return out.withColumn("status", F.when(n < 2, "insufficient_data").otherwise("ok")).drop("__steps")


# What a decision says.
REJECT, KEEP = (f"{x} H₀ at α=0.05 (Holm–Bonferroni corrected)" for x in ("Reject", "Fail to reject"))
INSUFFICIENT = "Insufficient data"


def decisions(tests: DataFrame, hypotheses: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The rows of a confirmatory result: Holm over all ``tests`` (hypothesis, task and the columns of ``signed_rank_tests``), numbers to six digits after it.

    Columns in the order of the result file: hypothesis, task, condition_A, condition_B, n_complete_pairs, wilcoxon_statistic,
    p_value_one_sided, rank_biserial_r, holm_bonferroni_rejected, interpretation, then holm_p.  Without two differences statistic and p are null.
    """
    out = holm(tests, "p", ["hypothesis", "task"], alpha=alpha).join(F.broadcast(hypotheses), "hypothesis")
    enough, rejected = F.col("status") == "ok", F.col("holm_rejected")
    return out.select(
        "hypothesis", "task", F.col("cond_a").alias("condition_A"), F.col("cond_b").alias("condition_B"), F.col("n_pairs").alias("n_complete_pairs"), F.when(enough, F.col("w_plus")).alias("wilcoxon_statistic"), F.round("p", 6).alias("p_value_one_sided"),
        F.round("r_rb", 6).alias("rank_biserial_r"), rejected.alias("holm_bonferroni_rejected"), F.when(~enough, INSUFFICIENT).when(rejected, REJECT).otherwise(KEEP).alias("interpretation"), F.round("holm_p", 6).alias("holm_p"),
    )


def holm(tests: DataFrame, p: str, order: Sequence[str], family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds holm_p (running maximum of min(1, p * (m - k + 1))) and holm_rejected (stops at the first failure).

    A null or NaN p counts as 1.  ``order`` breaks ties; ``family`` holds the correction apart.
    """
    own = F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0))
    base = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    ordered = base.orderBy("__p", *order)
    upto = ordered.rowsBetween(W.unboundedPreceding, 0)
    left = F.count("*").over(base) - F.row_number().over(ordered) + 1
    out = tests.withColumn("__p", own).withColumn("__left", left)
    out = out.withColumn("holm_p", F.max(F.least(F.lit(1.0), F.col("__p") * F.col("__left"))).over(upto))
    return out.withColumn("holm_rejected", F.min(F.when(F.col("__p") <= alpha / F.col("__left"), 1).otherwise(0)).over(upto) == 1).drop("__p", "__left")


def exploratory(diffs: DataFrame, by: Sequence[str], hypotheses: DataFrame, intervals: DataFrame | None = None, analysis: str = "per_model") -> DataFrame:
    """The rows of an exploratory result over ``diffs`` (hypothesis, task, model_id, d): two-sided tests, Holm within a model, numbers to six digits.

    ``intervals`` (the keys, ci_low, ci_high) may come from ``kernels.bootstrap_intervals``; without it both are null.
    """
    tests = holm(signed_rank_tests(diffs, by, alternative="two-sided"), "p", ["hypothesis", "task"], family=["model_id"])
    out = tests.join(diffs.groupBy(*by).agg(F.percentile("d", 0.5).alias("median_diff")), list(by)).join(F.broadcast(hypotheses), "hypothesis")
    out = out.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")}) if intervals is None else out.join(intervals, list(by), "left")
    return out.select(
        F.lit(analysis).alias("analysis"), "hypothesis", "task", "cond_a", "cond_b", F.col("model_id").alias("model"), "n_pairs", "n_pos", "n_neg", "n_tie", "median_diff",
        F.when(F.col("status") == "ok", F.col("w_plus")).alias("statistic"), F.round("p", 6).alias("raw_p"), F.round("holm_p", 6).alias("holm_p"), F.round("r_rb", 6).alias("r_rb"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "status",
    )


def upper_median(value: str) -> Column:
    """The element at position n div 2 of the sorted values, from counts of distinct ones: the lower median of the negated values."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`)")


def demand_models(scores: DataFrame, keys: Sequence[str], required: int, value: str = "score") -> DataFrame:
    """``cell_means`` where every cell must have ``required`` models; reading a cell that lacks one raises."""
    lost = F.raise_error(F.concat(F.lit("models missing for "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))).cast("double")
    return scores.groupBy(*keys).agg(F.when(F.count(value) == required, F.avg(value)).otherwise(lost).alias(value))


def restrict_units(scores: DataFrame, units: DataFrame | None, key: str = "unit_id") -> DataFrame:
    """The scores of the given units; of all without a list."""
    return scores if units is None else scores.join(units.select(key).distinct(), key, "left_semi")


def tie_mass(scores: DataFrame, by: Sequence[str], value: str = "score", digits: int = 4) -> DataFrame:
    """n, distinct values and the share of pairs that tie (0.0 for fewer than two)."""
    counts = scores.groupBy(*by, value).agg(F.count("*").alias("c"))
    out = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("ties"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select(*by, "n", "n_distinct", F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("ties") / F.when(pairs == 0, 1.0).otherwise(pairs), digits)).alias("tie_mass"))


def worst_case(cells: DataFrame, grid: DataFrame, keys: Sequence[str], favoured: str, best: Column, value: str = "score") -> DataFrame:
    """Cells over a full grid; a missing score is 0 in the ``favoured`` condition and ``best`` in the other."""
    return grid.join(cells, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.when(F.col("condition") == favoured, F.lit(0.0)).otherwise(best)))
