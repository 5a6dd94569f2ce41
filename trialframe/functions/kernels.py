"""Numeric kernels that SQL lacks: exact and normal signed-rank p-values, bootstrap, power, similarity."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trialframe.operators import stats

#: Fixed seeds of the study.
BOOTSTRAP_SEED = 20260427
POWER_SEED = 20260616


def ranks(values: Sequence[float]) -> np.ndarray:
    """Average ranks of the values' sizes."""
    _, inverse, counts = np.unique(np.abs(np.asarray(values, dtype=float)), return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[inverse]


def rank_biserial(d: Sequence[float]) -> float:
    d = np.asarray(d, dtype=float)
    d = d[d != 0]
    if not len(d):
        return 0.0
    r = ranks(d)
    up, down = r[d > 0].sum(), r[d < 0].sum()
    return float((up - down) / (up + down))


def signed_rank_p(d: Sequence[float], alternative: str = "greater") -> tuple[float, float]:
    """(W+, p) of the signed-rank test; (NaN, NaN) for fewer than two non-zero differences.

    Up to 13 differences, or 50 without ties, p is exact over all sign flips of the (mid-)ranks;
    beyond, it is the normal approximation with the tie term and no continuity correction.
    """
    d = np.asarray(d, dtype=float)
    d = d[d != 0]
    n = len(d)
    if n < 2:
        return math.nan, math.nan
    r = ranks(d)
    w = float(r[d > 0].sum())
    _, counts = np.unique(np.abs(d), return_counts=True)
    tied = bool((counts > 1).any())
    if n <= 13 or n <= 50 and not tied:
        doubled = np.rint(2 * r).astype(int)
        ways = np.zeros(doubled.sum() + 1)
        ways[0] = 1.0
        for x in doubled:
            moved = np.zeros_like(ways)
            moved[x:] = ways[: len(ways) - x]
            ways = (ways + moved) / 2
        at = int(round(2 * w))
        above, below = float(ways[at:].sum()), float(ways[: at + 1].sum())
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((counts.astype(float) ** 3 - counts).sum()) / 48)
        z = (w - n * (n + 1) / 4) / sd
        above, below = 0.5 * math.erfc(z / math.sqrt(2)), 0.5 * math.erfc(-z / math.sqrt(2))
    return w, {"greater": above, "less": below, "two-sided": min(1.0, 2 * min(above, below))}[alternative]


def bootstrap_interval(d: Sequence[float], resamples: int = 10_000, seed: int = BOOTSTRAP_SEED, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the rank-biserial correlation over resamples of all differences, in their order, zeros included; NaN for fewer than two non-zero ones.

    Resamples are counted by distinct size and sign, many at a time, so ranks come from running counts.
    """
    d = np.asarray(d, dtype=float)
    if np.count_nonzero(d) < 2:
        return math.nan, math.nan
    sizes, code = np.unique(np.abs(d), return_inverse=True)
    k, draw, found = len(sizes), np.random.default_rng(seed), []
    rows = max(1, 2_000_000 // len(d))
    for first in range(0, resamples, rows):
        m = min(rows, resamples - first)
        at = draw.integers(0, len(d), size=(m, len(d)))
        slot = np.arange(m)[:, None] * k + code[at]
        count = np.bincount(slot.ravel(), minlength=m * k).reshape(m, k).astype(float)
        up = np.bincount(slot[d[at] > 0], minlength=m * k).reshape(m, k).astype(float)
        if sizes[0] == 0:
            count[:, 0] = 0
        rank = np.cumsum(count, axis=1) - (count - 1) / 2.0
        plus, total = (rank * up).sum(axis=1), (rank * count).sum(axis=1)
        found.append(np.where(total > 0, (plus - (total - plus)) / np.where(total > 0, total, 1.0), 0.0))
    low, high = np.quantile(np.concatenate(found), [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def required_n(dz: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Pairs that a one-sided signed-rank test needs for the effect dz, by its efficiency 3/pi."""
    z = NormalDist().inv_cdf
    return math.ceil(((z(1 - alpha) + z(power)) / dz) ** 2 / (3 / math.pi))


def detectable_effect(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    z = NormalDist().inv_cdf
    return (z(1 - alpha) + z(power)) / math.sqrt(n * 3 / math.pi)


def simulated_power(n: int, dz: float, alpha: float = 0.05, draws: int = 4000, seed: int = POWER_SEED) -> float:
    """Share of normal samples with mean dz for which the one-sided test rejects."""
    rng = np.random.default_rng(seed)
    return float(np.mean([signed_rank_p(rng.normal(dz, 1.0, n))[1] < alpha for _ in range(draws)]))


def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks, to six digits."""
    return 1.0 if a == b else round(SequenceMatcher(None, a, b).ratio(), 6)


#: Distinct sizes of a test that one row holds, and resamples that one task draws at a time.
BLOCK, CHUNK = 5_000, 250


def bootstrap_intervals(diffs: DataFrame, by: Sequence[str], d: str = "d", resamples: int = 10_000, seed: int = BOOTSTRAP_SEED, level: float = 0.95) -> DataFrame:
    """Per test: ci_low, ci_high, the percentile interval of the rank-biserial correlation; null for fewer than two non-zero differences.

    A resample is a multinomial draw of how often each distinct difference occurs, zeros included.  Sizes go
    in blocks of ``BLOCK`` and resamples in chunks of ``CHUNK``: a task draws a block's share of a chunk, with seeds
    of both, so the result doesn't depend on the partitions; ranks are put together from the counts of the blocks before.
    No task sees a test's differences.
    """
    keys = list(by)
    counts = diffs.where(F.col(d).isNotNull()).groupBy(*keys, F.abs(F.col(d)).alias("__a")).agg(F.count("*").alias("n"), F.count_if(F.col(d) > 0).alias("up"))
    place = W.partitionBy(*keys).orderBy("__a")
    blocks = counts.withColumn("block", F.floor((F.row_number().over(place) - 1) / BLOCK)).groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct("__a", "n", "up"))).alias("sizes"), F.sum("n").alias("total"), F.sum(F.when(F.col("__a") > 0, F.col("n")).otherwise(0)).alias("some"))
    parts = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "total"))).alias("parts"), F.sum("some").alias("some")).where("some >= 2").drop("some")
    work = blocks.join(parts, keys).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(CHUNK))))
    work = work.select(*keys, "block", "first", F.transform("sizes", lambda x: x["__a"]).alias("a"), F.transform("sizes", lambda x: x["n"]).alias("n"), F.transform("sizes", lambda x: x["up"]).alias("up"), F.transform("parts", lambda x: x["total"]).alias("parts"))
    kinds = dict(diffs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block bigint, draw int, found bigint, up bigint, plus double"])

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                m = min(CHUNK, resamples - row["first"])
                parts, n, up = (np.asarray(row[c], dtype=np.int64) for c in ("parts", "n", "up"))
                share = np.random.default_rng([seed, row["first"]]).multinomial(parts.sum(), parts / parts.sum(), size=m)[:, row["block"]]
                rng = np.random.default_rng([seed, row["first"], row["block"] + 1])
                odds = np.concatenate((up, n - up)) / n.sum()
                counted = rng.multinomial(share, odds)
                ups, all_ = counted[:, : len(n)], counted[:, : len(n)] + counted[:, len(n) :]
                if row["a"][0] == 0:  # the first size of the first block: no difference, no rank
                    ups, all_ = ups[:, 1:], all_[:, 1:]
                rank = np.cumsum(all_, axis=1) - (all_ - 1) / 2.0
                yield pd.DataFrame({k: [row[k]] * m for k in keys} | {"block": row["block"], "draw": np.arange(row["first"], row["first"] + m, dtype=np.int32), "found": all_.sum(axis=1), "up": ups.sum(axis=1), "plus": (rank * ups).sum(axis=1)})

    each = work.repartition(F.xxhash64(*keys, "block", "first")).mapInPandas(drawn, schema)
    before = F.coalesce(F.sum("found").over(W.partitionBy(*keys, "draw").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = each.withColumn("plus", F.col("plus") + before * F.col("up")).groupBy(*keys, "draw").agg(F.sum("plus").alias("plus"), F.sum("found").cast("double").alias("found"))
    total = F.col("found") * (F.col("found") + 1) / 2
    r = sums.select(*keys, F.when(total > 0, 2 * F.col("plus") / F.when(total > 0, total) - 1).otherwise(0.0).alias("r"))
    ends = r.groupBy(*keys).agg(F.percentile("r", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("x")).select(*keys, F.col("x")[0].alias("ci_low"), F.col("x")[1].alias("ci_high"))
    return diffs.select(*keys).distinct().join(ends, keys, "left")


def required_pairs(dz: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """``required_n`` of a column of effects; null for no effect."""
    z = NormalDist().inv_cdf
    return F.ceil((F.lit(z(1 - alpha) + z(power)) / F.when(dz != 0, dz)) ** 2 / (3 / math.pi))


def detectable(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """``detectable_effect`` of a column of numbers of pairs."""
    z = NormalDist().inv_cdf
    return F.lit(z(1 - alpha) + z(power)) / F.sqrt(n * (3 / math.pi))


#: Values of a drawn sample that a task holds at once, and draws of a design that go to one task.
SAMPLE, DRAWS = 1_000_000, 4


def _cut(share: float, dz: float) -> float:
    """The size below which ``share`` of a normal sample with mean dz lies."""
    if not 0 < share < 1 or math.isnan(dz):
        return 0.0 if share <= 0 else math.inf
    cdf, far = NormalDist().cdf, abs(dz)
    low, high = 0.0, far + 40.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid - far) - cdf(-mid - far) < share else (low, mid)
    return high


def _sample_sums(seed: Sequence[int], n: int, dz: float, part: int) -> tuple[int, int, float, float, float | None]:
    """Of the ``part``-th of all ranges of sizes of a drawn sample: non-zero differences, positive ones, their rank sum in the whole sample, the tie term; and p if the sample is small enough for an exact one.

    The sample is drawn ``SAMPLE`` values at a time and only the range's are kept, so a sample of any size takes the memory of one range.
    """
    parts = -(-n // SAMPLE)
    low, high = _cut(part / parts, dz), _cut((part + 1) / parts, dz)
    rng, below, kept = np.random.default_rng(seed), 0, []
    for first in range(0, n, SAMPLE):
        d = rng.normal(dz, 1.0, min(SAMPLE, n - first))
        size = np.abs(d)
        below += np.count_nonzero((size > 0) & (size < low))
        kept.append(d[(size > 0) & (size >= low) & (size < high)])
    d = np.concatenate(kept)
    _, inverse, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    up = np.bincount(inverse[d > 0], minlength=len(counts))
    rank = below + np.cumsum(counts) - (counts - 1) / 2.0
    p = signed_rank_p(d)[1] if n <= stats.EXACT_UNTIED and len(d) > 1 else None
    return len(d), int(up.sum()), float((rank * up).sum()), float((counts.astype(float) ** 3 - counts).sum()), p


def power_simulation(designs: DataFrame, by: Sequence[str], alpha: float = 0.05, draws: int = 4000, seed: int = POWER_SEED) -> DataFrame:
    """Per design (``by``, n pairs, effect dz): power, the share of normal samples for which the one-sided signed-rank test rejects.

    Every draw has a seed of its own and is a row of work, or several by ranges of sizes if it has more than ``SAMPLE`` values: a row
    gives the sums that a test needs, so no drawn value is shuffled.  Small samples are tested exactly where they are drawn.
    """
    keys = list(by)
    kinds = dict(designs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "draw int, found bigint, n_pos bigint, w_plus double, tie_term double, exact double"])
    names = [*keys, "draw", "found", "n_pos", "w_plus", "tie_term", "exact"]
    each = designs.where("n >= 1").select(*keys, F.col("n").cast("bigint").alias("n"), F.col("dz").cast("double").alias("dz"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    work = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / SAMPLE) - 1))).repartition(-(-draws // DRAWS), F.xxhash64(*keys, "draw", "part"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(row[k] for k in keys), row["draw"], *_sample_sums([seed, row["draw"]], row["n"], row["dz"], row["part"])) for row in b.to_dict("records")]
            yield pd.DataFrame(rows, columns=names).astype({"exact": "Float64"})

    total = work.mapInPandas(sums, schema).groupBy(*keys, "draw").agg(F.sum("n_pos").alias("n_pos"), F.sum(F.col("found") - F.col("n_pos")).alias("n_neg"), F.sum("w_plus").alias("w_plus"), F.sum("tie_term").alias("tie_term"), F.max("exact").alias("exact"))
    return stats.normal_p(total).groupBy(*keys).agg(F.avg(F.when(F.coalesce("exact", "p") < alpha, 1.0).otherwise(0.0)).alias("power"))


def similarity_column():
    """A column function of two texts, see ``similarity``; nulls are empty texts."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio


def _plain_function(source: str | None, name: str) -> str | None:
    """The dump of a function without its docstring, decorators and return annotation; None without the function."""
    try:
        found = next((x for x in ast.walk(ast.parse(source or "")) if isinstance(x, ast.FunctionDef) and x.name == name), None)
    except (SyntaxError, ValueError, RecursionError):
        return None
    if found is None:
        return None
    body = found.body[ast.get_docstring(found, clean=False) is not None :] or [ast.Pass()]
    return ast.dump(ast.fix_missing_locations(ast.FunctionDef(name=found.name, args=found.args, body=body, decorator_list=[], returns=None, type_comment=None)))


def structure_column():
    """A column function of two sources and a function's name: (status, ast_equivalent, similarity); ``not_applicable`` where either lacks the function."""

    @F.pandas_udf("status string, ast_equivalent boolean, similarity double")
    def compare(a: pd.Series, b: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, n in zip(a, b, name, strict=True):
            p = _plain_function(x, n)
            q = p if x == y else _plain_function(y, n)
            rows.append(("not_applicable", None, None) if p is None or q is None else ("ok", p == q, similarity(p, q)))
        return pd.DataFrame(rows, columns=["status", "ast_equivalent", "similarity"])

    return compare
