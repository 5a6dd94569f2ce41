"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words that a fixed mask selects from a place; the words between them may
differ.  Seeds of texts and of benchmark items are joined and counted on each diagonal (the
distance between the place in the text and that in the item).  A differing word spoils as many
seeds of a mask as the mask selects words, so an overlap has a number of seeds on its diagonal
that follows from its limits: diagonals with fewer are passed over without loss, and the others
are compared word by word over the whole item, tolerating substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, clear_of, written

#: Fixed masks: places of the words that a seed selects; the others are ignored.
MASKS = ((0, 1, 3), (0, 2, 3))
#: Words that a mask covers, and those that it selects; shorter items are one seed of all their words.
REACH, WEIGHT = 4, 3
#: Items of fewer words count only word for word.
SPAN = 12
#: Bits of the table of seeds; a benchmark that fills it only makes it choose more of them.
MOST_BITS = 1 << 20


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _seeds(words: Column, mask: tuple[int, ...]) -> Column:
    """Hash of the words that ``mask`` selects from each position; the mask is part of it."""
    fits = F.slice(words, F.lit(1), F.greatest(F.size(words) - mask[-1], F.lit(0)))
    return F.transform(fits, lambda x, i: F.xxhash64(F.lit(str(mask)), x, *(F.get(words, i + p) for p in mask[1:])))


def _masks(size: int) -> tuple[tuple[int, ...], ...]:
    """Masks of items of ``size`` words, REACH standing for all longer ones."""
    return MASKS if size >= REACH else (tuple(range(size)),)


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, item_words and item (a hash of both) of each item with words; an item that repeats counts once."""
    words = benchmark.select(F.col(item).alias("item_id"), word_hashes(F.col(text)).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return words.withColumn("item", F.xxhash64(F.col("item_id"), F.col("item_words")))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """item, n_words, item_at and gram (the hash) of every seed of the items."""
    placed = lambda own: F.transform(own, lambda g, i: F.struct(i.alias("item_at"), g.alias("gram")))
    words = F.col("item_words")
    own = F.when(F.size(words) >= REACH, F.concat(*(placed(_seeds(words, m)) for m in MASKS)))
    for size in range(1, REACH):
        own = own.when(F.size(words) == size, placed(_seeds(words, _masks(size)[0])))
    return items.select("item", F.size(words).alias("n_words"), F.explode(own).alias("s")).select("item", "n_words", "s.*")


def seed_bits(grams: DataFrame):
    """A test of a seed against all of the benchmark's, without false negatives.

    Two bits of a table stand for a seed.  Spark sets the bits; at most MOST_BITS of them, a
    bound on what the driver gets and plans carry, become a constant array of longs.
    """
    n = grams.select("gram").distinct().count()
    longs = min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length())) // 64
    width = longs.bit_length() - 1
    places = ((64 - width, 0), (64 - 2 * width - 6 if 64 - 2 * width - 6 > 6 else 7, 6))

    def slot(h: Column, shift: int) -> Column:
        return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(longs - 1).cast("long")).cast("int")

    def bit(h: Column, shift: int) -> Column:
        return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")

    set_bits = grams.select("gram").distinct().select(F.explode(F.array(*(F.struct(slot(F.col("gram"), x).alias("slot"), bit(F.col("gram"), y).alias("bit")) for x, y in places))).alias("s"))
    rows = set_bits.select("s.*").distinct().groupBy("slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).collect()
    held = [0] * longs
    for r in rows:
        held[r["slot"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        one, two = (F.getbit(F.get(table, slot(h, x)), bit(h, y)) == 1 for x, y in places)
        return one & two

    return test


def _spare(n: Column) -> Column:
    """Words of an item of ``n`` that may differ where the item is met as a whole: a fifth, none below SPAN words."""
    return F.when(n >= SPAN, F.floor(n / 5)).otherwise(0).cast("int")


def _least_seeds(n: Column, least_score: int) -> Column:
    """Equal seeds that the diagonal of an overlap has at least.

    A stretch of k words has k - REACH + 1 seeds of a mask, and each of its r differing words spoils
    WEIGHT of them at most.  A run has k >= least_score + 3 r (a match counts 1, another word -2),
    so least_score - REACH + 1 are left; an item met as a whole has k = n and r <= _spare(n).
    """
    long_one = F.least(F.lit(least_score), n - WEIGHT * _spare(n)) - (REACH - 1)
    return F.when(n >= REACH, F.greatest(F.lit(1), len(MASKS) * long_one)).otherwise(1)


def _best_run(words: Column, item: Column, start: Column, offset: Column, size: Column) -> Column:
    """Best run of the diagonal as a struct: score (a match 1, a mismatch -2), matches, and first and last position in the text."""
    nothing = F.struct(F.lit(0).alias("score"), F.lit(0).alias("matches"), F.lit(0).alias("first"), F.lit(-1).alias("last"))
    zero = F.struct(nothing.alias("best"), nothing.alias("now"))

    def step(state: Column, k: Column) -> Column:
        at = start + k
        same = F.get(words, at) == F.get(item, at + offset)
        fresh = state["now"]["score"] <= 0
        score = F.when(fresh, 0).otherwise(state["now"]["score"]) + F.when(same, 1).otherwise(-2)
        now = F.struct(
            score.alias("score"),
            (F.when(fresh, 0).otherwise(state["now"]["matches"]) + F.when(same, 1).otherwise(0)).alias("matches"),
            F.when(fresh, at).otherwise(state["now"]["first"]).alias("first"),
            at.alias("last"),
        )
        return F.struct(F.when(now["score"] > state["best"]["score"], now).otherwise(state["best"]).alias("best"), now.alias("now"))

    return F.aggregate(F.sequence(F.lit(0), size - 1), zero, step, lambda s: s["best"])


def leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = 13, least_score: int = 10) -> DataFrame:
    """A row for each row of ``docs`` and benchmark item that overlap: ``keep``, item_id, matches, first and last word.

    Text and item are compared word by word along each diagonal, over the whole item.  They overlap
    where the best run, in which a matching word counts 1 and another one -2, scores ``least_score``
    and matches ``least`` words, or where all words of the item but a fifth match; an item of fewer
    than SPAN words must match word for word, whatever its length.  The run is given, or else the
    matches of the whole item.  Of several places of an item the one with most matches is given (of
    equal ones the first).  Null texts are empty, and empty items overlap with nothing.  Rows of
    ``docs`` that agree in ``keep`` give one row for an item.

    The benchmark's seeds are broadcast while they are at most BROADCAST_ROWS rows, else the join
    shuffles the seeds of the texts; only seeds that the benchmark has leave the scan.  ``docs`` is
    read twice: for the seeds, and for the words of the texts in which diagonals have enough.
    Texts of any length are compared whole.  Empty tables give no rows; columns of ``docs`` other
    than ``keep`` and ``text`` are not looked at, and ``keep`` must not name one that is added (ValueError).
    """
    clear_of(keep, "item_id", "matches", "first_word", "last_word")
    if least_score < REACH:
        raise ValueError(f"least_score must be {REACH} or more: runs that score less need not share a seed")
    items = benchmark_items(benchmark)
    grams = written(benchmark_seeds(items), "decontaminate-seeds")
    few = grams.count() <= BROADCAST_ROWS
    sizes = sorted(r[0] for r in grams.select(F.least("n_words", F.lit(REACH))).distinct().collect())
    masks = [m for k in sizes for m in _masks(k)]
    table = seed_bits(grams)
    keyed = docs.select(*keep, F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__t"))
    words = keyed.select("__t", word_hashes(F.col("__text")).alias("__w"))
    words = words.select("__t", *(_seeds(F.col("__w"), m).alias(f"__g{k}") for k, m in enumerate(masks)))
    chosen = [F.filter(F.transform(F.col(f"__g{k}"), lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda s: table(s["gram"])) for k in range(len(masks))]
    none = F.array().cast("array<struct<at:int,gram:bigint>>")
    found = words.select("__t", F.explode(F.concat(none, *chosen)).alias("s")).select("__t", "s.*")
    off = (F.col("at") - F.col("item_at")).alias("off")
    hits = found.join(F.broadcast(grams) if few else grams, "gram").groupBy("__t", "item", "n_words", off).agg(F.count("*").alias("seeds"))
    hits = hits.where(F.col("seeds") >= _least_seeds(F.col("n_words"), least_score))
    hits = written(hits.groupBy("__t").agg(F.collect_list(F.struct("item", "off")).alias("hits")), "decontaminate-hits")
    near = (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_ROWS
    hits = F.broadcast(hits) if near else hits
    near = keyed.join(hits, "__t")
    near = near.select(*keep, word_hashes(F.col("__text")).alias("__w"), "hits")
    near = near.select(*keep, "__w", F.explode("hits").alias("hit")).select(*keep, "__w", "hit.*")
    near = near.join(F.broadcast(items) if few else items, "item")
    # along the diagonal: the position in the text is that in the item plus ``off``
    low = F.greatest(F.lit(0), F.col("off"))
    high = F.least(F.size("__w"), F.size("item_words") + F.col("off"))
    run = _best_run(F.col("__w"), F.col("item_words"), low, -F.col("off"), high - low)
    same = F.filter(F.sequence(low, high - 1), lambda q: F.get(F.col("__w"), q) == F.get(F.col("item_words"), q - F.col("off")))
    near = near.withColumns({"run": run, "same": same})
    whole = F.struct(F.size("same").alias("matches"), F.get("same", F.lit(0)).alias("first"), F.element_at("same", -1).alias("last"))
    long_run = (F.col("run.score") >= least_score) & (F.col("run.matches") >= least)
    all_of_it = F.size("same") >= F.size("item_words") - _spare(F.size("item_words"))
    near = near.where(F.size("same") > 0).select(*keep, "item_id", F.when(long_run, F.struct("run.matches", "run.first", "run.last")).when(all_of_it, whole).alias("o")).where("o IS NOT NULL")
    best = F.max(F.struct(F.col("o.matches").alias("matches"), (-F.col("o.first")).alias("first"), F.col("o.last").alias("last"))).alias("b")
    out = near.groupBy(*keep, "item_id").agg(best)
    return out.select(*keep, "item_id", F.col("b.matches").cast("long").alias("matches"), (-F.col("b.first")).cast("long").alias("first_word"), F.col("b.last").cast("long").alias("last_word"))
