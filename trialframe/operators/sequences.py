"""Ordered-sequence operators over the long form (seq_id, pos, v): pos counts from 0 in each sequence.

Every operator takes a DataFrame and column names and returns a lazy DataFrame.  Empty sequences
have no rows, so operators whose result for them is a value give no row either.  Lists are built
by sorting collected (pos, value) structs, never by relying on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

S, P = "seq_id", "pos"


def w(seq: str = S, pos: str = P):
    return W.partitionBy(seq).orderBy(pos)


#: Positions of a sequence that one window partition takes.
BLOCK = 100_000


def _blocked(df: DataFrame, block: int | None) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(P) / (block or BLOCK)))


def previous(df: DataFrame, value: str, out: str, seq: str = S, block: int | None = None, following: bool = False) -> DataFrame:
    """Adds the value at the previous (``following``: next) position, null at the border.

    Windows are cut into blocks of positions, and the value at a block's edge comes over by a join
    of one row for each block, so a sequence of any length spreads over many tasks.
    """
    own = _blocked(df, block)
    edge = F.min_by(F.struct(F.col(value).alias("v")), P) if following else F.max_by(F.struct(F.col(value).alias("v")), P)
    edges = own.groupBy(seq, "__b").agg(edge.alias("__e")).withColumn("__b", F.col("__b") - 1 if following else F.col("__b") + 1)
    order = W.partitionBy(seq, "__b").orderBy(P)
    step = F.lead(F.struct(F.col(value).alias("v"))).over(order) if following else F.lag(F.struct(F.col(value).alias("v"))).over(order)
    return own.withColumn("__s", step).join(edges, [seq, "__b"], "left").withColumn(out, F.coalesce("__s", "__e")["v"]).drop("__s", "__e", "__b")


def running(df: DataFrame, value: str | list[str], out: str | list[str], how: str = "sum", seq: str = S, block: int | None = None) -> DataFrame:
    """Adds the running sum, min or max of a value (of a list of values, by one pass), by blocks as in ``previous``: block totals are summed up apart and joined back."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[how]
    values, outs = ([x] if isinstance(x, str) else x for x in (value, out))
    own = _blocked(df, block)
    before = W.partitionBy(seq).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = own.groupBy(seq, "__b").agg(*(fold(v).alias(f"__t{k}") for k, v in enumerate(values)))
    totals = totals.select(seq, "__b", *(fold(f"__t{k}").over(before).alias(f"__o{k}") for k in range(len(values))))
    upto = W.partitionBy(seq, "__b").orderBy(P).rowsBetween(W.unboundedPreceding, 0)
    inner = {f"__i{k}": fold(v).over(upto) for k, v in enumerate(values)}
    joined = own.withColumns(inner).join(totals, [seq, "__b"], "left")
    return joined.withColumns({o: both(F.col(f"__i{k}"), F.col(f"__o{k}")) for k, o in enumerate(outs)}).drop("__b", *inner, *(f"__o{k}" for k in range(len(values))))


def in_order(value: str | Column, pos: str | Column = P) -> Column:
    """The values of a group as a list in the order of ``pos``."""
    value, pos = (F.col(x) if isinstance(x, str) else x for x in (value, pos))
    return F.transform(F.sort_array(F.collect_list(F.struct(pos.alias("p"), value.alias("x")))), lambda s: s["x"])


def text(values: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), by)


# -- grouping -----------------------------------------------------------------------------------
def group_by_key(df: DataFrame, key: str, value: str, seq: str = S) -> DataFrame:
    """Key to list of values in order, with the position at which the key is first seen."""
    return df.groupBy(seq, key).agg(F.min(P).alias("first_pos"), in_order(value).alias("values"))


def group_and_aggregate(df: DataFrame, key: str, value: str, seq: str = S) -> DataFrame:
    """count, sum, min, max (and mean and range) of each key, keys ranked by first sight."""
    v = F.col(value)
    return df.groupBy(seq, key).agg(F.min(P).alias("first_pos"), F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("range"))


def frequency_table(df: DataFrame, value: str, seq: str = S, by_count: bool = False) -> DataFrame:
    """(value, count, cumulative fraction, place) by value, or by falling count then value."""
    counts = df.groupBy(seq, value).agg(F.count("*").alias("n"))
    order = [F.desc("n"), value] if by_count else [value]
    own = W.partitionBy(seq)
    upto = own.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumns({"cumulative": F.sum("n").over(upto) / F.sum("n").over(own), "place": F.row_number().over(own.orderBy(*order))})


# -- ranking and choosing -----------------------------------------------------------------------
def dense_rank(df: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    """Adds dense_rank (ascending) and competition_rank (descending); equal values are counted first, so windows see distinct values only."""
    own = W.partitionBy("__seq")
    above = F.sum("__n").over(own.orderBy(F.desc("__value")).rowsBetween(W.unboundedPreceding, -1))
    counts = df.groupBy(F.col(seq).alias("__seq"), F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    ranks = counts.withColumns({"dense_rank": F.dense_rank().over(own.orderBy("__value")), "competition_rank": F.coalesce(above, F.lit(0)) + 1})
    return df.join(ranks, F.col(seq).eqNullSafe(F.col("__seq")) & F.col(value).eqNullSafe(F.col("__value"))).drop("__seq", "__value", "__n")


def top_k_by(df: DataFrame, k: int, key: str | Column = "v", tiebreak: str | Column = P, seq: str = S, bottom: bool = False) -> DataFrame:
    """The k rows with the largest (smallest) key, ties by tiebreak, then position; none for k <= 0."""
    key = F.col(key) if isinstance(key, str) else key
    tie = F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak
    order = W.partitionBy(seq).orderBy(key.asc() if bottom else key.desc(), tie, P)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def index_of_max(df: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    """First and last position of the largest value."""
    return df.groupBy(seq).agg(F.max_by(P, F.struct(value, -F.col(P))).alias("first_index"), F.max_by(P, F.struct(value, P)).alias("last_index"))


# -- windows ------------------------------------------------------------------------------------
def sliding_window_max(df: DataFrame, k: int, value: str = "v", seq: str = S) -> DataFrame:
    """Largest value of every full window of k rows and its leftmost place; no row for k < 1."""
    if k < 1:
        return df.select(seq, P, F.col(value).alias("window_max"), F.col(P).alias("window_argmax")).where("false")
    # blocks of positions; the first rows of a block are known to the one before, whose last windows reach them
    size = max(BLOCK, k)
    block = F.floor(F.col(P) / size)
    dealt = df.withColumn("__b", F.explode(F.sequence(F.greatest(F.floor((F.col(P) - (k - 1)) / size), F.lit(0)), block)))
    frame = W.partitionBy(seq, "__b").orderBy(P).rowsBetween(0, k - 1)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(P)).alias("p"))).over(frame)
    own = dealt.withColumns({"__m": best, "__n": F.count("*").over(frame)}).where((F.col("__n") == k) & (F.col("__b") == block))
    return own.select(seq, P, F.col("__m.v").alias("window_max"), (-F.col("__m.p")).alias("window_argmax"))


def strided_windows(df: DataFrame, size: int, stride: int, value: str = "v", seq: str = S, partial: bool = False) -> DataFrame:
    """Windows from 0, stride, 2 * stride, ... as lists; with ``partial`` also the first one that the end cuts.

    A row goes to the windows that hold it (size / stride of them), which are then grouped; no window of a whole sequence is sorted.
    """
    first = F.greatest(F.ceil((F.col(P) - (size - 1)) / stride), F.lit(0)).cast("long")
    last = F.floor(F.col(P) / stride).cast("long")
    starts = F.transform(F.sequence(F.least(first, last), last), lambda x: x * stride)
    held = df.select(seq, F.col(P).alias("__p"), F.col(value).alias("__v"), F.explode(F.filter(starts, lambda x: F.col(P) < x + size)).alias(P))
    own = held.groupBy(seq, P).agg(in_order("__v", "__p").alias("window"))
    own = own.join(df.groupBy(seq).agg(F.count("*").alias("__n")), seq)
    full = F.col(P) + size <= F.col("__n")
    first_cut = ~full & ((F.col(P) == 0) | (F.col(P) - stride + size <= F.col("__n")))
    return own.where(full | first_cut if partial else full).select(seq, P, "window")


def batch_list(df: DataFrame, n: int, value: str = "v", seq: str = S) -> DataFrame:
    """Chunks of n rows as lists, the last may be shorter; none for n < 1."""
    if n < 1:
        return df.select(seq, F.col(P).alias("batch"), F.array(value).alias("items")).where("false")
    return df.groupBy(seq, F.floor(F.col(P) / n).alias("batch")).agg(in_order(value).alias("items"))


def running_stats(df: DataFrame, value: str = "v", seq: str = S, block: int | None = None) -> DataFrame:
    """Running count, mean, population variance and sample variance (0.0 for one row), by blocks as in ``previous``.

    A block's count, mean and squared deviations are joined with those of all blocks before, around the sequence's mean, so nothing large cancels.
    """
    centre = df.groupBy(seq).agg(F.avg(value).alias("__c"))
    own = _blocked(df.join(centre, seq), block).withColumn("__x", F.col(value) - F.col("__c"))
    parts = own.groupBy(seq, "__b").agg(F.count("__x").alias("__k"), F.sum("__x").alias("__s"), F.coalesce(F.sum(F.col("__x") * F.col("__x")), F.lit(0.0)).alias("__q"))
    before = W.partitionBy(seq).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(seq, "__b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__k", "__s", "__q")))
    upto = W.partitionBy(seq, "__b").orderBy(P).rowsBetween(W.unboundedPreceding, 0)
    out = own.withColumns({"__n": F.count("__x").over(upto), "__m": F.avg("__x").over(upto), "__v": F.var_pop("__x").over(upto)}).join(parts, [seq, "__b"])
    n, k = F.col("__n") + F.col("__k"), F.col("__k")
    own_mean, old_mean = F.coalesce("__m", F.lit(0.0)), F.try_divide("__s", k.cast("double"))
    apart = own_mean - F.coalesce(old_mean, F.lit(0.0))
    squares = F.coalesce("__v", F.lit(0.0)) * F.col("__n") + F.greatest(F.col("__q") - F.coalesce(F.col("__s") * old_mean, F.lit(0.0)), F.lit(0.0)) + apart * apart * F.try_divide((F.col("__n") * k).cast("double"), n.cast("double"))
    mean = F.try_divide(own_mean * F.col("__n") + F.col("__s"), n.cast("double")) + F.col("__c")
    out = out.withColumns({"n": n, "mean": mean, "var_pop": F.try_divide(squares, n.cast("double")), "var_samp": F.coalesce(F.try_divide(squares, n - 1.0), F.lit(0.0))})
    return out.drop("__b", "__c", "__x", "__k", "__s", "__q", "__n", "__m", "__v")


# -- runs and islands ---------------------------------------------------------------------------
def islands(df: DataFrame, value: str, seq: str = S, block: int | None = None) -> DataFrame:
    """Adds ``island``: the number of the run of equal values that a row belongs to; nulls equal nulls."""
    changed = ~F.col(value).eqNullSafe(F.col("__p")) | (F.col(P) == 0)
    return running(previous(df, value, "__p", seq, block).withColumn("__c", changed.cast("int")), "__c", "island", "sum", seq, block).drop("__c", "__p")


def rle_encode(df: DataFrame, value: str, seq: str = S) -> DataFrame:
    """Runs in order: value, length, start and end."""
    return islands(df, value, seq).groupBy(seq, "island", value).agg(F.count("*").alias("length"), F.min(P).alias("start"), F.max(P).alias("end"))


def chunk_on_change(df: DataFrame, key: str, value: str, seq: str = S) -> DataFrame:
    """Lists of values, a new one whenever the key changes, with their key."""
    return islands(df, key, seq).groupBy(seq, "island", key).agg(in_order(value).alias("chunk"))


def remove_adjacent_dups(df: DataFrame, value: str, seq: str = S) -> DataFrame:
    """The list without repeated neighbours, and how many rows that removes."""
    own = islands(df, value, seq)
    first = F.min(P).alias("p")
    runs = own.groupBy(seq, "island", value).agg(first, F.count("*").alias("n"))
    return runs.groupBy(seq).agg(in_order(value, "p").alias("kept"), (F.sum("n") - F.count("*")).alias("removed"))


def true_segments(df: DataFrame, flag: str | Column, seq: str = S) -> DataFrame:
    """Number of runs of true and their lengths in order (0 and an empty list without one)."""
    flag = F.expr(flag) if isinstance(flag, str) else flag
    runs = rle_encode(df.withColumn("__f", F.coalesce(flag, F.lit(False))), "__f", seq)
    # sort_array keeps only runs of true
    held = F.sort_array(F.collect_list(F.when(F.col("__f"), F.struct("start", "length"))))
    return runs.groupBy(seq).agg(F.count_if("__f").alias("segments"), F.transform(held, lambda s: s["length"]).alias("lengths"))


def segments_above(df: DataFrame, threshold, value: str = "v", seq: str = S) -> DataFrame:
    """Maximal runs with value > threshold: start and end."""
    own = df.where(F.col(value) > threshold)
    island = F.col(P) - F.row_number().over(w(seq))
    return own.withColumn("__i", island).groupBy(seq, "__i").agg(F.min(P).alias("start"), F.max(P).alias("end")).drop("__i")


def longest_plateau(df: DataFrame, value: str, seq: str = S) -> DataFrame:
    """The longest run (start, end, value): the earliest of equal ones, and the latest."""
    runs = rle_encode(df, value, seq)
    out = F.struct(F.col("start"), F.col("end"), F.col(value).alias("value"))
    early, late = F.max_by(out, F.struct("length", -F.col("start"))), F.max_by(out, F.struct("length", "start"))
    picked = runs.groupBy(seq).agg(early.alias("e"), late.alias("l"))
    return picked.select(seq, *(F.col(f"{k}.{c}").alias(f"{n}_{c}") for k, n in (("e", "first"), ("l", "last")) for c in ("start", "end", "value")))


def peaks_and_valleys(df: DataFrame, value: str = "v", seq: str = S, block: int | None = None) -> DataFrame:
    """Rows strictly above or strictly below both neighbours; borders are neither."""
    own = previous(previous(df, value, "__l", seq, block), value, "__r", seq, block, following=True)
    v, a, b = F.col(value), F.col("__l"), F.col("__r")
    kind = F.when((v > a) & (v > b), "peak").when((v < a) & (v < b), "valley")
    return own.withColumn("kind", kind).where("kind IS NOT NULL").select(seq, P, "kind")


def is_sorted(df: DataFrame, value: str = "v", seq: str = S, block: int | None = None) -> DataFrame:
    """Whether each sequence is non-decreasing, and strictly ascending."""
    before = previous(df, value, "__a", seq, block)
    return before.groupBy(seq).agg(F.coalesce(F.bool_and(F.col(value) >= F.col("__a")), F.lit(True)).alias("sorted"), F.coalesce(F.bool_and(F.col(value) > F.col("__a")), F.lit(True)).alias("strictly"))


def merge_intervals(df: DataFrame, start: str, end: str, seq: str = S) -> DataFrame:
    """Unions of intervals that overlap or touch."""
    order = W.partitionBy(seq).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    own = df.select(seq, F.col(start).alias("start"), F.col(end).alias("end"), F.when(F.col(start) <= reach, 0).otherwise(1).alias("__new"))
    order = W.partitionBy(seq).orderBy("start", "end")
    return own.withColumn("__g", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(seq, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def points_covered(df: DataFrame, start: str, end: str, seq: str = S) -> DataFrame:
    """Integer points that the intervals cover, ends included."""
    return merge_intervals(df, start, end, seq).groupBy(seq).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def _sums(df: DataFrame, value: str, seq: str, block: int | None = None) -> DataFrame:
    return running(df.select(seq, P, F.col(value).alias("__v")), "__v", "__s", "sum", seq, block)


def max_subarray(df: DataFrame, value: str = "v", seq: str = S, block: int | None = None) -> DataFrame:
    """(start, end, total) of the largest sum: among equals the first to end, from its earliest start."""
    own = _sums(df, value, seq, block).withColumn("__x", F.struct((F.col("__s") - F.col("__v")).alias("s"), F.col(P).alias("p")))
    own = running(own, "__x", "__m", "min", seq, block)
    total = F.col("__s") - F.col("__m.s")
    return own.groupBy(seq).agg(F.max(F.struct(total.alias("t"), (-F.col(P)).alias("e"), F.col("__m.p").alias("a"))).alias("b")).select(seq, F.col("b.a").alias("start"), (-F.col("b.e")).alias("end"), F.col("b.t").alias("total"))


def all_max_subarrays(df: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    """Every (start, end, total) with the largest sum; where all values are negative only single elements.

    A start with sum s before it can only pair with an end whose sum is s + largest: an equi-join
    on the sum, not a comparison of all pairs.
    """
    best = max_subarray(df, value, seq).select(seq, "total")
    own = _sums(df, value, seq).join(best, seq)
    starts = own.select(seq, F.col(P).alias("start"), (F.col("__s") - F.col("__v") + F.col("total")).alias("__t"), "total")
    ends = own.select(seq, F.col(P).alias("end"), F.col("__s").alias("__t"))
    found = starts.join(ends, [seq, "__t"]).where((F.col("end") >= F.col("start")) & ((F.col("total") >= 0) | (F.col("end") == F.col("start"))))
    return found.select(seq, "start", "end", "total")


# -- lists as bags ------------------------------------------------------------------------------
def merge_sorted(a: DataFrame, b: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    """All values of both lists, with their place in the merged order."""
    both = a.select(seq, value).unionByName(b.select(seq, value))
    return both.withColumn("place", F.row_number().over(W.partitionBy(seq).orderBy(value)) - 1)


def in_one_list(a: DataFrame, b: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    """Values of exactly one list; those that repeat in it repeat here."""
    x, y = a.select(seq, value), b.select(seq, value)
    return x.join(y, [seq, value], "left_anti").unionByName(y.join(x, [seq, value], "left_anti"))


def bag_intersection(a: DataFrame, b: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    return a.select(seq, value).intersectAll(b.select(seq, value))


def bag_difference(a: DataFrame, b: DataFrame, value: str = "v", seq: str = S) -> DataFrame:
    """Multiset symmetric difference."""
    x, y = a.select(seq, value), b.select(seq, value)
    return x.exceptAll(y).unionAll(y.exceptAll(x))


def two_sum(df: DataFrame, target: int, value: str = "v", seq: str = S) -> DataFrame:
    """Index pairs i < j whose values sum to the target: an equi-join on the missing part."""
    a = df.select(seq, F.col(P).alias("i"), F.col(value).alias("a"), (F.lit(target) - F.col(value)).alias("__need"))
    b = df.select(seq, F.col(P).alias("j"), F.col(value).alias("b"), F.col(value).alias("__need"))
    return a.join(b, [seq, "__need"]).where("i < j").select(seq, "i", "j", "a", "b")


def two_sum_pairs(df: DataFrame, target: int, value: str = "v", seq: str = S) -> DataFrame:
    """Distinct value pairs a <= b that sum to the target; values are counted first, so repeats make no pairs."""
    counts = df.groupBy(seq, value).agg(F.count("*").alias("n"))
    a = counts.select(seq, F.col(value).alias("a"), "n", (F.lit(target) - F.col(value)).alias("b"))
    b = counts.select(seq, F.col(value).alias("b"))
    return a.join(b, [seq, "b"]).where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n") > 1))).select(seq, "a", "b")


def stable_partition(df: DataFrame, predicate: str | Column, value: str = "v", seq: str = S) -> DataFrame:
    """Values that fit and values that don't, each in order; a null predicate doesn't fit."""
    p = F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))
    keep = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(P, value)))), lambda s: s[value])
    return df.groupBy(seq).agg(keep(p).alias("matching"), keep(~p).alias("rest"))


def rotate_list(df: DataFrame, k: int, value: str = "v", seq: str = S, right: bool = False) -> DataFrame:
    """Rows with the position that they have after a rotation by k."""
    sized = df.join(df.groupBy(seq).agg(F.count("*").alias("__n")), seq)
    return sized.select(seq, F.pmod(F.col(P) + k if right else F.col(P) - k, F.col("__n")).alias(P), value)


def buckets(df: DataFrame, n: int, value: str = "v", seq: str = S) -> DataFrame:
    """equal_width: the bucket of n between least and largest value (0 if all are equal); quantile: n parts of equal size, ties go to the lower."""
    own = W.partitionBy(seq)
    low, high = F.min(value).over(own), F.max(value).over(own)
    width = (high - low) / F.lit(float(n))
    out = df.withColumn("equal_width", F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - low) / F.when(width == 0, 1.0).otherwise(width)), F.lit(n - 1))).cast("int"))
    out = out.withColumn("__t", F.ntile(n).over(own.orderBy(value, P)) - 1)
    return out.withColumn("quantile", F.min("__t").over(W.partitionBy(seq, value))).drop("__t")


def clamp(value: Column, low: Column, high: Column, strict: bool = False) -> Column:
    """The low guard first, then the high one; ``strict`` raises where low > high."""
    out = F.when(value < low, low).when(value > high, high).otherwise(value)
    return F.when(low > high, F.raise_error(F.lit("clamp: low > high"))).otherwise(out) if strict else out


# -- matrices (m_id, r, c, v) -------------------------------------------------------------------
def antidiagonals(df: DataFrame, value: str = "v") -> DataFrame:
    """Values by r + c; rows ascending, and descending."""
    up, down = in_order(value, "r"), in_order(value, -F.col("r"))
    return df.groupBy("m_id", (F.col("r") + F.col("c")).alias("diagonal")).agg(up.alias("downwards"), down.alias("upwards"))


def _spiral(r: Column, c: Column, rows: Column, cols: Column) -> tuple[Column, Column]:
    ring = F.least(r, c, rows - 1 - r, cols - 1 - c)
    h, v = rows - 2 * ring, cols - 2 * ring
    right, down = c - ring, r - ring
    step = (
        F.when(down == 0, right)
        .when(right == v - 1, v - 1 + down)
        .when(down == h - 1, v - 1 + h - 1 + (v - 1 - right))
        .otherwise(2 * (v - 1) + h - 1 + (h - 1 - down))
    )
    return ring, step


def spiral_order(df: DataFrame, value: str = "v") -> DataFrame:
    """Values on the clockwise spiral from the first corner, and counter-clockwise, by a closed form of each cell's place."""
    own = W.partitionBy("m_id")
    sized = df.withColumns({"__h": F.max("r").over(own) + 1, "__w": F.max("c").over(own) + 1})
    r, c, h, v = (F.col(x) for x in ("r", "c", "__h", "__w"))
    placed = sized.select("m_id", value, F.struct(*_spiral(r, c, h, v)).alias("cw"), F.struct(*_spiral(c, r, v, h)).alias("ccw"))
    return placed.groupBy("m_id").agg(in_order(value, "cw").alias("clockwise"), in_order(value, "ccw").alias("counter"))
