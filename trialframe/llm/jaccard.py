"""N-gram Jaccard join by a count-vector R-tree.

Texts become sets of hashed shingles; equal sets are one point.  The hash space is cut into
groups and a point's coordinates are the numbers of its shingles in each group, so that the sum
of coordinate minima bounds the overlap of two sets, and of a set and everything in a rectangle.

The tree is distributed.  Its upper level are slabs: half spaces of the points that have a count
in one group of the finest grouping (one group a hash).  A point lies in as many slabs as it has
shingles, but only needs to be dealt to the first few in an order that all points share: two
points whose summed minima reach the bound share one of these, whatever the order.  Slabs that
many points share come last in the order, by a table of counts over all rows.  In a slab, an
R-tree for each band of sizes, over coarser groups (about as many as a point has shingles), finds
the pairs that the bound allows, and gives a forest of them; every edge of the forest is verified
on the shingle sets.  Where an edge fails, all pairs of what it held together are verified.

A first round is a shortcut on which nothing depends: it takes a few slabs of each point, those
of its smallest hashes, in parts of bounded size, and joins most of what belongs together.  The
second takes the slabs that the proof asks for, passing over those whose points one class holds
already; in a slab that a large class fills, only the other points are searched for partners.
So a group of near copies costs in proportion to its size.  No step is a matter of chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_batches, written
from .graph import components

#: Slots of the table of counts that orders the slabs.
SLOT_BITS = 16
#: Slabs of each point in the first round, and points of a slab that are then looked at together.
FIRST = 4
FIRST_POINTS = 1024
#: Points of a slab, shingles of a block and partners of a point that one task takes; larger
#: slabs and blocks are dealt out as pairs of parts, more partners as chunks.
TILE_POINTS = 4096
BLOCK_SHINGLES = 1_000_000
HUB_ROWS = 2000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, known: dict, size: int = 5) -> np.ndarray:
    """The sorted set of hashed shingles of ``size`` words; a shorter text is one shingle, none without words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know ASCII case and white space only
    if not own:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    size = min(size, len(own))
    out = np.full(len(own) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * _P + h[k : len(own) - size + 1 + k])
    return np.unique(out)


def packed(own: np.ndarray) -> bytes:
    """The upper six bytes of each hash, byte by byte (the uppermost ones are in order and take little room).

    A false match of a pair needs one of some hundred words to agree in 48 bits.
    """
    return own.view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    """The set, each hash without its lower two bytes."""
    out = np.zeros((len(stored) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(stored, dtype=np.uint8).reshape(6, -1).T
    return out.view(np.uint64)[:, 0]


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def slots(own: np.ndarray) -> np.ndarray:
    """The slot of the table of counts that each shingle belongs to."""
    return (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slabs(own: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(keys of the slabs that a set is dealt to, number of leading ones).

    Of two sets with an overlap of t, the first ``size - t + 1`` slabs of each have one in common:
    t is at least percent of the larger set, and 2 * percent / (100 + percent) of the smaller one,
    whose slabs are the leading ones.
    """
    n = len(own)
    if 100 * n < percent * (n + 1):  # no other set can reach the share
        return np.empty(0, dtype=np.int64), 0
    first = np.argsort(table[slots(own)], kind="stable")[: n - -(-percent * n // 100) + 1]
    return (own[first] >> np.uint64(16)).view(np.int64), n - -(-2 * percent * n // (100 + percent)) + 1


def count_vector(own: np.ndarray, most: int = 4096) -> bytes:
    """Shingles in each group of the hash space, one byte each; 255 stands for any number from there on.

    There are half as many groups as the size band (a power of two) of the set has shingles, ``most`` at most.
    """
    bits = max(3, min((len(own) - 1).bit_length(), most.bit_length()) - 1)
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _coordinates(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows of the same length; longer ones are folded by summing neighbouring groups."""
    least = min(map(len, vectors))
    rows = np.empty((len(vectors), least), dtype=np.int32)
    for row, v in zip(rows, vectors, strict=True):
        x = np.frombuffer(v, dtype=np.uint8).astype(np.int32)
        x[x == 255] = 1 << 24
        row[:] = x.reshape(least, -1).sum(axis=1) if len(x) > least else x
    return rows


class CountTree:
    """R-tree over (size, count vector) points, packed by size, then by the heaviest group.

    A rectangle keeps the maxima of its coordinates and the least and greatest size; a pair or a
    rectangle can reach 100 * overlap >= percent * union only if the summed minima do.
    """

    def __init__(self, sizes: np.ndarray, rows: np.ndarray, percent: int, page: int = 16) -> None:
        self.percent, self.page = percent, page
        self.order = np.lexsort((rows.argmax(axis=1), (np.log(sizes) * 4).astype(int)))
        self.levels = [(sizes[self.order], sizes[self.order], rows[self.order])]
        while len(self.levels[-1][0]) > page:
            low, high, top = self.levels[-1]
            cuts = np.arange(0, len(low), page)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts)))

    def search(self, size: int, row: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """Points that the bound allows as partners; ``alive`` restricts them (flags in the tree's order)."""
        p = self.percent
        own = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            low, high, top = self.levels[k]
            if k == 0 and alive is not None:
                own = own[alive[own]]
            own = own[(p * low[own] <= 100 * size) & (100 * high[own] >= p * size)]
            least = np.minimum(top[own], row).sum(axis=1)
            own = own[(100 + p) * least >= p * (size + low[own])]
            if k:
                own = (own[:, None] * self.page + np.arange(self.page)).ravel()
                own = own[own < len(self.levels[k - 1][0])]
        return own


def banded(sizes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of the forests of each band of sizes: of the points of a band (2 ** (b - 1), 2 ** b] and of those above that may link with them."""
    band = np.frexp(sizes - 0.5)[1]
    edges = []
    for b in np.unique(band).tolist():
        own = np.flatnonzero((band == b) | (band > b) & (percent * sizes <= 100 << b))
        if len(own) > 1 and (labels[own] != labels[own[0]]).any():
            found = forest(sizes[own], _coordinates(vectors[own].tolist()), labels[own], percent)
            edges += [(int(own[i]), int(own[j])) for i, j in found]
    return edges


def forest(sizes: np.ndarray, rows: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges (child, parent) of a spanning forest of the graph of allowed pairs, in which points of one label are one."""
    m = len(sizes)
    if m <= 16:
        return _small_forest(sizes, rows, labels, percent)
    tree = CountTree(sizes, rows, percent)
    s, r, own = tree.levels[0][0], tree.levels[0][2], labels[tree.order]
    names, code, count = np.unique(own, return_inverse=True, return_counts=True)
    by_label = np.split(np.argsort(code, kind="stable"), np.cumsum(count)[:-1])
    alive, left, edges = np.ones(m, dtype=bool), len(names), []
    for first in np.argsort(count, kind="stable").tolist():  # the largest label last: it is only searched for
        if not alive[by_label[first][0]]:
            continue
        if left == 1:
            break
        alive[by_label[first]] = False
        left -= 1
        todo = by_label[first].tolist()
        while todo and left:
            at = todo.pop()
            new = tree.search(int(s[at]), r[at], alive)
            if not len(new):
                continue
            for x, k in zip(*np.unique(code[new], return_index=True), strict=True):
                edges.append((int(new[k]), at))
                alive[by_label[x]] = False
                left -= 1
                todo += by_label[x].tolist()
    return [(int(tree.order[a]), int(tree.order[b])) for a, b in edges]


def _small_forest(sizes: np.ndarray, rows: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The same, by the pairs of greatest bound first."""
    m = len(sizes)
    pairs = []
    for i in range(1, m):
        least = np.minimum(rows[:i], rows[i]).sum(axis=1)
        both = sizes[:i] + sizes[i]
        ok = ((100 + percent) * least >= percent * both) & (percent * np.maximum(sizes[:i], sizes[i]) <= 100 * np.minimum(sizes[:i], sizes[i])) & (labels[:i] != labels[i])
        pairs += [(-float(least[j] / both[j]), i, j) for j in np.flatnonzero(ok).tolist()]
    if len(pairs) == 1:
        return [pairs[0][1:]]
    root: dict = {}

    def find(x):
        while x in root:
            x = root[x]
        return x

    edges = []
    for _, i, j in sorted(pairs):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            root[a] = b
            edges.append((i, j))
    return edges


def links(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of different labels, all verified, one for each set and label; with ``sides`` only pairs across count.

    The most frequent label is not searched from: each pair has an end outside of it.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    names, code, count = np.unique(labels, return_inverse=True, return_counts=True)
    if m < 2 or len(names) == 1:
        return []
    whole = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    posted = np.repeat(np.arange(m, dtype=np.int32), sizes)[np.argsort(whole, kind="stable")]
    ends = np.cumsum(np.bincount(whole))
    starts = np.concatenate(([0], ends[:-1]))
    at = np.concatenate(([0], np.cumsum(sizes)))
    found = []
    for i in np.flatnonzero(code != count.argmax()).tolist():
        own = whole[at[i] : at[i + 1]]
        n = ends[own] - starts[own]
        place = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(posted[place], minlength=m)
        ok = (100 * both >= percent * (sizes[i] + sizes - both)) & (code != code[i])
        if sides is not None:
            ok &= sides != sides[i]
        if ok.any():
            near = np.flatnonzero(ok)
            found += [(i, int(near[k])) for k in np.unique(code[near], return_index=True)[1]]
    return found


def _groups(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the rows of each key, from sorted batches; holds one group and one batch."""
    rest: pd.DataFrame | None = None
    for b in it:
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        columns = {c: b[c].to_numpy() for c in b}
        change = np.zeros(len(b), dtype=bool)
        change[0] = True
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = np.flatnonzero(change)
        for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            yield {c: x[s:e] for c, x in columns.items()}
        rest = b.iloc[cuts[-1] :]
    if rest is not None:
        yield {c: rest[c].to_numpy() for c in rest}


def _dealt(points: DataFrame, parts: str) -> DataFrame:
    """Deals points of groups with more than one part to every pair of parts, as ``pi``, ``pj`` and ``side``."""
    side = F.pmod(F.xxhash64("row"), F.col(parts))
    dealt = points.withColumn("side", side).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
    return dealt.withColumns({"pi": F.least("side", "x"), "pj": F.greatest("side", "x")}).drop("x", parts)


def _in_batches(work: Callable[[dict[str, np.ndarray]], list[tuple]], keys: list[str], columns: list[str]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for g in _groups(it, keys):
            rows += work(g)
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    return run


def _few(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if it has BROADCAST_ROWS rows (of a few numbers) at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _numbers(n: Column) -> Column:
    """0 up to n, without n."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1), lambda x: x < n)


def _open_slabs(postings: DataFrame) -> DataFrame:
    """key, row, label of the slabs that hold two labels and a leading point: one exchange by key, whatever it is joined with."""
    slab = Window.partitionBy("key")
    told = postings.select("*", F.max("leads").over(slab).alias("led"), F.min("label").over(slab).alias("low"), F.max("label").over(slab).alias("high"))
    return told.where("led AND low <> high").select("key", "row", "label")


def _first_tiles(slabs: DataFrame) -> DataFrame:
    """key, pi, pj, row, label of open slabs in parts of FIRST_POINTS; parts of different slabs cut across each other."""
    parts = slabs.groupBy("key").agg(F.ceil(F.count("*") / FIRST_POINTS).cast("long").alias("parts"))
    own = slabs.join(parts, "key").withColumn("pi", F.pmod(F.xxhash64("row", "key"), F.col("parts")))
    return own.select("key", "pi", F.col("pi").alias("pj"), "row", "label")


def _all_tiles(slabs: DataFrame) -> DataFrame:
    """key, pi, pj, row, label of open slabs in parts of TILE_POINTS.

    Slabs with the same points are taken once.  In a slab of more than TILE_POINTS points those of
    one large label (more than half as many) and the others are cut into parts; each part of the
    others (pi) meets each one of the label (pj, below 0) and of the others.
    """
    by_label = slabs.groupBy("key", "label").agg(F.count("*").alias("points"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    is_large = F.col("points") > TILE_POINTS // 2
    shared = by_label.groupBy("key").agg(
        F.sum("points").alias("points"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        F.max(F.when(is_large, F.col("label"))).alias("large"), F.coalesce(F.max(F.when(is_large, F.col("points"))), F.lit(0)).alias("most"),
    )
    # slabs of the same points have the same labels, too
    shared = shared.groupBy("points", "x", "y", "large", "most").agg(F.min("key").alias("key"))
    cut = lambda n: F.ceil(n / TILE_POINTS).cast("long")
    whole = F.col("points") <= TILE_POINTS
    shared = shared.select("key", F.when(~whole, F.col("large")).alias("large"), F.when(whole, 0).otherwise(cut(F.col("most"))).alias("parts"), F.when(whole, 1).otherwise(F.greatest(cut(F.col("points") - F.col("most")), F.lit(1))).alias("rest"))
    own = slabs.join(shared, "key")
    mine = F.coalesce(F.col("label") == F.col("large"), F.lit(False))
    part = F.pmod(F.xxhash64("row"), F.when(mine, F.col("parts")).otherwise(F.col("rest")))
    own = own.withColumn("part", part)
    met = F.transform(_numbers(F.col("rest")), lambda r: F.struct(r.alias("pi"), (-1 - F.col("part")).alias("pj")))
    with_large = F.transform(_numbers(F.col("parts")), lambda a: F.struct(F.col("part").alias("pi"), (-1 - a).alias("pj")))
    with_rest = F.transform(_numbers(F.col("rest")), lambda r: F.struct(F.least("part", r).alias("pi"), F.greatest("part", r).alias("pj")))
    return own.select("key", "row", "label", F.explode(F.when(mine, met).otherwise(F.concat(with_large, with_rest))).alias("at")).select("key", "at.*", "row", "label")


def _verified(edges: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """u, v, ok of every pair of ``edges``: sets meet at the pair's parent v, whose children come in chunks."""
    pairs = edges.select("u", "v").distinct()
    hubs = pairs.groupBy(F.col("v").alias("hub")).agg(F.ceil(F.count("*") / HUB_ROWS).cast("long").alias("chunks"))
    children = pairs.withColumnRenamed("v", "hub").join(hubs, "hub").select("hub", F.pmod(F.xxhash64("u"), F.col("chunks")).alias("chunk"), F.col("u").alias("wanted"), F.lit(True).alias("child"))
    parents = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("wanted"), F.lit(False).alias("child"))
    asked = written(children.unionByName(parents), f"{name}-asked")

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = np.empty(0, dtype=np.uint64)
        for b in it:
            rows = []
            for v, u, child, own in zip(b["hub"], b["wanted"], b["child"], b["own"], strict=True):
                x = unpacked(own)
                if not child:
                    hub = x  # it comes before its children
                    continue
                both = len(np.intersect1d(hub, x, assume_unique=True))
                rows.append((u, v, 100 * both >= percent * (len(hub) + len(x) - both)))
            yield pd.DataFrame(rows, columns=["u", "v", "ok"])

    met = sets.join(_few(asked), F.col("row") == F.col("wanted")).select("hub", "chunk", "child", "wanted", "own")
    with small_batches(edges.sparkSession):
        return written(met.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "child").mapInPandas(check, "u long, v long, ok boolean"), name)


def _of_blocks(tiles: DataFrame, edges: DataFrame, judged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the points of slabs in which an edge failed.

    Labels that edges of these slabs hold together are a block; sets go once to their block, and
    its pairs of different labels are verified.
    """
    at = ["key", "pi", "pj"]
    failed = edges.join(judged.where("NOT ok").select("u", "v"), ["u", "v"], "left_semi").select(*at).distinct()
    points = tiles.select(*at, "row", "label").join(failed, at, "left_semi").select("row", "label").distinct()
    points = written(points.join(sets.select("row", "n"), "row"), "jaccard-open")
    label = points.select("row", "label")
    own = edges.join(failed, at, "left_semi").select("u", "v").distinct()
    own = own.join(label.toDF("u", "lu"), "u").join(label.toDF("v", "lv"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    roots = components(own, "jaccard-open-labels")
    member = points.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("block", F.coalesce("root", "label")).drop("root")
    sized = member.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("parts"), F.count_distinct("label").alias("labels")).where("labels > 1").drop("labels")
    member = written(member.join(sized, "block").select(F.col("row").alias("wanted"), "block", "parts", "label"), "jaccard-blocks")

    def block(g: dict[str, np.ndarray]) -> list[tuple]:
        row = g["row"].tolist()
        crossing = g["pi"][0] != g["pj"][0]
        own = [unpacked(x) for x in g["own"]]
        return [(row[i], row[j]) for i, j in links(own, g["label"], g["side"] if crossing else None, percent)]

    at = ["block", "pi", "pj"]
    met = sets.join(_few(member), F.col("row") == F.col("wanted")).drop("wanted", "n")
    met = _dealt(met, "parts").repartition(*at).sortWithinPartitions(*at, "row").select(*at, "row", "label", "side", "own")
    with small_batches(tiles.sparkSession):
        return written(met.mapInPandas(_in_batches(block, at, ["u", "v"]), "u long, v long"), "jaccard-block-links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, groups: int = 4096) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_rows, n_copies.

    Two rows link when their shingle sets have ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable by links, ``class_rows`` the number of rows that
    have it for a link's sake (1 without links) and ``n_copies`` the rows of the very same set.  A
    null text or one without words has no shingles, no link and its own id as component.  Repeated
    rows link with each other; null ids are rows like others but never the smallest id: rows are
    told apart by a number written with their sets.  An empty table gives none; other columns are
    not looked at, whatever their names.  Nothing is capped: slabs and blocks that are too large
    for a task are dealt out as pairs of parts.  ``groups`` is the greatest number of coordinates.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table, seen = _Hashes(), np.zeros(1 << SLOT_BITS, dtype=np.int64), set()
        for b in it:
            sets = [shingles(t, known, size) for t in b["text"]]
            if sets:
                table += np.bincount(slots(np.concatenate(sets)), minlength=len(table))
            rows = []
            for x in sets:
                node, own = None, None
                if len(x):
                    node = digest(x)
                    if node not in seen:  # a copy in the same task has no need of its set
                        seen.add(node)
                        own = packed(x)
                rows.append((len(x), node, own))
            if len(seen) > 1_000_000:
                seen.clear()
            out = pd.concat([b[["row"]], b["id"].astype("Int64"), pd.DataFrame(rows, columns=["n", "node", "own"])], axis=1)
            yield out.assign(slot=pd.array([None] * len(out), dtype="Int64"), rows=pd.array([None] * len(out), dtype="Int64"))
        held = np.flatnonzero(table)
        none = pd.array([None] * len(held), dtype="Int64")
        yield pd.DataFrame({"row": none, "id": none, "n": none, "node": [None] * len(held), "own": [None] * len(held), "slot": held, "rows": table[held]})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    with small_batches(spark):
        base = written(source.mapInPandas(scan, "row long, id long, n long, node binary, own binary, slot long, rows long"), "jaccard-sets")
    # of a fixed size, whatever the input's
    table = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in base.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("rows").alias("rows")).collect():
        table[r["slot"]] = r["rows"]
    sent = spark.sparkContext.broadcast(table)

    # a point is the first row of its set; rows of other tasks with the same set step back
    stored = base.select("row", "id", "n", "node", F.col("own").isNotNull().alias("stored")).where("node IS NOT NULL")
    classes = written(stored.groupBy("node").agg(F.min(F.when(F.col("stored"), F.col("row"))).alias("row"), F.min("id").alias("id"), F.count("*").alias("copies"), F.count_if("stored").alias("times")), "jaccard-nodes")
    again = stored.where("stored").join(classes.where("times > 1").select("node", F.col("row").alias("first")), "node").where("row <> first").select("row")
    sets = base.where("own IS NOT NULL").select("row", "n", "own").join(_few(written(again, "jaccard-again")), "row", "left_anti")

    def address(first: int | None):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                rows = []
                for own in b["own"]:
                    x = unpacked(own)
                    keys, lead = slabs(x, sent.value, percent)
                    rows.append(((x[:first] >> np.uint64(16)).view(np.int64) if first and lead else keys, lead))
                yield pd.concat([b.drop(columns=["own", "n"]), pd.DataFrame(rows, columns=["keys", "lead"])], axis=1)

        return run

    def vectors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            b["own"] = [count_vector(unpacked(x), groups) for x in b["own"]]
            yield b

    def tile(g: dict[str, np.ndarray]) -> list[tuple]:
        row, at = g["row"].tolist(), (int(g["key"][0]), int(g["pi"][0]), int(g["pj"][0]))
        return [(row[a], row[b], *at) for a, b in banded(g["n"], g["own"], g["label"], percent)]

    def grown(roots: DataFrame | None, first: int | None, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(points of open slabs, edges of their forests, edges verified)."""
        at = ["key", "pi", "pj"]
        with small_batches(spark):
            postings = sets.mapInPandas(address(first), "row long, keys array<long>, lead int")
            if roots is None:
                postings = postings.withColumn("root", F.lit(None).cast("long"))
            else:
                postings = postings.join(_few(roots.select(F.col("node").alias("row"), "root")), "row", "left")
            postings = postings.select("row", "root", "lead", F.posexplode("keys").alias("pos", "key")).select("key", "row", "root", (F.col("pos") < F.col("lead")).alias("leads"))
            open_slabs = written(_open_slabs(postings.repartition("key").withColumn("label", F.coalesce("root", "row"))), f"{name}-slabs")
            tiles = written((_first_tiles if first else _all_tiles)(open_slabs), f"{name}-tiles")
            members = _few(written(tiles.select(F.col("row").alias("wanted")).distinct(), f"{name}-members"))
            shapes = sets.join(members, F.col("row") == F.col("wanted"), "left_semi").mapInPandas(vectors, "row long, n long, own binary")
            own = tiles.join(shapes, "row").repartition(*at).sortWithinPartitions(*at).select(*at, "row", "n", "own", "label")
            edges = written(own.mapInPandas(_in_batches(tile, at, ["u", "v", *at]), "u long, v long, key long, pi long, pj long"), f"{name}-edges")
        return tiles, edges, _verified(edges, sets, percent, name)

    _, _, judged = grown(None, FIRST, "jaccard-first")
    roots = components(judged.where("ok").select("u", "v"), "jaccard-first-roots")
    tiles, edges, judged = grown(roots, None, "jaccard-all")
    found = judged.where("ok").select("u", "v")
    if not judged.where("NOT ok").isEmpty():
        found = found.unionByName(_of_blocks(tiles, edges, judged, sets, percent))
    more = components(found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "jaccard-roots")

    own = classes.join(more.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = own.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("copies").alias("class_rows"))
    own = own.join(least, "root").select(F.col("node").alias("mine"), "component_id", "class_rows", F.col("copies").alias("n_copies"))
    one = F.lit(1).cast("long")
    return base.where("slot IS NULL").select("id", "n", "node").join(own, F.col("node") == F.col("mine"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_rows", one).alias("class_rows"), F.coalesce("n_copies", one).alias("n_copies")
    )
