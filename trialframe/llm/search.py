"""Ranked search over dual-sorted wavelet trees, one tree a shard of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Documents and postings of a shard; the last document may go beyond the latter.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Items and terms that are searched for at once; further ones are other blocks.
BLOCK_ITEMS, BLOCK_TERMS = 1_000, 200_000
#: Nodes of a tree that are opened together.
OPENED = 64

# what belongs to a term stays, A-Z in lower case; all else separates
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of 0-9, A-Z, a-z and what is beyond ASCII, in order, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


_POSTINGS = "ids array<long>, lengths array<long>, terms array<string>, df array<int>, docs binary, tfs binary"
_INDEX = "ids array<long>, terms array<string>, df array<int>, docs binary, impacts binary"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents to rows of shards: postings by term, in a term by document; documents in order of id, those without one last."""
    ids: list = []
    lengths: list[int] = []
    vocabulary: dict[bytes, int] = {}
    term_of: list[np.ndarray] = []
    tf_of: list[np.ndarray] = []
    size = 0

    def shard() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        t, tf = np.concatenate(term_of), np.concatenate(tf_of)
        d = np.repeat(rank, [len(x) for x in term_of])
        by = np.lexsort((d, t))
        df = np.bincount(t, minlength=len(vocabulary)).astype(np.int32)
        columns = [[[ids[k] for k in order]], [[lengths[k] for k in order]], [[x.decode() for x in vocabulary]], [df.tolist()], [d[by].astype("<i4").tobytes()], [tf[by].astype("<i4").tobytes()]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "lengths", "terms", "df", "docs", "tfs"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found = terms_of(text)
            if not found:
                continue
            counts = Counter(found)
            ids.append(doc_id)
            lengths.append(len(found))
            term_of.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in counts), np.int32, len(counts)))
            tf_of.append(np.fromiter(counts.values(), np.int32, len(counts)))
            size += len(counts)
            if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield shard()
                ids, lengths, vocabulary, term_of, tf_of, size = [], [], {}, [], [], 0
    if ids:
        yield shard()


class Tree:
    """A shard's wavelet tree over documents: the postings of all terms, in each term by falling impact, dealt at each level by a bit of the document.

    A node's postings of a term stay together and in order, so the first of them is the largest below the node.
    """

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> None:
        """``docs``: each posting's document (0 up to ``n_docs``), in the order of terms and impacts."""
        self.levels = max(1, math.ceil(math.log2(max(2, n_docs))))
        n = len(docs)
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        self.impact = np.empty((self.levels + 1, n + 1), np.int32)
        self.impact[:, n] = 0
        self.impact[0, :n] = impacts
        for level in range(self.levels):
            bit = (docs >> (self.levels - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            order = np.concatenate((np.flatnonzero(bit == 0), np.flatnonzero(bit)))
            self.zeros[level] = n - self.ones[level, n]
            docs = docs[order]
            self.impact[level + 1, :n] = self.impact[level, order]

    def best(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents of the ``k`` best documents for terms with postings [start, end), and of all that tie with the last; none below ``least``.

        The nodes with the highest bounds are opened first, until the k-th score is above all bounds.
        """
        level, low = np.zeros(1, np.int64), np.zeros(1, np.int64)
        start, end = start[None, :], end[None, :]
        bound = (weight * self.impact[0][start]).sum(1)
        scores, docs = np.empty(0, np.int64), np.empty(0, np.int64)
        least = max(least, 1)
        while len(bound):
            if len(bound) > OPENED:
                first = np.argpartition(-bound, OPENED)[:OPENED]
                rest = np.ones(len(bound), bool)
                rest[first] = False
            else:
                first, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            at, s, e, lo = level[first, None], start[first], end[first], low[first]
            s1, e1 = self.ones[at, s].astype(np.int64), self.ones[at, e].astype(np.int64)
            z = self.zeros[at]
            half = np.int64(1) << (self.levels - 1 - at[:, 0])
            s, e = np.concatenate((s - s1, z + s1)), np.concatenate((e - e1, z + e1))
            down, lo = np.concatenate((at[:, 0], at[:, 0])) + 1, np.concatenate((lo, lo + half))
            b = (np.where(s < e, self.impact[down[:, None], s], 0) * weight).sum(1)
            ok = b >= least
            leaf = ok & (down == self.levels)
            if leaf.any():
                scores, docs = np.concatenate((scores, b[leaf])), np.concatenate((docs, lo[leaf]))
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    good = scores >= least
                    scores, docs = scores[good], docs[good]
            ok &= ~leaf & (b >= least)
            rest &= bound >= least
            level, low, bound = np.concatenate((level[rest], down[ok])), np.concatenate((low[rest], lo[ok])), np.concatenate((bound[rest], b[ok]))
            start, end = np.concatenate((start[rest], s[ok])), np.concatenate((end[rest], e[ok]))
        return scores, docs


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The written index of ``docs`` (doc_id, text), the number of documents with a term, and that of their terms with repeats.

    A row is a shard: ids (in order, null last), terms, df (postings of each term, which follow each other),
    docs and impacts (of the postings, in each term by falling impact, then by document).  All rows and whole texts are indexed;
    only null, empty and separators-only texts have nothing to find.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark, 500):
        raw = written(own.mapInArrow(_postings, _POSTINGS), "postings")
    total = raw.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    n_docs, n_terms = map(int, total)

    def by_impact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                d, tf = np.frombuffer(row["docs"][0].as_py(), "<i4"), np.frombuffer(row["tfs"][0].as_py(), "<i4").astype(np.int64)
                n = row["lengths"].flatten().to_numpy()
                i = impacts(tf, (100 - 50 + 50 * n * n_docs // n_terms)[d])
                t = np.repeat(np.arange(len(row["terms"][0])), row["df"].flatten().to_numpy())
                by = np.lexsort((d, -i, t))
                yield pa.RecordBatch.from_arrays([row["ids"], row["terms"], row["df"], pa.array([d[by].tobytes()], pa.binary()), pa.array([i[by].astype("<i4").tobytes()], pa.binary())], ["ids", "terms", "df", "docs", "impacts"])

    with small_batches(spark, 1):
        index = written(raw.mapInArrow(by_impact, _INDEX), "index")
    discard(raw)
    return index, n_docs, n_terms


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """The items with their terms (each once) in blocks of a bounded size."""
    block, size = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        terms = [t.decode() for t in dict.fromkeys(terms_of(text))]
        if block and (len(block) >= BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((item_id, terms))
        size += len(terms)
    if block:
        yield block


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of an index (see ``build_index``) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Scores are whole numbers by the contract's formula; equal ones go by doc_id, null last.  Documents
    without a score above 0 are never returned.  Items are the stated queries: they go in blocks of at most
    ``BLOCK_ITEMS`` rows, each of which is searched for in all shards; a task carries its best scores from
    shard to shard, so later trees are hardly opened, and no exchange moves more than ``k`` rows of an item and task.

    Repeated rows of an item are ranked each; items that are null, empty or without terms have no rows,
    nor has an empty index.  Repeated documents are ranked each.  Other columns are ignored.
    """
    spark = index.sparkSession
    found = spark.createDataFrame([], "item_id " + items.schema["item_id"].dataType.simpleString() + ", rank int, doc_id long, score long")
    for block in _blocks(items):
        ids = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(block)], "item long, item_id " + items.schema["item_id"].dataType.simpleString())
        wanted = sorted({t for _, terms in block for t in terms})
        if not wanted:
            continue
        words = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))  # at most BLOCK_TERMS
        pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
        df = dict(pairs.join(words, "term").groupBy("term").agg(F.sum("df")).toLocalIterator())
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted if t in df}
        place = {t: p for p, t in enumerate(weight)}
        queries = [np.array([place[t] for t in terms if t in place], np.int64) for _, terms in block]
        best = index.mapInArrow(_searcher(pa.array(list(weight), pa.string()), np.array(list(weight.values()), np.int64), queries, k), "item long, doc_id long, score long")
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        found = found.unionByName(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return found


def _searcher(terms: pa.Array, weight: np.ndarray, queries: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [np.empty(0, np.int64)] * len(queries)
        docs: list[list] = [[]] * len(queries)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                ids = row["ids"].flatten()
                df = row["df"].flatten().to_numpy()
                at = pc.index_in(terms, row["terms"].flatten()).fill_null(-1).to_numpy()
                ends = np.concatenate((np.cumsum(df), [0]))
                starts = ends - np.concatenate((df, [0]))
                d, i = np.frombuffer(row["docs"][0].as_py(), "<i4"), np.frombuffer(row["impacts"][0].as_py(), "<i4")
                # only the terms that are asked for go into the tree
                used = np.unique(at[at >= 0])
                if not len(used):
                    continue
                size = df[used].astype(np.int64)
                place = np.zeros(len(df) + 1, np.int64)
                place[used] = np.cumsum(size) - size
                chosen = np.repeat(starts[used] - place[used], size) + np.arange(size.sum())
                tree = Tree(d[chosen], i[chosen], len(ids))
                for q, query in enumerate(queries):
                    t = at[query]
                    have = t >= 0
                    if not have.any():
                        continue
                    t = t[have]
                    least = int(scores[q][-1]) if len(scores[q]) == k else 1
                    new, where = tree.best(place[t], place[t] + df[t], weight[query[have]], k, least)
                    if len(new):
                        s = np.concatenate((scores[q], new))
                        x = docs[q] + ids.take(pa.array(where)).to_pylist()
                        order = sorted(range(len(s)), key=lambda j: (-s[j], x[j] is None, x[j] or 0))[:k]
                        scores[q], docs[q] = s[order], [x[j] for j in order]
        item = np.repeat(np.arange(len(queries)), [len(s) for s in scores])
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([x for own in docs for x in own], pa.int64()), pa.array(np.concatenate(scores), pa.int64())], ["item", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``build_index`` over ``docs`` (doc_id, text) and ``search`` for ``items`` (item_id, text)."""
    index, n_docs, _ = build_index(docs)
    return search(index, n_docs, items, k)


#: The ranking of ``documents`` for ``benchmark`` by the definition, in DuckDB.
SQL = r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0), g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
 p AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p JOIN (SELECT DISTINCT term FROM q) USING (term), g GROUP BY term, n_docs),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
