"""Ranked search and line dedup against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from trialframe.llm import lines, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(docs, items, k):
    held = [(d, w) for d, t in docs if (w := TERM.findall((t or "").translate(FOLD)))]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        found = []
        for doc_id, w in held:
            tf, m = Counter(w), 50 + 50 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(FOLD))) if tf[t])
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0))
        out += [(item, n + 1, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(found)[:k])]
    return out


def key(r):
    return tuple(map(str, r))


def test_terms():
    text = "Ab-c_d 9é\x00x\x7fÀÉ  y 漢字\n" + "".join(map(chr, range(256)))
    assert [t.decode() for t in search.terms_of(text)] == TERM.findall(text.translate(FOLD)) and search.terms_of(None) == search.terms_of("") == []


def test_tree():
    """The best documents of a tree are those of a plain sum, with all that tie, for any number of documents."""
    rng = np.random.default_rng(4)
    for n_docs in (1, 2, 3, 7, 64, 300):
        own = [sorted(((-int(rng.integers(1, 6)), int(d)) for d in rng.choice(n_docs, int(rng.integers(0, n_docs + 1)), replace=False))) for _ in range(6)]
        ends = np.cumsum([len(x) for x in own])
        starts = ends - [len(x) for x in own]
        tree = search.Tree(np.array([d for x in own for _, d in x], np.int32), np.array([-i for x in own for i, _ in x], np.int32), n_docs)
        weight = rng.integers(0, 4, 6)
        sums = Counter()
        for x, w in zip(own, weight):
            for i, d in x:
                sums[d] -= i * int(w)
        for k in (1, 5, 1000):
            scores, docs = tree.best(starts.astype(np.int64), ends.astype(np.int64), weight, k, 1)
            most = sorted((s for s in sums.values() if s > 0), reverse=True)
            least = most[k - 1] if len(most) >= k else 1
            assert sorted(zip(docs.tolist(), scores.tolist())) == sorted((d, s) for d, s in sums.items() if s >= least and s > 0)


def test_ranking(spark, monkeypatch):
    """Small shards and small blocks of items give the same rows: ties, repeated rows, nulls, empty and long texts."""
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 97}" for _ in range(4000)]
    docs = [(rng.randrange(150), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(180)]
    docs += [(None, "w1 W2 w3"), (None, None), (7, ""), (8, "-- --"), (9, "w1 w2 w3"), (9, "w1 w2 w3"), (10, "w1 " * 30_000), (2**40, "w2 w2 w5")]
    items = [(1, "w1 w2, w3"), (1, "w1 w2, w3"), (2, None), (3, ""), (4, "unknown"), (None, "W5 w5 w7"), (6, " ".join(words[:60]))]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, score string, ids string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = sorted(ranking(docs, items, 5), key=key)
    assert sorted(map(tuple, search.ranked_search(d, i, 5).select("item_id", "rank", "doc_id", "score").collect()), key=key) == want
    monkeypatch.setattr(search, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, search.ranked_search(d, i, 5).select("item_id", "rank", "doc_id", "score").collect()), key=key) == want
    assert search.ranked_search(d.where("false"), i).count() == search.ranked_search(d, i.where("false")).count() == 0


def test_shards_are_cut():
    """More documents or postings than a shard takes make more shards, and no row is lost."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": n, "text": f"a b{n}"} for n in range(50)])
    before, search.SHARD_DOCS = search.SHARD_DOCS, 16
    try:
        shards = list(search._postings(iter([batch, batch])))
    finally:
        search.SHARD_DOCS = before
    assert [len(s["ids"][0]) for s in shards] == [16] * 6 + [4] and sum(sum(s["df"][0].as_py()) for s in shards) == 200


def kept(docs, chars=10, least=2):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= chars:
                held.setdefault(norm(x), set()).add(d)
    first = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in held.items() if len(v) >= least}
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        stay = [x for x in own if norm(x) not in first or first[norm(x)] == d]
        out.append((d, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=key)


def test_lines(spark, odd):
    rng = random.Random(6)
    some = ["the same long line", " The SAME long line\t", "short", "", " the same long line", "another long line é", "ANOTHER long line É", "x" * 10, "\r", "only here, once"]
    docs = [(rng.randrange(30), "\n".join(rng.choices(some, k=rng.randrange(9)))) for _ in range(60)]
    docs += [(None, None), (None, "the same long line\nshort"), (None, "only without id, one\nthe same long line"), (None, "only without id, one"), (99, "\n" * 20_000 + "the same long line\n" * 20_000), (98, "a single long line " * 40_000)]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, gone_at string, h1 string").repartition(3)
    got = sorted(map(tuple, lines.line_digest(lines.dedup_lines(d)).collect()), key=key)
    assert got == kept(docs)
    assert sorted(map(tuple, lines.line_digest(lines.dedup_lines(d, least_chars=3, least_documents=4)).collect()), key=key) == kept(docs, 3, 4)
    assert lines.dedup_lines(d, keep=("h1", "gone_at")).columns == ["doc_id", "h1", "gone_at", "text", "n_lines", "n_dropped"]
    assert lines.dedup_lines(d.where("false")).count() == 0
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, lines.line_digest(lines.dedup_lines(odd)).collect()), key=key) == kept(plain)
