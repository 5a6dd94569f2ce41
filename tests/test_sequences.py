"""Documented input and output pairs of the sequence and matrix operators."""

import random

import pytest
from pyspark.sql import functions as F

from trialframe.operators import sequences as q


@pytest.fixture
def seq(spark):
    def make(*lists, kind="int"):
        rows = [(i, p, x) for i, own in enumerate(lists) for p, x in enumerate(own)]
        return spark.createDataFrame(rows, f"seq_id int, pos int, v {kind}")

    return make


def test_windows(seq):
    out = q.sliding_window_max(seq([1, 3, 2, 4, 1]), 3).orderBy("pos").collect()
    assert [(r.window_max, r.window_argmax) for r in out] == [(3, 1), (4, 3), (4, 3)]
    assert q.sliding_window_max(seq([1]), 0).count() == q.sliding_window_max(seq([1]), 2).count() == 0
    show = lambda **k: [r.window for r in q.strided_windows(seq([1, 2, 3, 4, 5]), 3, 2, **k).orderBy("pos").collect()]
    assert show() == [[1, 2, 3], [3, 4, 5]] and show(partial=True) == [[1, 2, 3], [3, 4, 5], [5]]
    assert [r["items"] for r in q.batch_list(seq([1, 2, 3]), 2).orderBy("batch").collect()] == [[1, 2], [3]]
    assert q.batch_list(seq([1]), 0).count() == 0
    out = q.running_stats(seq([2, 4, 6])).orderBy("pos").collect()
    assert [round(r.var_pop, 9) for r in out] == [0, 1, round(8 / 3, 9)] and [r.var_samp for r in out] == [0, 2, 4]


def test_runs(seq, spark):
    flags = seq([True, True, False, True], [False], kind="boolean")
    assert {r.seq_id: (r.segments, r.lengths) for r in q.true_segments(flags, "v").collect()} == {0: (2, [2, 1]), 1: (0, [])}
    r = q.longest_plateau(seq([5, 5, 1, 7, 7]), "v").first()
    assert (r.first_start, r.first_end, r.first_value, r.last_start, r.last_end) == (0, 1, 5, 3, 4)
    assert [(r.v, r.length) for r in q.rle_encode(seq([None, None, 1, None]), "v").orderBy("island").collect()] == [(None, 2), (1, 1), (None, 1)]
    r = q.remove_adjacent_dups(seq([1, 1, 2, 1]), "v").first()
    assert (r.kept, r.removed) == ([1, 2, 1], 1)
    assert [(r.start, r.end) for r in q.segments_above(seq([1, 5, 6, 1, 7]), 4).orderBy("start").collect()] == [(1, 2), (4, 4)]
    assert [(r.sorted, r.strictly) for r in q.is_sorted(seq([1, 1, 2], [2, 1], [3])).orderBy("seq_id").collect()] == [(True, False), (False, False), (True, True)]


def test_intervals_and_subarrays(seq, spark):
    iv = spark.createDataFrame([(0, a, b) for a, b in ([1, 3], [2, 6], [8, 10], [15, 18], [18, 20])], "seq_id int, s int, e int")
    assert [(r.start, r.end) for r in q.merge_intervals(iv, "s", "e").orderBy("start").collect()] == [(1, 6), (8, 10), (15, 20)]
    assert q.points_covered(iv, "s", "e").first().covered == 15
    rng = random.Random(5)
    lists = [[rng.randint(-4, 4) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    got = {r.seq_id: (r.start, r.end, r.total) for r in q.max_subarray(seq(*lists)).collect()}
    every: dict = {}
    for r in q.all_max_subarrays(seq(*lists)).collect():
        every.setdefault(r.seq_id, []).append((r.start, r.end))
    for i, own in enumerate(lists):
        best, cur, at = (own[0], 0, 0), 0, 0
        for p, x in enumerate(own):
            if p == 0 or cur + x < x:
                cur, at = x, p
            else:
                cur += x
            if cur > best[0]:
                best = (cur, at, p)
        assert got[i] == (best[1], best[2], best[0])
        subs = [(a, b) for a in range(len(own)) for b in range(a, len(own)) if sum(own[a : b + 1]) == best[0] and (best[0] >= 0 or a == b)]
        assert sorted(every[i]) == subs


def test_bags_and_places(seq):
    a, b = seq([1, 1, 2, 3]), seq([1, 1, 1, 3, 3])
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(q.bag_intersection(a, b)) == [1, 1, 3] and values(q.bag_difference(a, b)) == [1, 2, 3]
    assert values(q.in_one_list(seq([1, 3, 5]), seq([2, 3, 4]))) == [1, 2, 4, 5]
    pairs = q.two_sum_pairs(seq([1, 2, 2, 3, 3]), 4).orderBy("a").collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 3), (2, 2)]
    assert [(r.i, r.j) for r in q.two_sum(seq([1, 2, 2, 3]), 4).orderBy("i").collect()] == [(0, 3), (1, 2)]
    place = lambda **k: [r.v for r in q.rotate_list(seq([1, 2, 3, 4]), 1, **k).orderBy("pos").collect()]
    assert place() == [2, 3, 4, 1] and place(right=True) == [4, 1, 2, 3]
    r = q.stable_partition(seq([3, 4, 1, 2]), "v % 2 = 0").first()
    assert (r.matching, r.rest) == ([4, 2], [3, 1])
    out = q.buckets(seq([1, 2, 3, 100], [7, 7, 7, 7]), 2).orderBy("seq_id", "pos").collect()
    assert [r.quantile for r in out] == [0, 0, 1, 1, 0, 0, 0, 0] and [r.equal_width for r in out] == [0, 0, 0, 1, 0, 0, 0, 0]


def test_ranks(seq):
    out = q.dense_rank(seq([100, 50, 100, 10])).orderBy("pos").collect()
    assert [r.dense_rank for r in out] == [3, 2, 3, 1] and [r.competition_rank for r in out] == [1, 3, 1, 4]
    assert q.top_k_by(seq([1, 2]), 0).count() == 0
    assert [r.pos for r in q.top_k_by(seq([5, 9, 9]), 2).orderBy("place").collect()] == [1, 2]
    r = q.index_of_max(seq([1, 7, 7, 2])).first()
    assert (r.first_index, r.last_index) == (1, 2)
    assert [(r.pos, r.kind) for r in q.peaks_and_valleys(seq([1, 3, 2, 2, 0, 5])).orderBy("pos").collect()] == [(1, "peak"), (4, "valley")]


@pytest.mark.parametrize("size", [(1, 1), (1, 5), (4, 1), (3, 3), (3, 5), (6, 4), (7, 7)])
def test_spiral(spark, size):
    h, w = size
    cells = spark.createDataFrame([(0, r, c, r * w + c) for r in range(h) for c in range(w)], "m_id int, r int, c int, v int")

    def walk(h, w):
        seen, out, r, c, d = set(), [], 0, 0, 0
        for _ in range(h * w):
            seen.add((r, c))
            out.append((r, c))
            for _ in range(4):
                a, b = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
                if 0 <= a < h and 0 <= b < w and (a, b) not in seen:
                    r, c = a, b
                    break
                d = (d + 1) % 4
        return out

    row = q.spiral_order(cells).first()
    assert row.clockwise == [r * w + c for r, c in walk(h, w)]
    assert row.counter == [c * w + r for r, c in walk(w, h)]


def test_clamp(spark):
    df = spark.createDataFrame([(5, 1, 3), (0, 1, 3), (2, 3, 1)], "v int, lo int, hi int")
    assert [r.x for r in df.select(q.clamp(F.col("v"), F.col("lo"), F.col("hi")).alias("x")).collect()] == [3, 1, 3]
    with pytest.raises(Exception, match="low > high"):
        df.select(q.clamp(F.col("v"), F.col("lo"), F.col("hi"), strict=True)).collect()


@pytest.mark.parametrize("block", [1, 2, 3, 7, None])
def test_blocks_change_nothing(seq, block):
    rng = random.Random(9)
    lists = [[rng.choice((None, 1, 2)) if i % 2 else rng.randint(-3, 3) for _ in range(rng.randint(1, 25))] for i in range(20)]
    rows = q.previous(q.previous(seq(*lists), "v", "a", block=block), "v", "b", block=block, following=True).collect()
    for r in rows:
        own = lists[r.seq_id]
        assert r.a == (own[r.pos - 1] if r.pos else None) and r.b == (own[r.pos + 1] if r.pos + 1 < len(own) else None)
    got = {(r.seq_id, r.pos): r.island for r in q.islands(seq(*lists), "v", block=block).collect()}
    for i, own in enumerate(lists):
        n = 0
        for p, x in enumerate(own):
            n += p == 0 or x != own[p - 1]
            assert got[i, p] == n
    whole = [[x for x in own if x is not None] or [0] for own in lists]
    best = lambda b: sorted(map(tuple, q.max_subarray(seq(*whole), block=b).collect()))
    assert best(block) == best(None)


def test_windows_across_blocks(spark, monkeypatch):
    """Blocks of three positions give what a plain loop gives, ties and repeats included."""
    import random
    import statistics

    rng = random.Random(3)
    own = {t: [rng.randrange(6) for _ in range(n)] for t, n in (("a", 1), ("b", 7), ("c", 20))}
    df = spark.createDataFrame([(t, p, float(v) + 1e6) for t, vs in own.items() for p, v in enumerate(vs)], "seq_id string, pos long, v double")
    monkeypatch.setattr(q, "BLOCK", 3)
    for r in q.running_stats(df).collect():
        vs = [v + 1e6 for v in own[r.seq_id][: r.pos + 1]]
        assert r.n == len(vs) and abs(r["mean"] - statistics.fmean(vs)) < 1e-9 * 1e6 and abs(r.var_pop - statistics.pvariance(vs)) < 1e-6 and abs(r.var_samp - (statistics.variance(vs) if len(vs) > 1 else 0)) < 1e-6
    for k in (1, 2, 4, 9):
        got = sorted((r.seq_id, r.pos, r.window_max - 1e6, r.window_argmax) for r in q.sliding_window_max(df, k).collect())
        assert got == sorted((t, p, max(w := vs[p : p + k]), p + w.index(max(w))) for t, vs in own.items() for p in range(len(vs) - k + 1))
    for size, stride in ((1, 1), (4, 3), (2, 5), (5, 1)):
        got = {(r.seq_id, r.pos): [int(x - 1e6) for x in r.window] for r in q.strided_windows(df, size, stride).collect()}
        assert got == {(t, p): vs[p : p + size] for t, vs in own.items() for p in range(0, len(vs) - size + 1, stride)}
    got = {(r.seq_id, r.pos): (r.dense_rank, r.competition_rank) for r in q.dense_rank(df).collect()}
    assert got == {(t, p): (sorted(set(vs)).index(v) + 1, sum(x > v for x in vs) + 1) for t, vs in own.items() for p, v in enumerate(vs)}
