"""Queries of the sequence operators over events, orders and embeddings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trialframe.operators import sequences as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time: value in cents, type, and a coarse value b."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    v = F.round(F.col("value") * 100).cast("bigint")
    return e.select(F.col("user_id").alias("seq_id"), pos.alias("pos"), v.alias("v"), F.col("event_type").alias("k"), F.floor(v / 1000).alias("b"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the days of its orders, each open for 0 to 59 days."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("bigint")
    return o.select(F.col("o_custkey").alias("seq_id"), start.alias("start"), (start + F.col("o_orderkey") % 60).alias("end"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 matrices of thousandths."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = e.select(F.col("vec_id").alias("m_id"), F.posexplode("embedding").alias("i", "x"))
    return cells.select("m_id", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"), F.floor(F.col("x").cast("double") * 1000).cast("bigint").alias("v"))


_SEQ = """seq AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, round(value * 100)::BIGINT AS v, event_type AS k,
 floor(round(value * 100)::BIGINT / 1000)::BIGINT AS b FROM events)"""
_INTERVALS = "iv AS (SELECT o_custkey AS seq_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + o_orderkey % 60 AS e FROM orders)"
_CELLS = "cell AS (SELECT vec_id AS m_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, floor(embedding[i]::DOUBLE * 1000)::BIGINT AS v FROM embeddings, range(1, 65) t(i))"
_RUNS = _SEQ + """, mark AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER (PARTITION BY seq_id ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS n FROM seq),
 isl AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM mark),
 runs AS (SELECT seq_id, island, k, count(*) AS length, min(pos) AS s, max(pos) AS e FROM isl GROUP BY ALL)"""


@query(f"WITH {_SEQ} SELECT seq_id, k, min(pos) AS first_pos, string_agg(v::VARCHAR, ',' ORDER BY pos) AS values FROM seq GROUP BY ALL")
def group_by_key(spark, d):
    return q.group_by_key(events(spark, d), "k", "v").withColumn("values", q.text(F.col("values")))


@query(f"WITH {_SEQ} SELECT seq_id, k, min(pos) AS first_pos, count(*) AS n, sum(v)::BIGINT AS total, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, max(v) - min(v) AS range FROM seq GROUP BY ALL")
def group_and_aggregate(spark, d):
    return q.group_and_aggregate(events(spark, d), "k", "v").withColumn("mean", F.round("mean", 6))


_FREQ = f"WITH {_SEQ}, c AS (SELECT seq_id, b, count(*) AS n FROM seq GROUP BY ALL) SELECT seq_id, b, n, round(sum(n) OVER (PARTITION BY seq_id ORDER BY %s ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY seq_id), 6)::DOUBLE AS cumulative, row_number() OVER (PARTITION BY seq_id ORDER BY %s) AS place FROM c"


@query(_FREQ % ("b", "b"))
def frequency_table(spark, d):
    return q.frequency_table(events(spark, d), "b").withColumn("cumulative", F.round("cumulative", 6))


@query(_FREQ % ("n DESC, b", "n DESC, b"))
def frequency_table_by_count(spark, d):
    return q.frequency_table(events(spark, d), "b", by_count=True).withColumn("cumulative", F.round("cumulative", 6))


@query(f"WITH {_SEQ} SELECT seq_id, pos, dense_rank() OVER (PARTITION BY seq_id ORDER BY b) AS dense_rank, rank() OVER (PARTITION BY seq_id ORDER BY b DESC) AS competition_rank FROM seq")
def dense_rank(spark, d):
    return q.dense_rank(events(spark, d), "b").select("seq_id", "pos", "dense_rank", "competition_rank")


_TOP = f"WITH {_SEQ} SELECT * FROM (SELECT seq_id, pos, b, row_number() OVER (PARTITION BY seq_id ORDER BY b %s, k, pos) AS place FROM seq) WHERE place <= 3"


@query(_TOP % "DESC")
def top_k_by(spark, d):
    return q.top_k_by(events(spark, d), 3, "b", "k").select("seq_id", "pos", "b", "place")


@query(_TOP % "ASC")
def bottom_k_by(spark, d):
    return q.top_k_by(events(spark, d), 3, "b", "k", bottom=True).select("seq_id", "pos", "b", "place")


@query(f"WITH {_SEQ}, m AS (SELECT seq_id, max(b) AS b FROM seq GROUP BY ALL) SELECT seq_id, min(pos) AS first_index, max(pos) AS last_index FROM seq JOIN m USING (seq_id, b) GROUP BY ALL")
def index_of_max(spark, d):
    return q.index_of_max(events(spark, d), "b")


@query(f"""WITH {_SEQ}, x AS (SELECT a.seq_id, a.pos, max(b.v) AS window_max, count(*) AS n FROM seq a JOIN seq b ON b.seq_id = a.seq_id AND b.pos BETWEEN a.pos AND a.pos + 2 GROUP BY ALL)
 SELECT x.seq_id, x.pos, window_max, min(s.pos) AS window_argmax FROM x JOIN seq s ON s.seq_id = x.seq_id AND s.pos BETWEEN x.pos AND x.pos + 2 AND s.v = window_max WHERE n = 3 GROUP BY ALL""")
def sliding_window_max(spark, d):
    return q.sliding_window_max(events(spark, d), 3)


_WINDOWS = f"""WITH {_SEQ}, n AS (SELECT seq_id, count(*) AS n FROM seq GROUP BY ALL) SELECT a.seq_id, a.pos, string_agg(b.v::VARCHAR, ',' ORDER BY b.pos) AS forward, string_agg(b.v::VARCHAR, ',' ORDER BY b.pos DESC) AS backward
 FROM seq a JOIN n USING (seq_id) JOIN seq b ON b.seq_id = a.seq_id AND b.pos BETWEEN a.pos AND a.pos + 3 WHERE a.pos %% 3 = 0 AND (a.pos + 4 <= n%s) GROUP BY ALL"""


@query(_WINDOWS % "")
def strided_windows(spark, d):
    return q.strided_windows(events(spark, d), 4, 3).select("seq_id", "pos", q.text(F.col("window")).alias("forward"), q.text(F.reverse("window")).alias("backward"))


@query(_WINDOWS % " OR a.pos = 0 OR a.pos - 3 + 4 <= n")
def strided_windows_partial(spark, d):
    return q.strided_windows(events(spark, d), 4, 3, partial=True).select("seq_id", "pos", q.text(F.col("window")).alias("forward"), q.text(F.reverse("window")).alias("backward"))


@query(f"WITH {_SEQ} SELECT seq_id, (pos // 4)::BIGINT AS batch, string_agg(v::VARCHAR, ',' ORDER BY pos) AS items, string_agg(v::VARCHAR, ',' ORDER BY pos DESC) AS reversed FROM seq GROUP BY ALL")
def batch_list(spark, d):
    return q.batch_list(events(spark, d), 4).select("seq_id", "batch", q.text(F.col("items")).alias("items"), q.text(F.reverse("items")).alias("reversed"))


_UPTO = "OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"


# a billionth is added before rounding: exact ties then round alike in both engines
@query(f"WITH {_SEQ} SELECT seq_id, pos, count(*) {_UPTO} AS n, round(avg(b) {_UPTO} + 1e-9, 6) AS mean, round(var_pop(b) {_UPTO} + 1e-9, 6) AS var_pop, round(coalesce(var_samp(b) {_UPTO}, 0) + 1e-9, 6) AS var_samp FROM seq")
def running_stats(spark, d):
    out = q.running_stats(events(spark, d), "b")
    return out.select("seq_id", "pos", "n", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "var_pop", "var_samp")))


@query(f"WITH {_RUNS} SELECT seq_id, island, k, length FROM runs")
def rle_encode(spark, d):
    return q.rle_encode(events(spark, d), "k").select("seq_id", "island", "k", "length")


@query(f"WITH {_RUNS} SELECT seq_id, string_agg(k || ',' || length, ',' ORDER BY island) AS flat FROM runs GROUP BY ALL")
def rle_flat(spark, d):
    runs = q.rle_encode(events(spark, d), "k").withColumn("x", F.concat_ws(",", "k", F.col("length").cast("string")))
    return runs.groupBy("seq_id").agg(F.array_join(q.in_order("x", "island"), ",").alias("flat"))


@query(f"WITH {_RUNS} SELECT seq_id, island, k, string_agg(v::VARCHAR, ',' ORDER BY pos) AS chunk FROM isl GROUP BY ALL")
def chunk_on_change(spark, d):
    return q.chunk_on_change(events(spark, d), "k", "v").withColumn("chunk", q.text(F.col("chunk")))


@query(f"WITH {_RUNS} SELECT seq_id, string_agg(k, ',' ORDER BY island) AS kept, (sum(length) - count(*))::BIGINT AS removed FROM runs GROUP BY ALL")
def remove_adjacent_dups(spark, d):
    return q.remove_adjacent_dups(events(spark, d), "k").withColumn("kept", F.array_join("kept", ","))


_ABOVE = _SEQ + """, up AS (SELECT seq_id, pos, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM seq WHERE v > 3000), seg AS (SELECT seq_id, min(pos) AS s, max(pos) AS e FROM up GROUP BY seq_id, g)"""


@query(f"WITH {_ABOVE} SELECT u.seq_id, count(s) AS segments, coalesce(string_agg((e - s + 1)::VARCHAR, ',' ORDER BY s), '') AS lengths FROM (SELECT DISTINCT seq_id FROM seq) u LEFT JOIN seg USING (seq_id) GROUP BY ALL")
def true_segments(spark, d):
    return q.true_segments(events(spark, d), "v > 3000").withColumn("lengths", q.text(F.col("lengths")))


@query(f'WITH {_ABOVE} SELECT seq_id, s AS start, e AS "end" FROM seg')
def segments_above_threshold(spark, d):
    return q.segments_above(events(spark, d), 3000)


@query(f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY length DESC, s) AS f, row_number() OVER (PARTITION BY seq_id ORDER BY length DESC, s DESC) AS l FROM runs)
 SELECT a.seq_id, a.s AS first_start, a.e AS first_end, a.k AS first_value, b.s AS last_start, b.e AS last_end, b.k AS last_value FROM r a JOIN r b ON a.seq_id = b.seq_id WHERE a.f = 1 AND b.l = 1""")
def longest_plateau(spark, d):
    return q.longest_plateau(events(spark, d), "k")


@query(f"""WITH {_SEQ}, n AS (SELECT *, lag(b) OVER (PARTITION BY seq_id ORDER BY pos) AS p, lead(b) OVER (PARTITION BY seq_id ORDER BY pos) AS x FROM seq)
 SELECT seq_id, pos, CASE WHEN b > p THEN 'peak' ELSE 'valley' END AS kind FROM n WHERE (b > p AND b > x) OR (b < p AND b < x)""")
def peak_valley_indices(spark, d):
    return q.peaks_and_valleys(events(spark, d), "b")


@query(f"""WITH {_SEQ}, g AS (SELECT seq_id * 1000 + pos // 3 AS s, pos, b FROM seq), n AS (SELECT s, b, lag(b) OVER (PARTITION BY s ORDER BY pos) AS p FROM g)
 SELECT s AS seq_id, coalesce(bool_and(b >= p), true) AS sorted, coalesce(bool_and(b > p), true) AS strictly FROM n GROUP BY ALL""")
def is_sorted(spark, d):
    threes = events(spark, d).withColumn("seq_id", F.col("seq_id") * 1000 + F.floor(F.col("pos") / 3))
    return q.is_sorted(threes, "b")


_MERGED = _INTERVALS + """, o AS (SELECT *, max(e) OVER (PARTITION BY seq_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
 g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o), m AS (SELECT seq_id, min(s) AS s, max(e) AS e FROM g GROUP BY seq_id, g)"""


@query(f'WITH {_MERGED} SELECT seq_id, s AS start, e AS "end" FROM m')
def merge_intervals(spark, d):
    return q.merge_intervals(intervals(spark, d), "start", "end")


@query(f"WITH {_INTERVALS} SELECT seq_id, count(DISTINCT x) AS covered FROM (SELECT seq_id, unnest(range(s, e + 1)) AS x FROM iv) GROUP BY ALL")
def points_covered(spark, d):
    return q.points_covered(intervals(spark, d), "start", "end")


_SUBS = _SEQ + """, z AS (SELECT seq_id, pos, b - 5 AS x FROM seq), all_subs AS (SELECT a.seq_id, a.pos AS s, c.pos AS e, sum(c.x) OVER (PARTITION BY a.seq_id, a.pos ORDER BY c.pos) AS t FROM z a JOIN z c ON a.seq_id = c.seq_id AND c.pos >= a.pos),
 top AS (SELECT seq_id, max(t) AS t FROM all_subs GROUP BY ALL), hit AS (SELECT seq_id, s, e, t::BIGINT AS t FROM all_subs JOIN top USING (seq_id, t))"""


def _signed(spark, d):
    return events(spark, d).withColumn("x", F.col("b") - 5)


@query(f'WITH {_SUBS} SELECT seq_id, s AS start, e AS "end", t AS total FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY e, s) AS n FROM hit) WHERE n = 1')
def max_subarray_bounds(spark, d):
    return q.max_subarray(_signed(spark, d), "x")


@query(f'WITH {_SUBS} SELECT seq_id, s AS start, e AS "end", t AS total FROM hit WHERE t >= 0 OR s = e')
def all_max_subarrays(spark, d):
    return q.all_max_subarrays(_signed(spark, d), "x")


def _lists(spark, d):
    e = events(spark, d).withColumn("v", F.col("b"))
    return e.where("k = 'click'"), e.where("k = 'view'")


_LISTS = _SEQ + ", a AS (SELECT seq_id, b AS v FROM seq WHERE k = 'click'), c AS (SELECT seq_id, b AS v FROM seq WHERE k = 'view')"


@query(f"WITH {_LISTS} SELECT seq_id, v, row_number() OVER (PARTITION BY seq_id ORDER BY v) - 1 AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM c)")
def merge_sorted(spark, d):
    return q.merge_sorted(*_lists(spark, d))


@query(f"WITH {_LISTS} SELECT seq_id, v FROM a WHERE (seq_id, v) NOT IN (SELECT (seq_id, v) FROM c) UNION ALL SELECT seq_id, v FROM c WHERE (seq_id, v) NOT IN (SELECT (seq_id, v) FROM a)")
def values_in_one_list(spark, d):
    return q.in_one_list(*_lists(spark, d))


@query(f"WITH {_LISTS} SELECT seq_id, v FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM c)")
def sorted_list_intersection(spark, d):
    return q.bag_intersection(*_lists(spark, d))


@query(f"WITH {_LISTS} (SELECT * FROM a EXCEPT ALL SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT ALL SELECT * FROM a)")
def multiset_symmetric_difference(spark, d):
    return q.bag_difference(*_lists(spark, d))


@query(f"WITH {_SEQ} SELECT DISTINCT x.seq_id, least(x.b, y.b) AS a, greatest(x.b, y.b) AS b FROM seq x JOIN seq y ON x.seq_id = y.seq_id AND x.pos < y.pos AND x.b + y.b = 9")
def two_sum_sorted_pairs(spark, d):
    return q.two_sum_pairs(events(spark, d), 9, "b")


@query(f"WITH {_SEQ} SELECT x.seq_id, x.pos AS i, y.pos AS j FROM seq x JOIN seq y ON x.seq_id = y.seq_id AND x.pos < y.pos AND x.b + y.b = 9")
def two_sum_index_pairs(spark, d):
    return q.two_sum(events(spark, d), 9, "b").select("seq_id", "i", "j")


@query(f"WITH {_SEQ} SELECT seq_id, coalesce(string_agg(v::VARCHAR, ',' ORDER BY pos) FILTER (v % 2 = 0), '') AS matching, coalesce(string_agg(v::VARCHAR, ',' ORDER BY pos) FILTER (v % 2 <> 0), '') AS rest FROM seq GROUP BY ALL")
def stable_partition(spark, d):
    return q.stable_partition(events(spark, d), "v % 2 = 0").select("seq_id", q.text(F.col("matching")).alias("matching"), q.text(F.col("rest")).alias("rest"))


_ROTATE = f"WITH {_SEQ}, n AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM seq) SELECT seq_id, ((pos %s 7) %% n + n) %% n AS pos, v FROM n"


@query(_ROTATE % "-")
def rotate_list(spark, d):
    return q.rotate_list(events(spark, d), 7)


@query(_ROTATE % "+")
def rotate_list_right(spark, d):
    return q.rotate_list(events(spark, d), 7, right=True)


@query(f"""WITH {_SEQ}, m AS (SELECT *, min(v) OVER (PARTITION BY seq_id) AS lo, max(v) OVER (PARTITION BY seq_id) AS hi, ntile(5) OVER (PARTITION BY seq_id ORDER BY v, pos) - 1 AS t FROM seq)
 SELECT seq_id, pos, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 5.0::DOUBLE)), 4) END::BIGINT AS equal_width, min(t) OVER (PARTITION BY seq_id, v) AS quantile FROM m""")
def equal_width_buckets(spark, d):
    return q.buckets(events(spark, d), 5).select("seq_id", "pos", "equal_width", "quantile")


@query(f"WITH {_SEQ} SELECT seq_id, pos, CASE WHEN v < 1000 THEN 1000 WHEN v > 5000 THEN 5000 ELSE v END AS clamped, CASE WHEN v < 5000 THEN 5000 WHEN v > 1000 THEN 1000 ELSE v END AS crossed FROM seq")
def clamp(spark, d):
    v, lo, hi = F.col("v"), F.lit(1000).cast("bigint"), F.lit(5000).cast("bigint")
    return events(spark, d).select("seq_id", "pos", q.clamp(v, lo, hi, strict=True).alias("clamped"), q.clamp(v, hi, lo).alias("crossed"))


@query(f"WITH {_CELLS} SELECT m_id, r + c AS diagonal, string_agg(v::VARCHAR, ',' ORDER BY r) AS downwards, string_agg(v::VARCHAR, ',' ORDER BY r DESC) AS upwards FROM cell GROUP BY ALL")
def antidiagonals(spark, d):
    return q.antidiagonals(matrices(spark, d)).select("m_id", "diagonal", q.text(F.col("downwards")).alias("downwards"), q.text(F.col("upwards")).alias("upwards"))


# the walk itself: 0 right, 1 down, 2 left, 3 up; turn at the border or a visited cell
_WALK = """RECURSIVE walk(n, r, c, dir, seen) AS (SELECT 0, 0, 0, 0, [0] UNION ALL
 SELECT n + 1, r + [0, 1, 0, -1][d2 + 1], c + [1, 0, -1, 0][d2 + 1], d2, list_append(seen, (r + [0, 1, 0, -1][d2 + 1]) * 8 + c + [1, 0, -1, 0][d2 + 1]) FROM (SELECT *, CASE WHEN r + [0, 1, 0, -1][dir + 1] NOT BETWEEN 0 AND 7
 OR c + [1, 0, -1, 0][dir + 1] NOT BETWEEN 0 AND 7 OR list_contains(seen, (r + [0, 1, 0, -1][dir + 1]) * 8 + c + [1, 0, -1, 0][dir + 1]) THEN (dir + 1) % 4 ELSE dir END AS d2 FROM walk WHERE n < 63))"""


@query(f"WITH {_WALK}, {_CELLS} SELECT a.m_id, string_agg(a.v::VARCHAR, ',' ORDER BY n) AS clockwise, string_agg(b.v::VARCHAR, ',' ORDER BY n) AS counter FROM walk JOIN cell a ON a.r = walk.r AND a.c = walk.c JOIN cell b ON b.m_id = a.m_id AND b.r = a.c AND b.c = a.r GROUP BY ALL")
def spiral_order(spark, d):
    return q.spiral_order(matrices(spark, d)).select("m_id", q.text(F.col("clockwise")).alias("clockwise"), q.text(F.col("counter")).alias("counter"))
