"""Best-fit packing under conflicts.

Bins are kept by their residual capacity and carry bitmaps of the sources and of the clusters of
duplicates that they hold.  A piece goes to the first bin, from its own length upwards, that holds
neither its source nor its cluster: the tightest compatible one.  The same bitmaps are kept the
other way round, as the bins of each residual, source and cluster, so that one operation looks at
all bins of a residual and a search takes at most ``capacity`` of them, however many bins conflict.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written

BINS = "shard long, bin long, used long, residual long, n_sources int, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<long>"
COLUMNS = [x.split()[0] for x in BINS.split(", ")]


def best_fit(pieces: Sequence[tuple[int, int, int]], capacity: int) -> list[tuple[int, list[int], int]]:
    """(residual, pieces, source bitmap) of each bin, for pieces (length, source bit, cluster bit) in their order."""
    held: list[list] = []
    at_residual = [0] * (capacity + 1)  # bins of each residual, as bitmaps
    with_source: defaultdict[int, int] = defaultdict(int)
    with_cluster: defaultdict[int, int] = defaultdict(int)
    for k, (n, source, cluster) in enumerate(pieces):
        barred = with_source[source] | (with_cluster[cluster] if cluster >= 0 else 0)
        b = None
        if barred.bit_count() < len(held):
            for room in range(max(n, 1), capacity + 1):
                if fits := at_residual[room] & ~barred:
                    b = (fits & -fits).bit_length() - 1  # the oldest of the tightest ones
                    at_residual[room] ^= 1 << b
                    break
        if b is None:
            room, b = capacity, len(held)
            held.append([0, [], 0, 0])
        own, bit = held[b], 1 << b
        own[0] = room - n
        own[1].append(k)
        own[2] |= 1 << source
        with_source[source] |= bit
        if cluster >= 0:
            own[3] |= 1 << cluster
            with_cluster[cluster] |= bit
        at_residual[room - n] |= bit
    return [(x[0], x[1], x[2]) for x in held]


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def cluster_of(text: Column) -> Column:
    """Hash of the text with its case and white space evened out: equal for copies."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = 1024, shard_rows: int = 8192) -> DataFrame:
    """Bins of at most ``capacity`` words: shard, bin, used, residual, n_sources and the pieces as parallel lists.

    A text that exceeds the capacity becomes pieces of ``capacity`` words and a rest (``starts``
    and ``lengths`` are in words); every word of every row is in exactly one bin, an empty or null
    text is a piece of length 0.  No bin holds two pieces of one source or one cluster; null
    sources are one source.  ``cluster`` (a 64-bit integer, such as the class of a near-copy join)
    tells clusters; without it they are the copies that differ in case and white space at most, and
    near copies from different sources may share a bin.  Repeated rows are pieces of their own,
    null ids stay null, an empty table has no bins, other columns are not looked at.

    Longest pieces go first, ties by id and piece.  Pieces are dealt by a hash of their id and
    number to shards of about ``shard_rows`` pieces, which are packed apart: hot sources and
    clusters spread evenly, and a task holds one shard of numbers, no texts.  A shard that rows
    repeated under one id overfill is dealt out once more by the number of the row as written.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    cluster = cluster_of(body) if cluster is None else F.coalesce(cluster.cast("long"), cluster_of(body))
    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"), cluster.alias("cluster"), n_words(body).alias("n"), F.monotonically_increasing_id().alias("row"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long"))).alias("piece"))
    pieces = written(pieces.select("id", "source", "cluster", "row", F.col("piece").cast("int").alias("piece"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("length")), "packing-pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "cluster"), F.lit(shards)).cast("long"))
    full = dealt.groupBy("shard").count().where(F.col("count") > 2 * shard_rows).select(F.col("shard").alias("over"), F.ceil(F.col("count") / shard_rows).cast("long").alias("parts"))
    full = written(full, "packing-overfull")
    few = full.count() <= BROADCAST_ROWS
    dealt = dealt.join(F.broadcast(full) if few else full, F.col("shard") == F.col("over"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row", "piece"), "parts"), F.lit(0).cast("long")))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        source = {x: k for k, x in enumerate(sorted(rows["source"].unique()))}
        counts = rows["cluster"].value_counts()
        cluster = {x: k for k, x in enumerate(sorted(counts[counts > 1].index))}  # others conflict with nothing
        given = [(int(n), source[s], cluster.get(c, -1)) for n, s, c in zip(rows["length"], rows["source"], rows["cluster"], strict=True)]
        ids = [None if pd.isna(x) else int(x) for x in rows["id"]]
        piece, length = rows["piece"].tolist(), rows["length"].tolist()
        number = int(rows["shard"].iloc[0]) + shards * int(rows["part"].iloc[0])
        out = []
        for b, (residual, own, sources) in enumerate(best_fit(given, capacity)):
            out.append((number, b, capacity - residual, residual, sources.bit_count(), [ids[k] for k in own], [piece[k] for k in own], [piece[k] * capacity for k in own], [length[k] for k in own]))
        return pd.DataFrame(out, columns=COLUMNS)

    return dealt.select("id", "source", "cluster", "piece", "length", "shard", "part").groupBy("shard", "part").applyInPandas(shard, BINS)
