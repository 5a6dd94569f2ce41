"""Edit-distance join of names by intact pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import LOWER, UPPER

#: Edits that two names may differ by.
MOST = 2
#: Pieces of a name; an exchange of two code points may straddle two of them.
PIECES = 2 * MOST + 1
#: Names of fewer code points than this are short: their pieces would have fewer than two.
LONG = 2 * PIECES


def osa(a: str, b: str, most: int = MOST) -> int:
    """Optimal string alignment distance, or ``most`` + 1 if it is larger."""
    while a and b and a[0] == b[0]:
        n = 1
        while a[n : 2 * n] and a[n : 2 * n] == b[n : 2 * n]:
            n *= 2
        a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        n = 1
        while len(a) >= 2 * n and a[-2 * n : -n] == b[-2 * n : -n]:
            n *= 2
        a, b = a[:-n], b[:-n]
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    two, one = {}, {j: j for j in range(min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            x = i if j == 0 else min(one.get(j, far) + 1, now.get(j - 1, far) + 1, one.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, two.get(j - 2, far) + 1)
            now[j] = min(x, far)
        if min(now.values()) == far:
            return far
        two, one = one, now
    return one.get(len(b), far)


def _structs(names: str, rows: list[tuple]) -> Column:
    """A literal array of small integers by name."""
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {x}" for n, x in zip(names.split(), r, strict=True)) + ")" for r in rows) + ")")


def _cut(k: Column, length: Column) -> Column:
    """Where piece ``k`` begins."""
    return F.floor(k * length / PIECES).cast("int")


def _intact(name: Column, length: Column, i: Column, j: Column, shift: Column, delta: Column) -> Column:
    """What a name of ``length`` code points leaves without its pieces i and j, read from a name that is longer by ``delta``.

    Between the two pieces the other name is moved by ``shift``, behind them by ``delta``.
    """
    part = lambda a, b, by: F.substring(name, a + by + 1, b - a)
    return F.concat(part(F.lit(0), _cut(i, length), F.lit(0)), part(_cut(i + 1, length), _cut(j, length), shift), part(_cut(j + 1, length), length, delta))


def _swapped(name: Column, length: Column, k: Column) -> Column:
    """The name with the code points on both sides of cut ``k`` exchanged; 0 leaves it as it is."""
    at = _cut(k, length)
    return F.when(k == 0, name).otherwise(F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(1)), F.substring(name, at, F.lit(1)), F.substring(name, at + 2, length)))


def _touched() -> list[tuple[int, int]]:
    return [(i, j) for i in range(PIECES) for j in range(i + 1, PIECES)]


def _indexed() -> list[tuple[int, int, int, int]]:
    """(i, j, x, y): a name is indexed without its pieces i and j, after exchanges at the cuts x and y."""
    one = [(i, j, x, 0) for x in range(1, PIECES) for i, j in ((0, 1), (2, 3), (3, 4))]
    return [(*t, 0, 0) for t in _touched()] + one + [(0, 1, x, y) for x in range(1, PIECES) for y in range(x + 1, PIECES)]


def _probed() -> list[tuple[int, int, int, int]]:
    """(i, j, shift, delta): where both edits can be in one of two neighbouring pieces, what stands behind them is moved by delta alone."""
    moves = range(-MOST, MOST + 1)
    near = [(i, i + 1, 0, d) for i in range(PIECES - 1) for d in moves]
    return near + [(i, j, s, d) for i, j in _touched() if j > i + 1 for s in (-1, 0, 1) for d in moves if abs(d - s) <= 1]


def _short_keys(names: DataFrame, longest: int) -> DataFrame:
    """All that is left of a short name without up to two of its code points."""
    gaps = [(-1, -1), *((-1, q) for q in range(longest)), *((p, q) for q in range(longest) for p in range(q))]
    x = names.where(F.col("len") <= longest).select("name", "len", F.explode(_structs("p q", gaps)).alias("at")).where(F.col("at.q") < F.col("len"))
    p, q, n = F.col("at.p"), F.col("at.q"), F.col("name")
    left = F.when(q < 0, n).when(p < 0, F.concat(F.substring(n, F.lit(1), q), F.substring(n, q + 2, F.col("len"))))
    left = left.otherwise(F.concat(F.substring(n, F.lit(1), p), F.substring(n, p + 2, q - p - 1), F.substring(n, q + 2, F.col("len"))))
    return x.select("name", F.xxhash64(F.lit(-1), left).alias("piece_key")).distinct()


def index_keys(names: DataFrame) -> DataFrame:
    """Columns name, piece_key of the names (distinct, column name) that are split into pieces."""
    n = names.withColumn("len", F.length("name"))
    long = n.where(F.col("len") >= LONG).select("name", "len", F.explode(_structs("i j x y", _indexed())).alias("at"))
    length, at = F.col("len"), F.col("at")
    form = _swapped(_swapped(F.col("name"), length, at["x"]), length, at["y"])
    left = _intact(form, length, at["i"], at["j"], F.lit(0), F.lit(0))
    return long.select("name", F.xxhash64(length, at["i"], at["j"], left).alias("piece_key")).unionByName(_short_keys(n, LONG - 1))


def probe_keys(names: DataFrame) -> DataFrame:
    """Columns name, piece_key of the names that are read at shifted places."""
    n = names.withColumn("len", F.length("name"))
    long = n.select("name", "len", F.explode(_structs("i j s d", _probed())).alias("at")).where(F.col("len") - F.col("at.d") >= LONG)
    at = F.col("at")
    length = F.col("len") - at["d"]
    left = _intact(F.col("name"), length, at["i"], at["j"], at["s"], at["d"])
    return long.select("name", F.xxhash64(length, at["i"], at["j"], left).alias("piece_key")).unionByName(_short_keys(n, LONG - 1 + MOST))


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns left_name, right_name, distance (int, at most two) of all names of ``left`` and ``right`` (column name) that are so close.

    The distance is that of optimal string alignment: insertions, deletions, substitutions of a code
    point and exchanges of neighbours, none edited twice.  The left names are split into five pieces.
    Of an edit inside a piece, at most one piece is lost, so two of them leave three, which the right
    name has at shifts that the lengths bound; the join is on length, the numbers of the lost
    pieces and what the others read.  An exchange that straddles two pieces can only be at one of four
    cuts, so the left name is indexed with these exchanges done as well, and what is left of the
    two edits loses a piece at most.  Names of fewer than ten code points are joined on what they
    leave without up to two code points instead.  Every pair found is measured.  Keys are hashes of 64 bits, which can only add pairs to measure.

    Null and empty names take no part.  Repeated names count once, so no name is hot by its rows.  Nothing is
    broadcast or collected.  Names of any length are taken whole.  An empty table gives no rows; other columns are ignored.
    """
    own = lambda df: df.select("name").where("name <> ''").distinct()
    a, b = index_keys(own(left)).withColumnRenamed("name", "left_name"), probe_keys(own(right)).withColumnRenamed("name", "right_name")
    met = b.join(a.hint("merge"), "piece_key").select("left_name", "right_name").distinct()

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return met.withColumn("distance", distance("left_name", "right_name")).where(F.col("distance") <= MOST)


def lower_ascii(name: Column) -> Column:
    return F.translate(name, UPPER, LOWER)


def misspelt(name: Column, key: Column) -> Column:
    """The name with two neighbouring code points exchanged where the crc32 of the decimal key is even; without a key, as it is."""
    h, n = F.crc32(key.cast("string").cast("binary")), F.length(name)
    p = F.when(n >= 2, h % (n - 1)).otherwise(F.lit(0)).cast("int")
    other = F.concat(F.substring(name, F.lit(1), p), F.substring(name, p + 2, F.lit(1)), F.substring(name, p + 1, F.lit(1)), F.substring(name, p + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), other).otherwise(name)


def vendor_clients(clients: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per vendor and distance: vendor_id, distance, n_clients, first_client_id, clients_crc, of the clients whose name is within two edits of the vendor's.

    Vendor names are misspelt by ``misspelt`` as stored; both names are compared with A-Z in lower case.

    Null and empty names give no rows; a vendor without id keeps its name as it is.  Repeated rows of a
    client count as often as they stand; repeated rows of a vendor give one row.  A vendor id with several
    names gives rows for each of them.  Clients without id count in n_clients only.
    """
    v = vendors.select("vendor_id", lower_ascii(misspelt(F.col("name"), F.col("vendor_id"))).alias("left_name")).where("left_name <> ''").distinct()
    c = clients.select("client_id", lower_ascii(F.col("name")).alias("right_name")).where("right_name <> ''")
    c = c.groupBy("right_name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))).alias("crc"))
    pairs = name_pairs(v.select(F.col("left_name").alias("name")), c.select(F.col("right_name").alias("name")))
    by_name = pairs.join(c.hint("merge"), "right_name").groupBy("left_name", "distance")
    found = by_name.agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.coalesce(F.sum("crc"), F.lit(0)).alias("clients_crc"))
    return v.join(found.hint("merge"), "left_name").select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc")
