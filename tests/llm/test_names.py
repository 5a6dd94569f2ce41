"""Names within two edits, against all pairs."""

import random
import zlib

import duckdb
import pytest
from places import SF

from trialframe.llm import names, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(a, b):
    """Optimal string alignment over the whole table of prefixes."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rng, name, alphabet):
    x = list(name)
    for _ in range(rng.choice((0, 1, 2, 2, 2, 3))):
        kind, p = rng.randrange(4), rng.randrange(len(x) + 1)
        if kind == 0:
            x.insert(p, rng.choice(alphabet))
        elif x and kind == 1:
            del x[p % len(x)]
        elif x and kind == 2:
            x[p % len(x)] = rng.choice(alphabet)
        elif len(x) > 1:
            p %= len(x) - 1
            x[p], x[p + 1] = x[p + 1], x[p]
    return "".join(x)


def test_distance():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choices("abc", k=rng.randrange(14)))
        b = edited(rng, a, "abc")
        assert names.osa(a, b) == min(3, plain(a, b)), (a, b)
    assert names.osa("x" * 100_000 + "ab", "x" * 100_000 + "ba") == 1
    assert names.osa("ca", "abc") == 3  # no substring is edited twice


def test_pairs(spark):
    """Every pair within two edits is found: edits of all kinds at all places of names of all lengths, straddling ones too."""
    rng = random.Random(3)
    left = [""] + ["".join(rng.choices("abcdefghij", k=k)) for k in range(1, 31) for _ in range(4)] + ["é漢字😀" * 4, "aaaaaaaaaaaa", "ab" * 8]
    right = [edited(rng, a, "abcdefghij漢") for a in left for _ in range(25)]
    for a in ("abcdefghijklmnopqr", "abcdefghij"):  # two exchanges at every two places
        left.append(a)
        swap = lambda x, p: x[:p] + x[p + 1] + x[p] + x[p + 2 :]
        right += [swap(swap(a, p), q) for p in range(len(a) - 1) for q in range(p + 2, len(a) - 1)]
    one = lambda x: spark.createDataFrame([(n, "z") for n in x] + [(None, "z")], "name string, distance string")
    got = {tuple(r) for r in names.name_pairs(one(left), one(right)).select("left_name", "right_name", "distance").collect()}
    want = {(a, b, d) for a in set(left) - {""} for b in set(right) - {""} if abs(len(a) - len(b)) <= 2 and (d := plain(a, b)) <= 2}
    assert len(want) > 1500 and got == want


def by_hand(clients, vendors):
    found = {}
    held = {}
    for c, n in clients:
        if n:
            held.setdefault(n.translate(FOLD), []).append(c)
    for v, n in {x for x in vendors if x[1]}:
        h = 1 if v is None else zlib.crc32(str(v).encode())
        if h % 2 == 0 and len(n) >= 2:
            p = h % (len(n) - 1)
            n = n[:p] + n[p + 1] + n[p] + n[p + 2 :]
        n = n.translate(FOLD)
        for name, ids in held.items():
            if abs(len(name) - len(n)) <= 2 and (d := plain(n, name) if len(n) < 99 else names.osa(n, name)) <= 2:
                found.setdefault((v, n, d), []).extend(ids)
    return sorted((str(v), d, len(ids), min((i for i in ids if i is not None), default=None), sum(zlib.crc32(str(i).encode()) for i in ids if i is not None)) for (v, _, d), ids in found.items())


def test_query(spark):
    rows = lambda t, c: duckdb.sql(f"SELECT {c}, name FROM '{SF}/{t}.parquet'").fetchall()
    got = queries.op13_name_join(spark, SF).collect()
    assert sorted((str(r.vendor_id), r.distance, r.n_clients, r.first_client_id, r.clients_crc) for r in got) == by_hand(rows("clients", "client_id"), rows("vendors", "vendor_id"))


@pytest.mark.parametrize("flip", (False, True))
def test_edges(spark, flip):
    """Nulls, empty and very long names, repeated rows, clashing columns, empty tables."""
    long = "Anna Maria " * 3000
    clients = [(1, "Anna Lindqvist"), (1, "Anna Lindqvist"), (2, "anna lindqvits"), (None, "Anna Lindqvist"), (3, None), (4, ""), (5, "A"), (6, long), (7, "Ännä Lindqvist"), (8, " ")]
    vendors = [(1, "Anna Lindqvist"), (1, "Anna Lindqvist"), (None, "ANNA LINDQVIST"), (2, None), (3, ""), (4, "Bo"), (5, long[:-1]), (1, "Anna Lindqvis")]
    if flip:
        clients, vendors = vendors, clients
    c = spark.createDataFrame([(*r, "x", "y") for r in clients], "client_id long, name string, vendor_id string, distance string")
    v = spark.createDataFrame([(*r, "x", "y") for r in vendors], "vendor_id long, name string, n string, left_name string")
    got = names.vendor_clients(c, v)
    assert sorted((str(r.vendor_id), r.distance, r.n_clients, r.first_client_id, r.clients_crc) for r in got.collect()) == by_hand(clients, vendors)
    assert names.vendor_clients(c.where("false"), v).count() == names.vendor_clients(c, v.where("false")).count() == 0
