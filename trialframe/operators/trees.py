"""Trees as node tables: tree_id, node_id, parent_id (null at the root), kind, and whatever else a node carries."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import get_origin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from trialframe.operators.sequences import in_order, running
from trialframe.sources.scratch import stored

NODE = "tree_id string, node_id long, parent_id long, field string, pos long, kind string, depth long, lo long, hi long, scalar string"


def parse_rows(tree_id: str, source: str | None) -> list[tuple]:
    """Nodes of a Python source in depth-first order, scalars included; none if it doesn't parse."""
    try:
        root = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []
    todo = [(root, None, None, 0, 0)]
    while todo:
        node, parent, field, pos, depth = todo.pop()
        k = len(rows)
        if not isinstance(node, ast.AST):
            rows.append((tree_id, k, parent, field, pos, "scalar", depth, None, None, repr(node)))
            continue
        rows.append((tree_id, k, parent, field, pos, type(node).__name__, depth, getattr(node, "lineno", None), getattr(node, "end_lineno", None), None))
        below = []
        for name, value in ast.iter_fields(node):
            items = value if isinstance(value, list) else [value]
            below += [(x, k, name, i, depth + 1) for i, x in enumerate(items) if x is not None]
        todo += reversed(below)
    return rows


#: Sources that one task parses: their nodes take many times their bytes, by which Spark would deal them.
SOURCES = 20_000


def parse(sources: DataFrame, tree_id: str, source: str) -> DataFrame:
    """The node table of a column of sources; rows are independent and dealt out by their number, ``SOURCES`` to a task."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODE.split(", ")]
        for b in it:
            rows = [r for t, s in zip(b["t"], b["s"], strict=True) for r in parse_rows(t, s)]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("parent_id", "lo", "hi")})

    rows = sources.select(F.col(tree_id).cast("string").alias("t"), F.col(source).cast("string").alias("s"))
    tasks = -(-rows.count() // SOURCES)
    # its joins are merged, as what Spark holds for its size is that of the sources
    return (rows.repartition(tasks) if tasks > 1 else rows).mapInPandas(batches, NODE).hint("merge")


def normal_source():
    """A column function: the source as its tree is written again, null where it doesn't parse."""

    @F.pandas_udf("string")
    def normal(sources: pd.Series) -> pd.Series:
        def one(s):
            try:
                return ast.unparse(ast.parse(s or ""))
            except (SyntaxError, ValueError, RecursionError):
                return None

        return pd.Series([one(s) for s in sources], dtype=object)

    return normal


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id", "kind").agg(F.count("*").alias("n"))


def labeled_edges(nodes: DataFrame) -> DataFrame:
    """(parent kind, kind) of every edge with its count."""
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    return nodes.join(up, ["tree_id", "parent_id"]).groupBy("tree_id", "parent_kind", "kind").agg(F.count("*").alias("n"))


def _circle(rounds: int, most: int) -> None:
    if 2**rounds > most:
        raise ValueError("nodes run in a circle")


def depths(nodes: DataFrame, rounds: int = 6) -> DataFrame:
    """Adds depth (0 at the root) by doubling jumps until none is left.

    The table of jumps is written every second round, so the plan stays small and a path of any length takes
    the logarithm of its length in joins; whether a jump is left is first asked after ``rounds`` joins.
    """
    jump = nodes.select("tree_id", "node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    last, k = None, 0
    while True:
        far = jump.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__d"))
        jump = jump.join(far, ["tree_id", "up"], "left").select("tree_id", "node_id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"))
        k += 1
        if k % 2 == 0:
            last = jump = stored(jump, "depths", last)
            if k >= rounds:
                if jump.where("up IS NOT NULL").isEmpty():
                    break
                _circle(k, 2 * jump.count())
    return nodes.join(jump.select("tree_id", "node_id", "depth"), ["tree_id", "node_id"])


def ancestors(nodes: DataFrame, rounds: int = 6) -> DataFrame:
    """(node_id, ancestor, distance), each node being its own ancestor at distance 0; jumps double until none is left, written as in ``depths``."""
    closed = nodes.select("tree_id", "node_id", F.col("node_id").alias("ancestor"), F.lit(0).alias("distance"))
    jump = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("node_id").alias("ancestor"), F.col("parent_id").alias("above"))
    last, old, k = None, None, 0
    while True:
        # every pair so far, moved up by 2 ** k
        moved = closed.join(jump, ["tree_id", "ancestor"]).select("tree_id", "node_id", F.col("above").alias("ancestor"), (F.col("distance") + 2**k).alias("distance"))
        closed = closed.unionByName(moved)
        twice = jump.select("tree_id", F.col("ancestor").alias("above"), F.col("above").alias("far"))
        jump = jump.join(twice, ["tree_id", "above"]).select("tree_id", "ancestor", F.col("far").alias("above"))
        k += 1
        if k % 2 == 0:
            old, last = stored(closed, "closed", old), stored(jump, "jump", last)
            closed, jump = old, last
            if k >= rounds:
                if jump.isEmpty():
                    return closed
                _circle(k, 2 * nodes.count())


#: Nodes of a tree that one task may hold.
TREE = 50_000


def euler_order(nodes: DataFrame, order: str = "node_id", rounds: int = 6) -> DataFrame:
    """Adds pre (place in depth-first order from 0), size (of the subtree), depth and arity; siblings go by ``order``.

    Trees of ``TREE`` nodes at most are walked whole, many in a task, from sorted rows; larger ones are ranked by joins
    and spread over tasks.  Node ids are not negative, parents are in the table (else tasks fail, as by a circle); a tree
    with several roots is walked root by root.
    """
    counts = nodes.where("tree_id IS NOT NULL").groupBy("tree_id").agg(F.count("*").alias("__all"))
    large = stored(counts.where(F.col("__all") > TREE).select("tree_id"), "large")
    if large.isEmpty():
        return _walked(nodes, order)
    large = F.broadcast(large)  # a row for every TREE nodes at most
    return _walked(nodes.join(large, "tree_id", "left_anti"), order).unionByName(_ranked(nodes.join(large, "tree_id", "left_semi"), order, rounds))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a row's value is another than that of the row before."""
    return pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).to_numpy(zero_copy_only=False)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree_id, cut anew so that no tree lies in two batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        tree = b.column("tree_id")
        starts = np.flatnonzero(_changes(tree)) + 1
        if held and held[-1].column("tree_id")[-1] != tree[0]:
            yield pa.concat_batches(held)
            held = []
        if len(starts):
            yield pa.concat_batches([*held, b.slice(0, starts[-1])])
            held = []
        held.append(b.slice(starts[-1] if len(starts) else 0))
    if held:
        yield pa.concat_batches(held)


def _places(b: pa.RecordBatch) -> list[np.ndarray]:
    """pre, size, depth and arity of the nodes of whole trees, sorted by tree and the order of siblings: the walk of ``_ranked`` in arrays."""
    n = b.num_rows
    tree = np.concatenate([[0], np.cumsum(_changes(b.column("tree_id")))]).astype(np.int64)
    root = b.column("parent_id").is_null().to_numpy(zero_copy_only=False)
    ids = [pc.fill_null(b.column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("node_id", "parent_id")]
    held, code = np.unique(np.concatenate(ids), return_inverse=True)
    own, above = tree * len(held) + code[:n], tree * len(held) + code[n:]
    by = np.argsort(own, kind="stable")
    up = by[np.minimum(np.searchsorted(own[by], above), n - 1)]
    if (own[up] != above)[~root].any():
        raise ValueError("a parent is not in the table")
    up[root] = n + tree[root]
    beside = np.argsort(up, kind="stable")
    more = up[beside[1:]] == up[beside[:-1]]
    first, following = np.full(n, -1), np.full(n, -1)
    following[beside[:-1][more]] = beside[1:][more]
    eldest = beside[np.concatenate([[True], ~more])]
    eldest = eldest[~root[eldest]]
    first[up[eldest]] = eldest
    # a node is entered at twice its row and left at the next place; the last place is the end
    end = 2 * n
    to, entered, deeper = np.full(end + 1, end), np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
    to[0:end:2] = np.where(first >= 0, 2 * first, np.arange(1, end, 2))
    to[1:end:2] = np.where(following >= 0, 2 * following, np.where(root, end, 2 * up + 1))
    entered[0:end:2], deeper[0:end:2], deeper[1:end:2] = 1, 1, -1
    for _ in range(end.bit_length()):
        if (to == end).all():
            break
        entered, deeper, to = entered + entered[to], deeper + deeper[to], to[to]
    if (to != end).any():
        raise ValueError("nodes run in a circle")
    return [np.bincount(tree)[tree] - entered[0:end:2], entered[0:end:2] - entered[1:end:2], -deeper[0:end:2], np.bincount(up[~root], minlength=n)]


def _walked(nodes: DataFrame, order: str) -> DataFrame:
    """``euler_order`` of trees that fit into a task."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(it):
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in _places(b))], names=[*b.schema.names, "pre", "size", "depth", "arity"])

    own = nodes.where("tree_id IS NOT NULL AND node_id IS NOT NULL").repartition("tree_id").sortWithinPartitions("tree_id", order, "node_id").drop("depth")
    return own.mapInArrow(batches, StructType([*own.schema.fields, *(StructField(c, LongType()) for c in ("pre", "size", "depth", "arity"))])).hint("merge")


def _ranked(nodes: DataFrame, order: str, rounds: int) -> DataFrame:
    """``euler_order`` of trees of any size.

    The walk around a tree enters and leaves every node, a list of twice its nodes, which is ranked by doubling
    jumps: trees of any shape, chains and stars, take the logarithm of their size in joins.
    """
    key = ["tree_id", "node_id"]
    beside = W.partitionBy("tree_id", "parent_id").orderBy(order, "node_id")
    below = nodes.where("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", F.struct(F.col(order).alias("o"), F.col("node_id").alias("n"))).alias("first"), F.count("*").alias("arity"))
    own = nodes.select(*key, "parent_id", F.lead("node_id").over(beside).alias("next")).join(below, key, "left")
    enter, leave = (lambda n: F.col(n) * 2), (lambda n: F.col(n) * 2 + 1)
    step = lambda e, to, n, d: F.struct(e.alias("e"), to.alias("to"), F.lit(n).cast("long").alias("entered"), F.lit(d).cast("long").alias("deeper"))
    walk = own.select("tree_id", F.explode(F.array(step(enter("node_id"), F.coalesce(enter("first"), leave("node_id")), 1, 1), step(leave("node_id"), F.coalesce(enter("next"), leave("parent_id")), 0, -1))).alias("s")).select("tree_id", "s.*")
    last, k = None, 0
    while True:
        far = walk.select("tree_id", F.col("e").alias("to"), F.col("to").alias("__to"), F.col("entered").alias("__n"), F.col("deeper").alias("__d"))
        both = walk.join(far, ["tree_id", "to"], "left")
        walk = both.select("tree_id", "e", F.col("__to").alias("to"), (F.col("entered") + F.coalesce("__n", F.lit(0))).alias("entered"), (F.col("deeper") + F.coalesce("__d", F.lit(0))).alias("deeper"))
        k += 1
        if k % 2 == 0:
            last = walk = stored(walk, "walk", last)
            if k >= rounds:
                if walk.where("to IS NOT NULL").isEmpty():
                    break
                _circle(k, 4 * walk.count())
    ends = walk.groupBy("tree_id", F.floor(F.col("e") / 2).alias("node_id")).agg(*(F.sum(F.when(F.col("e") % 2 == x, F.col(c))).alias(n) for n, x, c in (("__in", 0, "entered"), ("__out", 1, "entered"), ("__deep", 0, "deeper"))))
    total = nodes.groupBy("tree_id").agg(F.count("*").alias("__all"))
    placed = ends.join(total, "tree_id").select(*key, (F.col("__all") - F.col("__in")).alias("pre"), (F.col("__in") - F.col("__out")).alias("size"), (-F.col("__deep")).alias("depth"))
    return nodes.drop("depth").join(placed, key).join(below.select(*key, "arity"), key, "left").withColumn("arity", F.coalesce("arity", F.lit(0)))


def subtree_sums(placed: DataFrame, value: str | list[str], out: str | list[str]) -> DataFrame:
    """Adds to a table of ``euler_order`` the sum of ``value`` below each node, itself included: a difference of two running sums, by blocks of places.

    Lists are lists of values and of their sums, which take the joins of one.
    """
    values, outs = ([x] if isinstance(x, str) else x for x in (value, out))
    ends, uptos = [f"__end{k}" for k in range(len(values))], [f"__upto{k}" for k in range(len(values))]
    # written, as rows and their blocks are read for both ends of a subtree
    upto = running(stored(placed.withColumn("pos", F.col("pre")), "placed"), values, uptos, seq="tree_id")
    last = upto.select("tree_id", F.col("pos").alias("__last"), *(F.col(u).alias(e) for u, e in zip(uptos, ends, strict=True)))
    both = upto.withColumn("__last", F.col("pre") + F.col("size") - 1).join(last, ["tree_id", "__last"])
    sums = {o: F.col(e) - F.col(u) + F.col(v) for o, e, u, v in zip(outs, ends, uptos, values, strict=True)}
    return both.withColumns(sums).drop("pos", "__last", *uptos, *ends)


#: A prime below 2 ** 31, and the bases of the three sums that tell subtrees apart.
PRIME, BASES = 2**31 - 1, (1_000_003, 48_271, 69_621)


def subtree_hashes(placed: DataFrame, label: Column) -> DataFrame:
    """Adds subtree_hash to a table of ``euler_order``: equal for subtrees of equal shape and labels, whatever tree they are in.

    Labels and numbers of children in depth-first order tell an ordered tree.  A subtree is a range of that order, so
    its hash is a difference of running sums of label times a power of the place, moved back to the range's start, for
    three bases; together they hold 93 bits, so subtrees that differ share a hash by chance only.
    """
    code = F.md5(F.concat_ws("\x1f", F.length(label).cast("string"), label, F.col("arity").cast("string")).cast("binary"))
    values, sums = ([f"{c}{k}" for k in range(len(BASES))] for c in ("__v", "__s"))
    term = lambda k: F.conv(F.substring("__code", 1 + 7 * k, 7), 16, 10).cast("long") + 1
    out = placed.withColumn("__code", code).withColumns({v: term(k) * _power(BASES[k], F.col("pre")) % PRIME for k, v in enumerate(values)}).drop("__code")
    out = subtree_sums(out, values, sums)
    parts = (F.lower(F.hex(F.col(s) % PRIME * _power(pow(BASES[k], -1, PRIME), F.col("pre")) % PRIME)) for k, s in enumerate(sums))
    return out.withColumn("subtree_hash", F.concat_ws("-", F.col("size").cast("string"), *parts)).drop(*values, *sums)


def _power(base: int, e: Column) -> Column:
    """base ** e modulo PRIME, by the powers of the four bytes that e has modulo PRIME - 1."""
    e = e % (PRIME - 1)
    table = lambda k: F.split(F.lit(",".join(str(pow(base, x << 8 * k, PRIME)) for x in range(256))), ",").cast("array<bigint>")
    a, b, c, d = (table(k)[F.shiftright(e, 8 * k).bitwiseAND(255).cast("int")] for k in range(4))
    return a * b % PRIME * c % PRIME * d % PRIME


def tree_hashes(placed: DataFrame, label: Column) -> DataFrame:
    """tree_id and tree_hash, the SHA-256 of a tree's labels and numbers of children in depth-first order, which is equal exactly for equal trees."""
    sign = F.concat(F.length(label).cast("string"), F.lit(":"), label, F.lit("/"), F.col("arity").cast("string"))
    return placed.groupBy("tree_id").agg(F.sha2(F.array_join(in_order(sign, F.col("pre")), ",").cast("binary"), 256).alias("tree_hash"))


def rendered(placed: DataFrame, before: Column, after: Column) -> DataFrame:
    """tree_id and text: every node says ``before`` where the walk around its tree enters it and ``after`` where it leaves it.

    All nodes write at once at the places that ``euler_order`` tells; a tree's text is one row, put together from its nodes' parts.
    """
    enter = 2 * F.col("pre") - F.col("depth")
    parts = placed.select("tree_id", F.explode(F.array(F.struct(enter.alias("at"), before.alias("said")), F.struct((enter + 2 * F.col("size") - 1).alias("at"), after.alias("said")))).alias("p"))
    return parts.groupBy("tree_id").agg(F.array_join(in_order("p.said", "p.at"), "").alias("text"))


@cache
def _fields(kind: str) -> tuple[type, list[tuple[str, bool]]]:
    """The class of a kind, and its fields with whether they are lists."""
    cls = getattr(ast, kind)
    return cls, [(name, get_origin(t) is list) for name, t in cls._field_types.items()]


@lru_cache(10_000)
def _short_scalar(said: str):
    return {"Ellipsis": ..., "inf": math.inf}[said] if said in ("Ellipsis", "inf") else complex(0, math.inf) if said == "infj" else ast.literal_eval(said)


def _scalar(said: str):
    return _short_scalar(said) if len(said) <= 100 else ast.literal_eval(said)


def _built(rows: list[tuple]) -> ast.AST:
    """The syntax tree of (node_id, parent_id, field, pos, kind, scalar) in the order of node_id: children have greater ids, so they are built first."""
    held: dict[int, dict[str, dict[int, object]]] = {}
    made = None
    for node_id, parent_id, field, pos, kind, scalar in reversed(rows):
        if kind == "scalar":
            made = _scalar(scalar)
        else:
            (cls, names), own = _fields(kind), held.pop(node_id, {})
            fields: dict[str, object] = {}
            for name, many in names:
                at = own.get(name, {})
                fields[name] = [at.get(i) for i in range(max(at, default=-1) + 1)] if many else at.get(0)
            for short, full in (("keys", "values"), ("kw_defaults", "kwonlyargs")):  # empty places at the end
                if isinstance(fields.get(short), list) and full in fields:
                    fields[short] += [None] * (len(fields[full]) - len(fields[short]))
            made = cls(**fields)
        if not pd.isna(parent_id):
            held.setdefault(int(parent_id), {}).setdefault(field, {})[int(pos)] = made
    return ast.fix_missing_locations(made)


def _base(note: ast.AST | None) -> str | None:
    """The name of an annotation without its parameters and modules."""
    if isinstance(note, ast.Subscript):
        return _base(note.value)
    return note.id if isinstance(note, ast.Name) else note.attr if isinstance(note, ast.Attribute) else "None" if isinstance(note, ast.Constant) and note.value is None else None


PARTS = "tree_id string, source string, name string, params array<struct<name:string,base:string>>, returns string, doc string, imports array<string>, body array<string>"


def to_source(nodes: DataFrame) -> DataFrame:
    """From the node table back to text: tree_id, source, and of the first function name, params (annotated ones, with the annotation's base), returns, doc, the imports before it, and the lines of its body without the docstring.

    A tree's nodes meet in one task, as its text did when it was parsed; a task reads its trees one after the other from sorted rows.
    """
    columns = ["node_id", "parent_id", "field", "pos", "kind", "scalar"]

    def one(tree_id: str, rows: list[tuple]) -> list:
        tree = _built(rows)
        f = next((x for x in tree.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)), None)
        found: list = [tree_id, ast.unparse(tree), None, [], None, None, [], []]
        if f is not None:
            doc = ast.get_docstring(f, clean=True)
            params = [{"name": a.arg, "base": b} for a in f.args.args if (b := _base(a.annotation)) is not None]
            imports = [ast.unparse(x) for x in tree.body[: tree.body.index(f)] if isinstance(x, ast.Import | ast.ImportFrom)]
            body = [line for x in f.body[doc is not None :] for line in ast.unparse(x).split("\n")]
            found[2:] = [f.name, params, _base(f.returns), doc, imports, body]
        return found

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        held: tuple | None = None
        for b in it:
            found = []
            for tree_id, row in zip(b["tree_id"].tolist(), zip(*(b[c].tolist() for c in columns), strict=True), strict=True):
                if held is None or held[0] != tree_id:
                    if held is not None:
                        found.append(one(*held))
                    held = (tree_id, [])
                held[1].append(row)
            yield pd.DataFrame(found, columns=names)
        if held is not None:
            yield pd.DataFrame([one(*held)], columns=names)

    together = nodes.select("tree_id", *columns).repartition("tree_id").sortWithinPartitions("tree_id", "node_id")
    return together.mapInPandas(batches, PARTS).hint("merge")


def tree_distance(pairs: DataFrame, nodes: DataFrame, rounds: int = 6) -> DataFrame:
    """Adds to (tree_id, a, b) the steps from a to b over their lowest common ancestor."""
    up = ancestors(nodes, rounds)
    a = up.select("tree_id", F.col("node_id").alias("a"), "ancestor", F.col("distance").alias("da"))
    b = up.select("tree_id", F.col("node_id").alias("b"), "ancestor", F.col("distance").alias("db"))
    return pairs.join(a, ["tree_id", "a"]).join(b, ["tree_id", "b", "ancestor"]).groupBy("tree_id", "a", "b").agg(F.min(F.col("da") + F.col("db")).alias("distance"))


def smallest_covering(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """For (tree_id, line) the node with the tightest span lo..hi around it: least width, then depth, then the first.

    Spans are cut at powers of two of their width, so that a span and a line meet in a bucket of the span's own level: a node has at
    most two buckets, a line one for each level that its tree has, and no line meets all nodes of its tree.
    """
    level = lambda w: F.when(w < 1, 0).otherwise(F.floor(F.log2(F.greatest(w, F.lit(1)).cast("double"))) + 1).cast("int")
    width = F.col("hi") - F.col("lo")
    own = nodes.where("lo IS NOT NULL AND hi >= lo").select("tree_id", "node_id", "lo", "hi", "depth", level(width).alias("level"))
    size = lambda k: F.expr(f"shiftleft(1L, {k})")
    at = lambda x, k: F.floor(F.col(x) / size(k)).cast("long")
    placed = own.select("*", F.explode(F.array_distinct(F.array(at("lo", "level"), at("hi", "level")))).alias("bucket"))
    used = own.select("tree_id", "level").distinct()
    asked = points.join(used, "tree_id").select("tree_id", "line", "level", at("line", "level").alias("bucket"))
    hit = asked.join(placed, ["tree_id", "level", "bucket"]).where(F.col("line").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("tree_id", "line").agg(F.min_by("node_id", F.struct((F.col("hi") - F.col("lo")).alias("w"), (-F.col("depth")).alias("d"), F.col("node_id"))).alias("node_id"))


def bag_retention(before: DataFrame, after: DataFrame, keys: list[str], value: str, bags: DataFrame | None = None) -> DataFrame:
    """Share of a bag that another one keeps, by counts; an empty bag of ``bags`` (the keys of all bags) keeps 1.0."""
    a = before.groupBy(*keys, value).agg(F.count("*").alias("a"))
    b = after.groupBy(*keys, value).agg(F.count("*").alias("b"))
    out = a.join(b, [*keys, value], "left").groupBy(*keys).agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("retention"))
    if bags is None:
        return out
    return bags.select(*keys).distinct().join(out, keys, "left").withColumn("retention", F.coalesce("retention", F.lit(1.0)))


def set_retention(before: Column, after: Column) -> Column:
    """Share of a set that another one keeps; 1.0 for an empty set."""
    own = F.array_distinct(before)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, after)) / F.size(own))


def direct_recursion(nodes: DataFrame) -> DataFrame:
    """Whether a tree calls, by name, the first function that it defines."""
    s = nodes.alias("s")
    defined = s.where("field = 'name' AND kind = 'scalar'").join(nodes.where("kind IN ('FunctionDef', 'AsyncFunctionDef')").select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"]).groupBy("tree_id").agg(F.min_by("scalar", "parent_id").alias("name"))
    called = nodes.where("kind = 'Name' AND field = 'func'").select("tree_id", F.col("node_id").alias("parent_id"))
    names = s.where("field = 'id' AND kind = 'scalar'").join(called, ["tree_id", "parent_id"]).select("tree_id", F.col("scalar").alias("name")).distinct().withColumn("recursive", F.lit(True))
    return defined.join(names, ["tree_id", "name"], "left").select("tree_id", F.coalesce("recursive", F.lit(False)).alias("recursive"))
