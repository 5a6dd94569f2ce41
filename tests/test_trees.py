"""Trees of any shape: order, sums, hashes, text and back to source."""

import ast
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trialframe.operators import trees


@pytest.fixture(scope="module")
def shapes(spark):
    """A chain, a star, random trees with ids in no order, twins and a tree that differs from them in one leaf."""
    rng = random.Random(7)
    rows = [("chain", k, k - 1 if k else None, "n") for k in range(1000)] + [("star", k, 0 if k else None, "n") for k in range(300)]
    for t in range(8):
        ids = rng.sample(range(1000), 40)
        rows += [(f"r{t}", x, rng.choice(ids[:k]) if k else None, rng.choice("ab")) for k, x in enumerate(ids)]
    twin = [(0, None, "a"), (1, 0, "b"), (2, 0, "c"), (3, 1, "b")]
    rows += [("t1", *r) for r in twin] + [("t2", 10 * n, None if p is None else 10 * p, k) for n, p, k in twin] + [("t3", n, p, "x" if n == 3 else k) for n, p, k in twin] + [("one", 5, None, "a")]
    return spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, kind string")


def plain(rows):
    """tree, node -> (pre, size, depth, shape)."""
    kids, roots = {}, {}
    for r in sorted(rows, key=lambda r: r.node_id):
        (roots.__setitem__(r.tree_id, r) if r.parent_id is None else kids.setdefault((r.tree_id, r.parent_id), []).append(r))
    out = {}
    for t, root in roots.items():
        order, todo = [], [(root, 0)]
        while todo:
            r, deep = todo.pop()
            order.append((r, deep))
            todo += [(k, deep + 1) for k in reversed(kids.get((t, r.node_id), []))]
        for pre, (r, deep) in reversed(list(enumerate(order))):
            below = [out[t, k.node_id] for k in kids.get((t, r.node_id), [])]
            out[t, r.node_id] = (pre, 1 + sum(b[1] for b in below), deep, hash((r.kind, tuple(b[3] for b in below))))
    return out


def test_order_and_hashes(shapes):
    want = plain(shapes.collect())
    placed = trees.euler_order(shapes)
    got = {(r.tree_id, r.node_id): r for r in trees.subtree_hashes(trees.subtree_sums(placed.withColumn("one", F.lit(1)), "one", "below"), F.col("kind")).collect()}
    assert {k: (r.pre, r.size, r.depth) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(r.below == r.size for r in got.values())
    assert len({(r.subtree_hash, want[k][3]) for k, r in got.items()}) == len({r.subtree_hash for r in got.values()}) == len({v[3] for v in want.values()})
    whole = {r.tree_id: r.tree_hash for r in trees.tree_hashes(placed, F.col("kind")).collect()}
    assert whole["t1"] == whole["t2"] != whole["t3"]
    text = {r.tree_id: r.text for r in trees.rendered(placed, F.concat("kind", F.lit("(")), F.lit(")")).collect()}
    assert text["t2"] == "a(b(b())c())" and text["one"] == "a()" and text["chain"] == "n(" * 1000 + ")" * 1000


def test_long_chain(shapes):
    """A thousand steps down, by ten joins or so."""
    chain = shapes.where("tree_id = 'chain'")
    assert {r.node_id: r.depth for r in trees.depths(chain, 2).collect()} == {k: k for k in range(1000)}
    short = chain.where("node_id < 200")
    up = trees.ancestors(short, 2).groupBy("node_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()
    assert {r.node_id: (r.n, r.far) for r in up} == {k: (k + 1, k) for k in range(200)}
    ring = chain.sparkSession.createDataFrame([("r", 0, 1), ("r", 1, 0)], "tree_id string, node_id long, parent_id long")
    with pytest.raises(ValueError, match="circle"):
        trees.depths(ring, 2)


SOURCES = [
    "import math\nfrom os import path as p\n\ndef f(a: int, b: list[int] = None, *c, d=1, e, **k) -> dict[str, int]:\n    \"\"\"Says.\n\n    More.\"\"\"\n    x = {**k, 'a': ..., 1: b'q', None: 1e400, True: 2j}\n    return [y for y in x if y not in (1, -2)][::2]\n",
    "class A(B, metaclass=M):\n    @staticmethod\n    async def g(self):\n        async with a as b, c:\n            await d\n        try:\n            pass\n        except (E, F) as e:\n            raise\n        finally:\n            global z\n",
    "def h(x):\n    match x:\n        case {'k': v, **rest}:\n            pass\n        case [1, *_] | None:\n            return f'{x!r:>{3}} {{}}'\n    lambda *, a=1, b: (yield)\n",
    "x = 1\n", "", "def broken(:\n",
]


def test_back_to_source(spark):
    """Text to nodes to text gives the same tree, for all syntax of this package too; what doesn't parse has no rows."""
    files = [p.read_text() for p in sorted(Path(trees.__file__).parents[1].rglob("*.py")) if p.stat().st_size]
    texts = SOURCES + files
    df = spark.createDataFrame([(str(n), s) for n, s in enumerate(texts)], "t string, s string")
    got = {int(r.tree_id): r for r in trees.to_source(trees.parse(df, "t", "s")).collect()}
    assert sorted(got) == [n for n in range(len(texts)) if n != 5]
    for n, r in got.items():
        assert ast.dump(ast.parse(r.source)) == ast.dump(ast.parse(texts[n])), n
    r = got[0]
    assert (r.name, r.doc, r.returns, r.imports) == ("f", "Says.\n\nMore.", "dict", ["import math", "from os import path as p"]) and [tuple(p) for p in r.params] == [("a", "int"), ("b", "list")]
    assert len(r.body) == 2 and got[3].name is None and got[1].name is None


def test_clauses(spark):
    from trialframe.operators import ir

    docs = ["Says.\n\n    PRECONDITIONS:\n- one\n  -  two three \nnot a bullet\n\nPostconditions:\n- None.\nInvariants:\n- none\n-\n- x: y\nPreconditions:\n- four", None, "", "Preconditions: here\n- no", "Invariants:"]
    got = [r.c for r in spark.createDataFrame([(n, d) for n, d in enumerate(docs)], "n int, d string").orderBy("n").select(ir.contract_clauses(F.col("d")).alias("c")).collect()]
    assert [tuple(map(list, c)) for c in got] == [(["one", "two three", "four"], [], ["x: y"])] + [([], [], [])] * 4


def test_records_and_recovery(spark):
    """A body that loses a statement and a text that loses a clause keep a part only; empty sets are kept whole."""
    from trialframe.operators import ir

    typed = spark.createDataFrame([("f", "h", "typed_ast-v1", ([("a", "builtins.list[builtins.int]"), ("b", "")], "NoneType")), ("g", "h", "odd", ([("", "x")], None)), ("k", "h", "typed_ast-v1", ([], "x.y.Any"))], "func_id string, source_hash string, record_format string, type_info struct<params:array<struct<name:string,mypy_type:string>>,return_type:string>")
    own = ["b is set", "the  Total is b"]
    contracts = spark.createDataFrame([("f", "h", "contract-reviewed-v1", own, ["total rises"], []), ("g", "z", "contract-reviewed-v1", [], [], None), ("k", "h", "contract-reviewed-v1", [], ["x"], ['"""'])], "func_id string, source_hash string, record_format string, preconditions array<string>, postconditions array<string>, invariants array<string>")
    records, broken = ir.assemble(typed, contracts)
    assert [r.func_id for r in records.collect()] == ["f"]
    rules = sorted((r.key, r.rule_id) for r in broken.collect())
    assert rules == sorted([("g", "contract.invariants_listed"), ("g", "contract.postcondition_given"), ("g", "hash_mismatch"), ("g", "typed.params_named"), ("g", "typed.return_set"), ("g", "typed.tag"), ("g", "contract.no_closing_quotes")][:6] + [("k", "contract.no_closing_quotes")])
    source = spark.createDataFrame([("f", "import re\ndef f(a, b):\n    '''Old.'''\n    a.append(b)\n    return None\n")], "func_id string, source string")
    nodes = trees.parse(source, "func_id", "source")
    body = trees.to_source(nodes).select(F.col("tree_id").alias("func_id"), "imports", "body")
    texts = records.join(body, "func_id").select("func_id", ir.annotated_text(F.col("func_id"), F.col("type_info"), F.col("contracts"), F.col("imports"), F.col("body")).alias("text"))
    text = texts.first().text
    assert text == 'import re\ndef f(a: list[int], b) -> None:\n    """\n    Preconditions:\n    - b is set\n    - the  Total is b\n\n    Postconditions:\n    - total rises\n\n    Invariants:\n    - None.\n    """\n    a.append(b)\n    return None\n'
    measure = lambda t: ir.recovery(records, nodes, trees.to_source(again := trees.parse(t, "func_id", "text")), again).first()
    r = measure(texts)
    assert (r.node_kinds, r.edges, r.preconditions, r.postconditions, r.invariants, r.cross_references, r.hash_agrees) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, False) and r.types == round(1 / 3, 6)
    r = measure(texts.withColumn("text", F.replace(F.replace("text", F.lit("    a.append(b)\n"), F.lit("")), F.lit("    - the  Total is b\n"), F.lit(""))))
    assert r.node_kinds < 1 and r.edges < 1 and r.preconditions == 0.5 and r.postconditions == 1.0 and r.cross_references == 0.0
    assert measure(source.withColumnRenamed("source", "text")).hash_agrees
    summary = {x.metric: x for x in ir.recovery_summary(ir.recovery(records, nodes, trees.to_source(nodes), nodes)).collect()}
    assert summary["hash_agrees"].mean == 1.0 and summary["node_kinds"].n == 1


def test_written_tables_are_not_broadcast(shapes):
    """Files of a written table are small, its rows may be many: no join sends them through the driver."""
    deep = trees.depths(shapes, 2)
    assert "Broadcast" not in deep._jdf.queryExecution().executedPlan().toString()


def test_sources_are_dealt_by_number(spark, monkeypatch):
    """Parsing goes by the number of sources; trees whose rows lie apart come back whole, one after the other."""
    monkeypatch.setattr(trees, "SOURCES", 10)
    df = spark.range(95).select(F.col("id").alias("t"), F.concat(F.lit("x = "), F.col("id").cast("string"), F.lit("\ndef f(a):\n    return 'y'\n")).alias("s")).coalesce(1)
    nodes = trees.parse(df, "t", "s")
    assert nodes.rdd.getNumPartitions() == 10
    got = {int(r.tree_id): r.source for r in trees.to_source(nodes.repartition(7)).collect()}
    assert got == {k: f"x = {k}\n\ndef f(a):\n    return 'y'" for k in range(95)}
    assert "FlatMapGroupsInPandas" not in trees.to_source(nodes)._jdf.queryExecution().optimizedPlan().toString()


def test_small_trees_are_walked_whole(shapes, monkeypatch):
    """Trees that fit into a task take no joins; larger ones are ranked by them, with the same result beside them."""
    written = []
    monkeypatch.setattr(trees, "stored", lambda df, name, *a, f=trees.stored: (written.append(name), f(df, name, *a))[1])
    forest = shapes.sparkSession.createDataFrame([("two", 3, None, "a"), ("two", 9, 7, "b"), ("two", 7, None, "c"), ("two", 4, 7, "d")], shapes.schema)
    own = shapes.withColumn("said", F.array("kind")).unionByName(forest.withColumn("said", F.array("kind"))).repartition(5)
    whole = sorted(map(tuple, trees.euler_order(own).collect()), key=repr)
    assert "walk" not in written
    assert {r[1]: r[5:] for r in whole if r[0] == "two"} == {3: (0, 1, 0, 0), 7: (1, 3, 0, 2), 4: (2, 1, 1, 0), 9: (3, 1, 1, 0)}
    monkeypatch.setattr(trees, "TREE", 39)
    both = trees.euler_order(own)
    assert "walk" in written and sorted(map(tuple, both.collect()), key=repr) == whole
    back = own.withColumn("turned", -F.col("node_id"))
    turned = sorted(map(tuple, trees.euler_order(back, "turned").drop("turned").collect()), key=repr)
    monkeypatch.setattr(trees, "TREE", 1000)
    assert sorted(map(tuple, trees.euler_order(back, "turned").drop("turned").collect()), key=repr) == turned != whole


def test_trees_across_batches(shapes):
    """Batches that end inside a tree change nothing."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = shapes.sparkSession
    whole, old = sorted(map(tuple, trees.euler_order(shapes).collect())), spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert sorted(map(tuple, trees.euler_order(shapes).collect())) == whole
    finally:
        spark.conf.set(key, old)


def test_broken_trees_are_refused(spark):
    schema = "tree_id string, node_id long, parent_id long"
    for rows, said in (([("r", 0, None), ("r", 1, 2), ("r", 2, 1)], "circle"), ([("r", 0, None), ("r", 1, 5)], "parent")):
        with pytest.raises(Exception, match=said):
            trees.euler_order(spark.createDataFrame(rows, schema)).collect()
    assert trees.euler_order(spark.createDataFrame([], schema)).collect() == []


def test_hashes_take_the_joins_of_one_sum(shapes):
    """Three running sums are one pass over a written table: one join for the blocks of each end, one for both ends."""
    plan = trees.subtree_hashes(trees.euler_order(shapes), F.col("kind"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3 and "aggregate(" not in plan


def test_large_classes_meet_no_task(spark, monkeypatch):
    """Classes of many nodes are broadcast, with the same result."""
    from places import SF

    from trialframe.plans import tree_queries

    want = sorted(map(tuple, tree_queries.equal_subtrees(spark, SF).collect()))
    monkeypatch.setattr(tree_queries, "OFTEN", 20)
    assert sorted(map(tuple, tree_queries.equal_subtrees(spark, SF).collect())) == want
