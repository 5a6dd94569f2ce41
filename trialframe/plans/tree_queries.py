"""Queries of the tree operators: each user's events form a binary heap whose kinds are the event types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators import ir, trees
from trialframe.plans.sequence_queries import events
from trialframe.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Nodes of a class of equal subtrees beyond which it is broadcast instead of meeting in a task.
OFTEN = 100_000


def nodes(spark, d) -> DataFrame:
    pos = F.col("pos").cast("bigint")
    parent = F.when(pos > 0, F.floor((pos - 1) / 2))
    return events(spark, d).select(F.col("seq_id").alias("tree_id"), pos.alias("node_id"), parent.alias("parent_id"), F.col("k").alias("kind"), F.col("b").alias("lo"), (F.col("b") + F.col("v") % 5).alias("hi"))


_NODES = """node AS (SELECT user_id AS tree_id, pos AS node_id, CASE WHEN pos > 0 THEN (pos - 1) // 2 END AS parent_id, k AS kind, b AS lo, b + v % 5 AS hi FROM
 (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS k, round(value * 100)::BIGINT AS v, floor(round(value * 100)::BIGINT / 1000)::BIGINT AS b FROM events))"""
_DEPTH = f"WITH RECURSIVE {_NODES}, dep AS (SELECT tree_id, node_id, 0::BIGINT AS depth FROM node WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, depth + 1 FROM node n JOIN dep ON n.tree_id = dep.tree_id AND n.parent_id = dep.node_id)"


@query(f"WITH {_NODES} SELECT tree_id, kind, count(*) AS n FROM node GROUP BY ALL")
def node_kinds(spark, d):
    return trees.kind_counts(nodes(spark, d))


@query(f"WITH {_NODES} SELECT a.tree_id, b.kind AS parent_kind, a.kind, count(*) AS n FROM node a JOIN node b ON a.tree_id = b.tree_id AND a.parent_id = b.node_id GROUP BY ALL")
def labeled_edges(spark, d):
    return trees.labeled_edges(nodes(spark, d))


@query(f"{_DEPTH} SELECT tree_id, node_id, depth FROM dep")
def node_depths(spark, d):
    return trees.depths(nodes(spark, d), 4).select("tree_id", "node_id", "depth")


@query(f"""WITH RECURSIVE {_NODES}, up AS (SELECT tree_id, node_id, node_id AS a, 0::BIGINT AS d FROM node UNION ALL SELECT up.tree_id, up.node_id, n.parent_id, d + 1 FROM up JOIN node n ON n.tree_id = up.tree_id AND n.node_id = up.a WHERE n.parent_id IS NOT NULL)
 SELECT x.tree_id, x.node_id AS a, y.node_id AS b, min(x.d + y.d)::BIGINT AS distance FROM up x JOIN up y ON x.tree_id = y.tree_id AND y.node_id = x.node_id + 3 AND x.a = y.a GROUP BY ALL""")
def tree_distance(spark, d):
    own = nodes(spark, d)
    last = own.groupBy("tree_id").agg(F.max("node_id").alias("m"))
    pairs = own.join(last, "tree_id").where("node_id + 3 <= m").select("tree_id", F.col("node_id").alias("a"), (F.col("node_id") + 3).alias("b"))
    return trees.tree_distance(pairs, own, 4)


@query(f"""{_DEPTH}, l AS (SELECT DISTINCT tree_id, lo AS line FROM node), c AS (SELECT l.tree_id, line, n.node_id, row_number() OVER (PARTITION BY l.tree_id, line ORDER BY hi - lo, -depth, n.node_id) AS r FROM l JOIN node n ON n.tree_id = l.tree_id AND line BETWEEN lo AND hi JOIN dep ON dep.tree_id = n.tree_id AND dep.node_id = n.node_id)
 SELECT tree_id, line, node_id FROM c WHERE r = 1""")
def smallest_covering_node(spark, d):
    own = trees.depths(nodes(spark, d), 4)
    return trees.smallest_covering(own.select("tree_id", F.col("lo").alias("line")).distinct(), own)


@query(f"""WITH {_NODES}, a AS (SELECT tree_id, kind, count(*) AS n FROM node WHERE node_id % 2 = 0 GROUP BY ALL), b AS (SELECT tree_id, kind, count(*) AS n FROM node WHERE node_id % 2 = 1 GROUP BY ALL)
 SELECT a.tree_id, round(sum(least(a.n, coalesce(b.n, 0))) / sum(a.n), 6)::DOUBLE AS retention FROM a LEFT JOIN b USING (tree_id, kind) GROUP BY ALL""")
def multiset_retention(spark, d):
    own = nodes(spark, d)
    return trees.bag_retention(own.where("node_id % 2 = 0"), own.where("node_id % 2 = 1"), ["tree_id"], "kind", own).withColumn("retention", F.round("retention", 6))


@query(f"""WITH {_NODES}, x AS (SELECT DISTINCT tree_id, lo FROM node WHERE node_id < 20), y AS (SELECT DISTINCT tree_id, lo FROM node WHERE node_id >= 20) SELECT x.tree_id, round(count(y.lo) / count(*), 6) AS retention FROM x LEFT JOIN y ON x.tree_id = y.tree_id AND x.lo = y.lo GROUP BY ALL""")
def set_retention(spark, d):
    held = nodes(spark, d).groupBy("tree_id").agg(F.collect_set(F.when(F.col("node_id") < 20, F.col("lo"))).alias("a"), F.collect_set(F.when(F.col("node_id") >= 20, F.col("lo"))).alias("b"))
    return held.select("tree_id", F.round(trees.set_retention(F.col("a"), F.col("b")), 6).alias("retention"))


# the way to a node in its heap by letters; its order is depth-first
_WAY = f"""WITH RECURSIVE {_NODES}, way AS (SELECT tree_id, node_id, '' AS way FROM node WHERE parent_id IS NULL UNION ALL SELECT n.tree_id, n.node_id, way || CASE WHEN n.node_id % 2 = 1 THEN 'a' ELSE 'b' END FROM node n JOIN way ON n.tree_id = way.tree_id AND n.parent_id = way.node_id),
 kid AS (SELECT tree_id, parent_id AS node_id, count(*) AS arity FROM node WHERE parent_id IS NOT NULL GROUP BY ALL), w AS (SELECT way.*, kind, lo, coalesce(arity, 0) AS arity FROM way JOIN node USING (tree_id, node_id) LEFT JOIN kid USING (tree_id, node_id)),
 sub AS (SELECT v.tree_id, v.node_id, v.way, count(*) AS size, sum(x.lo)::BIGINT AS lo_below, string_agg(substr(x.way, length(v.way) + 1) || x.kind, ',' ORDER BY x.way) AS shape FROM w v JOIN w x ON x.tree_id = v.tree_id AND starts_with(x.way, v.way) GROUP BY ALL)"""


@query(f"{_WAY} SELECT tree_id, sha256(string_agg(length(kind) || ':' || kind || '/' || arity, ',' ORDER BY way)) AS tree_hash FROM w GROUP BY ALL")
def canonical_hash(spark, d):
    return trees.tree_hashes(trees.euler_order(nodes(spark, d)), F.col("kind"))


@query(f"{_WAY} SELECT tree_id, node_id, row_number() OVER (PARTITION BY tree_id ORDER BY way) - 1 AS pre, size, length(way) AS depth, lo_below FROM sub")
def euler_order(spark, d):
    """Place in depth-first order, size and depth of every node, and a sum over its subtree."""
    return trees.subtree_sums(trees.euler_order(nodes(spark, d)), "lo", "lo_below").select("tree_id", "node_id", "pre", "size", "depth", "lo_below")


@query(f"{_WAY}, least AS (SELECT shape, min((tree_id, node_id)) AS x FROM sub GROUP BY ALL) SELECT tree_id, node_id, x[1] AS class_tree, x[2] AS class_node FROM sub JOIN least USING (shape)")
def equal_subtrees(spark, d):
    """Every node with the first node whose subtree equals its own, over all trees."""
    placed = trees.euler_order(nodes(spark, d).select("tree_id", "node_id", "parent_id", "kind"))
    own = stored(trees.subtree_hashes(placed, F.col("kind")).select("tree_id", "node_id", "subtree_hash"), "hashes")
    first = stored(own.groupBy("subtree_hash").agg(F.min(F.struct("tree_id", "node_id")).alias("x"), F.count("*").alias("n")), "classes")
    # a class of leaves holds a good part of all nodes, so large classes meet no task; there is one for every OFTEN nodes at most
    often = F.broadcast(first.where(F.col("n") > OFTEN))
    rest = own.join(often, "subtree_hash", "left_anti").join(first.where(F.col("n") <= OFTEN), "subtree_hash")
    return own.join(often, "subtree_hash").unionByName(rest).select("tree_id", "node_id", F.col("x.tree_id").alias("class_tree"), F.col("x.node_id").alias("class_node"))


@query(f"{_WAY}, ev AS (SELECT tree_id, way || '(' AS place, kind || '(' AS said FROM w UNION ALL SELECT tree_id, way || 'c', ')' FROM w) SELECT tree_id, string_agg(said, '' ORDER BY place) AS text FROM ev GROUP BY ALL")
def rendered_trees(spark, d):
    """Every heap tree as text, children inside their parent's brackets."""
    return trees.rendered(trees.euler_order(nodes(spark, d)), F.concat("kind", F.lit("(")), F.lit(")"))


@query("WITH c AS (SELECT item_id, unnest(string_split(text, ' ')) AS c FROM benchmark), t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(c), '[a-z_][a-z0-9_]*'))) AS token FROM c) SELECT item_id, token, count(*) AS clauses FROM t GROUP BY ALL HAVING count(*) >= 2")
def shared_identifiers(spark, d):
    """Identifiers that two or more words of an item hold."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.split("text", " ")).alias("clause"))
    return ir.shared_tokens(words, "item_id", "clause")


def _sources(spark, d) -> DataFrame:
    """A small function for every part; one in eight does not parse, some call themselves."""
    k = F.col("p_partkey")
    body = F.when(k % 8 == 0, "return (").when(k % 3 == 0, "return f(a - 1) if a else 0").otherwise(F.concat(F.lit("x = a * "), (k % 10).cast("string"), F.lit("\n    return x")))
    return spark.read.parquet(f"{d}/part.parquet").select(k.cast("string").alias("tree_id"), F.concat(F.lit("def f(a):\n    "), body, F.lit("\n")).alias("source"))


@query()
def source_to_nodes(spark, d):
    return trees.kind_counts(trees.parse(_sources(spark, d), "tree_id", "source"))


@query("SELECT p_partkey::VARCHAR AS tree_id, p_partkey % 3 = 0 AS recursive FROM part WHERE p_partkey % 8 <> 0")
def direct_recursion(spark, d):
    # written, as names, definitions and calls all read it
    return trees.direct_recursion(stored(trees.parse(_sources(spark, d), "tree_id", "source"), "nodes"))


def _records(spark, d):
    """Typed sources, contracts and records for every part; contracts of large parts are missing, those of cheap ones are of another source, some have no postcondition."""
    p = spark.read.parquet(f"{d}/part.parquet")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    kind = F.when(size % 3 == 0, "builtins.int").when(size % 3 == 1, "builtins.list[builtins.int]").otherwise("Any")
    info = F.struct(F.array(F.struct(F.lit("a").alias("name"), kind.alias("mypy_type"))).alias("params"), F.lit("builtins.int").alias("return_type"))
    typed = p.select(key.alias("func_id"), F.concat(F.lit("h"), key).alias("source_hash"), F.lit("typed_ast-v1").alias("record_format"), info.alias("type_info"))
    none = F.array().cast("array<string>")
    own = F.concat(F.when(F.col("p_retailprice") < 902, "x").otherwise("h"), key)
    post = F.when(size % 7 != 0, F.array(F.concat(F.lit("result   is below "), size.cast("string")), F.lit("a is kept, result is new"))).otherwise(none)
    contracts = p.where("p_size <= 45").select(key.alias("func_id"), own.alias("source_hash"), F.lit("contract-reviewed-v1").alias("record_format"), F.array(F.lit("a is given")).alias("preconditions"), post.alias("postconditions"), none.alias("invariants"))
    return typed, contracts


@query("""SELECT 'contract_missing' AS rule_id, p_partkey::VARCHAR AS key FROM part WHERE p_size > 45 UNION ALL SELECT 'hash_mismatch', p_partkey::VARCHAR FROM part WHERE p_size <= 45 AND p_retailprice < 902
 UNION ALL SELECT 'contract.postcondition_given', p_partkey::VARCHAR FROM part WHERE p_size <= 45 AND p_size % 7 = 0""")
def record_violations(spark, d):
    return ir.assemble(*_records(spark, d))[1].select("rule_id", "key")


_FITS = "p_size <= 45 AND p_size % 7 <> 0 AND p_retailprice >= 902"
_TYPE = "CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'list[int]' ELSE 'Any' END"
_BODY = "CASE WHEN p_partkey % 3 = 0 THEN '    return f(a - 1) if a else 0' ELSE '    x = a * ' || p_partkey % 10 || chr(10) || '    return x' END"


def _annotated(spark, d, keep: bool = False):
    """Records, their node table and annotated texts; with ``keep`` the last two are written, for those that read them more than once."""
    records, _ = ir.assemble(*_records(spark, d))
    held = trees.parse(_sources(spark, d), "tree_id", "source")
    if keep:
        held = stored(held, "nodes")
    parts = trees.to_source(held).select(F.col("tree_id").alias("func_id"), "imports", "body")
    text = ir.annotated_text(F.concat(F.lit("f"), F.col("func_id")), F.col("type_info"), F.col("contracts"), F.col("imports"), F.col("body"))
    texts = records.join(parts, "func_id").select("func_id", text.alias("text"))
    return records, held, stored(texts, "texts") if keep else texts


@query(f"""SELECT p_partkey::VARCHAR AS func_id, array_to_string([CASE WHEN p_size % 3 = 2 THEN 'from typing import Any' || chr(10) END, 'def f' || p_partkey || '(a: ' || {_TYPE} || ') -> int:', '    \"\"\"', '    Preconditions:', '    - a is given', '', '    Postconditions:', '    - result   is below ' || p_size, '    - a is kept, result is new', '', '    Invariants:', '    - None.', '    \"\"\"', {_BODY}, ''], chr(10)) AS text
 FROM part WHERE {_FITS} AND p_partkey % 8 <> 0""")
def annotated_sources(spark, d):
    """The sources of parts, through the node table, as text with types and contracts."""
    return _annotated(spark, d)[2]


# what the text keeps is known: all but the hash, as the docstring and the annotations are new nodes; sources that don't parse have no text
@query(f"SELECT p_partkey::VARCHAR AS func_id, 1.0::DOUBLE AS node_kinds, 1.0::DOUBLE AS edges, 1.0::DOUBLE AS types, 1.0::DOUBLE AS preconditions, 1.0::DOUBLE AS postconditions, 1.0::DOUBLE AS invariants, 1.0::DOUBLE AS cross_references, false AS hash_agrees FROM part WHERE {_FITS} AND p_partkey % 8 <> 0")
def round_trip(spark, d):
    """Source to nodes to annotated text to nodes, and what was kept of every record."""
    records, held, texts = _annotated(spark, d, keep=True)
    again = stored(trees.parse(texts, "func_id", "text"), "again")
    return ir.recovery(records.join(texts.select("func_id"), "func_id", "left_semi"), held, trees.to_source(again), again)


@query(f"""WITH RECURSIVE {_NODES}, up AS (SELECT tree_id, node_id, node_id AS a, 0::BIGINT AS d FROM node UNION ALL SELECT up.tree_id, up.node_id, n.parent_id, d + 1 FROM up JOIN node n ON n.tree_id = up.tree_id AND n.node_id = up.a WHERE n.parent_id IS NOT NULL),
 dist AS (SELECT x.tree_id, x.node_id AS a, y.node_id AS b, min(x.d + y.d) AS d FROM up x JOIN up y ON x.tree_id = y.tree_id AND y.node_id = x.node_id + 3 AND x.a = y.a GROUP BY ALL), dep AS (SELECT tree_id, node_id, max(d) AS depth FROM up GROUP BY ALL)
 SELECT dist.tree_id, round(max(1 - dist.d / (p.depth + q.depth)), 6) AS closeness FROM dist JOIN dep p ON p.tree_id = dist.tree_id AND p.node_id = a JOIN dep q ON q.tree_id = dist.tree_id AND q.node_id = b GROUP BY ALL""")
def node_location_score(spark, d):
    own = nodes(spark, d)
    deep = trees.depths(own, 4).select("tree_id", "node_id", "depth")
    last = own.groupBy("tree_id").agg(F.max("node_id").alias("m"))
    pairs = own.join(last, "tree_id").where("node_id + 3 <= m").select("tree_id", F.col("node_id").alias("a"), (F.col("node_id") + 3).alias("b"))
    far = trees.tree_distance(pairs, own, 4)
    for c in ("a", "b"):
        far = far.join(deep.select("tree_id", F.col("node_id").alias(c), F.col("depth").alias(f"d{c}")), ["tree_id", c])
    return far.groupBy("tree_id").agg(F.round(F.max(1 - F.try_divide(F.col("distance"), F.col("da") + F.col("db"))), 6).alias("closeness"))
