"""From typed sources and contracts to one record, to annotated text, and back with what was kept.

A record is func_id, source_hash, type_info (params as array<struct<name, mypy_type>>, return_type), contracts (preconditions,
postconditions, invariants as arrays of strings); its syntax tree is in a node table whose tree_id is the func_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.text import base_type, clean_type
from trialframe.operators.constraints import filled
from trialframe.operators.sequences import in_order
from trialframe.operators.trees import bag_retention, set_retention
from trialframe.operators.workflow import violations

KINDS = ("preconditions", "postconditions", "invariants")
INDENT = "    "


def typed_rules() -> list[tuple[str, Column]]:
    """Of a typed source: its format, what must be filled, and that every parameter has a name and a type."""
    named = F.forall("type_info.params", lambda p: F.coalesce((F.length(F.trim(p["name"])) > 0) & p["mypy_type"].isNotNull(), F.lit(False)))
    return [*filled("func_id", "source_hash"), ("tag", F.col("record_format") == "typed_ast-v1"), ("params_listed", F.col("type_info.params").isNotNull()), ("params_named", named), ("return_set", F.col("type_info.return_type").isNotNull())]


def contract_rules() -> list[tuple[str, Column]]:
    """Of a reviewed contract: its format, three lists of strings, and at least one postcondition."""
    listed = [(f"{k}_listed", F.forall(k, lambda x: x.isNotNull())) for k in KINDS]
    quotes = F.forall(F.concat(*(F.coalesce(k, F.array().cast("array<string>")) for k in KINDS)), lambda x: F.coalesce(~x.contains('"""'), F.lit(True)))
    return [*filled("func_id", "source_hash"), ("tag", F.col("record_format") == "contract-reviewed-v1"), *listed, ("postcondition_given", F.size("postconditions") > 0), ("no_closing_quotes", quotes)]


def assemble(typed: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records that fit together, and why the others don't (rule_id, key).

    Rows that break a rule of their own, typed sources without a contract (``contract_missing``), and pairs
    whose source hashes differ (``hash_mismatch``) give no record.  Joins are merged: by the size of their files, which are
    packed, both sides would be broadcast with millions of records.
    """
    own = violations(typed, F.col("func_id"), [(f"typed.{n}", ok) for n, ok in typed_rules()]).unionByName(violations(contracts, F.col("func_id"), [(f"contract.{n}", ok) for n, ok in contract_rules()]))
    c = contracts.select(F.col("func_id").alias("__of"), F.col("source_hash").alias("__hash"), F.struct(*KINDS).alias("contracts")).hint("merge")
    both = typed.join(c, F.col("func_id") == F.col("__of"), "left")
    pair = [("contract_missing", F.col("__of").isNotNull()), ("hash_mismatch", F.col("__of").isNull() | F.col("source_hash").eqNullSafe(F.col("__hash")))]
    broken = own.unionByName(violations(both, F.col("func_id"), pair))
    fits = both.join(broken.select(F.col("key").alias("func_id")).distinct().hint("merge"), "func_id", "left_anti")
    return fits.select("func_id", "source_hash", "type_info", "contracts"), broken


def shown_type(s: Column) -> Column:
    """A type as an annotation shows it."""
    return F.when(clean_type(s) == "NoneType", "None").otherwise(clean_type(s))


def annotated_text(func_id: Column, type_info: Column, contracts: Column, imports: Column, body: Column) -> Column:
    """The source with annotations and a docstring of contracts; null without a line in the body.

    The three sections stand in their order, an empty one says ``- None.``; ``from typing import Any`` is added where a type needs it.
    """
    some = lambda t: F.length(F.coalesce(t, F.lit(""))) > 0
    params = F.transform(type_info["params"], lambda p: F.when(some(p["mypy_type"]), F.concat(p["name"], F.lit(": "), shown_type(p["mypy_type"]))).otherwise(p["name"]))
    returns = F.when(some(type_info["return_type"]), F.concat(F.lit(" -> "), shown_type(type_info["return_type"]))).otherwise("")
    any_type = F.exists(type_info["params"], lambda p: F.coalesce(shown_type(p["mypy_type"]).contains("Any"), F.lit(False))) | F.coalesce(shown_type(type_info["return_type"]).contains("Any"), F.lit(False))
    nothing, gap = F.array().cast("array<string>"), F.array(F.lit(""))
    extra = F.when(any_type, F.concat(F.when(F.size(imports) > 0, gap).otherwise(nothing), F.array(F.lit("from typing import Any"), F.lit("")))).otherwise(nothing)
    bullets = lambda k: F.when(F.size(contracts[k]) > 0, F.transform(contracts[k], lambda x: F.concat(F.lit(INDENT + "- "), x))).otherwise(F.array(F.lit(INDENT + "- None.")))
    section = lambda k: F.concat(F.array(F.lit(f"{INDENT}{k.capitalize()}:")), bullets(k))
    quotes = F.array(F.lit(INDENT + '"""'))
    doc = F.concat(quotes, section(KINDS[0]), gap, section(KINDS[1]), gap, section(KINDS[2]), quotes)
    head = F.array(F.concat(F.lit("def "), func_id, F.lit("("), F.array_join(params, ", "), F.lit(")"), returns, F.lit(":")))
    lines = F.concat(imports, extra, head, doc, F.transform(body, lambda x: F.concat(F.lit(INDENT), x)))
    return F.when(F.size(body) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def contract_clauses(doc: Column) -> Column:
    """The bullets under each heading of a docstring, as a struct of three arrays; ``None`` bullets are no clauses."""

    def of(kind: str) -> Column:
        others = "|".join(KINDS)
        blocks = F.regexp_extract_all(F.coalesce(doc, F.lit("")), F.lit(rf"(?is)(?:^|\n)[ \t]*{kind}:[ \t]*(?=\n|$)(.*?)(?=\n[ \t]*(?:{others}):[ \t]*(?:\n|$)|$)"), F.lit(1))
        lines = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n")))
        found = F.transform(F.filter(lines, lambda x: F.trim(x).startswith("-")), lambda x: F.trim(F.substring(F.trim(x), F.lit(2), F.length(x))))
        return F.filter(found, lambda x: ~F.lower(x).isin("", "none", "none."))

    return F.struct(*(of(k).alias(k) for k in KINDS))


def normal_clause(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def shared_tokens(clauses: DataFrame, key: str, clause: str) -> DataFrame:
    """Identifiers that stand in two or more rows of a key: ``key``, token, clauses."""
    tokens = clauses.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(clause), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))).alias("token"))
    return tokens.groupBy(key, "token").agg(F.count("*").alias("clauses")).where("clauses >= 2")


def recovery(records: DataFrame, nodes: DataFrame, parts: DataFrame, nodes_again: DataFrame) -> DataFrame:
    """Per record what its annotated text keeps, each from 0 to 1: node kinds, labelled edges, types, the clauses of each kind, tokens shared by clauses; and hash_agrees.

    ``nodes`` is the records' node table, ``nodes_again`` that of their texts, ``parts`` (of ``trees.to_source``) what
    was read from it.  What is empty is kept whole.
    """
    real, again = (n.where("kind <> 'scalar'") for n in (nodes, nodes_again))
    keys = records.select(F.col("func_id").alias("tree_id"))

    def edges(n: DataFrame) -> DataFrame:
        up = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("above"))
        return n.join(up, ["tree_id", "parent_id"]).select("tree_id", F.concat_ws(">", "above", "kind").alias("edge"))

    def shared(df: DataFrame, contracts: str, name: str) -> DataFrame:
        rows = df.select("tree_id", F.explode(F.concat(*(F.col(contracts)[k] for k in KINDS))).alias("clause"))
        return shared_tokens(rows, "tree_id", "clause").groupBy("tree_id").agg(F.collect_set("token").alias(name))

    def sign(n: DataFrame, name: str) -> DataFrame:
        one = F.concat_ws("\x1f", F.col("depth").cast("string"), "field", F.col("pos").cast("string"), "kind", F.coalesce("scalar", F.lit("")))
        return n.groupBy("tree_id").agg(F.sha2(F.array_join(in_order(one, F.col("node_id")), "\x1e").cast("binary"), 256).alias(name))

    pair = lambda a, b: F.concat(a, F.lit("="), b)
    own = records.select(F.col("func_id").alias("tree_id"), "contracts", F.array_union(F.transform("type_info.params", lambda p: pair(p["name"], base_type(F.coalesce(p["mypy_type"], F.lit(""))))), F.array(pair(F.lit("__return__"), base_type(F.coalesce("type_info.return_type", F.lit("")))))).alias("types"))
    read = parts.select("tree_id", contract_clauses(F.col("doc")).alias("read"), F.array_union(F.transform("params", lambda p: pair(p["name"], p["base"])), F.array(pair(F.lit("__return__"), F.coalesce("returns", F.lit(""))))).alias("read_types"))
    out = own.join(read, "tree_id", "left")
    tables = [bag_retention(real, again, ["tree_id"], "kind", keys).withColumnRenamed("retention", "node_kinds"), bag_retention(edges(real), edges(again), ["tree_id"], "edge", keys).withColumnRenamed("retention", "edges")]
    tables += [shared(own, "contracts", "__shared"), shared(read, "read", "__read"), sign(nodes, "__hash"), sign(nodes_again, "__again")]
    out = reduce(lambda a, b: a.join(b, "tree_id", "left"), tables, out)
    none = F.array().cast("array<string>")
    kept = lambda a, b: F.round(set_retention(F.coalesce(a, none), F.coalesce(b, none)), 6)
    normal = lambda c, k: F.transform(F.col(c)[k], normal_clause)
    return out.select(
        F.col("tree_id").alias("func_id"), F.round("node_kinds", 6).alias("node_kinds"), F.round("edges", 6).alias("edges"), kept(F.col("types"), F.col("read_types")).alias("types"),
        *(kept(normal("contracts", k), normal("read", k)).alias(k) for k in KINDS), kept(F.col("__shared"), F.col("__read")).alias("cross_references"), F.coalesce(F.col("__hash") == F.col("__again"), F.lit(False)).alias("hash_agrees"),
    )


def recovery_summary(metrics: DataFrame) -> DataFrame:
    """metric, n, mean, least, most of every column of ``recovery``."""
    names = [c for c in metrics.columns if c != "func_id"]
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names))).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))
