"""Queries of the text and scoring functions, with their SQL (patterns are kept to what both engines know)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import text as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(values: Column, by: str = "|") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), by)


@query("SELECT doc_id, length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) AS vowels, length(regexp_replace(lower(text), '[^aeiouy]', '', 'g')) AS with_y FROM documents")
def count_vowels(spark, d):
    return _read(spark, d, "documents").select("doc_id", t.count_vowels(F.col("text")).alias("vowels"), t.count_vowels(F.col("text"), True).alias("with_y"))


# names in camel case: segment, capital initial of the type, an acronym
_CAMEL = "name AS (SELECT c_custkey, lower(split_part(c_mktsegment, ' ', 1)) || 'Of' || upper(substr(c_mktsegment, 1, 3)) || 'Value' || c_custkey || 'Id' AS camel FROM customer)"


def _camel(spark, d) -> DataFrame:
    seg = F.col("c_mktsegment")
    return _read(spark, d, "customer").select("c_custkey", F.concat(F.lower(F.split_part(seg, F.lit(" "), F.lit(1))), F.lit("Of"), F.upper(F.substring(seg, 1, 3)), F.lit("Value"), F.col("c_custkey").cast("string"), F.lit("Id")).alias("camel"))


_SNAKE = "lower(regexp_replace(regexp_replace(camel, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


@query(f"WITH {_CAMEL} SELECT c_custkey, camel, {_SNAKE} AS snake, replace({_SNAKE}, '_', '|') AS segments FROM name")
def camel_to_snake(spark, d):
    return _camel(spark, d).select("c_custkey", "camel", t.camel_to_snake(F.col("camel")).alias("snake"), joined(t.camel_segments(F.col("camel"))).alias("segments"))


_EXPR = "ex AS (SELECT o_orderkey, '(' || o_custkey || '+' || o_totalprice::DECIMAL(18,2) || ')*' || (o_orderkey % 7) || ' - x/' || (o_orderkey % 3) AS e FROM orders)"


def _expressions(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return _read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("("), s(F.col("o_custkey")), F.lit("+"), s(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(")*"), s(k % 7), F.lit(" - x/"), s(k % 3)).alias("e"))


def _kinds(ops: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(e, '[0-9.]+|[-+*/()]'), lambda x: CASE WHEN x = '(' THEN 'LPAREN' WHEN x = ')' THEN 'RPAREN' WHEN x IN ('+', '-', '*', '/') THEN {ops} ELSE 'NUM' END || ':' || x), '|')"


@query(f"WITH {_EXPR} SELECT o_orderkey, {_kinds(chr(39) + 'OP' + chr(39))} AS tokens, {_kinds(chr(40) + 'CASE WHEN x IN (' + chr(39) + '+' + chr(39) + ', ' + chr(39) + '-' + chr(39) + ') THEN ' + chr(39) + 'ADDOP' + chr(39) + ' ELSE ' + chr(39) + 'MULOP' + chr(39) + ' END)')} AS by_kind FROM ex")
def tokenize_arithmetic(spark, d):
    show = lambda x: joined(F.transform(x, lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))
    return _expressions(spark, d).select("o_orderkey", show(t.tokenize_arithmetic(F.col("e"))).alias("tokens"), show(t.tokenize_arithmetic(F.col("e"), True)).alias("by_kind"))


# brackets from the bits of a key, most of them unbalanced
_BRACKETS = """br AS (SELECT o_orderkey, replace(replace(bin((o_orderkey * 2654435761) % 65536), '1', '('), '0', ')') AS s FROM orders),
 ch AS (SELECT o_orderkey, i - 1 AS i, substr(s, i, 1) AS c FROM br, range(1, 18) r(i) WHERE i <= length(s)),
 d AS (SELECT *, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS p FROM ch),
 e AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY o_orderkey ORDER BY i)) AS depth FROM d),
 pair AS (SELECT a.o_orderkey, a.i AS s, min(b.i) AS e, any_value(a.depth) AS depth FROM e a JOIN e b ON a.o_orderkey = b.o_orderkey AND a.c = '(' AND b.c = ')' AND b.i > a.i AND b.depth = a.depth - 1 GROUP BY a.o_orderkey, a.i)"""


@query(f"""WITH {_BRACKETS}, top AS (SELECT * FROM pair x WHERE depth = 1)
 SELECT o_orderkey, coalesce((SELECT string_agg(s || ':' || e, '|' ORDER BY s) FROM top WHERE top.o_orderkey = br.o_orderkey), '') AS outermost, coalesce((SELECT string_agg(s || ':' || e, '|' ORDER BY s) FROM pair WHERE pair.o_orderkey = br.o_orderkey), '') AS nested FROM br""")
def find_balanced_spans(spark, d):
    s = F.translate(F.bin((F.col("o_orderkey") * 2654435761) % 65536), "10", "()")
    show = lambda x: joined(F.transform(x, lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))))
    return _read(spark, d, "orders").select("o_orderkey", show(t.balanced_spans(s, "(", ")")).alias("outermost"), show(t.balanced_spans(s, "(", ")", nested=True)).alias("nested"))


_STOP = "(" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + ")"
_KEY_TERMS = f"list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9_ ]', ' ', 'g')), ' +'), lambda x: length(x) >= 2 AND x NOT IN {_STOP})"


@query(f"""SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM (SELECT item_id, {_KEY_TERMS} AS l FROM benchmark)""")
def key_terms(spark, d):
    return _read(spark, d, "benchmark").select("item_id", joined(t.key_terms(F.col("text"))).alias("terms"))


# answers to a statement, the words of the whole item: all of them, all of them denied, every other one, all of them twice
_ANSWER = """st AS (SELECT item_id, string_split(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' ') AS words FROM benchmark),
 two AS (SELECT item_id, list_filter(words, lambda x: length(x) >= 4) AS w FROM st),
 qa AS (SELECT item_id, array_to_string(w, ' ') AS statement, CASE item_id % 4 WHEN 0 THEN array_to_string(w, ', (') || ') here' WHEN 1 THEN 'It is not ' || array_to_string(w, ' ') WHEN 2 THEN 'only ' || array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') || ' here' ELSE array_to_string(w, ' ') || ' it is far from here, never mind what was told of it; ' || array_to_string(w, ' ') END AS answer FROM two)"""


def _answers(spark, d) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " "), lambda x: F.length(x) >= 4)
    all_of_them, some = F.array_join("w", " "), F.array_join(F.filter("w", lambda x, i: i % 2 == 0), " ")
    k = F.col("item_id") % 4
    say = F.when(k == 0, F.concat(F.array_join("w", ", ("), F.lit(") here"))).when(k == 1, F.concat(F.lit("It is not "), all_of_them)).when(k == 2, F.concat(F.lit("only "), some, F.lit(" here")))
    return _read(spark, d, "benchmark").select("item_id", words.alias("w")).select("item_id", all_of_them.alias("statement"), say.otherwise(F.concat(all_of_them, F.lit(" it is far from here, never mind what was told of it; "), all_of_them)).alias("answer"))


_NORMAL = "trim(regexp_replace(regexp_replace(lower(answer), '[^\\w\\s=<>!?\\-_.]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH {_ANSWER} SELECT item_id, {_NORMAL} AS normalised FROM qa")
def normalize_response(spark, d):
    return _answers(spark, d).select("item_id", t.normalize_response(F.col("answer")).alias("normalised"))


_DENIED = " OR ".join(f"contains(before, '{n}')" for n in t.NEGATIONS if "'" not in n)
_MATCHED = f"""{_ANSWER}, term AS (SELECT item_id, {_NORMAL} AS r, unnest(list_filter(list_distinct(string_split(statement, ' ')), lambda x: x NOT IN {_STOP})) AS w, statement FROM qa),
 hit AS (SELECT *, list_position(string_split(statement, ' '), w) AS ord, list_contains(string_split(regexp_replace(r, '[^a-z0-9_]', ' ', 'g'), ' '), w) AS found FROM term),
 num AS (SELECT *, row_number() OVER (PARTITION BY item_id, found ORDER BY ord) AS k, (' ' || r || ' ') AS padded FROM hit),
 neg AS (SELECT *, substr(r, greatest(1, strpos(regexp_replace(padded, '[^a-z0-9_]', ' ', 'g'), ' ' || w || ' ') - 15), least(15, strpos(regexp_replace(padded, '[^a-z0-9_]', ' ', 'g'), ' ' || w || ' ') - 1)) AS before FROM num),
 prop AS (SELECT item_id, CASE WHEN count(*) FILTER (found) >= least(2, count(*)) AND NOT bool_or(found AND k <= 2 AND ({_DENIED})) THEN 1 ELSE 0 END::BIGINT AS matched FROM neg GROUP BY ALL)"""


@query(f"WITH {_MATCHED} SELECT item_id, matched FROM prop")
def property_match(spark, d):
    return _answers(spark, d).select("item_id", t.property_matched(t.normalize_response(F.col("answer")), F.col("statement")).alias("matched"))


@query(f"WITH {_MATCHED} SELECT item_id // 10 AS sheet, count(*) AS n, round(avg(matched), 6) AS score FROM prop GROUP BY ALL")
def checklist_score(spark, d):
    hit = _answers(spark, d).select(F.floor(F.col("item_id") / 10).alias("sheet"), t.property_matched(t.normalize_response(F.col("answer")), F.col("statement")).alias("matched"))
    return hit.groupBy("sheet").agg(F.count("*").alias("n"), F.round(F.avg("matched"), 6).alias("score"))


# responses about lines of a source: every claim form in turn
_RESPONSE = """rs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 12 + 1)::BIGINT AS truth, (l_partkey % 12 + 1 + l_suppkey % 3)::BIGINT AS truth_end, 8 + l_suppkey % 9 AS len,
 CASE l_linenumber % 4 WHEN 0 THEN 'The bug is at Line ' || (l_suppkey % 20) || ' or line ' || (l_partkey % 9) || '.' WHEN 1 THEN 'See #' || (l_suppkey % 15) || ', L' || (l_partkey % 7) || ' too' WHEN 2 THEN 'Nothing is wrong.' ELSE 'line  ' || (l_suppkey % 30) || ' in `x = ' || l_partkey || '`' END AS said FROM lineitem)"""
_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_LINES = "list_concat(list_transform(regexp_extract_all(said, '(?i)\\bline\\s+(\\d+)\\b', 1), lambda x: x::BIGINT), list_transform(regexp_extract_all(said, '(?i)(?:^|[^a-z\\d])(?:#|L)(\\d+)\\b', 1), lambda x: x::BIGINT))"


def _responses(spark, d) -> DataFrame:
    s = lambda c: c.cast("string")
    p, u = F.col("l_partkey"), F.col("l_suppkey")
    k = F.col("l_linenumber") % 4
    said = (
        F.when(k == 0, F.concat(F.lit("The bug is at Line "), s(u % 20), F.lit(" or line "), s(p % 9), F.lit(".")))
        .when(k == 1, F.concat(F.lit("See #"), s(u % 15), F.lit(", L"), s(p % 7), F.lit(" too")))
        .when(k == 2, F.lit("Nothing is wrong."))
        .otherwise(F.concat(F.lit("line  "), s(u % 30), F.lit(" in `x = "), s(p), F.lit("`")))
    )
    return _read(spark, d, "lineitem").select(*(c.strip() for c in _ID.split(",")), (p % 12 + 1).alias("truth"), (p % 12 + 1 + u % 3).alias("truth_end"), (8 + u % 9).alias("len"), said.alias("said"))


def _id() -> list[str]:
    return [c.strip() for c in _ID.split(",")]


@query(f"WITH {_RESPONSE} SELECT {_ID}, array_to_string({_LINES}, '|') AS lines, array_to_string(regexp_extract_all(said, '`([^`]+)`', 1), '|') AS quoted FROM rs")
def claim_extraction(spark, d):
    return _responses(spark, d).select(*_id(), joined(t.line_numbers(F.col("said"))).alias("lines"), joined(t.quoted_code(F.col("said"))).alias("quoted"))


@query(f"WITH {_RESPONSE} SELECT {_ID}, len(list_filter({_LINES}, lambda x: x BETWEEN truth AND truth_end)) > 0 AS located FROM rs")
def binary_location(spark, d):
    return _responses(spark, d).select(*_id(), (t.location_hit(t.line_numbers(F.col("said")), F.col("truth"), F.col("truth_end")) == 1).alias("located"))


@query(f"""WITH {_RESPONSE}, p AS (SELECT *, list_distinct(list_filter({_LINES}, lambda x: x BETWEEN 1 AND len)) AS p FROM rs),
 q AS (SELECT *, len(list_filter(p, lambda x: x BETWEEN truth AND truth_end)) AS inside, list_min(list_transform(p, lambda x: greatest(truth - x, x - truth_end))) AS far FROM p)
 SELECT {_ID}, round(CASE WHEN len(p) = 0 THEN 0 WHEN inside > 0 THEN inside / (len(p) + truth_end - truth + 1 - inside) ELSE 0.5::DOUBLE * greatest(0, 1 - (far - 1) / greatest(4, len // 4)) END, 6)::DOUBLE AS location FROM q""")
def continuous_location(spark, d):
    lines = F.array_distinct(F.filter(t.line_numbers(F.col("said")), lambda x: x.between(F.lit(1), F.col("len"))))
    return _responses(spark, d).withColumn("p", lines).select(*_id(), F.round(t.location_score(F.col("p"), F.col("truth"), F.col("truth_end"), F.col("len")), 6).alias("location"))


# sources of a few lines; a quote is a line of it, cut or with a comment behind
_SOURCE = """src AS (SELECT o_orderkey, ['def f(a, b):', '    total = ' || o_custkey, '    if a < ' || (o_orderkey % 10) || ':', '        return b', '', '    return total'] AS lines,
 CASE o_orderkey % 3 WHEN 0 THEN '`total = ' || o_custkey || '`' WHEN 1 THEN '`    if  A < ' || (o_orderkey % 10) || ':  # bug`' ELSE '`b`, line 6 and line 7' END AS said FROM orders)"""


def _sources(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ten = (k % 10).cast("string")
    lines = F.array(F.lit("def f(a, b):"), F.concat(F.lit("    total = "), c), F.concat(F.lit("    if a < "), ten, F.lit(":")), F.lit("        return b"), F.lit(""), F.lit("    return total"))
    said = F.when(k % 3 == 0, F.concat(F.lit("`total = "), c, F.lit("`"))).when(k % 3 == 1, F.concat(F.lit("`    if  A < "), ten, F.lit(":  # bug`"))).otherwise(F.lit("`b`, line 6 and line 7"))
    return _read(spark, d, "orders").select("o_orderkey", lines.alias("lines"), said.alias("said"))


_SQUEEZE = "lower(trim(regexp_replace(%s, '\\s+', ' ', 'g')))"


@query(f"""WITH {_SOURCE}, q AS (SELECT o_orderkey, lines, {_SQUEEZE % "regexp_extract(said, '`([^`]+)`', 1)"} AS q, list_filter(list_transform(regexp_extract_all(said, 'line\\s+(\\d+)', 1), lambda x: x::BIGINT), lambda x: x BETWEEN 1 AND 6) AS named FROM src),
 l AS (SELECT o_orderkey, q, i, {_SQUEEZE % "lines[i]"} AS s FROM q, range(1, 7) r(i)), hit AS (SELECT o_orderkey, i FROM l WHERE length(q) >= 6 AND s <> '' AND (contains(s, q) OR contains(q, s)) UNION SELECT o_orderkey, unnest(named) FROM q)
 SELECT src.o_orderkey, coalesce(string_agg(i::VARCHAR, '|' ORDER BY i), '') AS predicted FROM src LEFT JOIN hit USING (o_orderkey) GROUP BY ALL""")
def predicted_lines(spark, d):
    return _sources(spark, d).select("o_orderkey", joined(t.predicted_lines(F.col("said"), F.col("lines"))).alias("predicted"))


@query(f"WITH {_SOURCE} SELECT o_orderkey, array_to_string(list_concat(list_concat(lines[1:2], ['    if a <= ' || (o_orderkey % 10) || ':']), lines[4:6]), '|') AS patched FROM src")
def patch_splice(spark, d):
    fix = F.array(F.concat(F.lit("if a <= "), (F.col("o_orderkey") % 10).cast("string"), F.lit(":")))
    return _sources(spark, d).select("o_orderkey", joined(t.splice(F.col("lines"), F.lit(3), F.lit(3), fix)).alias("patched"))


@query("""SELECT o_orderkey, (contains(said, 'wrong') AND contains(said, 'operator') OR (contains(said, 'upper')::INT + contains(said, 'bound')::INT + contains(said, 'guard')::INT + contains(said, 'uses')::INT) >= 3)::INT::BIGINT AS diagnosed
 FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a wrong operator' WHEN 1 THEN 'the upper bound guard' WHEN 2 THEN 'upper bound' ELSE 'fine' END AS said FROM orders)""")
def diagnosis_score(spark, d):
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "a WRONG operator").when(k == 1, "the upper bound guard").when(k == 2, "upper bound").otherwise("fine")
    return _read(spark, d, "orders").select("o_orderkey", t.diagnosis_hit(said, F.lit("wrong_operator"), F.lit("The upper bound guard uses it")).alias("diagnosed"))


# three parts of a score; any failure of the fix leaves the score whole
@query(f"WITH {_RESPONSE}, s AS (SELECT l_suppkey, (len(list_filter({_LINES}, lambda x: x BETWEEN truth AND truth_end)) > 0)::INT AS loc, (contains(said, 'bug'))::INT AS diag, (contains(said, '`'))::INT AS fix FROM rs) SELECT l_suppkey, count(*) AS n, sum(loc + diag + fix)::BIGINT AS total, count(*) FILTER (fix = 0) AS parse_failures FROM s GROUP BY ALL")
def composite_score(spark, d):
    r = _responses(spark, d)
    loc, diag, fix = t.location_hit(t.line_numbers(F.col("said")), F.col("truth"), F.col("truth_end")), F.col("said").contains("bug").cast("int"), (F.size(t.quoted_code(F.col("said"))) > 0).cast("int")
    return r.select("l_suppkey", (loc + diag + fix).alias("s"), fix.alias("fix")).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("s").alias("total"), F.count_if(F.col("fix") == 0).alias("parse_failures"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'def g(x): return ' || o_custkey WHEN 1 THEN 'x = 1' WHEN 2 THEN 'def g(y):' || chr(10) || '  return y' END AS code FROM orders""")
def code_candidate(spark, d):
    k = F.col("o_orderkey") % 4
    said = (
        F.when(k == 0, F.concat(F.lit("```python\nx = 2\n```\nthen\n```python\ndef g(x): return "), F.col("o_custkey").cast("string"), F.lit("\n```")))
        .when(k == 1, F.lit("```\nx = 1\n```"))
        .when(k == 2, F.lit("a\n```\ndef f(x): 1\n```\n```\ndef g(y):\n  return y\n```"))
        .otherwise(F.lit("no code"))
    )
    return _read(spark, d, "orders").select("o_orderkey", t.code_candidate(said, F.lit("g")).alias("code"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'list[' || p_brand || ']' WHEN 1 THEN 'Callable[..., int]' ELSE 'float' END AS cleaned, CASE p_size % 3 WHEN 0 THEN 'list' WHEN 1 THEN ' int' ELSE 'float' END AS base FROM part""")
def type_cleanup(spark, d):
    k = F.col("p_size") % 3
    raw = F.when(k == 0, F.concat(F.lit("builtins.list[builtins."), F.col("p_brand"), F.lit("]"))).when(k == 1, F.lit("def (a: builtins.int) -> builtins.int")).otherwise(F.lit("builtins.float"))
    return _read(spark, d, "part").select("p_partkey", t.clean_type(raw).alias("cleaned"), F.when(k == 1, t.base_type(F.lit("def (a). int"))).otherwise(t.base_type(raw)).alias("base"))


# sections of a text: a line that ends in ':' heads the lines after it
_SECTIONS = """ln AS (SELECT item_id, i, x[i] AS s FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, string_split(replace(text, '. ', ':' || chr(10)), chr(10)) AS x FROM benchmark))),
 hd AS (SELECT *, last_value(CASE WHEN s LIKE '%:' THEN s END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY i) AS header FROM ln)"""


@query(f"WITH {_SECTIONS} SELECT item_id, header, count(*) AS n_lines, string_agg(s, '|' ORDER BY i) AS body FROM hd WHERE s NOT LIKE '%:' AND header IS NOT NULL GROUP BY ALL")
def docstring_sections(spark, d):
    from pyspark.sql.window import Window as W

    lines = _read(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit(":\n")), "\n")).alias("i", "s"))
    head = F.last(F.when(F.col("s").endswith(":"), F.col("s")), ignorenulls=True).over(W.partitionBy("item_id").orderBy("i"))
    body = lines.withColumn("header", head).where(~F.col("s").endswith(":") & F.col("header").isNotNull())
    held = F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"])
    return body.groupBy("item_id", "header").agg(F.count("*").alias("n_lines"), F.array_join(held, "|").alias("body"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def fenced_json(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return _read(spark, d, "events").select("event_id", F.from_json(t.strip_fence(fenced), "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' has status ' || o_orderstatus || '.' AS prompt FROM orders")
def prompt_template(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", t.render(F.lit("Order {key} has status {status}."), {"key": F.col("o_orderkey").cast("string"), "status": F.col("o_orderstatus")}).alias("prompt"))


@query("SELECT o_orderkey, 'src/a' || (o_orderkey % 5) || '.py|tests/x.py' AS paths, o_orderkey % 50 AS passed, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END AS failed FROM orders")
def result_mining(spark, d):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    log = F.concat(F.lit("edited src/a"), s(k % 5), F.lit(".py and tests/x.py, again src/a"), s(k % 5), F.lit(".py; "), s(k % 50), F.lit(" passed"), F.when(k % 2 == 0, F.concat(F.lit(", "), s(k % 3), F.lit(" failed"))).otherwise(F.lit("")))
    c = t.outcome_counts(log)
    return _read(spark, d, "orders").select("o_orderkey", joined(t.file_paths(log)).alias("paths"), c["passed"].alias("passed"), c["failed"].alias("failed"))


@query("""WITH x AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS t1, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 25) AS p1, count(*) FILTER (l_returnflag = 'N') AS t2, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 25) AS p2, count(*) FILTER (l_returnflag = 'R') AS t3, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS p3 FROM lineitem GROUP BY ALL)
 SELECT l_suppkey, round((p1 + 2 * p2 + 3 * p3) / (t1 + 2 * t2 + 3 * t3), 6) AS quality, round((p1 + p2 + p3) / (t1 + t2 + t3), 6) AS fraction FROM x""")
def weighted_quality(spark, d):
    flags = ("A", "N", "R")
    ok = lambda f: F.count_if((F.col("l_returnflag") == f) & (F.col("l_quantity") > 25))
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    x = _read(spark, d, "lineitem").groupBy("l_suppkey").agg(*(ok(f).alias(f"p{f}") for f in flags), *(n(f).alias(f"t{f}") for f in flags))
    tiers = [(F.col(f"p{f}"), F.col(f"t{f}"), k + 1) for k, f in enumerate(flags)]
    return x.select("l_suppkey", F.round(t.quality(tiers), 6).alias("quality"), F.round(t.quality([(p, q, 1) for p, q, _ in tiers]), 6).alias("fraction"))


@query("SELECT o_orderkey, abs(o_totalprice - (o_totalprice + CASE o_orderkey % 2 WHEN 0 THEN 1e-12 ELSE 1 END)) <= greatest(1e-9 * greatest(abs(o_totalprice), abs(o_totalprice + CASE o_orderkey % 2 WHEN 0 THEN 1e-12 ELSE 1 END)), 1e-9) AS same FROM orders")
def deep_equality(spark, d):
    other = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 1e-12).otherwise(1.0)
    return _read(spark, d, "orders").select("o_orderkey", t.close_to(F.col("o_totalprice"), other).alias("same"))
