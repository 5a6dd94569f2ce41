"""Queries of rules as data, the scores of the tasks and the long export, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions import text as t
from trialframe.sources import runs
from trialframe.sources.scratch import dealt, shared_dir
from trialframe.operators import rules, workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_RULES = "rule(unit, kind, pattern) AS (VALUES " + ", ".join(f"('{u}', '{k}', {_quoted(p)})" for k, table in (("location", rules.LOCATION), ("diagnosis", rules.DIAGNOSIS)) for u, ps in table.items() for p in ps) + ")"
# every document, as a response about one of four units; what it says at its end follows from its length
_UNITS = ("clamp", "count_vowels", "is_sorted", "merge")
_SAYS = ("so value <  hi is wrong", "it is added Twice, += 2", "see `>= items[i` here", "an off by one, merge loses its last line", "the check is equal for adjacent ones", "nothing else; value > HI", "line 4 then", "no fault")
_SAID = f"""said AS (SELECT doc_id, {list(_UNITS)}[doc_id % 4 + 1] AS unit, coalesce(text, '') || chr(10) || {[x for x in _SAYS]}[length(coalesce(text, '')) % 8 + 1] AS said FROM documents)"""


def _said(spark, d) -> DataFrame:
    x = spark.read.parquet(f"{d}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    return x.select("doc_id", pick(_UNITS, F.col("doc_id") % 4).alias("unit"), F.concat(body, F.lit("\n"), pick(_SAYS, F.length(body) % 8)).alias("said"))


@query(f"""WITH {_RULES}, {_SAID}, m AS (SELECT doc_id, max((CASE WHEN kind = 'location' THEN contains(lower(said), lower(pattern)) END)::INT) AS l, max((CASE WHEN kind = 'diagnosis' THEN regexp_matches(said, pattern, 'i') END)::INT) AS g FROM said JOIN rule USING (unit) GROUP BY doc_id),
 n AS (SELECT doc_id, max((x::BIGINT BETWEEN 3 AND 5)::INT) AS l FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(said, '(?i)\\bline\\s+(\\d+)\\b', 1), regexp_extract_all(said, '(?i)(?:^|[^a-z\\d])(?:#|L)(\\d+)\\b', 1))) AS x FROM said) WHERE length(x) < 10 GROUP BY ALL)
 SELECT unit, count(*) AS n, sum(greatest(coalesce(m.l, 0), coalesce(n.l, 0)))::BIGINT AS located, sum(coalesce(m.g, (contains(lower(said), 'off') AND contains(lower(said), 'by') AND contains(lower(said), 'one') OR contains(lower(said), 'merge')::INT + contains(lower(said), 'loses')::INT + contains(lower(said), 'last')::INT >= 3)::INT))::BIGINT AS diagnosed
 FROM said LEFT JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY unit""")
def rule_scores(spark, d):
    """Location and diagnosis of whole texts by the rules of their unit; one unit has none and goes by its description."""
    x = rules.with_rules(_said(spark, d), rules.fixed_rules(spark))
    numbers = F.filter(F.concat(F.regexp_extract_all("said", F.lit(r"(?i)\bline\s+(\d+)\b"), F.lit(1)), F.regexp_extract_all("said", F.lit(r"(?i)(?:^|[^a-z\d])(?:#|L)(\d+)\b"), F.lit(1))), lambda v: F.length(v) < 10).cast("array<int>")
    x = x.select("unit", rules.located(F.col("said"), numbers, F.lit(3), F.lit(5), F.col("location")).alias("l"), rules.diagnosed(F.col("said"), F.col("diagnosis"), F.lit("off_by_one"), F.lit("merge loses the last one")).alias("g"))
    return x.groupBy("unit").agg(F.count("*").alias("n"), F.sum("l").alias("located"), F.sum("g").alias("diagnosed"))


# answers with code: what they define depends on the order
_CODE = """CASE o_orderkey % 7 WHEN 0 THEN 'none at all' WHEN 1 THEN 'Try ```python' || chr(10) || 'def g(x):' || chr(10) || '    return x + ' || o_custkey || chr(10) || '```' WHEN 2 THEN '```' || chr(10) || 'def h(x): pass' || chr(10) || '```' WHEN 3 THEN '```python' || chr(10) || 'x = (' || chr(10) || '```'
 WHEN 4 THEN 'In prose: def g(a):' || chr(10) || '    return a' || chr(10) || 'def other(): pass' WHEN 5 THEN '```python' || chr(10) || 'y = 1' || chr(10) || '```' ELSE '```python' || chr(10) || 'def g(): pass' || chr(10) || '```' END"""


def _answers(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.lit("g").alias("name"), F.expr(_CODE.replace("chr(10)", "'\\n'")).alias("said"))


@query("SELECT o_orderkey AS key, CASE o_orderkey % 7 WHEN 0 THEN 'no_code_candidate' WHEN 2 THEN 'wrong_function_name' WHEN 3 THEN 'syntax_error' WHEN 5 THEN 'missing_target_function' END AS code FROM orders")
def parse_check(spark, d):
    """Why an answer's code can't be run."""
    x = _answers(spark, d).withColumn("candidate", t.code_candidate(F.col("said"), F.col("name")))
    return x.select("key", rules.parse_check()(F.col("candidate"), F.col("name"))["code"].alias("code"))


@query("""WITH r AS (SELECT l_orderkey AS key, count(*) FILTER (l_quantity > 20) AS passed, count(*) FILTER (l_linenumber < 5) AS total, max(l_discount) AS worst FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL),
 s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 IN (0, 2, 3, 5) THEN 'parse_failure' WHEN worst IS NULL THEN 'scoring_error' WHEN worst >= 0.09 OR total = 0 THEN 'execution_failure' ELSE 'ok' END AS status, least(passed, total) / greatest(total, 1) AS share,
 CASE o_orderkey % 7 WHEN 0 THEN 'no_code_candidate' WHEN 2 THEN 'wrong_function_name' WHEN 3 THEN 'syntax_error' WHEN 5 THEN 'missing_target_function' ELSE CASE WHEN worst IS NULL THEN 'outcome_missing' WHEN worst >= 0.1 THEN 'execution_timeout' WHEN worst >= 0.09 THEN 'module_load_failure' WHEN total = 0 THEN 'zero_total_tests' END END AS code FROM orders LEFT JOIN r ON key = o_orderkey)
 SELECT key, round(CASE WHEN status = 'ok' THEN share ELSE 0 END, 6)::DOUBLE AS score, status, code FROM s""")
def transform_scores(spark, d):
    """Scores of answers from the stored outcomes of their tests."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber < 6")
    held = x.groupBy(F.col("l_orderkey").alias("key")).agg(F.count_if(F.col("l_quantity") > 20).alias("p"), F.count_if(F.col("l_linenumber") < 5).alias("total"), F.max("l_discount").alias("worst"))
    error = F.when(F.col("worst") >= 0.1, "execution_timeout: 10 s").when(F.col("worst") >= 0.09, "load failed").otherwise("")
    out = rules.transform_scores(_answers(spark, d), held.select("key", F.least("p", "total").alias("passed"), "total", error.alias("error")))
    return out.select("key", F.round("score", 6).alias("score"), "status", F.col("failure_reason.code").alias("code"))


_LINES = "['if value > hi:', 'x = 1', '    if value  > hi :', '        return hi', '', 'count += 12', 'count+=1', '# for', '  for flag in flags:', '      n += 1', '    ', 'while j < n: # \".\" a', 'while j < n: # \".\" b']"


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN 'x = 1' ELSE CASE o_orderkey % 6 WHEN 0 THEN '    if value  > hi :' WHEN 1 THEN 'count+=1' WHEN 2 THEN '      for flag in flags:' || chr(10) || '          n += 1' WHEN 3 THEN 'while j < n: # "." b' WHEN 4 THEN 'x = 1' ELSE 'x = ' || o_custkey END END AS fix FROM orders""")
def fix_choice(spark, d):
    """The line of an answer that is its fix: the reference itself, by the unit's rules, or the first line of code."""
    x = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey") % 6
    unit = F.element_at(F.array(*map(F.lit, ("clamp", "count_vowels", "count_true_segments", "tokenize_arithmetic", "other", "clamp"))), (k + 1).cast("int"))
    own = F.concat(F.lit("x = "), F.col("o_custkey").cast("string"))
    lines = F.concat(F.expr("array(" + _LINES.replace("'if value > hi:', ", "").strip("[]") + ")"), F.when(k == 5, F.array(own)).otherwise(F.array().cast("array<string>")))
    rows = rules.with_rules(x.select("o_orderkey", unit.alias("unit"), lines.alias("lines"), F.concat(own, F.lit("  ")).alias("reference")), rules.fixed_rules(spark))
    return rows.select("o_orderkey", rules.fix_line(F.col("lines"), F.col("reference"), F.col("fixes")).alias("fix"))


@query("""WITH s AS (SELECT p_partkey AS key, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(10) WHEN 2 THEN 'It returns ' || p_name ELSE 'the total of ' || p_brand || ' rises' END AS said, CASE WHEN p_size % 7 = 0 THEN 'none' ELSE 'u' END AS unit FROM part)
 SELECT key, CASE WHEN said IS NULL OR trim(said, ' ' || chr(10)) = '' OR unit = 'none' THEN 0.0 WHEN contains(said, 'rises') THEN 0.5 ELSE 0.0 END::DOUBLE AS score, CASE WHEN said IS NULL OR trim(said, ' ' || chr(10)) = '' THEN 'invalid_response' WHEN unit = 'none' THEN 'scoring_error' ELSE 'ok' END AS status,
 CASE WHEN said IS NULL THEN 'missing_response' WHEN trim(said, ' ' || chr(10)) = '' THEN 'empty_response' WHEN unit = 'none' THEN 'context_load_error' END AS failure_reason FROM s""")
def checklist_scores(spark, d):
    """Scores of answers by a checklist, with what makes an answer invalid."""
    k = F.col("p_size") % 5
    said = F.when(k == 0, None).when(k == 1, "  \n").when(k == 2, F.concat(F.lit("It returns "), F.col("p_name"))).otherwise(F.concat(F.lit("the total of "), F.col("p_brand"), F.lit(" rises")))
    x = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 7 == 0, "none").otherwise("u").alias("unit"), said.alias("said"))
    properties = spark.createDataFrame([("u", "The total rises"), ("u", "zebra quagga okapi")], "unit string, statement string")
    return rules.checklist_scores(x, properties)


_LEDGER = """l AS (SELECT p_partkey, 'u' || p_partkey || '::T' || (p_size % 3 + 1) || '::C1::m/1' AS item_id, 'u' || p_partkey AS func_id, 'T' || (p_size % 3 + 1) AS task, CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'planned' END AS status, p_size FROM part)"""


@query(f"""WITH {_LEDGER} SELECT 'run1' AS run_id, item_id, 'm/1' AS model, func_id AS "function", task, 'C1' AS condition, status AS item_status, CASE WHEN p_size % 4 < 2 THEN '2024-01-01' END AS started_at, CASE WHEN p_size % 4 = 0 THEN '2024-01-02' END AS finished_at, (p_size % 3)::BIGINT AS attempt_count,
 CASE WHEN p_size % 4 < 2 THEN 'p/' || func_id END AS prompt_artifact_path, CASE WHEN p_size % 4 = 0 THEN 'r/' || func_id END AS response_artifact_path, CASE WHEN p_size % 4 = 0 THEN 's/' || func_id END AS score_artifact_path, p_size % 4 < 2 AS prompt_artifact_exists, p_size % 4 = 0 AS response_artifact_exists, p_size % 4 = 0 AND p_size % 8 = 0 AS score_artifact_exists,
 CASE WHEN p_size % 4 = 0 THEN p_size / 50.0::DOUBLE END AS score, CASE WHEN p_size % 8 = 0 THEN CASE WHEN p_size % 16 = 0 THEN 'ok' ELSE 'parse_failure' END END AS scorer_status, CASE WHEN p_size % 16 = 8 THEN 'c' END AS scorer_failure_reason_code, CASE WHEN p_size % 16 = 8 THEN 'm "q"' END AS scorer_failure_reason_message,
 CASE WHEN p_size % 16 = 0 THEN '{{"fix": 1, "location": 0}}' END AS score_subscores_json, CASE WHEN p_size % 8 = 0 THEN '{{"n": ' || p_size || '}}' END AS score_evidence_json, CASE WHEN p_size % 4 = 1 THEN 'interrupted' END AS execution_failure_reason_code, CASE WHEN p_size % 4 = 1 THEN 'by hand' END AS execution_failure_reason_message, CASE WHEN p_size % 4 = 2 THEN 'unavailable' END AS skip_reason,
 CASE WHEN p_size % 4 = 0 AND p_size % 8 <> 0 THEN '["score"]' ELSE '[]' END AS missing_expected_artifacts_json FROM l""")
def export_table(spark, d):
    """The 26 columns of the long export."""
    size, unit = F.col("p_size"), F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    k, task = size % 4, F.concat(F.lit("T"), (size % 3 + 1).cast("string"))
    p = spark.read.parquet(f"{d}/part.parquet")
    ledger = p.select(
        F.concat_ws("::", unit, task, F.lit("C1"), F.lit("m/1")).alias("item_id"), unit.alias("func_id"), task.alias("task"), F.lit("C1").alias("condition"), F.lit("m/1").alias("model"), F.when(k == 0, "completed").when(k == 1, "failed").when(k == 2, "skipped").otherwise("planned").alias("status"),
        F.when(k == 0, size / 50.0).alias("score"), F.when(k < 2, F.concat(F.lit("p/"), unit)).alias("prompt_path"), F.when(k == 0, F.concat(F.lit("r/"), unit)).alias("response_path"), F.when(k == 0, F.concat(F.lit("s/"), unit)).alias("score_path"), F.when(k == 2, "unavailable").alias("skip_reason"),
        F.when(k < 2, "2024-01-01").alias("started_at"), F.when(k == 0, "2024-01-02").alias("finished_at"), F.when(k == 1, F.struct(F.lit("interrupted").alias("code"), F.lit("by hand").alias("message"))).alias("failure_reason"), (size % 3).alias("attempt_count"))
    files = ledger.select(F.explode(F.array_compact(F.array("prompt_path", "response_path"))).alias("path")).unionByName(p.where("p_size % 8 = 0").select(F.concat(F.lit("s/"), unit).alias("path")))
    bad = size % 16 == 8
    payloads = p.where("p_size % 8 = 0").select(F.concat(F.lit("s/"), unit).alias("path"), F.when(bad, "parse_failure").otherwise("ok").alias("status"), F.when(bad, F.struct(F.lit("c").alias("code"), F.lit('m "q"').alias("message"))).alias("failure_reason"), F.when(~bad, F.create_map(F.lit("location"), F.lit(0), F.lit("fix"), F.lit(1))).alias("subscores"), F.concat(F.lit('{"n": '), size.cast("string"), F.lit("}")).alias("evidence"))
    return workflow.export_table(F.lit("run1"), ledger, payloads, files)


# a run for each return flag, a record for each lineitem; records of small quantities have another tag, those of large discounts failed
def _runs(spark, d) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    failed = F.col("l_discount") > 0.08
    rows = x.select(
        F.when(F.col("l_quantity") < 3, "other-v1").otherwise(runs.SCORE_TAG).alias("record_format"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("func_id"), F.lit("T1").alias("task"), F.lit("C1").alias("condition"), F.col("l_linestatus").alias("model_id"),
        (F.col("l_quantity") / 50).alias("score"), F.when(failed, "execution_failure").otherwise("ok").alias("status"), F.when(failed, F.struct(F.lit("module_load_failure").alias("code"), F.lit("m").alias("message"))).alias("failure_reason"), F.concat(F.lit("run"), "l_returnflag").alias("run_id"))
    path = f"{shared_dir(spark)}/tf-runs-{uuid.uuid4().hex}"
    runs.write_runs(rows, path)
    x.where("l_linenumber = 7").select(F.concat(F.lit("{broken "), F.col("l_partkey").cast("string")).alias("value"), F.concat(F.lit("run"), "l_returnflag").alias("run_id")).write.mode("append").partitionBy("run_id").text(path)
    return runs.scan_runs(spark, path)


@query("""SELECT 'run' || l_returnflag AS run_id, model_id, count(*) AS n, sum(q)::BIGINT AS total FROM (SELECT l_returnflag, l_linestatus AS model_id, l_quantity AS q FROM lineitem WHERE l_quantity >= 3 AND l_returnflag IN ('A', 'R')) GROUP BY ALL""")
def score_files(spark, d):
    """Two runs of the table of score files, through files; the other run's folder isn't read."""
    rows = runs.usable(_runs(spark, d).where(F.col("run_id").isin("runA", "runR")))
    return rows.groupBy("run_id", "model_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 50).cast("bigint")).alias("total"))


@query("""SELECT rule_id, run_id, count(*) AS n FROM (SELECT 'tag' AS rule_id, 'run' || l_returnflag AS run_id FROM lineitem WHERE l_quantity < 3 UNION ALL SELECT 'corrupt', 'run' || l_returnflag FROM lineitem WHERE l_linenumber = 7
 UNION ALL SELECT 'scorer_failed', 'run' || l_returnflag FROM lineitem WHERE l_quantity >= 3 AND l_discount > 0.08) GROUP BY ALL""")
def score_file_violations(spark, d):
    """What is wrong in the files: broken lines, other tags, scorers that failed."""
    rows = _runs(spark, d)
    wrong = runs.unusable(rows).unionByName(runs.not_ok(rows).drop("code"))
    return wrong.groupBy("rule_id", F.substring_index("key", "/", 1).alias("run_id")).agg(F.count("*").alias("n"))


@query("""SELECT CASE o_orderkey % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' ELSE 'T9' END AS task, CASE WHEN o_orderkey % 4 = 3 THEN 'scoring_error' WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'invalid_response' WHEN o_orderkey % 4 = 2 AND o_custkey % 2 = 0 THEN 'parse_failure' ELSE 'ok' END AS status,
 count(*) AS n, round(sum(CASE WHEN o_orderkey % 4 = 1 THEN o_custkey % 3 WHEN o_orderkey % 4 = 2 AND o_custkey % 2 = 1 THEN 0.5 WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 1 THEN 1 ELSE 0 END), 6)::DOUBLE AS total FROM orders GROUP BY ALL""")
def task_dispatch(spark, d):
    """Answers of three tasks through their scorers, those of an unknown task as errors."""
    k, odd = F.col("o_orderkey") % 4, F.col("o_custkey") % 2 == 1
    task = F.element_at(F.array(*map(F.lit, ("T1", "T2", "T3", "T9"))), (k + 1).cast("int"))
    said = F.when(k == 0, F.when(odd, "the total rises").otherwise(" ")).when(k == 2, F.when(odd, "```python\ndef g(): pass\n```").otherwise("none"))
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), task.alias("task"), F.lit("u").alias("unit"), F.lit("g").alias("name"), said.alias("said"), (F.col("o_custkey") % 3).alias("parts"))
    properties = spark.createDataFrame([("u", "The total rises")], "unit string, statement string")
    results = lambda df: df.select("key", F.lit(1).alias("passed"), F.lit(2).alias("total"), F.lit("").alias("error"))
    scorers = {"T1": lambda df: rules.checklist_scores(df, properties), "T2": lambda df: df.select("key", F.col("parts").alias("score"), F.lit("ok").alias("status")), "T3": lambda df: rules.transform_scores(df, results(df))}
    return runs.dispatched(x, scorers).groupBy("task", "status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("SELECT b AS backend, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'openai' WHEN 3 THEN 'openai' END AS b FROM part) GROUP BY ALL")
def model_backends(spark, d):
    k = F.col("p_size") % 5
    name = F.when(k == 0, "claude-x").when(k == 1, "gpt-4").when(k == 2, "o3").when(k == 3, "o4-mini").otherwise(F.concat(F.lit("Claude-"), "p_brand"))
    return spark.read.parquet(f"{d}/part.parquet").groupBy(runs.backend(name).alias("backend")).agg(F.count("*").alias("n"))


# what runs print, in turn: counts, an error, a summary with issues, blockers, headings only
_OUT = """CASE o_orderkey % 6 WHEN 0 THEN 'Created file: `src/a' || o_custkey || '.py`' || chr(10) || '3 passed, ' || o_custkey % 3 || ' failed' WHEN 1 THEN 'Traceback (most recent call last)' || chr(10) || 'NameError: x' || o_custkey
 WHEN 2 THEN '## Summary' || chr(10) || 'First done. Second ' || o_custkey || '! Third? Fourth.' || chr(10) || 'TODO: tidy up' || chr(10) || 'Bug: off by one' || chr(10) || 'fixme: tidy up' WHEN 3 THEN 'all well' || chr(10) || 'BLOCKED BY: order ' || o_custkey || chr(10) || 'blocker: none'
 WHEN 4 THEN '# Title' || chr(10) || '## More' ELSE 'Saved data/x.json and wrote ''b.txt''' || chr(10) || '[BLOCKING] no disk ' END"""


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'src/a' || o_custkey || '.py' WHEN 5 THEN 'data/x.json|b.txt' ELSE '' END AS files, CASE WHEN o_orderkey % 6 = 0 THEN 3 + o_custkey % 3 END::DOUBLE AS tests_run, CASE WHEN o_orderkey % 6 = 1 OR o_orderkey % 6 = 0 AND o_custkey % 3 > 0 THEN 'partial' ELSE 'success' END AS status,
 CASE o_orderkey % 6 WHEN 0 THEN 'Created file: `src/a' || o_custkey || '.py` 3 passed, ' || o_custkey % 3 || ' failed' WHEN 1 THEN 'Traceback (most recent call last) NameError: x' || o_custkey WHEN 2 THEN 'First done. Second ' || o_custkey || '! Third?' WHEN 3 THEN 'all well BLOCKED BY: order ' || o_custkey || ' blocker: none' WHEN 4 THEN 'No summary available.' ELSE 'Saved data/x.json and wrote ''b.txt'' [BLOCKING] no disk' END AS summary,
 CASE o_orderkey % 6 WHEN 2 THEN 'tidy up|off by one' WHEN 5 THEN 'no disk' ELSE '' END AS issues, CASE o_orderkey % 6 WHEN 3 THEN 'order ' || o_custkey WHEN 5 THEN 'no disk' END AS blocker FROM orders""")
def run_reports(spark, d):
    """What the output of runs says."""
    said = F.expr(_OUT.replace("chr(10)", "'\\n'").replace("''b.txt''", "\\'b.txt\\'"))
    r = t.run_report(said)
    x = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", r.alias("r"))
    return x.select("o_orderkey", F.array_join("r.files", "|").alias("files"), F.col("r.tests_run").cast("double").alias("tests_run"), "r.status", "r.summary", F.array_join("r.issues", "|").alias("issues"), "r.blocker")


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'missing required key: ''invariants''' WHEN 2 THEN '''preconditions'' is not a JSON array' WHEN 3 THEN '''postconditions'' contains non-string items' WHEN 4 THEN 'postconditions array is empty' ELSE 'response is not a JSON object' END AS errors FROM part""")
def contract_shapes(spark, d):
    """What is wrong with generated contracts, fenced or bare."""
    k, name = F.col("p_size") % 7, F.to_json(F.array("p_name"))
    said = (
        F.when(k == 0, F.concat(F.lit('```json\n{"preconditions": [], "postconditions": '), name, F.lit(', "invariants": ["a, b"]}\n```')))
        .when(k == 1, F.concat(F.lit('{"preconditions": [], "postconditions": '), name, F.lit("}")))
        .when(k == 2, F.lit('{"preconditions": "x", "postconditions": ["a"], "invariants": []}'))
        .when(k == 3, F.lit('{"preconditions": [], "postconditions": ["a", 1], "invariants": []}'))
        .when(k == 4, F.lit('{"preconditions": [], "postconditions": [], "invariants": []}'))
        .when(k == 5, F.lit("no json"))
    )
    return dealt(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.array_join(t.contract_errors(said), "|").alias("errors"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'not_applicable' ELSE 'ok' END AS status, CASE p_size % 4 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END AS ast_equivalent, CASE WHEN p_size % 4 IN (1, 2) THEN true WHEN p_size % 4 = 3 THEN false END AS similarity_is_one FROM part""")
def structural_similarity(spark, d):
    """Functions compared by their trees, whatever their docstrings, decorators and layout."""
    k, n = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    body = F.concat(F.lit("x = a * "), n)
    ref = F.concat(F.lit("def f(a):\n    "), body, F.lit("\n    return x\n"))
    other = F.when(k == 0, "def g(a): pass").when(k == 1, F.concat(F.lit('@dec\ndef f(a) -> int:\n  """Doc."""\n  '), body, F.lit(";  return (x)\n"))).when(k == 2, ref).otherwise(F.replace(ref, F.lit("return x"), F.lit("return a")))
    parts = dealt(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"))
    x = parts.select("p_partkey", kernels.structure_column()(other, ref, F.lit("f")).alias("s"))
    return x.select("p_partkey", "s.status", "s.ast_equivalent", (F.col("s.similarity") == 1.0).alias("similarity_is_one"))


_TRACK = """c AS (SELECT p_partkey, p_size % 10 = 0 AS anchor, CASE WHEN p_size % 6 = 0 THEN 'EXCLUDE' ELSE 'PASS' END AS s1, CASE WHEN p_size % 4 = 0 THEN 'not_run' WHEN p_size % 4 = 1 THEN 'EXCLUDE' ELSE 'INCLUDE' END AS s2, CASE WHEN p_size % 3 = 0 THEN 'preferred' ELSE 'not_run' END AS s3, p_brand FROM part)"""


@query(f"""WITH {_TRACK}, m AS (SELECT (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT s1 AS k, count(*) AS n FROM c GROUP BY ALL)) AS stage1_counts, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT s2 AS k, count(*) AS n FROM c GROUP BY ALL)) AS stage2_counts,
 (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT s3 AS k, count(*) AS n FROM c WHERE NOT anchor GROUP BY ALL)) AS stage3_counts, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT p_brand AS k, count(*) AS n FROM c WHERE NOT anchor AND s2 = 'INCLUDE' GROUP BY ALL)) AS t2_family_diversity)
 SELECT count(*) AS total, count(*) FILTER (anchor) AS anchors, count(*) FILTER (NOT anchor) AS non_anchors, count(*) FILTER (NOT anchor AND s2 = 'INCLUDE') AS screened_in_non_anchor, count(*) FILTER (NOT anchor AND s1 = 'PASS' AND s2 = 'not_run') AS stage2_eligible_awaiting, count(*) FILTER (NOT anchor AND s2 = 'INCLUDE' AND s3 = 'not_run') AS stage3_eligible_awaiting,
 sha256(coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) FILTER (NOT anchor AND s1 = 'PASS' AND s2 = 'not_run'), '')) AS stage2_eligible_sha, any_value(stage1_counts) AS stage1_counts, any_value(stage2_counts) AS stage2_counts, any_value(stage3_counts) AS stage3_counts, any_value(t2_family_diversity) AS t2_family_diversity FROM c, m""")
def tracker_report(spark, d):
    """The tracker's report; maps and lists as texts."""
    size = F.col("p_size")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("candidate_id"), (size % 10 == 0).alias("is_anchor"), F.when(size % 6 == 0, "EXCLUDE").otherwise("PASS").alias("stage1_result"), F.when(size % 4 == 0, "not_run").when(size % 4 == 1, "EXCLUDE").otherwise("INCLUDE").alias("stage2_result"),
        F.when(size % 3 == 0, "preferred").otherwise("not_run").alias("stage3_result"), F.lit("INCLUDE").alias("final_decision"), F.col("p_brand").alias("t2_bug_family_draft"), F.col("p_type").alias("t3_transform_family_draft"))
    said = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(m)
    out = workflow.tracker_report(rows)
    return out.select("total", "anchors", "non_anchors", "screened_in_non_anchor", "stage2_eligible_awaiting", "stage3_eligible_awaiting", F.sha2(F.array_join("stage2_eligible_ids", ","), 256).alias("stage2_eligible_sha"), said("stage1_counts"), said("stage2_counts"), said("stage3_counts"), said("t2_family_diversity"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_nationkey < 5")
def tracker_edits(spark, d):
    """Rows added and updated by key; keys that exist, or are missing, would raise."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    table = s.drop("s_nationkey")
    changed = workflow.update_rows(table, table.where("s_acctbal < 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), "s_suppkey")
    new = s.where("s_nationkey < 5").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), "s_name", "s_acctbal")
    return workflow.add_rows(changed, new, "s_suppkey")
