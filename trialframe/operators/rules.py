"""Scoring rules as a table: patterns by unit, matched in one pass over each response.

A rule has unit, kind, priority and pattern.  Kinds: ``location`` (a piece of the faulty code, in any case), ``diagnosis`` (a regular
expression, in any case; one of them is enough), ``fix`` (the first line that fits, by priority), ``fix_last`` (the last one), ``fix_block`` (the first
line that fits with the deeper lines below it, four characters further in).
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions import text as t

# What shows that a response names the fault of these units, and which of its lines is the fix.
LOCATION = {
    "clamp": ["value < hi", "< hi", "value<hi"],
    "count_vowels": ["count += 2", "count+=2", "+= 2"],
    "is_sorted": ["items[i] >= items[i + 1]", "items[i] >= items[i+1]", ">= items[i", ">= items[i + 1]"],
}
DIAGNOSIS = {
    "clamp": [
        r"\bvalue\s*<\s*hi\b", r"<\s*hi\b", r"wrong\s+(?:comparison|operator)", r"incorrect\s+(?:comparison|operator)", r"should\s+be\s+(?:value\s+)?>", r"\bvalue\s*>\s*hi\b", r">`.*`hi", r"`?\bvalue\s*<\s*hi`?", r"less\s+than\s+hi",
        r"upper.{0,20}(?:guard|bound|clamp).{0,20}(?:<|less)", r"(?:<|less).{0,20}(?:upper|hi|high|bound)", r"value < hi instead of value > hi", r"value < hi.*value > hi", r"value > hi.*correct", r"< hi.*> hi",
    ],
    "count_vowels": [
        r"\bcount\s*\+=\s*2\b", r"\+= 2\b", r"\bincrement.{0,30}\b2\b", r"\badd.{0,20}\b2\b", r"\bdouble", r"\bdoubl", r"\btwice\b", r"\b2 instead of 1\b", r"\binstead of 1\b", r"\bshould be 1\b", r"\bshould increment by 1\b", r"\bby 2\b", r"\badds 2\b",
        r"\bincrements.{0,15}2\b", r"\bcount \+= 2",
    ],
    "is_sorted": [
        r"\b>=\b", r"\bgreater.{0,10}than.{0,10}or.{0,10}equal\b", r"\bequal.{0,20}element", r"\bequal.{0,20}adjacent", r"\badjacent.{0,20}equal", r"\bduplicate.{0,20}element", r"\b>= instead of >\b", r"\bshould be >\b", r"\bshould use >\b", r"\bonly >\b",
        r"\bstrict.{0,15}greater", r"items\[i\]\s*>=", r"`>= `", r"wrong.{0,15}operator", r"incorrect.{0,15}operator", r"\bsorted.*equal.*false", r"\bequal.*sorted.*false",
    ],
}
FIX = {
    "clamp": [("fix", r"if\s+value\s*>\s*hi\s*:"), ("fix", r"value\s*>\s*hi")],
    "count_vowels": [("fix", r"count\s*\+=\s*1\b")],
    "is_sorted": [("fix", r"if\s+items\[i\]\s*>\s*items\[i\s*\+\s*1\]\s*:"), ("fix", r"items\[i\]\s*>\s*items\[i")],
    "count_true_segments": [("fix_block", r"for\s+flag\s+in\s+flags\s*:")],
    "tokenize_arithmetic": [("fix_last", r"""while\s+j\s*<\s*n.*['"]\.['"]"""), ("fix_last", r"while\s+j\s*<\s*n.*(?:dot_seen|isdigit.*or|or.*isdigit)")],
    "top_k_by": [("fix_last", r"-key\(pair\[1\]\)")],
}
NO_CANDIDATE, SYNTAX, WRONG_NAME, NO_FUNCTION, TIMEOUT, LOAD, NO_TESTS = "no_code_candidate", "syntax_error", "wrong_function_name", "missing_target_function", "execution_timeout", "module_load_failure", "zero_total_tests"
TIMED_OUT = "execution_timeout"


def fixed_rules(spark: SparkSession) -> DataFrame:
    """The rules above as a table."""
    rows = [(u, "location", n, p) for u, ps in LOCATION.items() for n, p in enumerate(ps)] + [(u, "diagnosis", n, p) for u, ps in DIAGNOSIS.items() for n, p in enumerate(ps)]
    rows += [(u, kind, n, p) for u, ps in FIX.items() for n, (kind, p) in enumerate(ps)]
    return spark.createDataFrame(rows, "unit string, kind string, priority int, pattern string")


def by_unit(rules: DataFrame) -> DataFrame:
    """One row a unit: location (array), diagnosis (one expression of all), fixes (array<struct<priority,kind,pattern>>)."""
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("priority", "pattern"))))
    fixes = F.sort_array(F.collect_list(F.when(F.col("kind").startswith("fix"), F.struct("priority", "kind", "pattern"))))
    any_of = F.array_join(F.transform(of("diagnosis"), lambda r: F.concat(F.lit("(?:"), r["pattern"], F.lit(")"))), "|")
    return rules.groupBy("unit").agg(F.transform(of("location"), lambda r: F.lower(r["pattern"])).alias("location"), F.nullif(any_of, F.lit("")).alias("diagnosis"), fixes.alias("fixes"))


#: Rules that are broadcast at most.
BROADCAST_RULES = 100_000


def with_rules(responses: DataFrame, rules: DataFrame, unit: str = "unit") -> DataFrame:
    """Responses with the rules of their unit (null without any).

    Up to ``BROADCAST_RULES`` rules go to every task: shuffled by their units, which may be few, whole responses would meet in few tasks.
    """
    own = by_unit(rules).withColumnRenamed("unit", "__unit")
    own = F.broadcast(own) if rules.count() <= BROADCAST_RULES else own
    return responses.join(own, F.col(unit) == F.col("__unit"), "left").drop("__unit")


def located(said: Column, lines: Column, start: Column, end: Column, location: Column) -> Column:
    """1 if a named line is in the span, or the response holds a piece of the faulty code."""
    low = F.lower(F.coalesce(said, F.lit("")))
    return F.greatest(F.coalesce(t.location_hit(lines, start, end), F.lit(0)), F.coalesce(F.exists(location, lambda p: low.contains(p)).cast("int"), F.lit(0)))


def diagnosed(said: Column, diagnosis: Column, category: Column, description: Column) -> Column:
    """1 if an expression of the unit fits; for units without one, by the words of category and description."""
    text = F.coalesce(said, F.lit(""))
    return F.when(diagnosis.isNotNull(), F.regexp_like(text, F.concat(F.lit("(?i)"), diagnosis)).cast("int")).otherwise(t.diagnosis_hit(text, category, description))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def _block(lines: Column, pattern: Column) -> Column:
    """The first line that fits and the lines below that are further in, up to an empty or a shallower one; null without a second line."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("block"))

    def step(a: Column, x: Column) -> Column:
        opens = (a["state"] == 0) & F.regexp_like(F.trim(x), pattern)
        goes_on = (a["state"] == 1) & (F.trim(x) != "") & (_indent(x) > a["depth"])
        state = F.when(opens | goes_on, 1).when(a["state"] == 1, 2).otherwise(a["state"])
        return F.struct(state.alias("state"), F.when(opens, _indent(x)).otherwise(a["depth"]).alias("depth"), F.when(opens | goes_on, F.concat(a["block"], F.array(F.concat(F.lit("    "), x)))).otherwise(a["block"]).alias("block"))

    return F.aggregate(lines, start, step, lambda a: F.when(F.size(a["block"]) > 1, F.array_join(a["block"], "\n")))


def fix_line(lines: Column, reference: Column, fixes: Column) -> Column:
    """The line that is the reference, else what the unit's rules choose by priority, else the first line of code; null without lines."""
    same = F.get(F.filter(lines, lambda x: F.trim(x) == F.trim(reference)), 0)
    fits = lambda r: F.filter(lines, lambda x: F.regexp_like(x, r["pattern"]))
    chosen = F.transform(fixes, lambda r: F.when(r["kind"] == "fix", F.get(fits(r), 0)).when(r["kind"] == "fix_last", F.try_element_at(fits(r), F.lit(-1))).otherwise(_block(lines, r["pattern"])))
    code = F.get(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), 0)
    return F.coalesce(same, F.get(F.filter(chosen, lambda x: x.isNotNull()), 0), code)


def parse_check():
    """A column function of code and function name: null if the code parses and defines the function, else the failure's code and message."""

    @F.pandas_udf("code string, message string")
    def check(code: pd.Series, name: pd.Series) -> pd.DataFrame:
        def one(source, wanted):
            if source is None:
                return NO_CANDIDATE, "no code candidate in the response"
            try:
                found = [x.name for x in ast.walk(ast.parse(source)) if isinstance(x, ast.FunctionDef)]
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                return SYNTAX, f"{type(e).__name__}: {e}"
            if not found:
                return NO_FUNCTION, "the code defines no function"
            return (None, None) if wanted in found else (WRONG_NAME, f"{wanted!r} not found; found: {found}")

        return pd.DataFrame([one(c, n) for c, n in zip(code, name, strict=True)], columns=["code", "message"])

    return check


def transform_scores(responses: DataFrame, results: DataFrame) -> DataFrame:
    """Scores of the third task: ``responses`` (key, name, said) and the test outcomes (key, passed, total, error) that were stored for their code.

    Columns key, score, status, failure_reason (code, message).  Without code, with code that doesn't parse or lacks the function, or
    with an outcome that is an error or counts no test, the score is 0.  A response whose outcome is missing is a ``scoring_error``.
    """
    own = responses.withColumn("candidate", t.code_candidate(F.col("said"), F.col("name"))).withColumn("failed", parse_check()(F.col("candidate"), F.col("name")))
    met = own.join(results.select("key", "passed", "total", "error", F.lit(True).alias("__ran")), "key", "left")
    code = (
        F.when(F.col("failed.code").isNotNull(), F.col("failed.code")).when(F.col("__ran").isNull(), "outcome_missing").when(F.col("error").startswith(TIMED_OUT), TIMEOUT).when(F.length("error") > 0, LOAD).when(F.coalesce(F.col("total"), F.lit(0)) == 0, NO_TESTS)
    )
    status = F.when(F.col("failed.code").isNotNull(), "parse_failure").when(F.col("__ran").isNull(), "scoring_error").when(code.isNotNull(), "execution_failure").otherwise("ok")
    message = F.coalesce(F.col("failed.message"), F.nullif("error", F.lit("")), F.lit("the suite has no tests"))
    score = F.when(code.isNull(), F.col("passed") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0)
    return met.select("key", score.alias("score"), status.alias("status"), F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message"))).alias("failure_reason"))


def checklist_scores(responses: DataFrame, properties: DataFrame) -> DataFrame:
    """Scores of the first task: the share of a unit's ``properties`` (unit, statement) that each of ``responses`` (key, unit, said) states.

    Columns key, score, status, failure_reason.  A response that is null (``missing_response``) or without text (``empty_response``) is
    ``invalid_response``, a unit without properties a ``scoring_error``; both score 0.
    """
    shown = responses.withColumn("__n", t.normalize_response(F.coalesce("said", F.lit(""))))
    met = shown.join(properties.select("unit", "statement"), "unit", "left")
    held = met.groupBy("key").agg(F.count("statement").alias("n"), F.sum(F.when(F.col("statement").isNotNull(), t.property_matched(F.col("__n"), F.col("statement")))).alias("hit"), F.max("said").alias("said"))
    code = F.when(F.col("said").isNull(), "missing_response").when(F.length(F.regexp_replace("said", r"\s+", "")) == 0, "empty_response").when(F.col("n") == 0, "context_load_error")
    status = F.when(code.isNull(), "ok").when(code == "context_load_error", "scoring_error").otherwise("invalid_response")
    return held.select("key", F.when(code.isNull(), F.round(F.col("hit") / F.when(F.col("n") > 0, F.col("n")), 6)).otherwise(0.0).alias("score"), status.alias("status"), code.alias("failure_reason"))
