"""Text and scoring functions as column expressions; each takes and returns Columns unless it says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a property statement.
STOP_WORDS = (
    "the a an of in is it to be as at by or if on up so do my we he she they that this with from have has had are "
    "was were will can may all any but not and for its his her our you your each both only also must does when what "
    "which where how than more less such been being into onto over under about after before since while should would "
    "could might just then them their these those some same make made take taken give given however always never "
    "either neither whether function parameter parameters"
).split()

# Cues that deny a term within the 15 characters before it.
NEGATIONS = ["not ", "never", "incorrect", "wrong", "doesn't", "does not", "cannot", "can't", "isn't", "aren't", "wasn't", "weren't", "inaccurate", "untrue"]
NEGATION_REACH = 15
LEAST_FRAGMENT = 6
PROXIMITY_WEIGHT = 0.5


def _lits(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


# -- words and identifiers ----------------------------------------------------------------------
def count_vowels(s: Column, with_y: bool = False) -> Column:
    return F.length(F.regexp_replace(F.lower(s), "[^aeiouy]" if with_y else "[^aeiou]", ""))


def camel_to_snake(s: Column) -> Column:
    """An underscore between a lower-case letter or digit and a capital, and before the last capital of a run that a lower-case letter follows."""
    s = F.regexp_replace(s, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", "_")
    return F.lower(F.regexp_replace(s, r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_"))


def camel_segments(s: Column) -> Column:
    return F.filter(F.split(camel_to_snake(s), "_"), lambda x: x != "")


def tokenize_arithmetic(s: Column, split_operators: bool = False) -> Column:
    """(kind, value) of numbers, operators and brackets; other characters are passed over."""
    found = F.regexp_extract_all(s, F.lit(r"[0-9.]+|[-+*/()]"), F.lit(0))
    op = lambda t: F.when(t.isin("+", "-"), "ADDOP").otherwise("MULOP") if split_operators else F.lit("OP")
    return F.transform(found, lambda t: F.struct(F.when(t == "(", "LPAREN").when(t == ")", "RPAREN").when(t.rlike("^[0-9.]"), "NUM").otherwise(op(t)).alias("kind"), t.alias("value")))


def balanced_spans(s: Column, opening: str, closing: str, nested: bool = False) -> Column:
    """(start, end) of the outermost bracket pairs, or of all pairs, by start; unmatched brackets are passed over.

    A stack over each text in Arrow batches, linear in its length; a fold in SQL copies its stack and its result at every bracket.
    """

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            stack, found = [], []
            for i, c in enumerate(text):
                if c == opening:
                    stack.append(i)
                elif c == closing and stack:
                    start = stack.pop()
                    if nested or not stack:
                        found.append((start, i))
            return [{"start": x, "end": y} for x, y in sorted(found)]

        return pd.Series([one(x) for x in texts], dtype=object)

    return spans(s)


# -- checklist scoring --------------------------------------------------------------------------
def normalize_response(s: Column) -> Column:
    """Lower case; characters outside words, white space and ``=<>!?-_.`` become spaces; white space is evened out."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"(?U)[^\w\s=<>!?\-_.]", " "), r"(?U)\s+", " "))


def key_terms(statement: Column) -> Column:
    """Distinct words of two characters or more that are no stop words, in order."""
    found = F.split(F.trim(F.regexp_replace(F.lower(statement), "[^a-z0-9_ ]", " ")), " +")
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS)))


def has_term(response: Column, term: Column) -> Column:
    """Whether a normalised response holds the term as a whole word."""
    return F.regexp_like(response, F.concat(F.lit(r"(?U)\b"), term, F.lit(r"\b")))


def near_negation(response: Column, term: Column) -> Column:
    """Whether any place of the term has a cue in the characters before it; cues with an apostrophe never fire on normalised text."""
    cues = [(n, len(n)) for n in NEGATIONS]
    fires = F.lit(False)
    for cue, n in cues:
        fires |= F.regexp_like(response, F.concat(F.lit(rf"(?U){cue}.{{0,{NEGATION_REACH - n}}}(?<!\w)"), term, F.lit(r"\b")))
    return fires


def property_matched(response: Column, statement: Column) -> Column:
    """1 if at least min(2, all) key terms occur and neither of the first two found is denied, else 0."""
    terms = key_terms(statement)
    found = F.filter(terms, lambda t: has_term(response, t))
    enough = (F.size(terms) > 0) & (F.size(found) >= F.least(F.lit(2), F.size(terms)))
    return F.when(enough & ~F.exists(F.slice(found, 1, 2), lambda t: near_negation(response, t)), 1).otherwise(0)


# -- location and fix claims --------------------------------------------------------------------
def line_numbers(response: Column) -> Column:
    """Numbers that a response names as ``line N``, then those as ``#N`` or ``LN``."""
    text = F.coalesce(response, F.lit(""))
    named = F.regexp_extract_all(text, F.lit(r"(?i)\bline\s+(\d+)\b"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?i)(?:^|[^a-z\d])(?:#|L)(\d+)\b"), F.lit(1))
    return F.concat(named, bare).cast("array<int>")


def fenced_blocks(response: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(response, F.lit("")), F.lit(r"(?s)```(?:[a-z]*)?\n?(.*?)```"), F.lit(1))


def quoted_code(response: Column) -> Column:
    """Non-empty lines of fenced blocks, then inline quotes, trimmed."""
    lines = F.filter(F.transform(F.flatten(F.transform(fenced_blocks(response), lambda b: F.split(b, "\n"))), lambda x: F.trim(x)), lambda x: x != "")
    inline = F.transform(F.regexp_extract_all(F.coalesce(response, F.lit("")), F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.trim(x))
    return F.concat(lines, inline)


def fix_lines(response: Column) -> Column:
    """Code lines of fenced blocks without comments; where there is none, prose lines that look like code."""
    lines = F.flatten(F.transform(fenced_blocks(response), lambda b: F.split(b, "\n")))
    code = F.transform(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), lambda x: F.rtrim(x))
    prose = F.filter(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.trim(x).rlike(r"^(if\s+.+:|count\s*\+=\s*\d|return\s+\w)"))
    return F.when(F.size(code) > 0, code).otherwise(F.transform(prose, lambda x: F.rtrim(x)))


def location_hit(lines: Column, start: Column, end: Column) -> Column:
    return F.exists(lines, lambda x: x.between(start, end)).cast("int")


def squeeze(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def predicted_lines(response: Column, source: Column) -> Column:
    """Lines of the source (an array) that a response names in range or quotes; quotes match in either direction from six characters on."""
    n = F.size(source)
    named = F.filter(line_numbers(response), lambda x: x.between(F.lit(1), n))
    quotes = F.filter(F.transform(quoted_code(response), squeeze), lambda x: F.length(x) >= LEAST_FRAGMENT)
    lines = F.transform(source, lambda x, i: F.struct(squeeze(x).alias("s"), (i + 1).alias("at")))
    hit = F.filter(lines, lambda x: (x["s"] != "") & F.exists(quotes, lambda q: x["s"].contains(q) | q.contains(x["s"])))
    return F.sort_array(F.array_distinct(F.concat(named, F.transform(hit, lambda x: x["at"]))))


def location_score(predicted: Column, start: Column, end: Column, length: Column) -> Column:
    """Intersection over union with the true span; without overlap half of a ramp that falls with the distance; 0 without a line."""
    inside = F.size(F.filter(predicted, lambda p: p.between(start, end)))
    union = F.size(F.array_distinct(predicted)) + (end - start + 1) - inside
    far = F.array_min(F.transform(predicted, lambda p: F.greatest(start - p, p - end)))
    reach = F.greatest(F.lit(4), F.floor(length / 4))
    ramp = F.greatest(F.lit(0.0), 1 - (far - 1) / reach)
    return F.when(F.size(predicted) == 0, 0.0).when(inside > 0, inside / union).otherwise(PROXIMITY_WEIGHT * ramp)


def diagnosis_hit(response: Column, category: Column, description: Column) -> Column:
    """All words of the category, or three of the first ten longer description words, occur."""
    said = F.lower(response)
    words = F.split(category, "_")
    long = F.slice(F.filter(F.split(F.lower(description), r"\W+"), lambda x: F.length(x) > 3), 1, 10)
    return (F.forall(words, lambda x: said.contains(x)) | (F.size(F.filter(long, lambda x: said.contains(x))) >= 3)).cast("int")


def splice(source: Column, start: Column, end: Column, fix: Column) -> Column:
    """The lines of a source with the closed span start..end replaced; a single line takes over the indentation."""
    indent = F.regexp_extract(F.element_at(source, start), r"^(\s*)", 1)
    new = F.when(F.size(fix) == 1, F.array(F.concat(indent, F.ltrim(F.element_at(fix, 1))))).otherwise(fix)
    return F.concat(F.slice(source, F.lit(1), start - 1), new, F.slice(source, end + 1, F.greatest(F.size(source) - end, F.lit(0))))


def code_candidate(response: Column, name: Column) -> Column:
    """The fenced block that defines the function, else the first one, blocks tagged python before others; without a block the function's text in the prose, up to the next one; else null."""
    text = F.coalesce(response, F.lit(""))
    tagged = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)\s*\n(.*?)```"), F.lit(1))
    plain = F.regexp_extract_all(text, F.lit(r"(?s)```\s*\n(.*?)```"), F.lit(1))
    blocks = F.concat(tagged, plain)
    own = F.filter(blocks, lambda b: b.contains(F.concat(F.lit("def "), name, F.lit("("))))
    prose = F.regexp_substr(text, F.concat(F.lit(r"(?s)def\s+\Q"), name, F.lit(r"\E\s*\(.*?(?=\ndef\s|\z)")))
    return F.regexp_replace(F.coalesce(F.get(own, 0), F.get(blocks, 0), prose), r"^\s+|\s+$", "")


# -- types, documents, results ------------------------------------------------------------------
def clean_type(s: Column) -> Column:
    """Without ``builtins.``; a callable's type becomes ``Callable[..., R]``."""
    s = F.regexp_replace(s, r"builtins\.", "")
    return F.when(s.rlike(r"^def \(.*\) -> "), F.concat(F.lit("Callable[..., "), F.regexp_extract(s, r"^def \(.*\) -> (.*)$", 1), F.lit("]"))).otherwise(s)


def base_type(s: Column) -> Column:
    return F.substring_index(F.substring_index(s, "[", 1), ".", -1)


def strip_fence(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^```[a-z]*\n?", ""), r"\n?```$", ""))


def render(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def file_paths(s: Column, most: int = 20) -> Column:
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]{1,5}"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, most)


def outcome_counts(s: Column) -> Column:
    number = lambda what: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, rf"(\d+) {what}", 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(number("passed").alias("passed"), number("failed").alias("failed"))


# What in a run's output tells of files, errors, issues and blockers.
FILE_PATTERNS = (r"""(?i)(?:Created|Modified|Added|Wrote|Updated|Saved|Written)(?:\s+file)?\s*[:`]?\s*['"`]?([^\s'"`,]+\.[a-zA-Z]{1,10})['"`]?""", r"(?i)`([a-zA-Z0-9_./ -]+\.[a-zA-Z]{2,10})`")
ERROR_SIGNS = ("traceback (most recent call last)", "syntaxerror", "nameerror", "importerror", "filenotfounderror", "error:", "failed to", "cannot proceed", "unable to")
SUMMARY_HEADS = ("## Summary", "# Summary", "**Summary**", "Summary:")
ISSUE_PATTERNS = (r"(?i)(?:TODO|FIXME|HACK):\s*(.+)", r"(?i)\[BLOCKING\]\s*(.+)", r"(?i)(?:Issue|Problem|Bug):\s*(.+)")
BLOCKER_PATTERNS = (r"(?i)\[BLOCKING\]\s*(.+)", r"(?i)BLOCKED BY:\s*(.+)", r"(?i)Cannot proceed[,\s]+because[:\s]+(.+)", r"(?i)BLOCKER:\s*(.+)")
#: What a report shows at most: files, issues, and characters of an issue, a blocker and a summary.
MOST_FILES, MOST_ISSUES, ISSUE_CHARS, BLOCKER_CHARS, SUMMARY_CHARS = 20, 5, 120, 200, 400


def _all(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))


def run_report(output: Column) -> Column:
    """What a run's output says: files (first seen first), tests_run, passed, failed, status, summary, issues, blocker.

    A report is cut to what it shows (``MOST_FILES`` and the others beside it); the output itself is read whole.
    """
    text = F.coalesce(output, F.lit(""))
    dots = lambda x: F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))
    files = F.filter(F.transform(_all(text, FILE_PATTERNS), lambda x: F.trim(x)), lambda x: x.contains("/") | (dots(x) == 1))
    count = lambda what: F.try_to_number(F.nullif(F.regexp_extract(text, rf"(\d+)\s+{what}", 1), F.lit("")), F.lit("9" * 18)).cast("bigint")
    passed, failed = count("passed"), count("failed")
    ran = F.nullif(F.coalesce(passed, F.lit(0)) + F.coalesce(failed, F.lit(0)), F.lit(0).cast("bigint"))
    low = F.lower(text)
    trouble = F.lit(False)
    for sign in ERROR_SIGNS:
        trouble |= low.contains(sign)
    status = F.when((F.coalesce(failed, F.lit(0)) > 0) | trouble, "partial").otherwise("success")
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    sentences = lambda x: F.array_join(F.slice(F.filter(F.split(stripped(x), r"(?<=[.!?])\s+"), lambda y: stripped(y) != ""), 1, 3), " ")
    told = [F.when(text.contains(h), F.nullif(F.substring(sentences(F.substring(text, F.instr(text, h) + len(h), F.length(text))), F.lit(1), F.lit(SUMMARY_CHARS)), F.lit(""))) for h in SUMMARY_HEADS]
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: (x != "") & ~x.startswith("#"))
    first = F.nullif(F.substring(F.array_join(F.slice(lines, 1, 3), " "), F.lit(1), F.lit(SUMMARY_CHARS)), F.lit(""))
    issues = F.filter(F.transform(_all(text, ISSUE_PATTERNS), lambda x: F.substring(stripped(x), F.lit(1), F.lit(ISSUE_CHARS))), lambda x: x != "")
    blocker = F.coalesce(*(F.get(F.regexp_extract_all(text, F.lit(p), F.lit(1)), 0) for p in BLOCKER_PATTERNS))
    return F.struct(
        F.slice(F.array_distinct(files), 1, MOST_FILES).alias("files"), ran.alias("tests_run"), passed.alias("passed"), failed.alias("failed"), status.alias("status"), F.coalesce(*told, first, F.lit("No summary available.")).alias("summary"),
        F.slice(F.array_distinct(issues), 1, MOST_ISSUES).alias("issues"), F.substring(stripped(blocker), F.lit(1), F.lit(BLOCKER_CHARS)).alias("blocker"),
    )


def contract_errors(response: Column) -> Column:
    """What is wrong with a response that should be a JSON object of three lists of strings, fenced or not: an array of texts, empty if it is one.

    Elements are looked at as JSON texts, so a number in a list of strings is seen.
    """
    raw = F.from_json(strip_fence(response), "map<string,string>", {"mode": "PERMISSIVE"})
    shape = lambda k: F.trim(raw[k])
    items = lambda k: F.from_json(shape(k), "array<string>")
    # each element as JSON again: a string that was quoted gives the list back, anything else doesn't
    again = lambda k: F.regexp_replace(F.to_json(items(k)), r"\s", "") == F.regexp_replace(shape(k), r"\s", "")
    named = [F.when(~F.map_contains_key(raw, k), f"missing required key: '{k}'").when(~F.coalesce(shape(k).startswith("["), F.lit(False)), f"'{k}' is not a JSON array").when(~F.coalesce(again(k), F.lit(False)) | F.exists(items(k), lambda x: x.isNull()), f"'{k}' contains non-string items") for k in ("preconditions", "postconditions", "invariants")]
    found = F.array_compact(F.array(*named))
    empty = F.array(F.lit("postconditions array is empty"))
    none = F.array().cast("array<string>")
    return F.when(raw.isNull(), F.array(F.lit("response is not a JSON object"))).when(F.size(found) > 0, found).when(F.size(items("postconditions")) == 0, empty).otherwise(none)


def close_to(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def quality(tiers: list[tuple[Column, Column, int]]) -> Column:
    """Weighted share of passed cases over (passed, total, weight) tiers; null without a case."""
    passed = sum((p * w for p, _, w in tiers), F.lit(0))
    total = sum((t * w for _, t, w in tiers), F.lit(0))
    return F.try_divide(passed.cast("double"), total.cast("double"))
