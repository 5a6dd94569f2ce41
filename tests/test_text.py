"""Documented pairs of the text functions."""

from pyspark.sql import functions as F

from trialframe.functions import text as t


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_names(spark):
    for s, want in (("camelCase", "camel_case"), ("XMLParser", "xml_parser"), ("getHTTPSResponse", "get_https_response"), ("éCole2Go", "é_cole2_go"), ("", "")):
        assert one(spark, t.camel_to_snake(F.lit(s))) == want
    assert one(spark, t.camel_segments(F.lit("getHTTPSResponse"))) == ["get", "https", "response"]
    assert one(spark, t.camel_segments(F.lit(""))) == []
    assert one(spark, t.count_vowels(F.lit("Hey YOU"))) == 3 and one(spark, t.count_vowels(F.lit("Hey YOU"), True)) == 5


def test_arithmetic(spark):
    assert [tuple(x) for x in one(spark, t.tokenize_arithmetic(F.lit("(1+2)*3 @ .5"), True))] == [("LPAREN", "("), ("NUM", "1"), ("ADDOP", "+"), ("NUM", "2"), ("RPAREN", ")"), ("MULOP", "*"), ("NUM", "3"), ("NUM", ".5")]
    assert one(spark, t.tokenize_arithmetic(F.lit(""))) == []


def test_brackets(spark):
    spans = lambda s, **k: [tuple(x) for x in one(spark, t.balanced_spans(F.lit(s), "(", ")", **k))]
    assert spans("a(b(c)d)e(f)") == [(1, 7), (9, 11)] and spans("((()))") == [(0, 5)] and spans("x") == []
    assert spans("((()))", nested=True) == [(0, 5), (1, 4), (2, 3)] and spans(")()(", nested=True) == [(1, 2)]


def test_checklist(spark):
    match = lambda r, s: one(spark, t.property_matched(t.normalize_response(F.lit(r)), F.lit(s)))
    assert match("The value, (bounded) here", "value bounded") == 1
    assert match("it is not value but bounded", "value bounded") == 0
    assert match("only value", "value bounded") == 0 and match("only value", "value") == 1 and match("x", "the a") == 0
    assert match("it doesn't change value bounded", "value bounded") == 1  # the apostrophe is gone by then
    assert match("not so near to the one value bounded", "value bounded") == 1
    assert one(spark, t.key_terms(F.lit("The lo, hi & LO of a value!"))) == ["lo", "hi", "value"]


def test_lines(spark):
    assert one(spark, t.line_numbers(F.lit("Line 8, at line 9; #12 and L3, xL4"))) == [8, 9, 12, 3]
    source = F.array(*(F.lit(x) for x in ("def f(a):", "    total = a + 1", "", "    return total")))
    assert one(spark, t.predicted_lines(F.lit("`total = a  + 1  # BUG` and `f` and line 9, line 1"), source)) == [1, 2]
    score = lambda p, s, e, n: one(spark, t.location_score(F.array(*map(F.lit, p)).cast("array<int>"), F.lit(s), F.lit(e), F.lit(n)))
    assert score([], 1, 2, 10) == 0 and score([2, 3], 2, 4, 10) == 2 / 3 and score([6], 2, 4, 16) == 0.5 * 0.75 and score([40], 2, 4, 16) == 0
    assert one(spark, t.splice(source, F.lit(2), F.lit(2), F.array(F.lit("total = 2"))))[1] == "    total = 2"
    assert one(spark, t.fix_lines(F.lit("use\nreturn x\nnow"))) == ["return x"]


def test_code_and_types(spark):
    said = "```python\nx = 1\n```\n```python\ndef g(a):\n    return a\n```"
    assert one(spark, t.code_candidate(F.lit(said), F.lit("g"))) == "def g(a):\n    return a"
    assert one(spark, t.code_candidate(F.lit(said), F.lit("h"))) == "x = 1" and one(spark, t.code_candidate(F.lit("none"), F.lit("g"))) is None
    assert one(spark, t.clean_type(F.lit("def (a: builtins.int) -> builtins.list[builtins.int]"))) == "Callable[..., list[int]]"
    assert one(spark, t.base_type(F.lit("typing.List[int]"))) == "List"
    assert one(spark, t.outcome_counts(F.lit("12 passed, 3 failed"))).asDict() == {"passed": 12, "failed": 3}
    assert one(spark, t.render(F.lit("{a}-{b}"), {"a": F.lit("x"), "b": F.lit("y")})) == "x-y"
    assert one(spark, t.quality([(F.lit(1), F.lit(2), 3), (F.lit(1), F.lit(1), 1)])) == 4 / 7 and one(spark, t.quality([(F.lit(0), F.lit(0), 1)])) is None
