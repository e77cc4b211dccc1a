import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparrowfold.functions import scores, text


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def many(spark, column, values, kind="string"):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"n int, v {kind}").select("n", column.alias("x")).orderBy("n").collect()]


def raises(f):
    with pytest.raises(Exception):  # noqa: B017
        f()


@settings(max_examples=20, deadline=None)
@given(values=st.lists(st.text(alphabet="ab \t\n\x0b\x1c\x1f\x85\xa0 　-", max_size=12), min_size=1, max_size=10))
def test_white_space(spark, values):
    assert many(spark, text.squeeze(F.col("v")), values) == [" ".join(v.split()) for v in values]
    assert many(spark, text.strip(F.col("v")), values) == [v.strip() for v in values]


def test_bullets_and_tokens(spark):
    assert many(spark, text.without_bullet(F.col("v")), ["• one", "  ‣two", "•• x", "plain", "–"]) == ["one", "two", "• x", "plain", ""]
    assert many(spark, text.is_bullet(F.col("v")), [" • a", "- a", "▪"]) == [True, False, True]
    assert many(spark, text.token_count(F.col("v")), ["Medicare Part B coverage", "word " * 600, ""]) == [6, 602, 2]
    assert many(spark, text.is_bold_font(F.col("v")), ["Arial-BoldMT", "Roboto BLACK", "Arial"]) == [True, True, False]


def spans(*parts):
    return [Row(text=t, x0=float(a), x1=float(b), size=10.0) for t, a, b in parts]


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ((("Part", 0, 20), ("B", 25, 30)), "Part B"), ((("Part", 0, 20), ("B", 20.5, 30)), "PartB"), ((("Part ", 0, 20), ("B", 20, 30)), "Part B"), ((("cost", 0, 20), (".", 25, 30)), "cost."),
        ((("(", 0, 5), ("a", 9, 12)), "(a"), ((("$", 0, 5), (" 5", 9, 12)), "$5"), ((("a", 0, 5), ("  ", 5, 9), ("b", 5.1, 8)), "ab"), ((), ""),
    ],
)
def test_spans(spark, parts, want):
    df = spark.createDataFrame([(spans(*parts),)], "s array<struct<text: string, x0: double, x1: double, size: double>>")
    assert df.select(text.join_spans(F.col("s"))).first()[0] == want


def test_lines(spark):
    cases = [["health-", "care"], ["health-", "Care"], ["a ", " b"], ["", "a"], ["one", "", "two"], []]
    assert many(spark, text.join_lines(F.col("v")), cases, "array<string>") == ["health-care", "health- Care", "a b", "a", "one two", ""]


def test_embedding_text_and_query(spark):
    assert one(spark, text.embedding_text(F.col("h"), F.col("t")), h=[" A ", " ", "B"], t=" body ") == "A\nB\nbody"
    assert one(spark, text.embedding_text(F.col("h"), F.col("t")), h=["A"], t=" ") == "A"
    assert one(spark, text.prepared_query(F.col("q"), "BAAI/bge-small-en-v1.5"), q="x").endswith(": x")
    assert one(spark, text.prepared_query(F.col("q"), "other"), q="x") == "x"


def plain_snippet(t, limit):
    s = " ".join(t.split())
    if len(s) <= limit:
        return s
    head = s[: limit - 1].rstrip()
    at = head.rfind(" ")
    return (head[:at].rstrip() if at >= int((limit - 1) * 0.6) else head) + "…"


@settings(max_examples=20, deadline=None)
@given(values=st.lists(st.text(alphabet="abcdefg  \n", max_size=90), min_size=1, max_size=8))
def test_snippets(spark, values):
    assert many(spark, text.snippet(F.col("v"), 30), values) == [plain_snippet(v, 30) for v in values]


def test_long_snippet_and_bounds(spark):
    got = one(spark, text.snippet(F.col("t"), 120), t="Some evidence sentence " * 50)
    assert len(got) <= 120 and got.endswith("…")
    raises(lambda: text.snippet(F.col("t"), 19))


def test_page_references_and_ids(spark):
    assert many(spark, text.page_reference(F.col("v")), [[54], [54, 55], [54, 56]], "array<int>") == ["PDF page 54", "PDF pages 54–55", "PDF pages 54, 56"]
    assert many(spark, text.query_status(F.col("v")), ["ok?", " \n", "x" * 2001, None]) == ["ok", "blank", "too_long", "blank"]


def test_chunk_ids(spark):
    row = spark.range(1).select(text.chunk_id(F.lit("doc"), F.lit(416), F.lit(7), F.lit(3)).alias("x")).first()
    assert row.x == "doc-t416-s0007-c03" and re.fullmatch(r"doc-t\d+-s\d{4}-c\d{2}", row.x)


def test_snapping(spark):
    assert many(spark, scores.snapped(F.col("v")), [121.0, 188.0, 332.2, 414.8, 1.0], "double") == [128, 192, 320, 416, 32]
    for bad in (0.0, -1.0, -100.0):
        raises(lambda bad=bad: many(spark, scores.snapped(F.col("v")), [bad], "double"))


def test_similarity(spark):
    assert one(spark, scores.inner_product(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, -1.0]) == 1.0
    assert one(spark, scores.unit_scale(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert many(spark, scores.next_double(F.col("v")), [0.1, 0.9], "double") == [math.nextafter(0.1, 1), math.nextafter(0.9, 1)]
    assert math.isclose(one(spark, scores.ideal_gain(F.col("n")), n=3), 1 + 1 / math.log2(3) + 0.5)
    assert one(spark, scores.ideal_gain(F.col("n")), n=0) == 0


def test_confidence(spark):
    top, t = 0.8728764057159424, 0.7607258856296539
    value = lambda cited, top=top, t=t: one(spark, scores.confidence(F.col("top"), F.col("c").cast("array<double>"), F.col("t")), top=top, c=cited, t=t)
    assert value([top]) == 0.7291 and value([top, 0.850187]) == 0.778
    df = spark.createDataFrame([(top, [], t)], "top double, c array<double>, t double")
    assert df.select(scores.confidence(F.col("top"), F.col("c"), F.col("t"))).first()[0] == 0.0
    assert value([1.0], 1.0, 1.0) == 0.95
    for bad in (([0.5], 0.5, 0.7), ([1.5], 0.9, 0.7), ([0.9], 0.9, float("nan")), ([0.9], 1.1, 0.7)):
        raises(lambda bad=bad: value(*bad))
