import pytest
from pyspark.sql import functions as F

from leafseek.errors import LeafseekError
from leafseek.functions.text import occurrences, regex_occurrences, snippet
from leafseek.operators.query import match_expression, parse_query
from leafseek.operators.search import index_pages, search_batch, search_pages
from leafseek.operators.spans import build_spans, page_texts
from leafseek.session import ship
from leafseek.streaming.pages import read_pages, stream_hits


def pages(spark, *rows):
    ship(spark)
    return index_pages(spark.createDataFrame(list(rows), "document_id string, page_number int, original_text string"))


def hits(df):
    return [(r.document_id, r.page, r.start, r.stop) for r in df.orderBy("document_id", "page", "start", "stop").collect()]


@pytest.mark.parametrize(("text", "needle", "expected"), [("aaa", "aa", [(1, 3), (2, 4)]), ("héllo héllo", "héllo", [(1, 6), (7, 12)]), ("xaab aa😀aa", "aa", [(2, 4), (6, 8), (9, 11)]), ("a.b\\E", "\\E", [(4, 6)]), ("abc", "", []), ("", "a", []), ("ab", "abc", [])])
def test_occurrences(spark, text, needle, expected):
    row = spark.createDataFrame([(text,)], "t string").select(occurrences(F.col("t"), needle).alias("o")).first()
    assert [tuple(x) for x in row.o] == expected


@pytest.mark.parametrize(("pattern", "text", "expected"), [("h.llo", "say hillo ok", [(5, 10)]), ("a+", "aa b aaa", [(1, 3), (6, 9)]), ("x*", "axb", [(1, 1), (2, 3), (3, 3), (4, 4)]), (r"(l)\1", "hello ball", [(3, 5), (9, 11)]), ("(?=the)", "the the", [(1, 1), (5, 5)]), ("(?P<x>he)", "he the", [(1, 3), (5, 7)]), ("(a|bc){2}", "abcbca bc", [(1, 4), (4, 7)]), ("[a-c]+d?", "", [])])
def test_regex(spark, pattern, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(regex_occurrences(F.col("t"), pattern).alias("o")).first()
    assert [tuple(x) for x in row.o] == expected


@pytest.mark.parametrize(("text", "start", "stop", "context", "expected"), [("hello world", 1, 6, 0, "hello..."), ("hello world", 7, 12, 2, "...o world"), ("hello", 1, 6, 80, "hello")])
def test_snippet(spark, text, start, stop, context, expected):
    assert spark.createDataFrame([(text,)], "t string").select(snippet(F.col("t"), F.lit(start), F.lit(stop), context).alias("s")).first().s == expected


def test_many_places(spark):
    row = spark.createDataFrame([("ab" * 700 + "a",)], "t string").select(occurrences(F.col("t"), "a").alias("o"), regex_occurrences(F.col("t"), "[b]").alias("r")).first()
    assert [x.start for x in row.o] == list(range(1, 1402, 2)) and [x.start for x in row.r] == list(range(2, 1401, 2))


def test_parsing():
    assert [(parse_query(q).phrases, parse_query(q).terms) for q in ('a"b c"d', '"open', '""x"y', '"a" "b"')] == [(("b c",), ("a", "d")), ((), ('"open',)), (("x",), ('"', 'y')), (("a", "b"), ())]
    spec = parse_query('"supply chain" resilience')
    assert spec.phrases == ("supply chain",) and spec.terms == ("resilience",) and spec.needles == ("supply chain",)
    assert match_expression(spec) == '"supply chain" AND "resilience"'
    for bad in ("", "   ", '"  "'):
        with pytest.raises(LeafseekError):
            parse_query(bad)
    with pytest.raises(LeafseekError):
        parse_query("(", regex_mode=True)


def test_two_stages_fallback_and_limits(spark):
    df = pages(spark, ("a", 1, "art is part of art"), ("a", 2, "party"), ("b", 1, "only parts"), ("c", 1, "café"), ("d", 1, None), ("e", 1, ""))
    assert hits(search_pages(df, "art")) == [("a", 1, 1, 4), ("a", 1, 9, 12), ("a", 1, 16, 19), ("b", 1, 7, 10)]
    assert hits(search_pages(df, "cafe")) == []
    assert hits(search_pages(df, "art", limit=1)) == [("a", 1, 1, 4), ("b", 1, 7, 10)]
    assert hits(search_pages(df, "art", limit=1, candidate_limit=None, scope="corpus")) == [("a", 1, 1, 4)]
    assert hits(search_pages(df, "part", literal=True, page_range=(2, 9))) == [("a", 2, 1, 5)]


def test_phrases_hide_terms_and_case(spark):
    df = pages(spark, ("a", 1, "Hello hello of the World"), ("b", 1, "of, the hello"))
    assert hits(search_pages(df, '"of the" hello')) == [("a", 1, 13, 19)]
    assert hits(search_pages(df, "Hello", case_sensitive=True)) == [("a", 1, 1, 6)]


def test_original_offsets_and_explain(spark):
    df = pages(spark, ("a", 1, "Straße  ﬁn-\nal Café"))
    row = search_pages(df, "final", explain=True).first()
    assert (row.start, row.stop, row.original_start, row.original_stop, row.original_text) == (9, 14, 9, 15, "ﬁn-\nal")
    assert search_pages(index_pages(df.select("document_id", "page_number", "original_text"), with_map=False), "final").first() == search_pages(df, "final").first()
    assert row.explain.condition == '"final"' and row.explain.filters.limit == 20


def test_spans_boxes_and_text(spark):
    ship(spark)
    words = spark.createDataFrame([("a", 1, 1, 1, "Under-", (0.0, 0.0, 1.0, 1.0)), ("a", 1, 2, 2, "standing", None), ("a", 1, 3, 2, " ", None), ("a", 1, 4, 2, "Straße", (2.0, 2.0, 3.0, 3.0))], "document_id string, page_number int, word_no int, line int, word string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    spans = build_spans(words)
    rows = spans.orderBy("span_id").collect()
    assert [(r.span_id, r.start, r.stop, r.original_start, r.original_stop, r.text) for r in rows] == [(1, 1, 6, 1, 6, "under"), (2, 6, 14, 6, 14, "standing"), (3, 15, 22, 15, 21, "strasse")]
    text = page_texts(spans).first()
    assert (text.text, text.original_text) == ("understanding strasse", "Understanding Straße")
    df = pages(spark, ("a", 1, "understanding straße"))
    hit = search_pages(df, "understanding strasse", spans, boxes=True).orderBy("start").collect()
    assert [len(h.boxes) for h in hit] == [1, 1]
    assert [len(h.boxes) for h in search_pages(df, "understanding", spans.where("span_id = 2"), boxes=True).collect()] == [0]


def test_batch(spark):
    df = pages(spark, ("a", 1, "one two three"), ("b", 1, "two, three"))
    phrases = index_pages(spark.createDataFrame([(1, 1, "Two three"), (2, 1, "four"), (3, 1, "!")], "query_id int, page_number int, original_text string")).select("query_id", "text", "tok_text")
    assert [tuple(r) for r in search_batch(df, phrases).collect()] == [(1, "a", 1, 5)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"document_id":"a","page_number":1,"original_text":"Supply chain"}\n{"document_id":"b","page_number":1,"original_text":"none"}\n')
    stream = stream_hits(read_pages(spark, str(tmp_path / "in")), "supply")
    query = stream.writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.document_id, r.start) for r in spark.sql("select * from found").collect()] == [("a", 1)]
