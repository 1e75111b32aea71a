"""Registered queries of the search operators, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import text as T
from .functions.normalize import joined_linebreaks, normalized, token_string
from .operators import search as S
from .operators import spans as P
from .plans.index import last_of_each
from .sources import layout
from .staging import once

Query = Callable[[SparkSession, str], DataFrame]

# ---- SQL building blocks

_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_TOK = "' ' || array_to_string(regexp_extract_all(strip_accents({0}), '[\\pL\\pN\\p{{Co}}]+'), ' ') || ' '"


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pages_sql(source: str) -> str:
    own = {
        "conv": "SELECT conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, text AS original_text FROM conversations",
        "line": "SELECT doc_id AS document_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS page_number, unnest(string_split(text, chr(10))) AS original_text FROM documents",
        "whole": "SELECT doc_id AS document_id, 1 AS page_number, text AS original_text FROM documents",
    }[source]
    return f"src AS ({own}), normed AS (SELECT *, {_NORM.format('original_text')} AS text FROM src), pages AS (SELECT *, {_TOK.format('text')} AS tok FROM normed)"


def _starts(text: str, needle: str) -> str:
    n = _lit(needle)
    return f"CASE WHEN length({text}) < length({n}) THEN [] ELSE list_filter(range(1, length({text}) - length({n}) + 2), lambda k: substring({text}, k, length({n})) = {n}) END"


def _hits_sql(source: str, condition: str, needles: list[str], *, where: str = "true", fallback: str | None = None, text: str = "text", context: int = 80, candidate_limit: int | None = None, limit: int | None = None) -> str:
    """The hits of needles on the pages of a condition, with fallback and both limits by document."""
    whole = f"contains(text, {_lit(fallback)})" if fallback is not None else "false"
    parts = " UNION ALL ".join(f"SELECT document_id, page_number, {text} AS t, unnest({_starts(text, n)}) AS start, {len(n)} AS n FROM cand" for n in needles)
    first = f"WHERE place <= {candidate_limit}" if candidate_limit else ""
    last = f"WHERE r <= {limit}" if limit else ""
    return f"""WITH {_pages_sql(source)},
        held AS (SELECT *, ({condition}) AS tokened, ({whole}) AS whole FROM pages WHERE {where}),
        one AS (SELECT *, max(CAST(tokened AS INTEGER)) OVER (PARTITION BY document_id) AS any_token FROM held WHERE tokened OR whole),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS place FROM one WHERE tokened OR any_token = 0),
        cand AS (SELECT * FROM numbered {first}),
        found AS ({parts}),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY document_id, page_number) AS match_count, row_number() OVER (PARTITION BY document_id ORDER BY page_number, start, start + n) AS r FROM found)
        SELECT document_id, page_number AS page, CAST(match_count AS INTEGER) AS match_count, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS stop, substring(t, start, n) AS match_text,
            CASE WHEN start - {context} > 1 THEN '...' ELSE '' END || substring(t, greatest(1, start - {context}), least(length(t), start + n - 1 + {context}) - greatest(1, start - {context}) + 1) || CASE WHEN start + n - 1 + {context} < length(t) THEN '...' ELSE '' END AS snippet
        FROM ranked {last}"""


def _has(*phrases: str) -> str:
    return " AND ".join(f"contains(tok, {_lit(f' {p} ')})" for p in phrases)


_FLAT = ["document_id", "page", "match_count", "start", "stop", "match_text", "snippet"]
_SOURCES = {"conv": views.conversation_pages, "line": views.line_pages, "whole": views.whole_pages}


def _index(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The search index of a view, written by the first query of the application that asks for it."""
    return once(spark, ("pages", source, sf_dir), lambda: S.index_pages(_SOURCES[source](spark, sf_dir), with_map=False))


def _search(source: str, query: str, **options) -> Query:
    options.setdefault("limit", None)
    where = options.pop("where", "true")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.search_pages(_index(spark, sf_dir, source).where(where), query, **options).select(*_FLAT)

    return run


def _hyphenated(column):
    return F.regexp_replace(column, "([a-z]{3}) ([a-z]{3})", "$1-\n$2")


_HYPHENS = "regexp_replace(text, '([a-z]{3}) ([a-z]{3})', '\\1-' || chr(10) || '\\2', 'g')"


def _rejoined(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(\\pL)-[ \\t]*\\n[ \\t]*(\\pL)', '\\1\\2', 'g'), '(\\pL)-[ \\t]*\\n[ \\t]*(\\pL)', '\\1\\2', 'g')"


# ---- queries


def normalize_docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", normalized("text").alias("text"))


def normalize_hyphen(spark, d):
    return views.table(spark, d, "documents").select("doc_id", normalized(_hyphenated(F.col("text"))).alias("text"), F.length(joined_linebreaks(_hyphenated(F.col("text")))).alias("joined_length"))


def _map_rows(pages: DataFrame) -> DataFrame:
    rows = S.index_pages(pages).select("document_id", "page_number", F.posexplode("norm_map").alias("i", "r"))
    return rows.select("document_id", "page_number", (F.col("i") + 1).alias("position"), F.col("r.first").alias("first"), F.col("r.last").alias("last"))


def norm_map_conv(spark, d):
    """The map of each turn: a sharp s stands for two characters of the text."""
    return _map_rows(views.conversation_pages(spark, d))


def norm_map_marks(spark, d):
    """The same with each acute e written as a letter and a mark: a cluster of two source characters."""
    return _map_rows(views.conversation_pages(spark, d).withColumn("original_text", F.replace("original_text", F.lit("é"), F.lit("e\u0301"))))


def _map_sql(width: str) -> str:
    return f"""WITH {_pages_sql("conv")},
    chars AS (SELECT document_id, page_number, unnest(string_split(original_text, '')) AS c, generate_subscripts(string_split(original_text, ''), 1) AS i FROM pages WHERE original_text <> ''),
    folded AS (SELECT *, CASE WHEN c = 'ß' THEN 2 ELSE 1 END AS n, {width} AS w FROM chars),
    placed AS (SELECT *, sum(n) OVER p - n AS before, sum(w) OVER p AS upto FROM folded WINDOW p AS (PARTITION BY document_id, page_number ORDER BY i))
    SELECT document_id, page_number, CAST(before + k AS INTEGER) AS position, CAST(upto - w + 1 AS INTEGER) AS first, CAST(upto AS INTEGER) AS last FROM placed, unnest([1, 2]) AS u(k) WHERE k <= n"""


def tokens_conv(spark, d):
    pages = _index(spark, d, "conv")
    return pages.select("document_id", "page_number", F.posexplode(F.split(F.trim("tok_text"), " ")).alias("i", "token")).where("token <> ''").select("document_id", "page_number", (F.col("i") + 1).alias("place"), "token")


_TOKENS_SQL = f"WITH {_pages_sql('conv')}, t AS (SELECT document_id, page_number, string_split(trim(tok), ' ') AS l FROM pages) SELECT document_id, page_number, CAST(generate_subscripts(l, 1) AS INTEGER) AS place, unnest(l) AS token FROM t WHERE l[1] <> ''"


def token_freq(spark, d):
    return tokens_conv(spark, d).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def original_offsets(spark, d):
    return S.search_pages(_index(spark, d, "conv"), "und", limit=None).select("document_id", "page", "start", "stop", "original_start", "original_stop", "original_text")


# a sharp s takes two places of the text: a place lies as far before itself in the source as there are such second places up to it
_OFFSETS_SQL = f"""WITH hits AS ({_hits_sql("conv", _has("und"), ["und"], fallback="und")}),
    hit AS (SELECT h.document_id, h.page, h.start, c.text AS o, list_transform(string_split(c.text, 'ß'), lambda x: length(x)) AS l FROM hits h JOIN conversations c ON c.conv_id = h.document_id AND c.turn + 1 = h.page),
    placed AS (SELECT *, start - len(list_filter(range(1, len(l)), lambda j: list_sum(l[1:j]) + 2 * j <= start)) AS a, start + 2 - len(list_filter(range(1, len(l)), lambda j: list_sum(l[1:j]) + 2 * j <= start + 2)) AS b FROM hit)
    SELECT document_id, page, CAST(start AS INTEGER) AS start, CAST(start + 3 AS INTEGER) AS stop, CAST(a AS INTEGER) AS original_start, CAST(b + 1 AS INTEGER) AS original_stop, substring(o, a, b + 1 - a) AS original_text FROM placed"""


def _regex_sql(pattern: str, length: str = "length(hit[k])") -> str:
    """Hits of a pattern; ``length`` is that of a match where the pattern here reaches further."""
    return f"""WITH {_pages_sql("conv")}, m AS (SELECT *, regexp_extract_all(text, '{pattern}') AS hit, regexp_split_to_array(text, '{pattern}') AS gap FROM pages),
    f AS (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM m WHERE len(hit) > 0),
    s AS (SELECT *, 1 + list_sum(list_transform(gap[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda g: length(g))), 0) AS start, {length} AS n FROM f)
    SELECT document_id, page_number AS page, CAST(len(hit) AS INTEGER) AS match_count, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS stop, substring(text, CAST(start AS BIGINT), CAST(n AS BIGINT)) AS match_text,
        CASE WHEN start - 80 > 1 THEN '...' ELSE '' END || substring(text, CAST(greatest(1, start - 80) AS BIGINT), CAST(least(length(text), start + n - 1 + 80) - greatest(1, start - 80) + 1 AS BIGINT)) || CASE WHEN start + n - 1 + 80 < length(text) THEN '...' ELSE '' END AS snippet FROM s"""


def search_explain(spark, d):
    """The explanation that goes with each hit."""
    hits = S.search_pages(_index(spark, d, "conv"), '"of the" and', limit=None, page=2, explain=True)
    return hits.select("document_id", "start", F.col("explain.condition").alias("condition"), F.col("explain.normalization.casefold").alias("casefold"), F.col("explain.filters.page").alias("only_page"))


def search_top_corpus(spark, d):
    """The first hits of all documents together."""
    return S.search_pages(_index(spark, d, "conv"), "the", limit=50, candidate_limit=None, scope="corpus").select("document_id", "page", "start", "match_count")


def search_corpus_batch(spark, d):
    phrases = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), normalized("text").alias("text"))
    phrases = phrases.withColumn("tok_text", token_string("text"))
    return S.search_batch(_index(spark, d, "whole"), phrases)


_BATCH_SQL = f"""WITH {_pages_sql("whole")}, q AS (SELECT item_id AS query_id, {_NORM.format("text")} AS phrase FROM benchmark), t AS (SELECT *, {_TOK.format("phrase")} AS tokens FROM q)
    SELECT query_id, document_id, page_number, CAST(instr(text, phrase) AS INTEGER) AS start FROM t JOIN pages ON contains(tok, tokens) AND contains(text, phrase) WHERE trim(tokens) <> ''"""


def _spans(hyphens: bool) -> Query:
    def run(spark, d):
        spans = P.build_spans(views.document_words(spark, d, hyphens))
        return spans.select("document_id", "page_number", "span_id", "start", "stop", "original_start", "original_stop", "text", "original_text", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"))

    return run


def _words_sql(hyphens: bool) -> str:
    word, line = ("CASE WHEN word_no % 5 = 0 THEN w || '-' ELSE w END", "CAST(floor((word_no - 1) / 5) AS INTEGER)") if hyphens else ("w", "CAST(floor((word_no - 1) / 10) AS INTEGER)")
    return f"""raw AS (SELECT doc_id AS document_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w, generate_subscripts(regexp_split_to_array(text, '[ \\n]+'), 1) AS word_no FROM documents),
        words AS (SELECT document_id, 1 AS page_number, word_no, {line} AS line, {word} AS word FROM raw WHERE w <> '')"""


def _spans_cte(hyphens: bool) -> str:
    return f"""{_words_sql(hyphens)}, n AS (SELECT *, {_NORM.format("word")} AS norm FROM words),
        j AS (SELECT *, coalesce(lag(norm) OVER p LIKE '%-' AND line > lag(line) OVER p AND regexp_matches(norm, '^\\pL'), false) AS joined, row_number() OVER p AS no FROM n WHERE norm <> '' WINDOW p AS (PARTITION BY document_id ORDER BY word_no)),
        z AS (SELECT *, CAST(coalesce(lead(joined) OVER p, false) AS INTEGER) AS popped, CAST(no > 1 AND NOT joined AS INTEGER) AS sep FROM j WINDOW p AS (PARTITION BY document_id ORDER BY word_no)),
        b AS (SELECT *, sum(sep) OVER p AS blanks, sum(length(norm) - popped) OVER p - (length(norm) - popped) AS ls, sum(length(word) - popped) OVER p - (length(word) - popped) AS lo FROM z WINDOW p AS (PARTITION BY document_id ORDER BY word_no ROWS UNBOUNDED PRECEDING)),
        spans AS (SELECT document_id, page_number, CAST(no AS INTEGER) AS span_id, CAST(1 + ls + blanks AS INTEGER) AS start, CAST(1 + ls + blanks + length(norm) - popped AS INTEGER) AS stop, CAST(1 + lo + blanks AS INTEGER) AS original_start, CAST(1 + lo + blanks + length(word) - popped AS INTEGER) AS original_stop,
            substring(norm, 1, length(norm) - popped) AS text, word AS original_text, CASE WHEN word_no % 7 <> 0 THEN CAST(word_no AS DOUBLE) END AS x0, CASE WHEN word_no % 7 <> 0 THEN CAST(line + 1 AS DOUBLE) END AS y1 FROM b)"""


def page_text_hash(spark, d):
    """Hash of the page text that spans make up, and of the source text."""
    pages = P.page_texts(P.build_spans(views.document_words(spark, d, True)))
    return pages.select("document_id", F.sha2("text", 256).alias("text_hash"), F.length("original_text").alias("original_length"))


_PAGE_TEXT_SQL = f"""WITH {_spans_cte(True)}, pieces AS (SELECT *, CASE WHEN span_id > 1 AND start > lag(stop) OVER p THEN ' ' ELSE '' END AS gap FROM spans WINDOW p AS (PARTITION BY document_id ORDER BY span_id))
    SELECT document_id, sha256(string_agg(gap || text, '' ORDER BY span_id)) AS text_hash, CAST(sum(length(gap) + original_stop - original_start) AS INTEGER) AS original_length FROM pieces GROUP BY document_id"""


def boxes_overlap(spark, d):
    words = views.document_words(spark, d)
    spans = P.build_spans(words)
    hits = S.search_pages(_index(spark, d, "whole"), '"of the"', limit=None)
    boxed = S.result_boxes(hits, spans)
    return boxed.select("document_id", "page", "start", F.size("boxes").alias("n_boxes"), F.coalesce(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x0"]), F.lit(0.0)).alias("sum_x0"))


_BOXES_SQL = f"""WITH {_pages_sql("whole")}, {_spans_cte(False)}, hit AS (SELECT document_id, unnest({_starts("text", "of the")}) AS start FROM pages WHERE {_has("of the")})
    SELECT h.document_id, 1 AS page, CAST(h.start AS INTEGER) AS start, CAST(count(s.x0) AS INTEGER) AS n_boxes, coalesce(sum(s.x0), 0.0) AS sum_x0
    FROM hit h LEFT JOIN spans s ON s.document_id = h.document_id AND s.start < h.start + 6 AND s.stop > h.start AND s.x0 IS NOT NULL GROUP BY h.document_id, h.start"""


def _tool_pages(spark, d):
    """Text as a tool prints it: lines as pages, blanks before line feeds, and a page count that is one off at times."""
    lines = F.size(F.split("text", "\n"))
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.replace(F.translate("text", "\n", "\f"), F.lit(". "), F.lit(". \t\n")).alias("output"), (lines + F.pmod("doc_id", F.lit(3)).cast("int") - 1).alias("page_count"))


def page_split_pad(spark, d):
    """Form-feed pages, cut or padded to the page count."""
    pages = layout.split_pages(_tool_pages(spark, d))
    return pages.select("document_id", "page_number", F.length("original_text").alias("length"), (normalized("original_text") != "").alias("text_native"))


_SPLIT_SQL = f"""WITH s AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT document_id, unnest(range(1, CAST(len(l) + document_id % 3 AS BIGINT))) AS page_number, l FROM s),
    t AS (SELECT document_id, page_number, regexp_replace(replace(coalesce(l[page_number], ''), '. ', '. ' || chr(9) || chr(10)), '[ \t]+\n', chr(10), 'g') AS o FROM p)
    SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CAST(length(o) AS INTEGER) AS length, {_NORM.format("o")} <> '' AS text_native FROM t"""


def pages_text_native(spark, d):
    return layout.health(page_split_pad(spark, d), "text_native")


def selected_pages(spark, d):
    """A range of pages of each document."""
    return S.page_filter(views.line_pages(spark, d), page_range=(2, 4)).groupBy("document_id").agg(F.count("*").alias("pages"), F.min("page_number").alias("first"))


def xml_words(spark, d):
    """Words of the layout markup of all lines of each document."""
    word = F.transform(F.filter(F.split("original_text", " "), lambda w: w != ""), lambda w, i: F.concat(F.lit('<word xMin="'), i.cast("string"), F.lit('" yMin="1.5" xMax="'), F.when(i % 3 == 0, F.lit("")).otherwise((i + 1).cast("string")), F.lit('" yMax="2">'), w, F.lit("</word>")))
    block = F.concat(F.lit("<line>"), F.array_join(word, "\n"), F.lit("</line>"))
    pages = views.line_pages(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", block.alias("b")))).alias("l"))
    markup = pages.select("document_id", F.concat(F.lit('<page width="612.0" height="792.5">'), F.array_join(F.transform("l", lambda x: x["b"]), ""), F.lit("</page>")).alias("output"))
    return layout.layout_words(markup).select("document_id", "page_number", "line", "word_no", "word", F.col("bbox.x0").alias("x0"), "width", "height")


_XML_SQL = """WITH l AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents), f AS (SELECT document_id, unnest(range(1, len(l) + 1)) AS line, l FROM l),
    w AS (SELECT document_id, line, list_filter(string_split(l[line], ' '), lambda x: x <> '') AS w FROM f),
    e AS (SELECT document_id, line, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM w)
    SELECT document_id, 1 AS page_number, CAST(line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY document_id ORDER BY line, i) AS INTEGER) AS word_no, word, CASE WHEN i % 3 <> 0 THEN CAST(i AS DOUBLE) END AS x0, CAST(612.0 AS DOUBLE) AS width, CAST(792.5 AS DOUBLE) AS height FROM e"""


def metadata_scan(spark, d):
    """Values of a metadata listing; a line without a colon is none, and a value may hold one."""
    listing = F.concat(F.lit("Title: page "), F.col("page_id").cast("string"), F.lit("\nno value here\nSource:  "), "url", F.lit("\nPages: "), F.length("html").cast("string"))
    found = layout.metadata(views.table(spark, d, "pages").select(F.col("page_id").alias("document_id"), listing.alias("output")))
    return found.select("document_id", F.element_at("info", "Title").alias("title"), F.element_at("info", "Source").alias("source"), T.parse_int(F.element_at("info", "Pages")).alias("pages"), F.size("info").alias("n"))


def page_sizes(spark, d):
    """Sizes of a listing; each third document tells none."""
    told = F.when(F.col("doc_id") % 3 == 0, F.lit("unknown")).otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".25  x "), F.pmod("doc_id", F.lit(1000)).cast("string"), F.lit(" pts")))
    return views.table(spark, d, "documents").select("doc_id", T.page_size(told).alias("s")).select("doc_id", "s.width", "s.height")


def safe_parse(spark, d):
    """Numbers and truth values of texts that are some at times."""
    words = F.array(F.lit(" 12 "), F.lit("x"), F.lit(""), F.lit("-3.5"), F.lit("Yes"), F.lit("TRUE "), F.lit("1"))
    word = F.get(words, F.pmod("doc_id", F.lit(7)).cast("int"))
    return views.table(spark, d, "documents").select("doc_id", T.parse_int(word, -1).alias("i"), T.parse_double(word, -1.0).alias("f"), T.parse_bool(word).alias("b"))


_PARSE_SQL = """WITH w AS (SELECT doc_id, [' 12 ', 'x', '', '-3.5', 'Yes', 'TRUE ', '1'][CAST(doc_id % 7 + 1 AS BIGINT)] AS w FROM documents)
    SELECT doc_id, CASE WHEN regexp_full_match(trim(w), '-?[0-9]+') THEN TRY_CAST(trim(w) AS INTEGER) ELSE -1 END AS i, coalesce(TRY_CAST(trim(w) AS DOUBLE), -1.0) AS f, lower(trim(w)) IN ('yes', 'true', '1') AS b FROM w"""


def html_unescape_numeric(spark, d):
    """References by number, decimal and hexadecimal, beside an escaped one that is decoded once."""
    coded = F.concat(F.replace(F.replace("text", F.lit("é"), F.lit("&#233;")), F.lit("ß"), F.lit("&#xDF;")), F.lit(" &amp;#65; &#1114112;"))
    return views.table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.html_unescape(coded).cast("binary")).alias("text_md5"))


def total_images(spark, d):
    return image_counts(spark, d).groupBy("document_id").agg(F.sum("image_count").alias("images"))


def html_unescape_named(spark, d):
    return views.table(spark, d, "pages").select("page_id", F.md5(T.named_entities(F.col("html")).cast("binary")).alias("html_md5"), F.length(T.html_unescape("html")).alias("full_length"))


_UNESCAPE = "replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_UNESCAPE_SQL = f"SELECT page_id, md5({_UNESCAPE}) AS html_md5, CAST(length({_UNESCAPE}) AS INTEGER) AS full_length FROM pages"


def image_counts(spark, d):
    """Images of each page from a listing, with pages that have none."""
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("page   num  type\n-----\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.pmod("doc_id", F.lit(5)).cast("int") + 1), lambda i: F.concat(F.pmod(i, F.lit(3)).cast("string"), F.lit("  0 image"))), "\n")).alias("output"), F.lit(3).alias("page_count"))
    return layout.image_counts(rows)


_IMAGES_SQL = """WITH d AS (SELECT doc_id AS document_id, unnest(range(1, CAST(doc_id % 5 + 2 AS BIGINT))) % 3 AS page FROM documents), c AS (SELECT document_id, page, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT doc_id AS document_id, unnest([1, 2, 3]) AS page_number FROM documents)
    SELECT p.document_id, CAST(p.page_number AS INTEGER) AS page_number, CAST(coalesce(n, 0) AS INTEGER) AS image_count FROM p LEFT JOIN c ON c.document_id = p.document_id AND c.page = p.page_number"""


def spans_written(spark, d):
    return P.build_spans(views.document_words(spark, d)).groupBy("document_id").agg(F.count("*").alias("spans"), F.max("stop").alias("text_end"))


def match_counts(spark, d):
    return S.search_pages(_index(spark, d, "conv"), "the", limit=None).groupBy("document_id").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("hits"))


_COUNTS_SQL = f"SELECT document_id, count(DISTINCT page) AS pages, count(*) AS hits FROM ({_hits_sql('conv', _has('the'), ['the'], fallback='the')}) GROUP BY document_id"


def text_hash(spark, d):
    return views.conversation_pages(spark, d).select("document_id", "page_number", F.sha2(normalized("original_text"), 256).alias("text_hash"))


def validate_counts(spark, d):
    """Rows of pages and spans, as a build is checked by."""
    pages = views.conversation_pages(spark, d).agg(F.count("*").alias("pages"), F.count_if(F.col("original_text") != "").alias("indexed_pages"))
    spans = spans_written(spark, d).agg(F.sum("spans").alias("spans"))
    return pages.select(F.lit("pages").alias("name"), F.col("pages").alias("n")).union(pages.select(F.lit("indexed_pages"), "indexed_pages")).union(spans.select(F.lit("spans"), "spans"))


def anti_join_fk(spark, d):
    """Labels without a document, and documents without a label."""
    docs, labels = views.table(spark, d, "documents").select("doc_id"), views.table(spark, d, "labels").select("doc_id")
    return labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("label").alias("kind")).union(docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("document")))


def upsert_last(spark, d):
    """The last turn of each role in a conversation replaces those before it."""
    return last_of_each(views.table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", F.length("text").alias("length"))


def queries() -> dict[str, Query]:
    return {
        "normalize_docs": normalize_docs,
        "normalize_hyphen": normalize_hyphen,
        "norm_map_conv": norm_map_conv,
        "norm_map_marks": norm_map_marks,
        "tokens_conv": tokens_conv,
        "token_freq": token_freq,
        "search_term": _search("conv", "der"),
        "search_and": _search("conv", "the of"),
        "search_phrase": _search("conv", '"of the"'),
        "search_phrase_term": _search("conv", '"of the" and'),
        "search_punctuated_phrase": _search("conv", '"und, der"'),
        "search_phrase_over_marks": _search("conv", '"und der"'),
        "search_diacritic": _search("line", "ete"),
        "search_fallback": _search("line", "entmen"),
        "search_literal": _search("whole", "+1 (", literal=True),
        "search_document": _search("conv", "the", where="document_id = 3"),
        "search_regex": _search("conv", "th[a-e]+n", regex=True),
        "search_regex_reference": _search("conv", r"(l)\1", regex=True),
        "search_regex_look": _search("conv", "th(?=e)", regex=True),
        "search_regex_named": _search("conv", "(?P<first>w)ith", regex=True),
        "search_explain": search_explain,
        "search_top_corpus": search_top_corpus,
        "search_case_sensitive": _search("conv", "The", case_sensitive=True),
        "search_page": _search("conv", "the", page=2),
        "search_page_range": _search("conv", "the", page_range=(2, 3)),
        "search_limit_two_stage": _search("line", "the", limit=3),
        "search_corpus_batch": search_corpus_batch,
        "snippet_ctx0": _search("conv", "von", context=0),
        "original_offsets": original_offsets,
        "spans_build": _spans(False),
        "spans_hyphen": _spans(True),
        "page_text_hash": page_text_hash,
        "boxes_overlap": boxes_overlap,
        "page_split_pad": page_split_pad,
        "pages_text_native": pages_text_native,
        "selected_pages": selected_pages,
        "metadata_scan": metadata_scan,
        "page_sizes": page_sizes,
        "safe_parse": safe_parse,
        "html_unescape_numeric": html_unescape_numeric,
        "total_images": total_images,
        "xml_words": xml_words,
        "html_unescape_named": html_unescape_named,
        "image_counts": image_counts,
        "spans_written": spans_written,
        "match_counts": match_counts,
        "text_hash": text_hash,
        "validate_counts": validate_counts,
        "anti_join_fk": anti_join_fk,
        "upsert_last": upsert_last,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "normalize_docs": f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents",
        "normalize_hyphen": f"SELECT doc_id, {_NORM.format(_rejoined(_HYPHENS))} AS text, CAST(length({_rejoined(_HYPHENS)}) AS INTEGER) AS joined_length FROM documents",
        "norm_map_conv": _map_sql("1"),
        "norm_map_marks": _map_sql("CASE WHEN c = 'é' THEN 2 ELSE 1 END"),
        "tokens_conv": _TOKENS_SQL,
        "token_freq": f"WITH t AS ({_TOKENS_SQL}) SELECT token, count(*) AS n, count(DISTINCT document_id) AS documents FROM t GROUP BY token",
        "search_term": _hits_sql("conv", _has("der"), ["der"], fallback="der"),
        "search_and": _hits_sql("conv", _has("the", "of"), ["the", "of"], fallback="the of"),
        "search_phrase": _hits_sql("conv", _has("of the"), ["of the"], fallback='"of the"'),
        "search_phrase_term": _hits_sql("conv", _has("of the", "and"), ["of the"], fallback='"of the" and'),
        "search_punctuated_phrase": _hits_sql("conv", _has("und der"), ["und, der"], fallback='"und, der"'),
        "search_phrase_over_marks": _hits_sql("conv", _has("und der"), ["und der"], fallback='"und der"'),
        "search_document": _hits_sql("conv", _has("the"), ["the"], fallback="the", where="document_id = 3"),
        "search_diacritic": _hits_sql("line", _has("ete"), ["ete"], fallback="ete"),
        "search_fallback": _hits_sql("line", _has("entmen"), ["entmen"], fallback="entmen"),
        "search_literal": _hits_sql("whole", "true", ["+1 ("]),
        "search_regex": _regex_sql("th[a-e]+n"),
        "search_regex_reference": _regex_sql("ll"),
        "search_regex_look": _regex_sql("the", "2"),
        "search_regex_named": _regex_sql("with"),
        "search_explain": "SELECT document_id, start, '\"of the\" AND \"and\"' AS condition, true AS casefold, 2 AS only_page FROM (" + _hits_sql("conv", _has("of the", "and"), ["of the"], fallback='"of the" and', where="page_number = 2") + ")",
        "search_top_corpus": "SELECT document_id, page, start, match_count FROM (" + _hits_sql("conv", _has("the"), ["the"], fallback="the") + ") ORDER BY document_id, page, start LIMIT 50",
        "selected_pages": "WITH p AS (SELECT doc_id AS document_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page_number FROM documents) SELECT document_id, count(*) AS pages, min(page_number) AS first FROM p WHERE page_number BETWEEN 2 AND 4 GROUP BY document_id",
        "metadata_scan": "SELECT page_id AS document_id, 'page ' || page_id AS title, trim(url) AS source, CAST(length(html) AS INTEGER) AS pages, 3 AS n FROM pages",
        "page_sizes": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 595.276 ELSE CAST(n_chars || '.25' AS DOUBLE) END AS width, CASE WHEN doc_id % 3 = 0 THEN 841.89 ELSE CAST(doc_id % 1000 AS DOUBLE) END AS height FROM documents",
        "safe_parse": _PARSE_SQL,
        "html_unescape_numeric": f"SELECT conv_id, turn, md5({_UNESCAPE.replace('html', 'text')} || ' A ' || '&#1114112;') AS text_md5 FROM conversations",
        "total_images": f"SELECT document_id, CAST(sum(image_count) AS BIGINT) AS images FROM ({_IMAGES_SQL}) GROUP BY document_id",
        "search_case_sensitive": _hits_sql("conv", _has("the"), ["The"], fallback="The", text="original_text"),
        "search_page": _hits_sql("conv", _has("the"), ["the"], fallback="the", where="page_number = 2"),
        "search_page_range": _hits_sql("conv", _has("the"), ["the"], fallback="the", where="page_number BETWEEN 2 AND 3"),
        "search_limit_two_stage": _hits_sql("line", _has("the"), ["the"], fallback="the", candidate_limit=3, limit=3),
        "search_corpus_batch": _BATCH_SQL,
        "snippet_ctx0": _hits_sql("conv", _has("von"), ["von"], fallback="von", context=0),
        "original_offsets": _OFFSETS_SQL,
        "spans_build": f"WITH {_spans_cte(False)} SELECT * FROM spans",
        "spans_hyphen": f"WITH {_spans_cte(True)} SELECT * FROM spans",
        "page_text_hash": _PAGE_TEXT_SQL,
        "boxes_overlap": _BOXES_SQL,
        "page_split_pad": _SPLIT_SQL,
        "pages_text_native": f"WITH p AS ({_SPLIT_SQL}) SELECT document_id, count(*) FILTER (text_native) AS text_native_pages, count(*) FILTER (NOT text_native) AS image_only_pages FROM p GROUP BY document_id",
        "xml_words": _XML_SQL,
        "html_unescape_named": _UNESCAPE_SQL,
        "image_counts": _IMAGES_SQL,
        "spans_written": f"WITH {_spans_cte(False)} SELECT document_id, count(*) AS spans, max(stop) AS text_end FROM spans GROUP BY document_id",
        "match_counts": _COUNTS_SQL,
        "text_hash": f"WITH {_pages_sql('conv')} SELECT document_id, page_number, sha256(text) AS text_hash FROM pages",
        "validate_counts": f"WITH {_spans_cte(False)} SELECT 'pages' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'indexed_pages', count(*) FILTER (text <> '') FROM conversations UNION ALL SELECT 'spans', count(*) FROM spans",
        "anti_join_fk": "SELECT doc_id, 'label' AS kind FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "upsert_last": "SELECT conv_id, role, turn, CAST(length(text) AS INTEGER) AS length FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1",
    }
