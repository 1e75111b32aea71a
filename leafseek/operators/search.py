"""Search over indexed pages.

Cheap conditions on tokens choose candidate pages; exact occurrences are then
found on the candidates only. One plan serves many documents: what the condition
finds nothing in falls back to a substring by document, and limits are by
document too. The window that does both sees rows that passed a condition, not
the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import DESCRIPTION, indexed, normalize_text, searchable, source_ranges
from ..functions.text import occurrences, regex_occurrences, snippet
from .query import QuerySpec, match_expression, parse_query

#: Characters of a page's text that hits and spans meet by.
STRETCH = 256
_NOTHING = "array<struct<start:int,stop:int>>"


def index_pages(pages: DataFrame, with_map: bool = True, written: bool = True) -> DataFrame:
    """Add text, tok_text and, with a map, norm_map to pages with document_id, page_number and original_text.

    The result is meant to be written: a filter on a function's result would
    evaluate the function twice. With ``written=False`` it may be filtered as it
    is: the function is evaluated once, but no filter passes it on its way to the
    source. Without maps a search computes those of the pages with hits.
    """
    function = indexed if with_map else searchable
    function = function if written else function.asNondeterministic()
    return pages.withColumn("_index", function("original_text")).select(*[c for c in pages.columns if c not in ("text", "norm_map", "tok_text")], "_index.*")


def page_filter(pages: DataFrame, page: int | None = None, page_range: tuple[int, int] | None = None) -> DataFrame:
    """One page, or a range of pages; a page takes precedence."""
    if page is not None:
        return pages.where(F.col("page_number") == int(page))
    if page_range is not None:
        return pages.where(F.col("page_number").between(int(page_range[0]), int(page_range[1])))
    return pages


def token_condition(spec: QuerySpec) -> Column:
    """All phrases and terms stand as neighbouring tokens on the page."""
    phrases = spec.token_phrases
    if not phrases or not all(phrases):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.contains(F.col("tok_text"), F.lit(p)) for p in phrases])


def candidates(pages: DataFrame, spec: QuerySpec, limit: int | None) -> DataFrame:
    """Pages to look at: those that the condition finds, or in documents without any, those that hold the whole query."""
    if not (spec.literal or spec.regex):
        fallback = normalize_text(spec.raw, casefold=not spec.case_sensitive)
        held = pages.withColumn("_token", token_condition(spec)).where(F.col("_token") | F.contains(F.col("text"), F.lit(fallback)))
        by_document = Window.partitionBy("document_id")
        pages = held.withColumn("_any", F.max(F.col("_token").cast("int")).over(by_document)).where(F.col("_token") | (F.col("_any") == 0)).drop("_token", "_any")
    if limit is None:
        return pages
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    return pages.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def page_occurrences(spec: QuerySpec) -> Column:
    """All (start, stop) on a page, in order of start, then stop; equal ones of different terms stay."""
    text = F.col("original_text" if spec.case_sensitive else "text")
    if spec.regex:
        return regex_occurrences(text, spec.raw)
    found = [occurrences(text, n) for n in spec.needles]
    return F.array_sort(F.concat(*found)) if found else F.array().cast(_NOTHING)


def original_range(start: Column, stop: Column) -> Column:
    """The source characters of a match, from the page's map; null beyond it."""
    inside = (stop > 1) & (start <= F.size("norm_map")) & (stop - 1 <= F.size("norm_map"))
    return F.when(inside, F.struct(F.get("norm_map", start - 1)["first"].alias("start"), (F.get("norm_map", stop - 2)["last"] + 1).alias("stop")))


def _stretches(start: Column, stop: Column) -> Column:
    """The stretches of ``STRETCH`` characters that a range touches."""
    return F.sequence(F.floor(start / STRETCH), F.floor(F.greatest(start, stop - 1) / STRETCH))


def result_boxes(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``boxes``: those of the spans that overlap each hit, in order of span_id; none gives an empty array.

    Hits and spans meet by page and stretch of its text, so a span is compared
    with the hits near it only; a pair that shares several stretches counts in
    the first of them.
    """
    boxed = spans.where("bbox.x0 is not null and bbox.y0 is not null and bbox.x1 is not null and bbox.y1 is not null")
    boxed = boxed.select("document_id", F.col("page_number").alias("page"), "span_id", F.col("start").alias("_from"), F.col("stop").alias("_to"), "bbox")
    boxed = boxed.withColumn("_stretch", F.explode(_stretches(F.col("_from"), F.col("_to"))))
    matches = hits.select("document_id", "page", "start", "stop").distinct().withColumn("_stretch", F.explode(_stretches(F.col("start"), F.col("stop"))))
    overlap = (F.col("_from") < F.col("stop")) & (F.col("_to") > F.col("start"))
    joined = matches.join(boxed, ["document_id", "page", "_stretch"]).where(overlap & (F.col("_stretch") == F.floor(F.greatest("start", "_from") / STRETCH)))
    lists = joined.groupBy("document_id", "page", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("span_id", "bbox"))).alias("_boxes"))
    out = hits.join(lists, ["document_id", "page", "start", "stop"], "left")
    return out.withColumn("boxes", F.coalesce(F.transform("_boxes", lambda b: b["bbox"]), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))).drop("_boxes")


def search_pages(
    pages: DataFrame,
    query: str | QuerySpec,
    spans: DataFrame | None = None,
    *,
    page: int | None = None,
    page_range: tuple[int, int] | None = None,
    limit: int | None = 20,
    candidate_limit: int | None = -1,
    context: int = 80,
    literal: bool = False,
    case_sensitive: bool = False,
    regex: bool = False,
    boxes: bool = False,
    explain: bool = False,
    scope: str = "document",
) -> DataFrame:
    """One row for each occurrence, with the number of them on its page.

    ``limit`` holds twice, for candidate pages before matching and for
    occurrences after sorting, each by document; ``candidate_limit`` sets the
    first apart, and None lifts a limit. ``scope="corpus"`` takes the first
    occurrences of all documents together.
    """
    spec = query if isinstance(query, QuerySpec) else parse_query(query, literal, case_sensitive, regex)
    limit = None if limit is None else max(1, int(limit))
    first = limit if candidate_limit == -1 else candidate_limit
    text = F.col("original_text" if spec.case_sensitive else "text")
    found = candidates(page_filter(pages, page, page_range), spec, first).withColumn("_found", page_occurrences(spec)).where(F.size("_found") > 0)
    found = found.withColumn("match_count", F.size("_found"))
    if spec.case_sensitive:
        hits = found.withColumn("_m", F.explode("_found")).withColumn("_source", F.struct(F.col("_m.start").alias("start"), F.col("_m.stop").alias("stop")))
    elif "norm_map" in pages.columns:
        hits = found.withColumn("_m", F.explode("_found")).withColumn("_source", original_range(F.col("_m.start"), F.col("_m.stop")))
    else:
        both = found.withColumn("_sources", source_ranges("original_text", "_found"))
        hits = both.withColumn("_z", F.explode(F.arrays_zip(F.col("_found").alias("m"), F.col("_sources").alias("s")))).withColumn("_m", F.col("_z.m")).withColumn("_source", F.col("_z.s"))
    start, stop = F.col("_m.start"), F.col("_m.stop")
    hits = hits.select(
        "document_id",
        F.col("page_number").alias("page"),
        "match_count",
        start.alias("start"),
        stop.alias("stop"),
        F.substring(text, start, stop - start).alias("match_text"),
        snippet(text, start, stop, max(0, int(context))).alias("snippet"),
        F.col("_source.start").alias("original_start"),
        F.col("_source.stop").alias("original_stop"),
        F.substring(F.col("original_text"), F.col("_source.start"), F.col("_source.stop") - F.col("_source.start")).alias("original_text"),
    )
    order = ["page", "start", "stop"]
    if limit is not None:
        if scope == "corpus":
            hits = hits.orderBy("document_id", *order).limit(limit)
        else:
            hits = hits.withColumn("_rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).where(F.col("_rank") <= limit).drop("_rank")
    if boxes and spans is not None:
        hits = result_boxes(hits, spans)
    if explain:
        filters = F.struct(F.lit(page).cast("int").alias("page"), F.lit(None if page_range is None else f"{page_range[0]}:{page_range[1]}").cast("string").alias("page_range"), F.lit(limit).cast("int").alias("limit"))
        rules = F.struct(*[F.lit(v).alias(k) for k, v in DESCRIPTION.items()])
        hits = hits.withColumn("explain", F.struct(F.lit(match_expression(spec)).alias("condition"), rules.alias("normalization"), filters.alias("filters")))
    return hits


def search_batch(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """First place of each phrase (query_id, text, tok_text) on each page: query_id, document_id, page_number, start.

    Both sides have normalized texts and token strings. A phrase meets the pages
    of its token that stands on the fewest pages, by a join of keys; the texts
    are fetched for the pages that are left, and verified.
    """
    tokens = lambda c: F.explode(F.array_distinct(F.split(F.trim(c), " "))).alias("token")
    key = ["document_id", "page_number"]
    asked = phrases.where("tok_text <> ''").select("query_id", F.col("text").alias("phrase"), F.col("tok_text").alias("tokens"))
    wanted = asked.select("query_id", tokens("tokens"))
    held = pages.select(*key, tokens("tok_text")).join(wanted.select("token").distinct(), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    # a token on no page is the rarest, and leaves its phrase without pages
    rarest = wanted.join(counts, "token", "left").groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    met = held.join(rarest, "token").select("query_id", *key).join(asked, "query_id")
    both = met.join(pages.select(*key, "text", "tok_text"), key).where(F.contains("tok_text", "tokens") & F.contains("text", "phrase"))
    return both.select("query_id", *key, F.expr("instr(text, phrase)").alias("start"))
