"""Tables from the text that layout tools print: pages, words, image listings, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bbox_from_attributes, html_unescape, parse_double, xml_attribute

# The page size where none is told.
WIDTH, HEIGHT = 595.276, 841.89


def split_pages(outputs: DataFrame) -> DataFrame:
    """document_id, page_number and original_text of form-feed text; exactly ``page_count`` pages each.

    Pages beyond the count go, missing ones are empty, blanks before a line feed go.
    """
    chunks = F.split("output", "\f", -1)
    pages = outputs.where("page_count > 0").select("document_id", chunks.alias("_c"), F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    return pages.select("document_id", "page_number", F.regexp_replace(F.coalesce(F.get("_c", F.col("page_number") - 1), F.lit("")), "[ \t]+\n", "\n").alias("original_text"))


def layout_words(outputs: DataFrame) -> DataFrame:
    """Words of layout markup (document_id, output) with line, bbox and page size; empty words go.

    ``word_no`` counts the words of a page.
    """
    page = r"(?s)(<page\b[^>]*>.*?</page>)"
    pages = outputs.select("document_id", F.posexplode(F.regexp_extract_all("output", F.lit(page), 1)).alias("p", "block"))
    tag = F.regexp_extract("block", r"(<page\b[^>]*>)", 1)
    size = lambda name, fallback: parse_double(xml_attribute(tag, name, str(fallback)), fallback)
    pages = pages.select("document_id", (F.col("p") + 1).alias("page_number"), size("width", WIDTH).alias("width"), size("height", HEIGHT).alias("height"), "block")
    lines = pages.select("*", F.posexplode(F.regexp_extract_all("block", F.lit(r"(?s)<line\b[^>]*>(.*?)</line>"), 1)).alias("l", "content")).drop("block")
    words = lines.select("document_id", "page_number", "width", "height", (F.col("l") + 1).alias("line"), F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)(<word\b[^>]*>.*?</word>)"), 1)).alias("w", "element"))
    text = html_unescape(F.regexp_extract("element", r"(?s)<word\b[^>]*>(.*?)</word>", 1))
    words = words.select("document_id", "page_number", "width", "height", "line", "w", text.alias("word"), bbox_from_attributes(F.regexp_extract("element", r"<word\b([^>]*)>", 1)).alias("bbox")).where("word <> ''")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("line", "w"))
    return words.withColumn("word_no", place).drop("w")


def image_counts(outputs: DataFrame) -> DataFrame:
    """document_id, page_number and image_count of image listings (document_id, output, page_count).

    Rows count from behind a line that begins with ``page``; pages outside the document do not.
    """
    lines = F.transform(F.split("output", "\n"), lambda x: F.trim(x))
    header = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("page"))), True)
    rows = F.when(header > 0, F.slice(lines, header.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    listed = outputs.select("document_id", F.explode(rows).alias("row")).select("document_id", F.regexp_extract("row", r"^(\d+)(\s|$)", 1).try_cast("int").alias("page_number"))
    counts = listed.where("page_number is not null").groupBy("document_id", "page_number").agg(F.count("*").cast("int").alias("n"))
    pages = outputs.where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    return pages.join(counts, ["document_id", "page_number"], "left").select("document_id", "page_number", F.coalesce("n", F.lit(0)).alias("image_count"))


def metadata(outputs: DataFrame) -> DataFrame:
    """document_id and info, a map of the ``key: value`` lines of each output."""
    pairs = F.transform(F.filter(F.split("output", "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    return outputs.select("document_id", F.map_from_entries(pairs).alias("info"))


def health(pages: DataFrame, native: str) -> DataFrame:
    """Pages with text and pages without, for each document."""
    return pages.groupBy("document_id").agg(F.count_if(F.col(native)).alias("text_native_pages"), F.count_if(~F.col(native)).alias("image_only_pages"))
