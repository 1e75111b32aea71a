"""Spans and page text from words in reading order, as window functions.

A word depends on the one before it only: it joins a word that ends in a hyphen
on an earlier line, and else stands behind a blank. Running sums of lengths then
give all offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalized_word


def build_spans(words: DataFrame, include_boxes: bool = True) -> DataFrame:
    """Spans of words with document_id, page_number, word_no, line, word and bbox.

    Words that normalize to nothing are left out.
    """
    page = Window.partitionBy("document_id", "page_number").orderBy("word_no")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    kept = words.withColumn("norm", normalized_word("word")).where("norm <> ''")
    starts_with_letter = F.regexp_like("norm", F.lit(r"^\p{L}"))
    joined = F.coalesce(F.endswith(F.lag("norm").over(page), F.lit("-")) & (F.col("line") > F.lag("line").over(page)) & starts_with_letter, F.lit(False))
    linked = kept.withColumn("_joined", joined).withColumn("_no", F.row_number().over(page))
    popped = F.coalesce(F.lead("_joined").over(page), F.lit(False)).cast("int")
    sized = linked.withColumn("_popped", popped).withColumn("_ls", F.length("norm") - F.col("_popped")).withColumn("_lo", F.length("word") - F.col("_popped"))
    sized = sized.withColumn("_sep", ((F.col("_no") > 1) & ~F.col("_joined")).cast("int"))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = sized.withColumn("_blanks", total("_sep") + F.col("_sep")).withColumn("_s", 1 + total("_ls") + F.col("_blanks")).withColumn("_o", 1 + total("_lo") + F.col("_blanks"))
    box = F.col("bbox") if include_boxes else F.lit(None).cast(words.schema["bbox"].dataType)
    return placed.select(
        "document_id",
        "page_number",
        F.col("_no").alias("span_id"),
        F.col("_s").cast("int").alias("start"),
        (F.col("_s") + F.col("_ls")).cast("int").alias("stop"),
        F.col("_o").cast("int").alias("original_start"),
        (F.col("_o") + F.col("_lo")).cast("int").alias("original_stop"),
        F.expr("substring(norm, 1, _ls)").alias("text"),
        F.col("word").alias("original_text"),
        box.alias("bbox"),
    )


def page_texts(spans: DataFrame) -> DataFrame:
    """text and original_text of each page, from its spans: a blank stands before a span that does not join."""
    row = F.struct("span_id", "start", "stop", "original_start", "original_stop", "text", "original_text")
    pages = spans.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(row)).alias("s"))

    def joined(text: str, start: str, stop: str):
        piece = lambda x, i: F.concat(F.when((i > 0) & (x[start] > F.get("s", i - 1)[stop]), F.lit(" ")).otherwise(F.lit("")), F.substring(x[text], F.lit(1), x[stop] - x[start]))
        return F.array_join(F.transform("s", piece), "")

    return pages.select("document_id", "page_number", joined("text", "start", "stop").alias("text"), joined("original_text", "original_start", "original_stop").alias("original_text"))
