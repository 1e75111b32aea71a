"""Search over a stream of pages: an extension; each page is looked at alone.

There is no state: fallbacks and limits by document need all pages of a document
and belong to the batch search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators.query import parse_query
from ..operators.search import index_pages, page_occurrences, token_condition
from ..session import ship


def read_pages(spark: SparkSession, path: str, schema: str = "document_id string, page_number int, original_text string") -> DataFrame:
    """New JSON-lines files of pages under ``path``."""
    ship(spark)
    return spark.readStream.schema(schema).json(path)


def stream_hits(pages: DataFrame, query: str, context: int = 80, **modes) -> DataFrame:
    """Occurrences on the pages that hold the query's tokens; literal and regex queries look at all pages."""
    spec = parse_query(query, modes.get("literal", False), modes.get("case_sensitive", False), modes.get("regex", False))
    indexed = index_pages(pages, with_map=False, written=False)
    chosen = indexed if spec.literal or spec.regex else indexed.where(token_condition(spec))
    found = chosen.withColumn("_found", page_occurrences(spec)).withColumn("_m", F.explode("_found"))
    text = F.col("original_text" if spec.case_sensitive else "text")
    return found.select("document_id", F.col("page_number").alias("page"), F.size("_found").alias("match_count"), F.col("_m.start").alias("start"), F.col("_m.stop").alias("stop"), snippet(text, F.col("_m.start"), F.col("_m.stop"), context).alias("snippet"))
