"""Text tables as pages: document_id, page_number and original_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A table of fewer bytes for each core may stand in fewer row groups than there are cores.
SMALL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one is dealt out to all cores, since a row group is read by one task."""
    path = f"{sf_dir}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return df.repartition(cores) if 1 << 18 < size < cores * SMALL_BYTES else df


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, which begin at zero, as pages, which begin at one."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("original_text"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "original_text")).select("document_id", (F.col("n") + 1).alias("page_number"), "original_text")


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("original_text"))


def document_words(spark: SparkSession, sf_dir: str, hyphens: bool = False) -> DataFrame:
    """Words of documents with their line and a box of their own; each seventh has none.

    With ``hyphens`` each fifth word ends in one, and stands on a line before the next.
    """
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "[ \n]+").alias("words"))
    words = lines.select("document_id", F.lit(1).alias("page_number"), F.posexplode("words").alias("p", "word")).where("word <> ''").withColumn("word_no", F.col("p") + 1)
    if hyphens:
        cut = F.col("word_no") % 5 == 0
        words = words.withColumn("word", F.when(cut, F.concat("word", F.lit("-"))).otherwise(F.col("word"))).withColumn("line", F.floor((F.col("word_no") - 1) / 5).cast("int"))
    else:
        words = words.withColumn("line", F.floor((F.col("word_no") - 1) / 10).cast("int"))
    x, y = F.col("word_no").cast("double"), F.col("line").cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))
    return words.select("document_id", "page_number", "word_no", "line", "word", F.when(F.col("word_no") % 7 != 0, box).alias("bbox"))
