"""Tables that a session writes in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made once; that is for one machine
    (a local master), and any other master raises an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_DIR:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="leafseek-", dir="/tmp/checkpoints"))
    return _OWN_DIR[0]


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a point that survives lost executors. The files are
    removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafseek-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.option("compression", compression).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.leafseek_path = path
    return written


def remove(written: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned."""
    spark = written.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.leafseek_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """``build()`` written for the first caller with ``key`` in this Spark application, and read by all."""
    held = spark.sparkContext.__dict__.setdefault("_leafseek_written", {})
    if key not in held:
        held[key] = materialize(build(), "table")
    return held[key]
