"""Shipping this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once per Spark context.

    Executors fetch the archive from the driver when they first need it, so it
    stays until the driver ends.
    """
    context = spark.sparkContext
    if getattr(context, "_leafseek_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="leafseek-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(os.path.realpath(folder), "leafseek.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("leafseek", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._leafseek_shipped = True
