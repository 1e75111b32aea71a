"""Leafseek: evidence-backed search over paged documents, on Spark DataFrames."""

__version__ = "0.1.0"
