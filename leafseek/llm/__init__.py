"""Operators for preparing large text and media corpora on Spark.

Nothing outside this subpackage imports it. Each operator keeps a general
interface; ``entries`` holds the registered queries that apply the operators to
whole tables.
"""
