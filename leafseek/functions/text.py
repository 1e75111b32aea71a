"""Column functions over text: occurrences, snippets, markup, safe parsing."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_POSITIONS = "array<struct<start:int,stop:int>>"
#: Lengths that are summed side by side.
_CHUNK = 256


def java_literal(needle: str) -> str:
    """A Java pattern that matches ``needle`` itself."""
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else f"\\x{{{ord(c):X}}}" for c in needle)


def _positions(lengths: Column) -> Column:
    """Running sums of an array of lengths, from 1 on.

    Sums go by chunks: an array that grows by one place at a time would be copied
    as often as it has places.
    """
    chunks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda c: F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK))))

    def sums(values: Column, first: Column, kind: str, add) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast(kind).alias("all"))
        return F.aggregate(values, zero, add)

    def chunk(at: Column, values: Column) -> Column:
        return sums(values, at, "array<int>", lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))

    def joined(s: Column, values: Column) -> Column:
        own = lambda part: F.struct(part["at"].alias("at"), F.concat(s["all"], F.array(part["all"])).alias("all"))
        return F.get(F.transform(F.array(chunk(s["at"], values)), own), 0)

    return F.flatten(sums(F.coalesce(chunks, F.array().cast("array<array<int>>")), F.lit(1), "array<array<int>>", joined)["all"])


def occurrences(text: Column, needle: str) -> Column:
    """(start, stop) of all, also overlapping, places of ``needle``; none for an empty needle.

    The text is split where the needle begins; the pieces' running lengths are
    the places. The first piece begins at one only if the text does.
    """
    if not needle:
        return F.array().cast(_NO_POSITIONS)
    pieces = F.split(text, f"(?={java_literal(needle)})", -1)
    starts = _positions(F.transform(pieces, lambda p: F.length(p)))
    starts = F.when(F.startswith(text, F.lit(needle)), starts).otherwise(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))))
    found = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + len(needle)).alias("stop")))
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(F.array().cast(_NO_POSITIONS))


#: Patterns that Java and Python's ``regex`` read alike: plain characters, ASCII sets, groups, alternatives, counts.
_PLAIN_PATTERN = re.compile(r"(?:[A-Za-z0-9 ]|\[[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\]|\((?!\?)|\)|\||(?<=[A-Za-z0-9\])])(?:[*+?]|\{\d+(?:,\d*)?\}))+")


def regex_occurrences(text: Column, pattern: str) -> Column:
    """(start, stop) of the matches of a pattern, one behind the other, as ``regex.finditer`` gives them.

    Patterns that Java reads in the same way and that match no empty text stay
    in the JVM; all others, with references, looks or named groups, are searched
    for by ``regex`` itself.
    """
    if _PLAIN_PATTERN.fullmatch(pattern) and regex.search(pattern, "") is None:
        matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.length(m))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        begin = _positions(F.transform(steps, lambda x: x["g"] + x["m"]))
        return F.zip_with(begin, steps, lambda b, x: F.struct((b + x["g"]).alias("start"), (b + x["g"] + x["m"]).alias("stop")))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
    def scan(column: pa.Array) -> pa.Array:
        own = regex.compile(pattern)
        rows = [None if t is None else [{"start": m.start() + 1, "stop": m.end() + 1} for m in own.finditer(t)] for t in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))

    # a filter on the result would evaluate a deterministic function twice
    return scan.asNondeterministic()(text)


def snippet(text: Column, start: Column, stop: Column, context: int) -> Column:
    """The match with ``context`` characters on both sides, and ``...`` where text is cut."""
    context = max(context, 0)
    first = F.greatest(F.lit(1), start - context)
    last = F.least(F.length(text), stop - 1 + context)
    cut = F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), F.substring(text, first, last - first + 1), F.when(last < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(cut)


# The named entities.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'"}
_NAMED = re.compile("|".join(ENTITIES))


def html_unescape_text(value: str) -> str:
    """Named entities in one pass, then hexadecimal, then decimal references; bad ones stay."""
    value = _NAMED.sub(lambda m: ENTITIES[m[0]], value)

    def char(m, base):
        code = int(m[1], base)
        return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else m[0]

    value = re.sub(r"&#x([0-9A-Fa-f]+);", lambda m: char(m, 16), value)
    return re.sub(r"&#([0-9]+);", lambda m: char(m, 10), value)


def named_entities(column: Column) -> Column:
    """The named entities alone, in the JVM: the ampersand comes last, so that none is decoded twice."""
    for entity in sorted(ENTITIES, key=lambda e: e == "&amp;"):
        column = F.replace(column, F.lit(entity), F.lit(ENTITIES[entity]))
    return column


@F.arrow_udf(T.StringType())
def html_unescape(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html_unescape_text(v) for v in column.to_pylist()], pa.string())


def xml_attribute(tag: Column, name: str, fallback: str | None = None) -> Column:
    pattern = rf'\b{name}="([^"]*)"'
    return F.when(F.regexp_like(tag, F.lit(pattern)), F.regexp_extract(tag, pattern, 1)).otherwise(F.lit(fallback).cast("string"))


def bbox_from_attributes(tag: Column) -> Column:
    """x0, y0, x1, y1; null unless all four are there and not empty."""
    values = [xml_attribute(tag, n, "") for n in ("xMin", "yMin", "xMax", "yMax")]
    box = F.struct(*[parse_double(v, 0.0).alias(k) for v, k in zip(values, ("x0", "y0", "x1", "y1"), strict=True)])
    present = values[0] != ""
    for v in values[1:]:
        present = present & (v != "")
    return F.when(present, box)


def parse_int(column: Column, fallback: int = 0) -> Column:
    return F.coalesce(F.trim(column).try_cast("int"), F.lit(fallback))


def parse_double(column: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.trim(column).try_cast("double"), F.lit(fallback))


def parse_bool(column: Column) -> Column:
    return F.coalesce(F.lower(F.trim(column)).isin("yes", "true", "1"), F.lit(False))


def page_size(column: Column) -> Column:
    """Width and height of ``a x b``, or A4."""
    pattern = r"([0-9.]+)\s+x\s+([0-9.]+)"
    side = lambda i, fallback: F.coalesce(F.regexp_extract(column, pattern, i).try_cast("double"), F.lit(fallback))
    return F.struct(side(1, 595.276).alias("width"), side(2, 841.89).alias("height"))
