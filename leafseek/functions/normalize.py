"""Search text with a map back to the source.

Text is taken cluster by cluster through compatibility composition and case
folding, hyphens at line ends between letters are joined, white space collapses
to single blanks, and the ends are trimmed. Every character of the result knows
the range of source characters that it stands for.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIPTION = {"unicode": "NFKC", "casefold": True, "collapse_whitespace": True, "join_hyphenated_linebreaks": True}
#: White space of the rules: ASCII controls, next line, and all space separators.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]+")
_BREAK = re.compile(r"-[ \t]*\n[ \t]*")
_CLUSTER = regex.compile(r"\X")
_MARKS = re.compile("[\u0300-\u036f]+")
TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def fold_cluster(cluster: str, casefold: bool = True) -> str:
    out = unicodedata.normalize("NFKC", cluster)
    return unicodedata.normalize("NFKC", out.casefold()) if casefold else out


def _joined(chars: str) -> list[tuple[int, int]]:
    """Ranges of a hyphen and line break between letters, which are left out."""
    found = []
    for m in _BREAK.finditer(chars):
        if m.start() and m.end() < len(chars) and chars[m.start() - 1].isalpha() and chars[m.end()].isalpha():
            found.append((m.start(), m.end()))
    return found


def normalize_with_map(value: str, casefold: bool = True, join_hyphenated_linebreaks: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The text and, for each of its characters, the first and last source character (1-based)."""
    if value.isascii() and "\r" not in value:  # each character is a cluster of its own
        whole = value.lower() if casefold else value
        ranges = [(i, i) for i in range(1, len(value) + 1)]
    else:
        chars: list[str] = []
        ranges, at = [], 1
        for cluster in _CLUSTER.findall(value):
            source = (at, at + len(cluster) - 1)
            for c in fold_cluster(cluster, casefold):
                chars.append(c)
                ranges.append(source)
            at += len(cluster)
        whole = "".join(chars)
    if join_hyphenated_linebreaks:
        for start, stop in reversed(_joined(whole)):
            del ranges[start:stop]
            whole = whole[:start] + whole[stop:]
    out, mapped, last = [], [], 0
    for m in _SPACE.finditer(whole):
        out += [whole[last : m.start()], " "]
        mapped += ranges[last : m.start()]
        own = ranges[m.start() : m.end()]
        mapped.append((min(a for a, _ in own), max(b for _, b in own)))
        last = m.end()
    out.append(whole[last:])
    mapped += ranges[last:]
    text = "".join(out)
    begin, end = len(text) - len(text.lstrip(" ")), len(text.rstrip(" "))
    return (text[begin:end], mapped[begin:end]) if begin < end else ("", [])


def normalize_text(value: str, casefold: bool = True, join_hyphenated_linebreaks: bool = True) -> str:
    """The text alone, without the map."""
    if value.isascii() and "\r" not in value:
        whole = value.lower() if casefold else value
    else:
        whole = "".join(fold_cluster(c, casefold) for c in _CLUSTER.findall(value))
    if join_hyphenated_linebreaks and "-" in whole:
        for start, stop in reversed(_joined(whole)):
            whole = whole[:start] + whole[stop:]
    return _SPACE.sub(" ", whole).strip(" ")


def normalize_word(value: str) -> str:
    return normalize_text(value, join_hyphenated_linebreaks=False)


def fold_marks(text: str) -> str:
    """``text`` without combining Latin marks, as tokens are compared."""
    return text if text.isascii() else unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text)))


def tokens(text: str) -> list[str]:
    return TOKEN.findall(fold_marks(text))


def token_text(text: str) -> str:
    """Tokens with one blank before, between and behind; a phrase is a substring of it."""
    return f" {' '.join(found)} " if (found := tokens(text)) else ""


def _each(column: pa.Array, function, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in column.to_pylist()], kind)


@F.arrow_udf(T.StringType())
def normalized(column: pa.Array) -> pa.Array:
    """Column form of ``normalize_text``; null stays null."""
    return _each(column, normalize_text, pa.string())


@F.arrow_udf(T.StringType())
def normalized_word(column: pa.Array) -> pa.Array:
    return _each(column, normalize_word, pa.string())


@F.arrow_udf(T.StringType())
def token_string(column: pa.Array) -> pa.Array:
    """Column form of ``token_text`` over normalized text."""
    return _each(column, token_text, pa.string())


# types as objects: executors import this module, and have no parser for type strings
_RANGE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
_INDEXED = T.StructType([T.StructField("text", T.StringType()), T.StructField("norm_map", T.ArrayType(_RANGE)), T.StructField("tok_text", T.StringType())])


@F.arrow_udf(_INDEXED)
def indexed(column: pa.Array) -> pa.Array:
    """Text, map and tokens in one pass over the source, for the index build."""
    out = []
    for value in column.to_pylist():
        if value is None:
            out.append(None)
            continue
        text, mapped = normalize_with_map(value)
        out.append({"text": text, "norm_map": [{"first": a, "last": b} for a, b in mapped], "tok_text": token_text(text)})
    pair = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    return pa.array(out, pa.struct([("text", pa.string()), ("norm_map", pa.list_(pair)), ("tok_text", pa.string())]))


_SEARCHABLE = T.StructType([T.StructField("text", T.StringType()), T.StructField("tok_text", T.StringType())])


@F.arrow_udf(_SEARCHABLE)
def searchable(column: pa.Array) -> pa.Array:
    """Text and tokens without the map, which only pages with hits need."""
    texts = [None if v is None else normalize_text(v) for v in column.to_pylist()]
    return pa.array([None if t is None else {"text": t, "tok_text": token_text(t)} for t in texts], pa.struct([("text", pa.string()), ("tok_text", pa.string())]))


def ranges_in_source(value: str, found: list[dict]) -> list[dict | None]:
    """The source characters of each match in the normalized text; None for one that reaches beyond it."""
    mapped = normalize_with_map(value)[1]
    return [{"start": mapped[m["start"] - 1][0], "stop": mapped[m["stop"] - 2][1] + 1} if 1 < m["stop"] <= len(mapped) + 1 and m["start"] <= len(mapped) else None for m in found]


_MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@F.arrow_udf(_MATCHES)
def source_ranges(original: pa.Array, found: pa.Array) -> pa.Array:
    """Column form of ``ranges_in_source``."""
    rows = [None if v is None or f is None else ranges_in_source(v, f) for v, f in zip(original.to_pylist(), found.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def joined_linebreaks(column: Column) -> Column:
    """The hyphen rule alone, in the JVM."""
    return F.regexp_replace(column, r"(?<=\p{L})-[ \t]*\n[ \t]*(?=\p{L})", "")
