"""Substring dedup: repeated passages found by an FM-index of each shard.

Equal windows of words hold the same least hash of their ``GRAM``-word pieces,
their anchor. Each document is cut into runs of windows with one anchor; a run
and the words that its windows reach form a segment, and segments meet in the
shard of their anchor. So a shard holds every occurrence of its windows, and only
anchors of several documents go on. Equal segments are one sequence of the
least doc_id. A shard indexes its segments, streams them through backward search,
and reports the stretches whose match reaches a whole window, with the least
doc_id that holds it.

A passage that very many documents share gives an anchor as many segments as it
has surroundings. Anchors of more than ``HOT`` segments are split further, by the
hash of each window, and the least doc_id of each window is aggregated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .fm_index import FMIndex

WINDOW, GRAM = 50, 12
#: Windows of a run at most; segments of an anchor that share a shard; words of a shard on average.
RUN, HOT, SHARD_WORDS = 64, 2000, 250_000
#: Words of documents that are hashed side by side, and cached words of a worker.
SIDE_BY_SIDE, CACHED = 1 << 18, 200_000
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED and len(word) <= 64:
            self[word] = found
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M1
    x = (x ^ x >> np.uint64(29)) * _M2
    return x ^ x >> np.uint64(32)


class _Rolling:
    """Hashes of stretches of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        one = np.ones(1, np.uint64)
        powers = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
        self.back = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def runs(words: np.ndarray, lens: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, hash) of the runs of some documents' words, one after another."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none, none
    rolling = _Rolling(words)
    at = np.arange(len(words) - GRAM + 1)
    anchor = _least(rolling.of(at, at + GRAM), window - GRAM + 1)
    ends = np.cumsum(lens)
    document = np.repeat(np.arange(len(lens)), lens)[: len(anchor)]
    inside = np.arange(len(anchor)) + window <= ends[document]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1]) | (inside[1:] != inside[:-1])])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(anchor)))
    start, count = start[inside[start]], count[inside[start]]
    parts = -(-count // RUN)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(start, parts) + step * RUN
    count = np.minimum(np.repeat(count, parts) - step * RUN, RUN)
    return document[start], start - (ends - lens)[document[start]], count, anchor[start].view(np.int64), rolling.of(start, start + count + window - 1).view(np.int64)


def _groups(rows, size, limit):
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash, so that repeated ids keep apart) and text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string"))


def _find_runs(keyed: DataFrame, window: int) -> DataFrame:
    def found(batches):
        hashes = _Hashes()
        for batch in batches:
            rows = ((d, k, (t.as_py() or "").encode().split()) for d, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
            for held in _groups((r for r in rows if r[0] is not None and len(r[2]) >= window), lambda r: len(r[2]), SIDE_BY_SIDE):
                lens = np.array([len(r[2]) for r in held])
                words = np.fromiter((h for r in held for h in map(hashes.__getitem__, r[2])), np.uint64, int(lens.sum()))
                document, start, count, anchor, own = runs(words, lens, window)
                ids, keys = (np.array([r[i] for r in held], np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[document]), pa.array(keys[document]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(own)], ["doc_id", "key", "start", "n", "anchor", "h"])

    return map_arrow(keyed, found, "doc_id long, key long, start int, n int, anchor long, h long", lean=True)


def _segments(keyed: DataFrame, owners: DataFrame, window: int) -> DataFrame:
    """The words of each segment, from its owner; of hot anchors' segments the hashes of their windows."""
    by_doc = owners.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n", "anchor", "h", "hot")).alias("own"))
    joined = keyed.join(by_doc, ["doc_id", "key"]).select("doc_id", "text", "own")

    def cut(batches):
        hashes = _Hashes()
        for batch in batches:
            out = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                for s in own.as_py():
                    part = words[s["start"] : s["start"] + s["n"] + window - 1]
                    if not s["hot"]:
                        out.append((s["anchor"], s["h"], doc, b" ".join(part), None, None, None))
                        continue
                    rolling = _Rolling(np.fromiter(map(hashes.__getitem__, part), np.uint64, len(part)))
                    at = np.arange(s["n"])
                    other = xxhash.xxh64_intdigest
                    for i, w in zip(at.tolist(), rolling.of(at, at + window).view(np.int64).tolist(), strict=True):
                        out.append((s["anchor"], s["h"], doc, None, i, w, other(b" ".join(part[i : i + window])) >> 1))
                if len(out) >= 4096:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "h", "doc_id", "words", "at", "w1", "w2"])

    return map_arrow(joined, cut, "anchor long, h long, doc_id long, words binary, at int, w1 long, w2 long", lean=True)


def index_shard(sequences: list[np.ndarray], owners: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """For each sequence the stretches (from, to, least owner) of its windows, from an index of all of them."""
    index = FMIndex(sequences, window)
    ids, number = np.unique(owners, return_inverse=True)
    least = [number[index.owner].astype(np.int32)]
    while 2 << (len(least) - 1) <= index.n:
        last, half = least[-1], 1 << (len(least) - 1)
        least.append(np.minimum(last[:-half], last[half:]))
    out = []
    for at in range(0, len(sequences), 4096):
        some = sequences[at : at + 4096]
        for words, (length, low, high) in zip(some, index.matching_statistics(some), strict=True):
            whole = np.flatnonzero(length[: max(len(words) - window + 1, 0)] >= window)
            low, high = low[whole], high[whole]
            level = np.frexp((high - low).astype(float))[1] - 1
            first = np.zeros(len(whole), np.int32)
            for k in np.unique(level):
                own = level == k
                first[own] = np.minimum(least[k][low[own]], least[k][high[own] - (1 << k)])
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(whole) != 1) | (np.diff(first) != 0)])) if len(whole) else []
            ends = [*cuts[1:], len(whole)] if len(whole) else []
            out.append([(int(whole[a]), int(whole[b - 1]) + 1, int(ids[first[a]])) for a, b in zip(cuts, ends, strict=True)])
    return out


def _shards(segments: DataFrame, window: int) -> DataFrame:
    """(anchor, h, a, b, least): the windows a to b - 1 of the segment occur first in document ``least``."""
    total = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, total // (6 * SHARD_WORDS))

    def searched(batches):
        def some(held):
            hashes = _Hashes()
            sequences = [np.fromiter(map(hashes.__getitem__, r[3].split(b" ")), np.uint64) for r in held]
            out = [(r[1], r[2], *x) for r, own in zip(held, index_shard(sequences, np.array([r[4] for r in held]), window), strict=True) for x in own]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "h", "a", "b", "least"])

        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield some(held)
                    held = []
                held.append(row)
        if held:
            yield some(held)

    rows = segments.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "anchor", "h", "words", "doc_id")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "anchor", "h")
    return map_arrow(dealt, searched, "anchor long, h long, a int, b int, least long", lean=True)


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key and spans (from, to: places of words) of the windows that start in a smaller doc_id too.

    Documents without such a window, and rows with a null doc_id, are not listed.
    ``key`` is the hash of the text.
    """
    keyed = _keyed(docs)
    found = materialize(_find_runs(keyed, window), "runs")
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = materialize(found.join(anchors, "anchor", "left_semi"), "shared")
    owners = shared.groupBy("anchor", "h").agg(F.min(F.struct("doc_id", "key", "start", "n")).alias("o"))
    owners = materialize(owners, "owners")
    hot = owners.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    flagged = owners.join(hot, "anchor", "left").select("anchor", "h", "o.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    segments = materialize(_segments(keyed, flagged, window), "segments")
    windows = segments.where("words is null").select("anchor", "h", "doc_id", "at", "w1", "w2")
    least = windows.groupBy("anchor", "w1", "w2").agg(F.min("doc_id").alias("least"))
    split = windows.join(least, ["anchor", "w1", "w2"]).select("anchor", "h", F.col("at").alias("a"), (F.col("at") + 1).alias("b"), "least")
    first = materialize(_shards(segments.where("words is not null"), window).union(split), "first")
    spans = shared.join(first, ["anchor", "h"]).where("least < doc_id").select("doc_id", "key", (F.col("start") + F.col("a")).alias("from"), (F.col("start") + F.col("b") + (window - 1)).alias("to"))
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _kept(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["from"] for s in spans], 1)
    np.add.at(edge, [s["to"] for s in spans], -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[i] for i in keep.tolist()]


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    marked = docs.withColumn("leafseek_key", F.xxhash64(F.col("text").cast("string"))).withColumn("leafseek_id", F.col("doc_id").cast("long"))
    found = repeated(docs.select("doc_id", "text"), window).select(F.col("doc_id").alias("leafseek_id"), F.col("key").alias("leafseek_key"), F.col("spans").alias("leafseek_spans"))
    return marked.join(found, ["leafseek_id", "leafseek_key"], "left").drop("leafseek_id", "leafseek_key")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words of each row.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Rows of one doc_id
    are not smaller than each other. Rows with a null doc_id lose nothing and
    are no source of removals.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def told(batches):
        for batch in batches:
            n, removed, sha = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                kept = _kept(words, spans.as_py())
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), window)
    return map_arrow(joined.select("doc_id", "text", "leafseek_spans"), told, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all their columns; a text with repeats keeps its other words, one blank apart."""

    def cleaned(batches):
        for batch in batches:
            texts = [t if spans is None else b" ".join(_kept(t.encode().split(), spans)).decode() for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    at = docs.columns.index("text")
    joined = _with_spans(docs.withColumn("text", F.col("text").cast("string")), window)
    return map_arrow(joined, cleaned, joined.drop("leafseek_spans").schema, lean=True)
