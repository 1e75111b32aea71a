"""Token ids of a corpus in Huffman-coded files, in document order.

The file format is Parquet: ``codes`` holds the code length of each id, and
``blocks`` one row per independent block: the documents in it with their numbers
of ids, the number of ids of all documents before it, the coded bits, their
checkpoints and their checksum. Canonical codes follow from the lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import huffman
from .common import map_arrow, materialize
from .word_ids import WordEncoder, encode_with_end, encoder

#: A block closes with the document that takes it to so many ids.
BLOCK_IDS = 65_536
#: Documents that a stretch of the order holds on average, and the most stretches.
STRETCH_DOCS, MOST_STRETCHES = 5_000, 65_536
#: Blocks decoded side by side, by their ids.
DECODE_IDS = 1 << 20

_STAGED = "stretch int, block int, before long, doc_ids array<long>, lens array<int>, ids binary"
_CODED = "stretch int, block int, start long, doc_ids array<long>, lens array<int>, payload binary, checkpoints binary, n_ids long, payload_crc32 long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _bounds(docs: DataFrame) -> list[int]:
    """Ascending doc_ids that part the order into stretches of about equal numbers of rows."""
    n = docs.count()
    parts = min(MOST_STRETCHES, -(-n // STRETCH_DOCS))
    if parts < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def _staged(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Blocks of whole documents with plain ids, of 16 bits where the vocabulary's fit; null doc_ids come first."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bounds, width = _bounds(docs), encoder(vocabulary).kind.itemsize
    shipped = spark.sparkContext.broadcast((vocabulary, bounds))

    def tokens(batches):
        vocabulary, bounds = shipped.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            coded = [x.tobytes() for x in encode_with_end((x.as_py() for x in batch.column(1)), vocabulary)]
            stretch = [0 if i is None else bisect_right(bounds, i) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(stretch, pa.int32()), pa.array(ids, pa.int64()), pa.array(coded, pa.binary())], ["stretch", "doc_id", "ids"])

    def blocks(batches):
        now, before, block, docs, lens, held, size = None, 0, 0, [], [], [], 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([b"".join(held)], pa.binary())], ["stretch", "block", "before", "doc_ids", "lens", "ids"])

        for batch in batches:
            for stretch, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if docs and (stretch != now or size >= BLOCK_IDS):
                    yield closed()
                    before, block, docs, lens, held, size = before + size, block + 1, [], [], [], 0
                if stretch != now:
                    now, before, block = stretch, 0, 0
                raw = ids.as_buffer()
                docs.append(doc)
                lens.append(raw.size // width)
                held.append(raw)
                size += raw.size // width
        if docs:
            yield closed()

    rows = map_arrow(docs, tokens, "stretch int, doc_id long, ids binary")
    # stretches share tasks: the order is kept by the stretch number, not by the task
    dealt = rows.repartition("stretch").sortWithinPartitions("stretch", F.col("doc_id").asc_nulls_first(), "ids")
    return materialize(map_arrow(dealt, blocks, _STAGED), "ids")


def _histogram(staged: DataFrame, own: WordEncoder) -> np.ndarray:
    """How often each id occurs; the driver gets a row for each id of the vocabulary at most."""
    size, kind = len(own), own.kind

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in map_arrow(staged.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Write the files; returns ``codes`` and ``blocks`` as they are read back.

    Documents stand in ascending doc_id order, null doc_ids first, rows of one
    doc_id by their ids. A null text counts as empty: it has the end id alone.
    No documents give two empty tables.
    """
    spark = docs.sparkSession
    staged = _staged(docs, vocabulary)
    own = encoder(vocabulary)
    kind, lengths = own.kind, huffman.code_lengths(_histogram(staged, own))
    sizes = staged.groupBy("stretch").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["stretch"]):
        base[r["stretch"]] = total
        total += r["n"]
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    codes = materialize(spark.createDataFrame(used, "id int, bits int").coalesce(1), "codes")
    shipped = spark.sparkContext.broadcast((lengths, huffman.canonical_codes(lengths), base))

    def coded(batches):
        lengths, codes, base = shipped.value
        for batch in batches:
            stretch, before = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for x in batch.column(5):
                ids = np.frombuffer(x.as_buffer(), kind)
                payload, checkpoints = huffman.encode(ids, lengths, codes)
                rows.append((payload, checkpoints.astype("<u4").tobytes(), len(ids), zlib.crc32(payload)))
            payload, checkpoints, n, crc = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([base[s] + b for s, b in zip(stretch, before, strict=True)], pa.int64()), batch.column(3), batch.column(4), pa.array(payload, pa.binary()), pa.array(checkpoints, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["stretch", "block", "start", "doc_ids", "lens", "payload", "checkpoints", "n_ids", "payload_crc32"],
            )

    return codes, materialize(map_arrow(staged, coded, _CODED), "blocks", "uncompressed")


def read_tokens(codes: DataFrame, blocks: DataFrame, rows=None, schema: str = "doc_id long, start long, ids array<int>") -> DataFrame:
    """The documents of the files with their ids, or what ``rows`` makes of them.

    ``rows`` gets (doc_ids, starts, arrays of ids) of some blocks and returns the
    columns of ``schema``. A block whose checksum is wrong raises an error.
    """
    used = codes.collect()  # one row for each id of the vocabulary at most
    lengths = np.zeros(max((r["id"] for r in used), default=0) + 1, np.uint8)
    for r in used:
        lengths[r["id"]] = r["bits"]
    shipped = codes.sparkSession.sparkContext.broadcast(lengths)
    if rows is None:
        rows = lambda docs, starts, ids: [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]

    def decoded(batches):
        table = huffman.decoding_table(shipped.value)

        def some(held):
            docs, starts, parts = [], [], []
            ids = huffman.decode([(x["payload"], np.frombuffer(x["checkpoints"], "<u4"), x["n_ids"]) for x in held], table)
            for x, own in zip(held, ids, strict=True):
                ends = np.cumsum(x["lens"])
                docs += x["doc_ids"]
                starts += (x["start"] + ends - np.array(x["lens"])).tolist()
                parts += np.split(own, ends[:-1])
            columns = rows(docs, starts, parts)
            return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))]) if columns else None

        held, size = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if zlib.crc32(x["payload"]) != x["payload_crc32"]:
                    raise ValueError(f"block {x['stretch']}/{x['block']} is damaged")
                held.append(x)
                size += x["n_ids"]
                if size >= DECODE_IDS:
                    yield some(held)
                    held, size = [], 0
        if held:
            yield some(held)

    names = [x.split()[0] for x in schema.split(", ")]
    internal = ", ".join(f"c{i} {x.split(' ', 1)[1]}" for i, x in enumerate(schema.split(", ")))
    return map_arrow(blocks, decoded, internal).toDF(*names)


def digest(codes: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the 32-bit ids of each document in the files."""

    def rows(docs, starts, ids):
        return [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64())]

    return read_tokens(codes, blocks, rows, _ROWS)
