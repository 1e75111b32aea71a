"""Packing of documents into training sequences, shortest pack first.

The packing works on the histogram of piece lengths only. Lengths are placed
longest first, each into the open packs that are shortest; packs are held as
patterns with counts, so a placement updates a few counts however many documents
there are. The patterns are then joined back to the pieces by their rank among
the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .word_ids import encode_with_end

#: Pieces of one length that a salt of the ranking holds on average, and the most salts of a length.
RANK_GROUP, MOST_GROUPS = 1024, 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths, longest first, and how often each is used.

    As many packs are open from the start as all tokens need at least. Each
    length goes to the shortest open packs that have room, and to new packs
    only where none has.
    """
    lengths = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= width for n in lengths):
        raise ValueError("lengths must be from 1 to the width")
    done: list[tuple[tuple[int, ...], int]] = []
    if full := lengths.pop(width, 0):
        done.append(((width,), full))
    total = sum(n * c for n, c in lengths.items())
    packs: dict[tuple[int, ...], int] = {(): -(-total // width)} if total else {}
    heap = [(0, p) for p in packs]
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        while left:
            if heap and heap[0][0] + n <= width:
                used, pattern = heap[0]
                have = packs[pattern]
            else:
                used, pattern, have = 0, (), left
            take = min(have, left)
            if pattern in packs and heap and heap[0] == (used, pattern):
                if take == have:
                    heapq.heappop(heap)
                    del packs[pattern]
                else:
                    packs[pattern] = have - take
            grown = (*pattern, n)
            if grown in packs:
                packs[grown] += take
            elif used + n == width:
                done.append((grown, take))
            else:
                packs[grown] = take
                heapq.heappush(heap, (used + n, grown))
            left -= take
    merged: Counter = Counter()
    for pattern, count in [*done, *packs.items()]:
        if pattern:
            merged[pattern] += count
    return sorted(merged.items(), key=lambda x: (-sum(x[0]), x[0]))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, pieces of that length in a sequence, first offset)."""
    rows: dict[int, list] = {}
    rank: Counter = Counter()
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for n, times in sorted(Counter(pattern).items(), reverse=True):
            rows.setdefault(n, []).append((rank[n], sequence, times, offset))
            rank[n] += count * times
            offset += n * times
        sequence += count
    return {n: np.array(x, dtype=np.int64) for n, x in rows.items()}


def cuts(n: int, width: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole widths, whole units, and the rest.

    Rests under a unit fill what packs of whole units leave, which halves padding.
    """
    ends = [*range(width, n, width), n]
    rest = (n % width) % unit
    if rest and n % width > unit:
        ends.insert(-1, n - rest)
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def cut(docs: DataFrame, vocabulary: str, width: int = 2048, unit: int = 256) -> DataFrame:
    """Pieces of at most ``width`` ids of each document: doc_id, start, length, ids_crc32, doc_tokens.

    A null text counts as empty and gives the end id alone. Repeated rows are
    packed as often as they occur; a null doc_id stays null.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pieces(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode_with_end((x.as_py() for x in batch.column(1)), shipped.value), strict=True):
                ids = ids.astype("<u4")
                out += [(doc, a, m, zlib.crc32(ids[a : a + m]), len(ids)) for a, m in cuts(len(ids), width, unit)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), pieces, PIECES)


def pack(pieces: DataFrame, width: int = 2048) -> DataFrame:
    """Give each piece a sequence_id and an offset in it.

    ``pieces`` has the columns of ``cut``. The histogram has at most ``width``
    entries, and so have the patterns a bound that does not grow with the input.
    Ranks come from salted groups: a length that most pieces share is ranked in
    many tasks.
    """
    # the rows' numbers are written, so that copies of a row part and a lost task finds the same ones again
    pieces = materialize(pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("row")), "pieces")
    by_length = pieces.groupBy("length").count().collect()
    groups = [1] * (width + 1)
    for r in by_length:
        groups[r["length"]] = min(MOST_GROUPS, -(-r["count"] // RANK_GROUP))
    table = slots(shortest_pack_first({r["length"]: r["count"] for r in by_length}, width))
    shipped = pieces.sparkSession.sparkContext.broadcast(table)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.get(F.lit(groups), F.col("length").cast("int"))).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("group_start"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("place", F.row_number().over(within)).join(starts, ["length", "salt"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("group_start") + F.col("place") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            rank, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 2))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = shipped.value[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                step = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + step // row[:, 2]
                offset[at] = row[:, 3] + step % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(ranked, place, PIECES + ", sequence_id long, offset long")
