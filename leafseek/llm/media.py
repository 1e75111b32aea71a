"""Media columns: FLAC streams of payloads, and PCM blocks read from FLAC streams."""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import remove
from . import flac
from .common import map_arrow, materialize

#: Bytes of payloads or streams that a task handles side by side.
GROUP_BYTES = 4 << 20
#: Frames of a PCM block that the query reads, and slices that it writes one after another.
BLOCK_FRAMES, SLICES = 64, 2
_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PCM = "doc_id long, block int, first_sample long, n_samples int, channels int, pcm binary, error string"


def payload(text: str | None) -> bytes:
    """The text's bytes with bytes 255 up to a positive multiple of a block; null counts as empty."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % flac.BLOCK or (0 if raw else flac.BLOCK))


def _groups(rows, size):
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= GROUP_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (a FLAC stream) of each row; a null doc_id stays null."""

    def encoded(batches):
        for batch in batches:
            rows = ((doc, text.as_py()) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for held in _groups(rows, lambda r: len(r[1] or "")):
                media = flac.encode_streams([payload(text) for _, text in held])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([len((r[1] or "").encode()) for r in held], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encoded, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, frames: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of little-endian PCM of each stream in ``media`` (doc_id, media), each of some frames, in order.

    ``first_sample`` is the block's offset, so that a range of samples is a
    filter. A damaged or null stream gives one row that holds the error only.
    Columns in ``keep`` go along with each block.
    """
    names = [c.split()[0] for c in PCM.split(", ")]

    def blocks(batches):
        for batch in batches:
            rows = ((i, x.as_py() or b"") for i, x in enumerate(batch.column(1)))
            for held in _groups(rows, lambda r: len(r[1])):
                out, source = [], []
                for (at, stream), found in zip(held, flac.decode_streams([r[1] for r in held]), strict=True):
                    doc = batch.column(0)[at].as_py()
                    if isinstance(found, flac.DamagedStream):
                        out.append((doc, None, None, None, None, None, str(found)))
                        source.append(at)
                        continue
                    size = (flac.read_info(stream).sample_bits + 7) // 8
                    first = 0
                    for i in range(0, len(found), frames):
                        x = found[i] if frames == 1 else np.concatenate(found[i : i + frames])
                        pcm = np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
                        out.append((doc, i // frames, first, len(x), x.shape[1], pcm, None))
                        source.append(at)
                        first += len(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                own = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *[batch.column(k).take(pa.array(source)) for k in keep]], [*names, *keep])

    picked = media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary"), *keep)
    return map_arrow(picked, blocks, PCM + "".join(f", {f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[2:]))


class _Features:
    """Sum, sum of squares, least, largest and sign changes of samples that come in blocks."""

    def __init__(self):
        self.sum = self.squares = self.changes = 0
        self.least, self.largest, self.last = 1 << 62, -(1 << 62), None

    def add(self, samples: np.ndarray) -> None:
        negative = samples < 0
        self.sum += int(samples.sum())
        self.squares += int((samples * samples).sum())
        self.least, self.largest = min(self.least, int(samples.min())), max(self.largest, int(samples.max()))
        self.changes += int(np.count_nonzero(negative[1:] != negative[:-1])) + int(self.last is not None and self.last != negative[0])
        self.last = negative[-1]

    def __str__(self) -> str:
        return f"sum={self.sum};squares={self.squares};min={self.least};max={self.largest};changes={self.changes}"


def features(samples: np.ndarray) -> str:
    """The features of one block of samples."""
    own = _Features()
    own.add(samples)
    return str(own)


def describe(stored: DataFrame) -> DataFrame:
    """Payload, media and features of each row of a written table (doc_id, n_bytes, media), from its PCM blocks.

    A damaged stream raises an error.
    """
    schema = _DIGEST
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    blocks = pcm_blocks(stored, BLOCK_FRAMES, ("n_bytes", "media_bytes", "media_sha256"))

    def described(batches):
        kinds = [pa.string() if "string" in c else pa.int64() for c in schema.split(", ")]
        out, now = [], None

        def closed():
            row, sha, size, tail, own = now
            return (row["doc_id"], row["n_bytes"], size, sha.hexdigest(), zlib.crc32(tail), row["media_bytes"], row["media_sha256"], str(own))

        for batch in batches:
            for row in batch.to_pylist():
                if row["error"]:
                    raise flac.DamagedStream(row["error"])
                if row["block"] == 0:  # the blocks of a stream stand together
                    if now:
                        out.append(closed())
                    now = [row, hashlib.sha256(), 0, b"", _Features()]
                samples = np.frombuffer(row["pcm"], np.int8).astype(np.int64)
                back = (samples + 128).astype(np.uint8).tobytes()
                now[1].update(back)
                now[2] += len(back)
                now[3] = (now[3] + back[-32:])[-32:]
                now[4].add(samples)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return map_arrow(blocks, described, schema)


def digest(docs: DataFrame, slices: int = SLICES) -> DataFrame:
    """Write each text as a FLAC column, read the column back in PCM blocks, and describe these.

    A stream of text is about as long as the text, so the column is written in
    slices by hash, one after another, and each is deleted when its rows are
    described: that bounds the disk. All rows are in one of the slices.
    """
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))
    done = []
    for i in range(slices):
        stored = materialize(encode_texts(docs.where(slot == i)), "media", "uncompressed")
        done.append(materialize(describe(stored), "described"))
        remove(stored)
    return reduce(DataFrame.union, done)
