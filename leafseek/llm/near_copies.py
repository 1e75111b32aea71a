"""Near copies of texts by their word shingles: SimHash finds candidates, the shingles decide.

Texts with equal sets of shingles are one node. Fingerprints of the shingles go
through the SimHash operator, and nodes of a group of fingerprints that links of
``DISTANCE`` bits connect are a bucket. Similar texts may differ in more bits, so
MinHash bands add buckets for the rest: nodes that share a band of ``ROWS``
minima are one; a pair of similarity s shares one of ``BANDS`` bands with a
chance of 1 - (1 - s ** ROWS) ** BANDS, 0.9996 at 0.8. No bucket is paired at
once: each member is compared with the bucket's least node, and only buckets
whose members are then in several components are compared in full, in tiles of a
bounded size. So the components are those of all similar pairs of all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import map_arrow, materialize
from .components import components
from .embed_dedup import _runs, _spanning

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of one link differ at most.
DISTANCE = 2
BANDS, ROWS, SEED = 20, 5, 42
#: Nodes of a tile's side, and shingles that a tile multiplies at once.
TILE, COLUMNS = 512, 4096


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than a shingle are one, no words none."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def _bands(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """A hash of each band's minima; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at : at + (1 << 12)] * factors[:, None]).min(1), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), j) - (1 << 63) for j, b in enumerate(least.reshape(BANDS, ROWS))]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash h, and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text"))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _marked(keyed: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h, node (of the set of shingles), fp and bands of each row; the sets themselves would be longer than the texts."""

    def read(batches):
        factors = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            nodes, fps, bands = [], [], []
            for x in batch.column(2):
                hashes = simhash.shingle_hashes(x.as_py(), shingle)
                fps.append(simhash.majority(hashes))
                own = np.unique(hashes)
                nodes.append(_node(own))
                bands.append(_bands(own, factors))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h", "node", "fp", "bands"])

    return map_arrow(keyed, read, "doc_id long, h long, node long, fp long, bands array<long>", lean=True)


def _sets(keyed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and set of the rows in ``wanted`` (doc_id, h, node), made from their texts again."""

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in batch.column(1)], pa.binary())], ["node", "set"])

    rows = keyed.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return map_arrow(rows.select("node", "text"), read, "node long, set binary", lean=True)


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def verified(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                hit.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    paired = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return map_arrow(paired.select("a", "b", "x", "y"), verified, "a long, b long", lean=True)


def _tile_pairs(entries: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar pairs inside the buckets of entries (value, node, n)."""

    def compared(batches):
        for _, table in _runs(batches, ["value", "i", "j"]):
            node = table.column("node").to_numpy()
            rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]
            size = np.array([len(r) for r in rows])
            # shingles of one row add to no intersection
            _, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
            column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
            row = np.repeat(np.arange(len(rows)), size)
            order = np.argsort(column, kind="stable")
            column, row = column[order], row[order]
            both = np.zeros((len(rows), len(rows)), np.float32)
            for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                a, b = np.searchsorted(column, [start, start + COLUMNS])
                x = np.zeros((len(rows), COLUMNS), np.float32)
                x[row[a:b], column[a:b] - start] = 1
                both += x @ x.T
            hit = both >= similarity * (size[:, None] + size[None] - both.astype(np.float64))
            np.fill_diagonal(hit, False)
            found = _spanning(hit)
            yield pa.RecordBatch.from_arrays([pa.array(node[[p for p, _ in found]], pa.int64()), pa.array(node[[q for _, q in found]], pa.int64())], ["a", "b"])

    blocks = F.ceil(F.col("n") / TILE)
    placed = entries.select("value", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    tiles = placed.select("value", "node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    tiles = tiles.select("value", "node", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).join(sets, "node")
    dealt = tiles.select("value", "i", "j", "node", "set").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "node")
    return map_arrow(dealt, compared, "a long, b long", lean=True)


def _entries(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """value (of a bucket) and node: by the groups of the fingerprints of ``own`` (node, fp), and by the bands of ``nodes``."""
    fps = materialize(own.select("fp", F.col("fp").alias("id")).distinct(), "fingerprints")
    grouped = own.select("node", "fp").distinct().join(simhash.groups(fps, DISTANCE), "fp")
    near = materialize(grouped.select("node", F.xxhash64(F.lit("fp"), "component").alias("value")).distinct(), "groups")
    return near.union(nodes.select("node", F.explode("bands").alias("value")))


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows with doc_id, h and node; and by node its smallest doc_id, its component and the smallest doc_id of that."""
    keyed = _keyed(docs)
    marked = materialize(_marked(keyed, shingle), "shingles")
    own = marked.where("doc_id is not null")
    nodes = own.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("node", F.col("r.doc_id").alias("id"), F.col("r.h").alias("h"), "bands"), "nodes")
    entries = _entries(own, nodes)
    buckets = entries.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    entries = materialize(entries.join(buckets, "value"), "buckets")
    wanted = nodes.select(F.col("id").alias("doc_id"), "h", "node").join(entries.select("node").distinct(), "node", "left_semi")
    sets = materialize(_sets(keyed, wanted, shingle), "sets")
    pairs = entries.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    links = materialize(_similar_pairs(pairs, sets, similarity), "pairs")
    found = components(links)
    held = entries.where("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = held.groupBy("value").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("value")
    more = materialize(_tile_pairs(held.join(split, "value", "left_semi"), sets, similarity), "pairs")
    found = materialize(components(links.union(more)), "components")
    grouped = nodes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    return marked, grouped.join(least, "component").select("node", "id", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the texts reachable by similar pairs) of each row.

    Words are those of the SimHash operator; similarity is that of sets of
    shingles. Texts without words are equal. Rows with a null doc_id take part in
    no pair and have a null component_id.
    """
    marked, by_node = _grouped(docs.select("doc_id", "text"), shingle, similarity)
    return marked.select("doc_id", "node").join(by_node.select("node", "component_id"), "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of similar texts a row of the smallest doc_id, with all columns of ``docs``.

    Of rows that share that doc_id the text of the least hash stays, and of its
    copies one. Rows with a null doc_id stay.
    """
    marked, by_node = _grouped(docs.select("doc_id", "text"), shingle, similarity)
    own = marked.where("doc_id is not null").select("doc_id", "node", "h").join(by_node.select("node", "component", "component_id"), "node")
    chosen = own.where("doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("r")).select(F.col("r.doc_id").alias("leafseek_id"), F.col("r.h").alias("leafseek_h"))
    rows = docs.withColumn("leafseek_id", F.col("doc_id").cast("long")).withColumn("leafseek_h", F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(chosen, ["leafseek_id", "leafseek_h"], "left_semi").dropDuplicates(["leafseek_id", "leafseek_h"])
    return kept.select(docs.columns).union(rows.where("leafseek_id is null").select(docs.columns))
