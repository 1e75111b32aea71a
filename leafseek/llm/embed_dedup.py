"""Near-duplicate vectors by sorted passes over random projections.

Each pass orders the distinct vectors of a label by the bits of their random
projections, one after another, and compares each vector with the next
``WINDOW`` of that order. The number of passes follows from the size and the mean
cosine of each label, so that a pair at the threshold is met with a chance of
``RECALL`` at least. Verified pairs of all passes are united. Where many
vectors lie close together a window sees only some of a vector's neighbours, so
the vectors of each component are then compared with each other in tiles of a
bounded size; the passes have to connect a group, not to see each of its pairs.

Copies of a vector are one node with a count. Vectors are compared only when
their labels are equal and not null and their lengths are equal. Null or zero
vectors and vectors with null or non-finite components link with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize
from .components import components

PASSES, WINDOW, PASS_BITS, SEED = 10, 1024, 64, 7
#: Chance that a pair at the threshold is met, if other vectors of its label lie as its mean cosine says.
RECALL = 0.99
#: Vectors of a block in a pass, of its parts that are multiplied at once, and of a tile's side on average.
BLOCK, TILE, SIDE = 2048, 512, 1024


def _usable(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, label, dim and the vector's bytes (null where it links with nothing)."""

    def read(batches):
        for batch in batches:
            lists = batch.column(2)
            lens = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)  # nulls are NaN
            ends = np.cumsum(lens)
            out: list[bytes | None] = [None] * len(lens)
            for n in np.unique(lens[lens > 0]):
                at = np.flatnonzero(lens == n)
                x = flat[(ends[at] - n)[:, None] + np.arange(n)]
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                for i in np.flatnonzero(good):
                    out[at[i]] = x[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lens.astype(np.int32)), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "vec"])

    picked = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding"))
    return map_arrow(picked, read, "vec_id long, label string, dim int, vec binary")


def _unit(column, kind: str) -> np.ndarray:
    """Unit vectors in double precision of vectors of one length; scaled first, so that squares stay finite."""
    x = np.stack([np.frombuffer(v.as_buffer(), kind) for v in column]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches, keys: list[str]):
    """Tables of the rows between changes of the keys, of rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        own = list(zip(*columns, strict=True))
        start = 0
        for i in range(len(own)):
            if own[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield last, pa.Table.from_batches(held).combine_chunks()
                held, start, last = [], i, own[i]
        held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def passes_for(n: float, cosine: float, threshold: float, window: int, least: int) -> int:
    """Passes that meet a pair at the threshold with a chance of ``RECALL``, among n vectors of a mean cosine.

    A bit of the order keeps a share of the label beside a vector, and the pair together with a higher chance.
    """
    if n <= window + 1:
        return least
    together, other = (1 - np.arccos(np.clip(x, -1, 1 - 1e-6)) / np.pi for x in (threshold, min(cosine, threshold)))
    met = (window / n) ** (np.log(together) / np.log(other))
    return max(least, int(np.ceil(np.log(1 - RECALL) / np.log1p(-met))))


def _passes_of(nodes: DataFrame, kind: str, threshold: float, window: int, least: int) -> int:
    """The most passes that a label needs; one row for each label and length of over a window reaches the driver."""

    def summed(batches):
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            for key in set(keys):
                own = batch.take(pa.array([i for i, k in enumerate(keys) if k == key]))
                total = _unit(own.column("vec"), kind).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(total)), pa.array([key[1]] * len(total), pa.int32()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["label", "dim", "i", "total"])

    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size")).where(F.col("size") > window + 1)
    large = nodes.select("label", "dim", "vec").join(sizes, ["label", "dim"], "left_semi")
    totals = map_arrow(large, summed, "label string, dim int, i int, total double").groupBy("label", "dim", "i").agg(F.sum("total").alias("total"))
    cosines = totals.groupBy("label", "dim").agg(F.sum(F.col("total") * F.col("total")).alias("square")).join(sizes, ["label", "dim"])
    # without each vector's cosine to itself
    found = cosines.select("size", ((F.col("square") - F.col("size")) / (F.col("size") * (F.col("size") - 1.0))).alias("cosine")).collect()
    return max((passes_for(r["size"], r["cosine"], threshold, window, least) for r in found), default=least)


def _passes(nodes: DataFrame, kind: str, passes: int) -> DataFrame:
    """Each node once for each pass, with its code and its rank in the order of all passes."""

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                own = batch.take(pa.array(at))
                if n not in planes:
                    planes.clear()
                    planes[n] = np.random.default_rng([SEED, int(n)]).standard_normal((int(n), passes * PASS_BITS))
                unit = _unit(own.column("vec"), kind)
                for k in range(passes):
                    code = np.packbits(unit @ planes[n][:, k * PASS_BITS : (k + 1) * PASS_BITS] > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), own.column("label"), own.column("dim"), pa.array([c.tobytes() for c in code], pa.binary()), own.column("node"), own.column("vec")], ["pass", "label", "dim", "code", "node", "vec"])

    def numbered(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns], ["part", "at", *batch.schema.names])
            at += n

    order = ["pass", "label", "dim", "code", "node"]
    fields = "pass int, label string, dim int, code binary, node long, vec binary"
    rows = map_arrow(nodes, coded, fields)
    # one row for each partition reaches the driver
    ordered = materialize(map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), numbered, "part int, at long, " + fields), "passes")
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, starts = 0, [0] * (max(sizes, default=0) + 1)
    for part in sorted(sizes):
        starts[part] = first
        first += sizes[part]
    return ordered.withColumn("rank", F.get(F.lit(starts).cast("array<long>"), F.col("part")) + F.col("at"))


def _spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix connects."""
    left, out = np.ones(len(hit), bool), []
    for first in range(len(hit)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue:
            p = queue.pop()
            new = np.flatnonzero(hit[p] & left)
            left[new] = False
            out += [(p, int(q)) for q in new]
            queue += new.tolist()
    return out


def _window_pairs(ranked: DataFrame, kind: str, threshold: float, window: int) -> DataFrame:
    """Verified pairs (a, b), a < b, that connect all such neighbours in the order; blocks overlap by a window."""

    def compared(batches):
        for (block,), table in _runs(batches, ["block"]):
            rank = table.column("rank").to_numpy()
            group = list(zip(*(table.column(k).to_pylist() for k in ("pass", "label", "dim")), strict=True))
            change = np.flatnonzero(np.array([True] + [a != b for a, b in zip(group, group[1:], strict=False)] + [True]))
            for a, b in zip(change, change[1:], strict=False):
                x, node = _unit(table.column("vec").combine_chunks().slice(a, b - a), kind), table.column("node").to_numpy()[a:b]
                own = rank[a:b] < (block + 1) * BLOCK
                hit = np.zeros((b - a, b - a), bool)
                for c in range(0, int(own.sum()), TILE):
                    p, q = np.arange(c, min(c + TILE, int(own.sum()))), np.arange(c, min(c + TILE + window, b - a))
                    sims = x[p] @ x[q].T
                    # near the threshold the sum of products decides, as in the tiles
                    for i, j in zip(*np.nonzero(np.abs(sims - threshold) < 1e-9), strict=True):
                        sims[i, j] = np.einsum("i,i->", x[p[i]], x[q[j]])
                    apart = q[None] - p[:, None]
                    hit[p[0] : p[-1] + 1, q[0] : q[-1] + 1] = (sims >= threshold) & (apart > 0) & (apart <= window)
                found = np.array(_spanning(hit | hit.T), np.int64).reshape(-1, 2)
                if len(found):
                    u, v = node[found[:, 0]], node[found[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    home = F.floor(F.col("rank") / BLOCK)
    blocks = F.when(F.col("rank") % BLOCK < window, F.array(home, home - 1)).otherwise(F.array(home))
    dealt = ranked.select(F.explode(blocks).alias("block"), "rank", "pass", "label", "dim", "node", "vec").repartition("block").sortWithinPartitions("block", "rank")
    return map_arrow(dealt, compared, "a long, b long").distinct()


def _tile_counts(nodes: DataFrame, found: DataFrame, kind: str, threshold: float) -> DataFrame:
    """node and n_links of the nodes of all components, from all pairs inside each."""

    def compared(batches):
        for (_, i, j), table in _runs(batches, ["component", "i", "j"]):
            side, node, n = (table.column(k).to_numpy() for k in ("block", "node", "n"))
            x = _unit(table.column("vec").combine_chunks(), kind)
            p, q = np.flatnonzero(side == i), np.flatnonzero(side == j)
            # a product of matrices rounds otherwise than a sum of products: near the threshold the sum decides
            sims = x[p] @ x[q].T
            for a, b in zip(*np.nonzero(np.abs(sims - threshold) < 1e-9), strict=True):
                sims[a, b] = np.einsum("i,i->", x[p[a]], x[q[b]])
            hit = sims >= threshold
            if i == j:
                np.fill_diagonal(hit, False)
            counts = np.zeros(len(node), np.int64)
            counts[p] += hit @ n[q]
            if i != j:
                counts[q] += n[p] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(counts)], ["node", "n"])

    # blocks come from hashes, so no task sees a whole component
    blocks = found.groupBy("component").agg(F.ceil(F.count("*") / SIDE).alias("blocks"))
    members = nodes.join(found, "node").join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tiles = members.select("component", "block", "node", "n", "vec", F.explode(others).alias("o"))
    tiles = tiles.select("component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "n", "vec")
    dealt = tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return map_arrow(dealt, compared, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label).

    Repeated rows count as vectors of their own. A row with a null vec_id takes
    part in no link and has a null component_id and kept.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    vectors = vectors if kind == "<f4" else vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = _usable(vectors, kind).withColumn("key", F.when(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.sha2(F.concat(F.concat_ws(":", "dim", F.octet_length("label"), "label").cast("binary"), F.col("vec")), 256)))
    rows = materialize(rows, "vectors")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    nodes = materialize(nodes, "nodes")
    passes = _passes_of(nodes, kind, threshold, window, passes)
    pairs = materialize(_window_pairs(_passes(nodes.select("label", "dim", "node", "vec"), kind, passes), kind, threshold, window), "pairs")
    found = materialize(components(pairs), "components")
    counts = _tile_counts(nodes.select("node", "n", "vec"), found, kind, threshold)
    by_key = nodes.select("key", "node", "n").join(found, "node", "left").join(counts, "node", "left")
    by_key = by_key.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("vec_id", "key").join(by_key, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
