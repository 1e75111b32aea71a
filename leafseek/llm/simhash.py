"""SimHash near-duplicates: a generalised pigeonhole over correlated groups of bits.

Two fingerprints within ``distance`` bits of each other, cut into m groups of
bits with thresholds that add up to ``distance - m + 1``, are within the
threshold of at least one group; a threshold of -1 leaves a group out. Bits that
go together stand in one group, so the other groups tell fingerprints apart. A
dynamic program allots the thresholds by the candidates that it expects from
each group, and chooses between numbers of groups likewise. Fingerprints are
probed by the values of their groups within the thresholds, and candidates are
verified.

A bucket of more than ``HOT`` fingerprints is not paired. Fingerprints within two
bits of each other share a value that is within one bit of both, so each member
is listed under its 65 such values, and members of a value are linked to the
least: rows in proportion to the members, and groups of 65 at most.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .components import components

BITS, SEED = 64, 42
#: Fingerprints of a bucket that are paired.
HOT = 64
#: Cost of a verified candidate against that of a probe.
VERIFY_COST = 0.2


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles in their order; fewer words than a shingle are one, no words none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64, n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; none of no hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half the hashes of the word shingles, repeats included; no words give zero."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; fewer words than a
    shingle are one shingle; a null text counts as empty.
    """

    def hashed(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), hashed, "doc_id long, fp long")


def _together(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bits i and j: 64 x 64 numbers from each task."""

    def count(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy()
            for at in range(0, len(x), 1 << 14):
                b = np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += b.T @ b
                n += len(b)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["i", "j", "n"])

    together, n = np.zeros((BITS, BITS)), 0
    for r in map_arrow(fps.select("fp"), count, "i int, j int, n long", lean=True).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            together[r["i"], r["j"]] = r["n"]
    return n, together


def correlated_groups(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about equal size; each takes the bits that go most with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = -(-len(left) // (m - g))
        first = max(left, key=lambda b: (phi[b, list(left)].max(), -b))
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(left, key=lambda b: (phi[b, group].mean(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allot(expected: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 that add up to ``total`` at the least cost; ``expected[i][t + 1]`` is group i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in expected:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(costs):
                at = used + t - 1
                if at not in then or cost + c < then[at][0]:
                    then[at] = (cost + c, [*chosen, t - 1])
        best = then
    return best[total]


def _mask(group: list[int]) -> int:
    mask = sum(1 << b for b in group)
    return mask - (1 << BITS) if mask >> 63 else mask


def plan(fps: DataFrame, distance: int) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, bits) of each group that is probed, from statistics of all fingerprints."""
    n, together = _together(fps)
    options = {m: correlated_groups(n, together, m) for m in range(1, distance + 2)}
    masks = [(m, i, _mask(g)) for m, groups in options.items() for i, g in enumerate(groups)]
    listed = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(k)).alias("value")) for m, i, k in masks]))
    counts = fps.select(listed.alias("x")).select("x.*").groupBy("m", "i", "value").count()
    # a row for each group: pairs that agree in it
    pairs = {(r["m"], r["i"]): float(r["c"]) for r in counts.groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("c")).collect()}
    p = np.diag(together) / max(n, 1)
    best = None
    for m, groups in options.items():
        expected = []
        for i, group in enumerate(groups):
            differ = np.zeros(distance + 1)  # chance of so many differing bits, taken as independent
            differ[0] = 1
            for b in group:
                d = 2 * p[b] * (1 - p[b])
                differ[1:] = differ[1:] * (1 - d) + differ[:-1] * d
                differ[0] *= 1 - d
            agree, costs, probes = pairs.get((m, i), 0.0), [0.0], 0
            for t in range(distance + 1):
                probes += comb(len(group), t)
                costs.append(n * probes + VERIFY_COST * (agree + float(n) * n * differ[1 : t + 1].sum()))
            expected.append(costs)
        cost, thresholds = allot(expected, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(_mask(g), t, g) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> 63 else value


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id) within ``distance`` bits.

    Fingerprints of cold buckets are paired; those of hot buckets are linked in
    stars, which connect the same fingerprints. ``distance`` is 2 at most where
    stars are to be exact.
    """
    if not 0 <= distance <= 2:
        raise ValueError("a distance from 0 to 2")
    groups = plan(fps, distance)
    index = fps.select("fp", "id", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _, _ in groups])).alias("g", "value"))
    sizes = index.groupBy("g", "value").count()
    flips = [[_signed(sum(1 << b for b in bits)) for t in range(threshold + 1) for bits in combinations(group, t)] for _, threshold, group in groups]
    if any(len(f) > 1 for f in flips):
        variants = F.when(F.col("g") == 0, F.lit(flips[0]))
        for g, f in enumerate(flips[1:], 1):
            variants = variants.when(F.col("g") == g, F.lit(f))
        probes = index.select("fp", "id", "g", F.explode(variants).alias("flip"), "value").select("fp", "id", "g", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        held = index.join(sizes, ["g", "value"])
    else:
        probes = index.join(sizes.where("count > 1"), ["g", "value"])
        held = probes
        probes = probes.where(F.col("count") <= HOT).drop("count")
    cold = held.where(F.col("count") <= HOT).select("g", "value", F.col("fp").alias("other"), F.col("id").alias("other_id"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    paired = probes.join(cold, ["g", "value"]).where((F.col("fp") < F.col("other")) & near if all(len(f) == 1 for f in flips) else (F.col("fp") != F.col("other")) & near).select(F.col("id").alias("a"), F.col("other_id").alias("b"))
    hot = held.where(F.col("count") > HOT).select("fp", "id").distinct()
    if any(len(f) > 1 for f in flips):
        # a probe may reach a hot bucket from outside it
        reached = probes.join(sizes.where(F.col("count") > HOT), ["g", "value"]).select("fp", "id")
        hot = hot.union(reached).distinct()
    around = F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(BITS)]) if distance == 2 else F.array(F.lit(0).cast("long"))
    if distance == 1:
        around = F.array(F.lit(0), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    stars = hot.select("fp", "id", F.explode(around).alias("flip")).select("id", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("own"))
    if distance == 1:  # a value stands for a fingerprint that is there
        stars = stars.join(hot.select(F.col("fp").alias("value")), "value", "left_semi")
    least = stars.groupBy("value").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    starred = stars.join(least, "value").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return paired.union(starred)


def groups(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """fp and component (the smallest id reachable by links, itself included) of each distinct fingerprint (fp, id)."""
    found = components(links(distinct, distance))
    return distinct.join(found, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links, itself included) of each row.

    Copies of a fingerprint are one node, so a group of copies adds no links.
    Repeated rows give repeated results. Rows with a null doc_id keep their
    fingerprint and have a null component_id; empty texts share fingerprint zero.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "distinct")
    return marked.join(groups(distinct, distance), "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
