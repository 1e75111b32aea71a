"""Byte-level BPE: encoding by ranked merges in Spark expressions, and decoding.

Spark higher-order functions fold the ranked merges over the bytes of distinct
words. Words that most tasks meet are folded once for the
whole corpus and sent to all tasks; a bound on their bytes is the only bound, and
all other words are folded where they occur, so results do not depend on it.

Documents are taken in blocks. A first Arrow pass splits the texts of a block and
lists the distinct words that neither the shared words nor the blocks before it
in its task have; the fold gives their ids; a second Arrow pass, in the same
task, keeps them and puts them in the documents' order. A block is one row all
along, so texts are not shuffled. A task begins anew after a bounded number of
distinct words, so no dictionary grows with the corpus.

The rank map is a literal: rows of pairs of ids in one array, displaced so that
they do not meet; a lookup is a sum and three array reads.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow, materialize, small_batches

#: A block closes with the document that takes it to so many characters.
BLOCK_CHARS = 1 << 18
#: Texts are split into chunks in runs that close with the text that takes them to so many bytes.
RUN_BYTES = 1 << 20
#: Distinct words beside the shared ones from which on a task begins a new list of them, with the next run of texts.
GENERATION = 125_000
#: Distinct chunks from which on a task begins a new list of them for the choice of shared words.
LISTED = 500_000
#: Longer words are merged with a heap in the second pass: a fold's cost is quadratic.
FOLD_BYTES = 128
#: The chunks that give the shared words have so many bytes in all at most.
SHARED_BYTES = 6 << 20
#: Steps of a doubling of the number of lists that hold a word, and parts of a step.
_STEPS, _PARTS = 8, 64
#: White space other than single blanks and line feeds needs the whole pattern.
_OTHERS = "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n")
_UNEVEN = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{_OTHERS}]"
#: Words that the pattern leaves whole behind a blank, with one mark at most that it parts from them.
_PLAIN, _MARKS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+[.,;:!?]?"), frozenset(".,;:!?")
_BLOCK = "fresh boolean, doc_ids array<long>, n_words array<int>, places binary, words array<array<int>>, long array<struct<at: int, word: binary>>"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class PairMap:
    """The ranks as literals of a Spark expression.

    A pair of ids leads to the rank of their bytes together, which is the id of
    the merged piece. The pairs of each left id are a row; rows are displaced
    into one array so that none of their entries meet, and an entry holds its
    left id above the rank. A lookup is a sum and three array reads: the entry,
    with the left id taken off, is the rank where the entry is the pair's, and
    beyond all ranks elsewhere.

    In the fold a pair stands as one number: its rank, the offset of its first
    byte, and its left id, from the highest bits on.
    """

    WIDTH, RANK_AT = 16, 40
    #: An id that no pair holds; it stands at both ends of a word, as byte 256.
    NONE, END = (1 << WIDTH) - 1, 256
    #: Pairs that do not merge are from this on.
    NEVER = 1 << 20 + RANK_AT

    def __init__(self, ranks: dict[bytes, int]):
        if any(rank >= self.NONE for rank in ranks.values()):
            raise ValueError("too many ranks")
        rows: dict[int, dict[int, int]] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    rows.setdefault(ranks[t[:i]], {})[ranks[t[i:]]] = r
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        if self.bytes.max() > 255:
            raise ValueError("single bytes have the first 256 ranks")
        merges = sorted((a * (self.END + 1) + b, r) for a in range(self.END) for b, r in rows.get(a, {}).items() if b < self.END)
        # the last entry stands for the last byte before an end mark, which no rank has
        places, values = np.array([*merges, (self.END * (self.END + 1) - 1, -1)]).T
        self.first, self.one = self._gaps(places, values), None
        self._displace(rows)

    def _displace(self, rows: dict[int, dict[int, int]]) -> None:
        """Each row, the longest first, stands at a place where all its entries are free."""
        span = 9 * sum(map(len, rows.values())) + 1
        free, draw = np.ones(span + self.NONE, bool), np.random.default_rng(0)
        table = np.full(len(free), -1, np.int64)
        self.rows = [0] * (1 << self.WIDTH)
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            rights = np.fromiter(row, np.int64, len(row))
            fits = np.zeros(0, bool)
            while not fits.any():
                places = draw.integers(0, span, 32)
                fits = free[places[:, None] + rights].all(1)
            at = int(places[fits.argmax()])
            self.rows[left] = at
            free[at + rights] = False
            table[at + rights] = left << self.WIDTH | np.fromiter(row.values(), np.int64, len(row))
        taken = np.flatnonzero(table >= 0)
        self.table = self._gaps(taken, table[taken].astype(np.uint32).view(np.int32))

    @staticmethod
    def _gaps(places: np.ndarray, values: np.ndarray) -> list[list[int]]:
        """Entries of an array as the number of free places before each, and its value."""
        return np.stack([np.diff(places, prepend=-1) - 1, values], 1).tolist()

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the literals as columns, which ``start`` and ``rank`` read.

        The literals are parsed once, in scalar subqueries. Inside the fold's
        expressions each would be printed and compared dozens of times. Plans and
        their events hold the literals as text, so free places are not written out.
        """
        literal = lambda values, kind: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")
        zero = F.col("id").cast("int")  # not a literal, so that the optimizer leaves the long arrays to the run
        filled = lambda gaps: F.flatten(F.transform(literal(gaps, "array<int>"), lambda x: F.concat(F.array_repeat(zero - 1, F.get(x, 0)), F.slice(x, 2, 1))))
        parts = {
            "table": filled(self.table),
            "rows": literal(self.rows, "int"),
            "first": F.transform(filled(self.first), lambda x, i: F.when(x >= 0, F.shiftleft(x.cast("bigint"), self.RANK_AT)).otherwise(F.lit(self.NEVER)) + F.floor(i / (self.END + 1))),
            "ranks": F.transform(F.sequence(zero, zero + self.NONE - 1), lambda r: F.shiftleft(r.cast("bigint"), self.RANK_AT)),
        }
        if self.one is None:
            self.one = df.sparkSession.range(1).select(*[c.alias(k) for k, c in parts.items()])
        return df.select("*", *[self.one.select(k).scalar().alias(f"pairs_{k}") for k in parts])

    def start(self, left: Column, right: Column, offset: Column) -> Column:
        """The number of two bytes of a word; the last has none on its right."""
        known = F.coalesce(F.get("pairs_first", left * (self.END + 1) + right), F.lit(self.NEVER + self.NONE))
        return known + offset.cast("bigint") * (1 << self.WIDTH)

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of two ids, in its bits, or NEVER."""
        entry = F.get("pairs_table", F.get("pairs_rows", left) + right)
        return F.coalesce(F.get("pairs_ranks", entry.bitwiseXOR(F.shiftleft(left, self.WIDTH))), F.lit(self.NEVER))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def encode_word(word: Column, pairs: PairMap) -> Column:
    """Ids of the bytes of one word, by merging the adjacent pair of the lowest rank until none has one.

    ``word`` is the array of its bytes' ids between two end marks. The fold goes
    over the array of the pairs' numbers: the least is the next merge, the first
    of equal ranks, and its rank is the merged id. A merge replaces two entries
    and looks up the two pairs beside it only.
    """
    start = F.transform(word, lambda a, i: pairs.start(a, F.get(word, i + 1), i))
    id_of = lambda x: x.bitwiseAND(F.lit(PairMap.NONE)).cast("int")
    own = lambda x: x.bitwiseAND(F.lit((1 << PairMap.RANK_AT) - 1))
    offset = lambda x: x.bitwiseAND(F.lit((1 << PairMap.RANK_AT) - (1 << PairMap.WIDTH)))
    new = lambda x: F.shiftright(x, PairMap.RANK_AT)

    def merged(q: Column, low: Column, k: Column) -> Column:
        left, rank = F.get(q, k - 2), new(low).cast("int")
        both = F.array(pairs.rank(id_of(left), rank) + own(left), pairs.rank(rank, id_of(F.get(q, k + 1))) + offset(low) + new(low))
        return F.flatten(F.array(F.slice(q, F.lit(1), k - 2), both, F.slice(q, k + 2, F.lit(1 << 20))))

    def step(q: Column, _: Column) -> Column:
        apply = lambda low: _let(F.array_position(q, low).cast("int"), lambda k: merged(q, low, k))
        return _let(F.array_min(q), lambda low: F.when(low < PairMap.NEVER, apply(low)).otherwise(q))

    # a word of n bytes takes n - 1 merges at most
    folded = F.aggregate(F.slice(word, F.lit(1), F.size(word) - 3), start, step)
    return _let(folded, lambda q: F.transform(F.slice(q, F.lit(2), F.size(q) - 2), id_of))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word of any length, in n log n steps."""
    n = len(word)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1" * n)
    heap = []

    def offer(i):
        if after[i] < n and (rank := ranks.get(word[i : ends[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, ends[after[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j] = 0
        ends[i], after[i] = ends[j], after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _strings(array: pa.Array) -> list[str]:
    """``to_pylist`` without a scalar for each string."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _stretches(sizes: np.ndarray, limit: int):
    """(begin, end) of stretches that close with the entry that takes their sum to ``limit``."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ends):
        end = min(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit)) + 1, len(ends))
        yield begin, end
        begin = end


def _runs(texts: pa.Array, limit: int):
    """(offset, texts) of stretches of an array of texts; null texts are empty, and offsets 64 bits wide."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for begin, end in _stretches(pc.binary_length(texts).to_numpy(), limit):
        yield begin, texts.slice(begin, end - begin)


def _chunks(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text: a chunk stands behind a blank, or behind a line feed that it begins with."""
    return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")


def _gather(flat: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    ends = np.cumsum(lens)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lens, lens)]


def _append(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The first ``used`` entries of an array and ``more``; the array itself where it has the room behind them."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.empty(len(more) + used // 2, held.dtype)])
    held[used : used + len(more)] = more
    return held


class _Table:
    """Places of distinct strings, found by their hashes; a string takes 12 bytes beside the array.

    A string whose hash another one has may not be found.
    """

    def __init__(self, strings: pa.Array):
        self.strings = strings
        parts = (_strings(strings.slice(i, 10_000)) for i in range(0, len(strings), 10_000))
        hashes = np.fromiter((h for part in parts for h in map(hash, part)), np.int64, len(strings))
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def places(self, strings: pa.Array, listed: list[str]) -> np.ndarray:
        """The place of each string, given twice, or -1."""
        out = np.full(len(listed), -1, np.int32)
        if len(self.hashes):
            own = np.fromiter(map(hash, listed), np.int64, len(listed))
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            like = np.flatnonzero(self.hashes[at] == own)
            found = self.order[at[like]]
            same = pc.equal(self.strings.take(pa.array(found)).cast(strings.type), strings.take(pa.array(like)))
            same = same.to_numpy(zero_copy_only=False)
            out[like[same]] = found[same]
        return out


class _Splitter:
    """Places of the words of texts, as 32-bit integers, in ``first`` and behind it in ``words``, the distinct others so far.

    A run of texts lists its distinct words and looks them up together, so of the
    first words no Python strings are kept.
    """

    def __init__(self, pattern, first=()):
        self.find, self.words, self.n_first = pattern.findall, {}, len(first)
        self.first = _Table(first if isinstance(first, pa.Array) else pa.array(first, pa.string()))

    def __iter__(self):
        """The chunks that are a first word behind a blank."""
        return (w[1:] for w in _strings(self.first.strings) if w[:1] == " " and not w[1:2].isspace() and len(w) > 1)

    def forget(self) -> None:
        """Begin anew behind the first words, in place, so that no two lists are held at a time."""
        self.words = {}

    def __missing__(self, chunk: str) -> list[str]:
        """The words of a chunk that is no first word behind a blank."""
        if not _PLAIN.fullmatch(chunk):
            return self.find(chunk if chunk[:1] == "\n" else " " + chunk)
        return [" " + chunk[:-1], chunk[-1]] if chunk[-1] in _MARKS else [" " + chunk]

    def _places(self, parts) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all lists in a row, and the number of words of each."""
        distinct, lens, codes = defaultdict(count().__next__), array("q"), array("i")
        for part in parts:
            lens.append(len(part))
            codes.extend(map(distinct.__getitem__, part))
        listed = list(distinct)
        at = self.first.places(pa.array(listed, pa.large_string()), listed)
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = self.n_first + self.words.setdefault(listed[i], len(self.words))
        return at[np.frombuffer(codes, np.int32)], np.frombuffer(lens, np.int64)

    def split(self, text: str) -> bytes:
        return self.split_all(pa.array([text], pa.large_string()))[0].tobytes()

    def split_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all texts in a row, and the number of words of each; a distinct chunk is looked up once."""
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        chunks = _chunks(pc.if_else(uneven, pa.scalar("", texts.type), texts))
        begins, chunks = chunks.offsets.to_numpy()[:-1] - chunks.offsets[0].as_py(), chunks.flatten()
        # a text's first chunk stands behind no blank; an uneven text is one
        first = np.zeros(len(chunks), bool)
        first[begins] = True
        heads = pc.if_else(uneven, texts, chunks.take(pa.array(begins)))
        coded = chunks.filter(pa.array(~first)).dictionary_encode()
        at = np.empty(len(chunks), np.int64)
        at[begins], at[~first] = np.arange(len(heads)), coded.indices.to_numpy() + np.int64(len(heads))
        blank = pa.scalar(" ", texts.type)
        behind = pc.binary_join_element_wise(blank, coded.dictionary, pa.scalar("", texts.type))
        listed = _strings(behind)
        known = self.first.places(behind, listed)
        known[pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)] = -1
        missing = np.flatnonzero(known < 0)
        others, n_others = self._places(chain(map(self.find, _strings(heads)), (self.__missing__(listed[i][1:]) for i in missing.tolist())))
        lens = np.ones(len(heads) + len(known), np.int64)
        lens[: len(heads)], lens[len(heads) + missing] = n_others[: len(heads)], n_others[len(heads) :]
        whole = np.concatenate([np.zeros(len(heads), bool), known >= 0])
        places, whole = np.empty(lens.sum(), "<i4"), np.repeat(whole, lens)
        places[whole], places[~whole] = known[known >= 0], others
        own = lens[at]
        return _gather(places, (np.cumsum(lens) - lens)[at], own), np.add.reduceat(own, begins)


def _byte_lists(words: list[str], byte_ids: np.ndarray) -> tuple[pa.ListArray, list[dict]]:
    """The ids of each word's bytes between two end marks; of long words the marks alone, and the words apart."""
    own = [w.encode() for w in words]
    long = [{"at": i, "word": w} for i, w in enumerate(own) if len(w) > FOLD_BYTES]
    for x in long:
        own[x["at"]] = b""
    lens = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lens + 2)
    flat = np.full(ends[-1] if len(own) else 0, PairMap.END, np.int32)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = inner[ends - lens - 2] = False
    flat[inner] = byte_ids[np.frombuffer(b"".join(own), np.uint8)]
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat)), long


def _lists(texts: DataFrame) -> DataFrame:
    """Each distinct chunk between blanks of the texts of a task, but for those too long to fold; a task begins anew after LISTED."""

    def listed(batches):
        chunks = set()

        def closed():
            own = [x for x in chunks if 0 < len(x) < FOLD_BYTES]
            for i in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 50_000], pa.string())], ["chunk"])

        for batch in batches:
            for _, texts in _runs(batch.column(0), RUN_BYTES):
                chunks.update(_strings(_chunks(texts).flatten().unique()))
                if len(chunks) >= LISTED:
                    yield from closed()
                    chunks = set()
        yield from closed()

    return map_arrow(texts, listed, "chunk string", lean=True)


def shared_words(docs: DataFrame, pairs: PairMap, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of the chunks on the most lists, SHARED_BYTES at most; their ids in a row, and where each word's begin.

    All texts are counted. Chunks on one list only are not among them, since
    sharing would save nothing. What is chosen changes the time alone: a word
    that is missing is folded where it occurs.
    """
    texts = docs.select(F.col("text").cast("string")).where("text is not null")
    # a task's list is distinct, so nothing is combined before the shuffle
    counts = _lists(texts).repartition(F.col("chunk")).groupBy("chunk").agg(F.count("*").alias("lists")).where("lists > 1")
    place = F.floor(F.log2("lists") * _STEPS) * _PARTS + F.pmod(F.xxhash64("chunk"), F.lit(_PARTS))
    counts = materialize(counts.select("chunk", place.cast("int").alias("place")), "bpe-chunks")
    sizes = counts.groupBy("place").agg(F.sum(F.octet_length("chunk")).alias("bytes")).collect()  # 64 places a step, 8 steps a doubling
    least, room = None, SHARED_BYTES
    for r in sorted(sizes, key=lambda r: -r.place):
        room -= r.bytes
        if room < 0:
            break
        least = r.place
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def words_of(batches):
        splitter = _Splitter(regex.compile(pattern))
        own = {w for batch in batches for chunk in batch.column(0).to_pylist() for w in splitter.__missing__(chunk)}
        own = [w for w in own if len(w.encode()) <= FOLD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["word"])

    byte_ids = pairs.bytes

    def lists(batches):
        for batch in batches:
            own = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            words = _byte_lists(batch.column(0).to_pylist(), byte_ids)[0]
            yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], ["own", "words"])

    # written before the fold, which then has no exchange: each new plan of an adaptive one would hold the literals again
    chosen = map_arrow(counts.where(F.col("place") >= least).select("chunk"), words_of, "word string", lean=True).distinct()
    chosen = materialize(chosen.repartition(docs.sparkSession.sparkContext.defaultParallelism), "bpe-shared")
    blocks = pairs.attach(map_arrow(chosen, lists, "own array<string>, words array<array<int>>", lean=True))
    coded = blocks.select("own", F.transform("words", lambda w: encode_word(w, pairs)).alias("ids")).toArrow()
    words, flat, lens = [pa.array([], pa.string())], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for batch in coded.to_batches():
        ids = batch.column("ids").flatten()
        words.append(batch.column("own").flatten())
        flat.append(ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint16))
        lens.append(np.diff(ids.offsets.to_numpy()).astype(np.int64))
    return pa.concat_arrays(words), np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(lens))])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, rows=None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """Ids of each text, or what ``rows`` makes of (doc_ids, arrays of ids, ranks).

    A null text counts as empty and has no ids. Each input row gives one row; a
    null doc_id stays null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = PairMap(ranks)
    byte_ids = pairs.bytes
    shipped = spark.sparkContext.broadcast(ranks)
    own_words, *own_ids = shared_words(docs, pairs, pattern)
    shared, shared_ids = spark.sparkContext.broadcast(own_words), spark.sparkContext.broadcast(own_ids)
    if rows is None:
        rows = lambda docs, ids, ranks: [pa.array(docs, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]

    def words(batches):
        splitter, known = _Splitter(regex.compile(pattern), shared.value), 0

        def closed(ids, counts, places, new):
            nested, long = _byte_lists(new, byte_ids)
            kinds = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.binary())]))
            own = pa.ListArray.from_arrays(pa.array([0, len(nested)], pa.int32()), nested)
            return pa.RecordBatch.from_arrays([pa.array([not known]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([places.tobytes()], pa.binary()), own, pa.array([long], kinds)], ["fresh", "doc_ids", "n_words", "places", "words", "long"])

        for batch in batches:
            for at, texts in _runs(batch.column(1), RUN_BYTES):
                if known >= GENERATION:
                    splitter.forget()
                    known = 0
                places, counts = splitter.split_all(texts)
                give_back()  # the task's other worker has its turn meanwhile
                new, before = list(islice(reversed(splitter.words), len(splitter.words) - known))[::-1], known
                ends = np.concatenate([[0], np.cumsum(counts)])
                for begin, end in _stretches(pc.utf8_length(texts).to_numpy(), BLOCK_CHARS):
                    own = places[ends[begin] : ends[end]]
                    # words up to the last that the block has; the run's last block has those that are left
                    upto = max(known, int(own.max(initial=-1)) + 1 - splitter.n_first) if end < len(texts) else len(splitter.words)
                    yield closed(batch.column(0)[at + begin : at + end].to_pylist(), counts[begin:end], own, new[known - before : upto - before])
                    known = upto

    def gathered(batches):
        ranks = shipped.value
        flat, begins, n_flat, n_begins = np.zeros(0, np.uint16), np.zeros(1, np.int64), 0, 1
        for batch in batches:
            give_back()
            for i in range(batch.num_rows):
                fresh, docs, counts = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64)
                places = np.frombuffer(batch.column(3)[i].as_buffer(), "<i4")
                coded, long = batch.column(4)[i].values, batch.column(5)[i].values
                new, lens = coded.flatten().to_numpy(zero_copy_only=False).astype(np.uint16), np.diff(coded.offsets.to_numpy()).astype(np.int64)
                if len(long):  # words for the heap, which the fold left out
                    extra = {j: heap_merges(w, ranks) for j, w in zip(long.field("at").to_pylist(), long.field("word").to_pylist(), strict=True)}
                    parts = np.split(new, np.cumsum(lens)[:-1])
                    parts = [x if j not in extra else np.array(extra[j], np.uint16) for j, x in enumerate(parts)]
                    new, lens = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
                if fresh:
                    flat, begins = shared_ids.value
                    n_flat, n_begins = len(flat), len(begins)
                if len(lens):
                    begins, flat = _append(begins, n_begins, n_flat + np.cumsum(lens)), _append(flat, n_flat, new)
                    n_flat, n_begins = n_flat + len(new), n_begins + len(lens)
                first = begins[places]
                lens = begins[places + 1] - first
                ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)]
                ids = np.split(_gather(flat, first, lens), ends[:-1])
                columns = rows(docs, ids, ranks)
                yield pa.RecordBatch.from_arrays(columns, [f"c{j}" for j in range(len(columns))])

    blocks = pairs.attach(map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), words, _BLOCK, lean=True))
    # a long word is empty here and has no bytes to fold
    coded = F.transform("words", lambda w: F.when(F.size(w) > 2, encode_word(w, pairs)).otherwise(F.array().cast("array<int>")))
    blocks = blocks.select("fresh", "doc_ids", "n_words", "places", coded.alias("ids"), "long")
    names = [x.split()[0] for x in schema.split(", ")]
    internal = ", ".join(f"c{i} {x.split(' ', 1)[1]}" for i, x in enumerate(schema.split(", ")))
    return map_arrow(blocks, gathered, internal, lean=True).toDF(*names)


def pieces_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode_ids(ids: list[np.ndarray], pieces: pa.LargeBinaryArray) -> list[memoryview]:
    """The bytes of arrays of ids: their pieces, one after another."""
    whole = pieces.take(pa.array(np.concatenate(ids)))
    _, offsets, data = whole.buffers()
    cuts = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
    data = memoryview(data or b"")
    return [data[a:b] for a, b in pairwise(cuts)]


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the decoded bytes of rows of doc_id and ids; null ids give null."""
    shipped = tokens.sparkSession.sparkContext.broadcast(pieces_by_id(ranks))

    def decoded(batches):
        for batch in batches:
            out = [None if x is None else b"".join(map(shipped.value.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), decoded, "doc_id long, bytes binary")


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode each text, decode the ids, and return counts and hashes of both."""

    pieces = []  # of a task, made once

    def rows(docs, ids, ranks):
        if not pieces:
            pieces.append(pa.array(pieces_by_id(ranks), pa.large_binary()))
        return [
            pa.array(docs, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(np.ascontiguousarray(x, "<u4")).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decode_ids(ids, *pieces)], pa.string()),
        ]

    return encode(docs, ranks, pattern, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
