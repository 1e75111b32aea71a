"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie. A node's failure link leads to where matching goes on
when no edge fits, and its popped-token count says how many tokens are complete
by then. Both are computed once for the vocabulary; counting then follows edges
and links and adds up numbers, without building a piece.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: What stands before a word in the vocabulary.
WORD_START = "▁"
#: Cached words of a worker.
CACHED = 200_000


def build(vocabulary: list[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Edges, failure links (-1: none) and popped-token counts of the trie's nodes; node 0 is the root."""
    edges: list[dict[str, int]] = [{}]
    final = [False]
    for piece in vocabulary:
        at = 0
        for c in piece:
            if c not in edges[at]:
                edges[at][c] = len(edges)
                edges.append({})
                final.append(False)
            at = edges[at][c]
        final[at] = at > 0
    fail, popped = [-1] * len(edges), [0] * len(edges)
    todo = deque([0])
    while todo:
        parent = todo.popleft()
        for c, node in edges[parent].items():
            todo.append(node)
            if final[node]:
                fail[node], popped[node] = 0, 1
                continue
            link, count = fail[parent], popped[parent]
            while link >= 0 and c not in edges[link]:
                count += popped[link]
                link = fail[link]
            if link >= 0:
                fail[node], popped[node] = edges[link][c], count
    return edges, fail, popped


class Counter(dict):
    """Tokens of a word; a word that cannot be matched to its end counts as one unknown token.

    The values hold unknown words in the bits above 40.
    """

    def __init__(self, automaton):
        super().__init__()
        self._edges, self._fail, self._popped = automaton

    def count(self, word: str) -> int:
        """Tokens of a word with its start mark, or -1."""
        edges, fail, popped = self._edges, self._fail, self._popped
        node = total = 0
        for c in word:
            while c not in edges[node]:
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
            node = edges[node][c]
        while node:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total

    def __missing__(self, word: bytes) -> int:
        n = self.count(WORD_START + word.decode())
        found = n if n >= 0 else 1 | 1 << 40
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found


def count_tokens(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has none. Each input
    row gives one row; a null doc_id stays null. The vocabulary is shipped whole,
    its automaton is built once in each task.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        counter = Counter(build(shipped.value))
        for batch in batches:
            words, sums = [], []
            for text in batch.column(1):
                own = (text.as_py() or "").encode().split()
                words.append(len(own))
                sums.append(sum(map(counter.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array([s & (1 << 40) - 1 for s in sums], pa.int64()), pa.array([s >> 40 for s in sums], pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), counted, "doc_id long, n_words long, n_tokens long, n_unknown long")


def piece_vocabulary(model: bytes) -> list[str]:
    """The pieces of a public piece model, without its control, unknown and byte pieces."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [pieces.id_to_piece(i) for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
