"""Ids of texts under the lower-casing word vocabulary, encoded piece by piece.

The tokenizer drops white space and never joins text across it, so the ids of a
text are those of its pieces between blanks and line feeds, one after another.
That makes a cache of pieces exact. Of the pieces that are not cached, plain Latin
letters with at most a run of marks behind them go to the library's model as a
lower-cased word, once for all its forms; the run, and all other pieces, go to the
whole library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: The id that ends each document.
END_ID = 1
#: Letters below U+0250 but U+0130, which keep their form under NFC and have a one-letter lower case.
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+")
#: Marks behind them: ASCII but the apostrophe, which the vocabulary may join with letters, and ``<``, which begins its special tokens.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Characters of texts that are encoded together, and the longest piece that is kept.
TOGETHER, LONGEST = 1 << 20, 64
_ENCODERS: dict[int, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces; one that is missing comes from the older generation or from ``encode``, and is kept unless it is long."""

    def __init__(self, encode, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.encode, self.old = encode, old

    def __missing__(self, piece: str) -> bytes:
        coded = self.old.get(piece)
        if coded is None:
            coded = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = coded
        return coded


class WordEncoder:
    """Maps texts to the little-endian ids of their tokens, of 16 bits where all ids fit, else of 32.

    The cache holds two generations of about ``generation`` pieces; the older one
    goes when the younger is full, so frequent pieces stay.
    """

    def __init__(self, vocabulary: str, generation: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(vocabulary)
        held = self._tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(held.values()) < 1 << 16 else "<u4")
        self._packed = [i.to_bytes(self.kind.itemsize, "little") for i in range(max(held.values()) + 1)]
        self._letters = str.maketrans(_byte_letters())
        # plain words need no normalizer where the vocabulary lower-cases and spells words by bytes
        self._lowers = self._tokenizer.encode("AÉ", add_special_tokens=False).ids == [t.id for t in self._tokenizer.model.tokenize("a" + "é".encode().decode("latin-1").translate(self._letters))]
        self._pieces = _Pieces(self._piece, {})
        self._generation = generation

    def __len__(self) -> int:
        """One more than the largest id."""
        return len(self._packed)

    def _whole(self, piece: str) -> bytes:
        return b"".join([self._packed[i] for i in self._tokenizer.encode(piece, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        body = piece.rstrip(_MARKS)
        ascii_letters = body.isascii() and body.isalpha()
        if not (self._lowers and (ascii_letters or _LETTERS.fullmatch(body))):
            return self._whole(piece)
        lowered = body.lower()
        if lowered != piece:
            # a run of marks is a piece of its own
            marks = piece[len(body) :]
            return self._pieces[lowered] + self._pieces[marks] if marks else self._pieces[lowered]
        spelled = piece if ascii_letters else piece.encode().decode("latin-1").translate(self._letters)
        packed = self._packed
        return b"".join([packed[t.id] for t in self._tokenizer.model.tokenize(spelled)])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each whole text, without an end id; null counts as empty."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(text.replace("\n", " ").split(" ") if text else [])
            size += len(text) if text else 0
            if size >= TOGETHER:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _coded(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(self._pieces) >= self._generation:
            self._pieces.old = {}  # so that no more than two are held
            self._pieces = _Pieces(self._piece, self._pieces.copy())
        of = self._pieces.__getitem__
        return iter([b"".join(map(of, pieces)) for pieces in held])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text."""
        return np.frombuffer(next(self.encode_all([text])), self.kind)


def encoder(vocabulary: str) -> WordEncoder:
    """This worker's encoder for a vocabulary given as its JSON text."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(vocabulary)
    return _ENCODERS[key]


def forget() -> None:
    """Drop this worker's encoder and its cache."""
    _ENCODERS.clear()


def encode_with_end(texts: Iterable[str | None], vocabulary: str) -> Iterator[np.ndarray]:
    """For each text its ids with the end id."""
    own = encoder(vocabulary)
    end = np.array([END_ID], own.kind).tobytes()
    for coded in own.encode_all(texts):
        yield np.frombuffer(coded + end, own.kind)
