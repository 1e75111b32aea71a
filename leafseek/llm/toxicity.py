"""Toxicity by a chain of linear classifiers.

The categories are columns of the labels, in a fixed order. The model of each
category sees the words of a text, their beginnings, and the probabilities of the
categories before it. In training those come from models that have not seen the
row (out of fold), words chosen without it too, so later models learn what the
earlier ones are worth on unseen texts; in scoring they come from the models of
all rows.

The chain is fitted on at most ``MAX_ROWS`` labelled rows, those with the least
hashes of doc_id. Words that tell a category by a chi-square of ``LEAST_CHI`` are
its features, however many they are; the rows are sparse. Scoring reads whole
texts in one pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

MAX_ROWS, FOLDS, RIDGE = 8192, 5, 1e-4
#: Chi-square of a word with a category, and texts with the word, from which on it is a feature.
LEAST_CHI, LEAST_TEXTS = 80.0, 3
#: Letters of a word's beginning.
BEGINNING = 4
#: A text is toxic from this probability of the last category on.
THRESHOLD = 0.5
#: Columns of the labels, 0 or 1 each; the last is what texts are rejected for.
CATEGORIES = ("quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words of letters, and with ``*`` the beginnings of longer ones; null counts as empty.

    Beginnings carry what inflected and compound words have in common.
    """
    found = set(_WORD.findall(text.lower())) if text else set()
    return found | {w[:BEGINNING] + "*" for w in found if len(w) > BEGINNING}


@dataclass
class Chain:
    vocabulary: dict[str, int]
    #: One row for each category: weights of the words, of the earlier categories, and the constant.
    weights: list[np.ndarray]
    categories: tuple[str, ...] = CATEGORIES

    def scores(self, texts) -> np.ndarray:
        """Probabilities (texts, categories)."""
        n, known = len(self.vocabulary), self.vocabulary
        out = np.zeros((len(texts), len(self.weights)))
        at = [[known[w] for w in words(t) if w in known] for t in texts]
        for c, w in enumerate(self.weights):
            base = np.array([w[i].sum() for i in at]) if at else np.zeros(0)
            out[:, c] = _sigmoid(base + out[:, :c] @ w[n:-1] + w[-1])
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Design:
    """Rows of a few words among many, as places (row, column) of ones, beside a few columns of numbers."""

    row: np.ndarray
    column: np.ndarray
    width: int
    dense: np.ndarray

    def rows(self, keep: np.ndarray, columns: np.ndarray | None = None) -> Design:
        """The rows that are kept, with the words of some columns only."""
        chosen = keep[self.row] if columns is None else keep[self.row] & columns[self.column]
        return Design((np.cumsum(keep) - 1)[self.row[chosen]], self.column[chosen], self.width, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.dense)) + self.dense @ w[self.width : -1] + w[-1]

    def gathered(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, r[self.row], self.width), self.dense.T @ r, [r.sum()]])


def _solved(product, b: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Conjugate gradients."""
    x, r = np.zeros_like(b), b.copy()
    d, norm = r.copy(), r @ r
    least = 1e-6 * norm
    for _ in range(rounds):
        if norm <= least:
            break
        q = product(d)
        step = norm / (d @ q)
        x, r = x + step * d, r - step * q
        norm, last = r @ r, norm
        d = r + norm / last * d
    return x


def fit_linear(x: Design, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights and constant of a ridge logistic regression, by Newton's method with bounded steps."""
    n = len(y)
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    rate = np.clip(y.mean() if n else 0, 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    if not n or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = ridge / 100
    for _ in range(rounds):
        p = _sigmoid(x.times(w))
        curvature = p * (1 - p) / n + 1e-9
        step = _solved(lambda v: x.gathered(curvature * x.times(v)) + penalty * v, x.gathered(p - y) / n + penalty * w)  # noqa: B023
        w = w - step * min(1, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: Design, y: np.ndarray, folds: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """Weights of each category; ``y`` has a column for each, ``folds`` a number for each row.

    ``chosen[f]`` marks the words that the rows outside fold f choose, and its
    last row those that all rows choose.
    """
    every, weights = np.ones(len(folds), bool), []
    for c in range(y.shape[1]):
        weights.append(fit_linear(x.rows(every, chosen[-1]), y[:, c]))
        if c + 1 < y.shape[1]:
            unseen = np.zeros(len(folds))
            for f in np.unique(folds):
                out = folds == f
                w = fit_linear(x.rows(~out, chosen[f]), y[~out, c])
                unseen[out] = _sigmoid(x.rows(out, chosen[f]).times(w))
            x = Design(x.row, x.column, x.width, np.concatenate([x.dense, unseen[:, None]], 1))
    return weights


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain on labelled texts; ``labels`` has doc_id and a column of 0 or 1 for each category.

    Rows with a null id or a null label are left out. Of several labels of a
    doc_id the largest counts, and of several texts the one of the least hash, so
    no more than ``max_rows`` rows are used. Without labelled rows every
    probability is next to zero.
    """
    own = labels.select("doc_id", *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    ys = [f"y{i}" for i in range(len(categories))]
    picked = own.groupBy("doc_id").agg(*[(F.max(y) > 0).cast("int").alias(y) for y in ys]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # at most max_rows rows
    labelled = texts.join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("doc_id", *ys, F.xxhash64("text").alias("h"), "text")

    def listed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sorted(words(t.as_py())) for t in batch.column("text")], pa.list_(pa.string()))], [*batch.schema.names[:-1], "words"])

    sample = map_arrow(labelled, listed, "doc_id long, " + "".join(f"{y} int, " for y in ys) + "h long, words array<string>", lean=True)
    sample = sample.groupBy("doc_id").agg(F.min_by(F.struct(*ys, "words"), "h").alias("r")).select("doc_id", "r.*")
    sample = materialize(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "labelled")
    # numbers of texts with a word, and of those with a word and a label, without each fold and of all
    parts = range(FOLDS + 1)
    within = [F.lit(True) if f == FOLDS else F.col("fold") != f for f in parts]
    sizes = sample.agg(*[F.count_if(within[f]).alias(f"n{f}") for f in parts], *[F.coalesce(F.sum(F.when(within[f], F.col(y))), F.lit(0)).alias(f"{y}_{f}") for f in parts for y in ys]).first()
    counts = sample.select("fold", *ys, F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(within[f]).cast("double").alias(f"n{f}") for f in parts], *[F.coalesce(F.sum(F.when(within[f], F.col(y))), F.lit(0)).cast("double").alias(f"{y}_{f}") for f in parts for y in ys])

    def tells(f: int):
        n, k = float(sizes[f"n{f}"]), F.col(f"n{f}")
        found = F.lit(False)
        for y in ys:
            labelled_texts, both = float(sizes[f"{y}_{f}"]), F.col(f"{y}_{f}")
            gap = both * n - k * labelled_texts
            scale = k * (n - k) * (labelled_texts * (n - labelled_texts))
            found = found | (gap * gap * n >= scale * LEAST_CHI) & (scale > 0)
        return found & (k >= LEAST_TEXTS)

    told = counts.select("word", F.array(*[tells(f) for f in parts]).alias("told")).where(F.exists("told", lambda x: x))
    features = sorted((r["word"], r["told"]) for r in told.collect())
    place = {w: i for i, (w, _) in enumerate(features)}
    chosen = np.array([t for _, t in features], bool).reshape(-1, FOLDS + 1).T
    known = sample.select("doc_id", "fold", *ys, F.explode_outer("words").alias("word")).join(F.broadcast(told.select("word", F.lit(True).alias("told"))), "word", "left")
    rows = known.groupBy("doc_id", "fold", *ys).agg(F.collect_list(F.when(F.col("told"), F.col("word"))).alias("words")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    row = np.repeat(np.arange(len(rows)), [len(r["words"]) for r in rows])
    column = np.array([place[w] for r in rows for w in sorted(r["words"])], np.int64)
    y = np.array([[r[k] for k in ys] for r in rows], float).reshape(-1, len(ys))
    weights = fit_chain(Design(row, column, len(features), np.zeros((len(rows), 0))), y, np.array([r["fold"] for r in rows], np.int64), chosen)
    # words that only some folds choose have no weight
    final = np.flatnonzero(chosen[-1])
    names = [features[i][0] for i in final]
    return Chain({w: i for i, w in enumerate(names)}, [np.concatenate([w[final], w[len(features) :]]) for w in weights], tuple(categories))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, and toxic, of each row.

    A null text counts as empty; repeated rows give repeated results, and a null
    doc_id stays null.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.weights, chain.categories))

    def scored(batches):
        own = Chain(*shipped.value)
        for batch in batches:
            p = own.scores([t.as_py() for t in batch.column(1)]).round(6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= THRESHOLD)], ["doc_id", *[f"p_{c}" for c in own.categories], "toxic"])

    fields = ", ".join(["doc_id long", *[f"p_{c} double" for c in chain.categories], "toxic boolean"])
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scored, fields)


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.weights))
    at = docs.columns.index("text")

    def clean(batches):
        own = Chain(*shipped.value)
        for batch in batches:
            yield batch.filter(pa.array(own.scores([t.as_py() for t in batch.column(at)])[:, -1].round(6) < THRESHOLD))

    return map_arrow(docs, clean, docs.schema, lean=True)
