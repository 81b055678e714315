"""Toxicity categories by a classifier chain.

One linear model a category, in order; each also gets the probabilities of the
categories before it.  In training those are out-of-fold predictions, so a
later model sees them as unsure as they will be on new text.  Features are the
words of the whole text and their beginnings, hashed; the most telling buckets
of the sample are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.linear import fit_logistic, sigmoid
from tabweave.llm.text import crc_mod, crc_mod_of, map_batches, text_words, utf8

SAMPLE = 20_000
BUCKETS = 1 << 18
KEPT = 512
FOLDS = 3
PREFIXES = (4, 5)
HELD_OUT_OF = 5
# abuse is rare, so the models are cautious
THRESHOLD = 0.3


def text_buckets(data: bytes) -> list[int]:
    """The buckets of the distinct words of a text and of their beginnings."""
    words = set(text_words(data))
    parts = {w + b" " for w in words}.union(*({w[:n] for w in words if len(w) >= n} for n in PREFIXES))
    return list({zlib.crc32(p) % BUCKETS for p in parts})


@dataclass
class ToxicityChain:
    categories: list[str]
    buckets: np.ndarray
    weights: list[np.ndarray]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        place = {b: i for i, b in enumerate(self.buckets.tolist())}
        x = np.zeros((len(texts), len(place)), np.float32)
        for row, text in zip(x, texts):
            row[[place[b] for b in text_buckets(text) if b in place]] = 1
        return chained(x, self.weights)


def chained(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(x), len(weights)))
    for k, w in enumerate(weights):
        n = x.shape[1]
        out[:, k] = sigmoid(x @ w[:n] + out[:, :k] @ w[n:n + k] + w[-1])
    return out


def telling(x_buckets: list[np.ndarray], y: np.ndarray, kept: int) -> np.ndarray:
    """The buckets whose presence differs most, in standard errors, between the
    rows of any category and the others; ties to the smaller bucket."""
    best = np.zeros(BUCKETS)
    flat = np.concatenate(x_buckets) if x_buckets else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(x_buckets)), [len(b) for b in x_buckets])
    for k in range(y.shape[1]):
        n1 = int(y[:, k].sum())
        n0 = len(y) - n1
        if not n1 or not n0:
            continue
        a = np.bincount(flat[y[rows, k] == 1], minlength=BUCKETS)
        b = np.bincount(flat[y[rows, k] == 0], minlength=BUCKETS)
        p = (a + b) / len(y)
        z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
        best = np.maximum(best, z)
    order = np.lexsort((np.arange(BUCKETS), -best))[:kept]
    return np.sort(order[best[order] > 0])


def fit_chain(categories: Sequence[str], buckets: list[np.ndarray], y: np.ndarray, fold: np.ndarray,
              folds: int = FOLDS, kept: int = KEPT) -> ToxicityChain:
    """``y``: a column of 0 and 1 for each category; ``fold``: a fold number for each row."""
    chosen = telling(buckets, y, kept)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(buckets), len(chosen)), np.float32)
    for row, b in zip(x, buckets):
        at = place[b]
        row[at[at >= 0]] = 1
    earlier = np.zeros((len(x), 0))
    weights = []
    for k in range(y.shape[1]):
        own = np.concatenate((x, earlier), axis=1)
        weights.append(fit_logistic(own, y[:, k]))
        if k + 1 < y.shape[1]:
            unseen = np.zeros(len(x))
            for f in range(folds):
                w = fit_logistic(own[fold != f], y[fold != f, k])
                unseen[fold == f] = sigmoid(own[fold == f] @ w[:-1] + w[-1])
            earlier = np.concatenate((earlier, unseen[:, None]), axis=1)
    return ToxicityChain(list(categories), chosen, weights)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE,
        held_out_of: int = HELD_OUT_OF) -> ToxicityChain:
    """Fit on labelled documents whose ``crc32(doc_id) mod held_out_of`` is not 0.

    ``labels`` has a 0/1 column for each category.  About ``sample`` rows are
    drawn by a hash of the id, and 2 * ``sample`` at most where ids repeat; rows with a null label or id are left out; a document labelled
    twice counts as marked if any of its rows is.  Without labelled documents
    every probability is one half.
    """
    marks = labels.where(c("doc_id").isNotNull()).groupBy(c("doc_id").cast("long").alias("label_id")).agg(
        *[F.max(c(k)).cast("int").alias(f"_y{i}") for i, k in enumerate(categories)]).dropna()
    marks = marks.where(crc_mod(F.col("label_id"), held_out_of) != 0)
    share = min(1.0, sample / max(marks.count(), 1))
    chosen = marks.where(F.pmod(F.xxhash64("label_id", F.lit(29)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    names = [f"_y{i}" for i in range(len(categories))]
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "doc_id", *names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([text_buckets(t) for t in utf8(b.column(0))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, *b.columns[1:]], names=["buckets", *b.schema.names[1:]])

    found = map_batches(rows, hashed, "buckets array<int>, doc_id long, " + ", ".join(f"{n} int" for n in names))
    # a draw by id takes all rows of an id: what one id may add is bounded, in the order of a hash of the row
    got = found.orderBy(F.xxhash64("doc_id", "buckets")).limit(2 * sample).toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    buckets = [np.sort(x.values.to_numpy()).astype(np.int64) for x in got.column("buckets")]
    y = np.array([got.column(n).to_pylist() for n in names], np.float64).reshape(len(names), got.num_rows).T
    fold = np.array([crc_mod_of(f"fold {i}", FOLDS) for i in got.column("doc_id").to_pylist()], np.int64)
    return fit_chain(categories, buckets, (y > 0).astype(np.float64), fold)


def score(docs: DataFrame, chain: ToxicityChain, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``p_<category>`` of each row.  Null and empty texts are
    scored by the intercepts alone; repeated rows repeat; other columns are
    not read; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *[f"p_{k}" for k in chain.categories]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = held.value.probabilities(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in p.T.copy()]], names=names)

    return map_batches(docs.select(c(id_column).cast("long").alias("doc_id"), c(text_column).cast("string").alias("text")),
                       run, "doc_id long, " + ", ".join(f"`{n}` double" for n in names[1:]))
