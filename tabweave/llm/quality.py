"""Quality of web text by positive-unlabelled learning.

Trusted good documents are the positives, a sample of all documents is the
unlabelled web text; a linear model over binned measures of the whole text
minimises the non-negative unbiased risk under an estimated share of good
documents.  The fit sees at most ``SAMPLE`` rows of either kind; every document
is scored in one pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.linear import Bins, fit_positive_unlabelled, sigmoid
from tabweave.llm.text import batch, crc_mod, map_batches, utf8

SAMPLE = 20_000
HELD_OUT_OF = 5
THRESHOLD = 0.3

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SENTENCE = b".,;:?'\"-()"
_SPACE = b" \t\r\n\x0b\x0c"
# every other printable ASCII character
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _LOWER + _UPPER + _DIGITS + _SENTENCE)
_HIGH = bytes(range(128, 256))
N_FEATURES = 16


def text_measures(data: bytes) -> list[float]:
    """Measures of a whole text; an empty one has zeros."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    size = len(data)
    left = lambda chars: size - len(data.translate(None, chars))
    upper, lower, high = left(_UPPER), left(_LOWER), left(_HIGH)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    stops = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    return [
        np.log1p(n), len(counts) / n, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.__eq__, words, words[2:])) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1), (size - left(_SPACE)) / n,
        upper / (upper + lower + high + 1), left(_SYMBOLS) / size, left(_DIGITS) / size, left(_SENTENCE) / size,
        data.count(b"!") / n, data.count(b"|") / n, stops / n, len(set(lines)) / len(lines), len(lines) / n]


@dataclass
class QualityModel:
    bins: Bins
    weights: np.ndarray
    prior: float

    def scores(self, measures: np.ndarray) -> np.ndarray:
        if not len(measures):
            return np.zeros(0)
        return sigmoid(self.weights[:-1][self.bins.places(measures)].sum(1) + self.weights[-1])


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([text_measures(t) for t in utf8(b.column(0))]).reshape(b.num_rows, N_FEATURES)
        yield pa.RecordBatch.from_arrays(
            [b.column(1), b.column(2), pa.array(list(values), pa.list_(pa.float64()))],
            names=["positive", "unlabelled", "measures"])


def sampled(key, share: float):
    """A condition that holds for about this share of the values of a column."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < F.lit(int(min(share, 1.0) * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
        prior: float | None = None, held_out_of: int = HELD_OUT_OF) -> QualityModel:
    """Fit on documents whose ``crc32(doc_id) mod held_out_of`` is not 0.

    About ``sample`` trusted positives and ``sample`` unlabelled documents are
    drawn by a hash of their id, and 4 * ``sample`` rows at most where ids repeat.  Without a given prior it is the share of
    label 1 among the labelled training rows.  A document labelled both ways is not
    trusted; null labels and ids are left out.  Without positives or documents
    every score is the prior (one half without labels).
    """
    marks = labels.where(c("doc_id").isNotNull() & c(label).isNotNull()).groupBy(
        c("doc_id").cast("long").alias("label_id")).agg(F.min(c(label)).alias("low"))
    marks = marks.where(crc_mod(F.col("label_id"), held_out_of) != 0)
    total, good = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("low") == 1).cast("long")), F.lit(0))).first()
    if prior is None:
        prior = (good + 0.5) / (total + 1)
    train = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text")).where(
        crc_mod(F.col("doc_id"), held_out_of) != 0)
    n = docs.count()
    # at most about ``sample`` rows
    trusted = marks.where((F.col("low") == 1) & sampled("label_id", sample / max(good, 1))).select(
        "label_id", F.lit(True).alias("positive"))
    rows = train.join(F.broadcast(trusted), F.col("doc_id") == F.col("label_id"), "left").select(
        "text", F.coalesce("positive", F.lit(False)).alias("positive"),
        sampled("doc_id", sample / max(n, 1)).alias("unlabelled")).where("positive or unlabelled")
    # a draw by id takes all rows of an id: what one id may add is bounded, in the order of a hash of the row
    measured = map_batches(rows, _measured, "positive boolean, unlabelled boolean, measures array<double>")
    found = measured.orderBy(F.xxhash64("measures", "positive")).limit(4 * sample).toArrow()
    values = np.array(found.column("measures").to_pylist(), np.float64).reshape(found.num_rows, N_FEATURES)
    pick = lambda name: values[np.array(found.column(name).to_pylist(), bool)]
    # rows in an order of their own, so that sums do not depend on the tasks' order
    positive, unlabelled = (v[np.lexsort(v.T)] for v in (pick("positive"), pick("unlabelled")))
    bins = Bins.of(unlabelled)
    weights = fit_positive_unlabelled(bins.places(positive), bins.places(unlabelled), prior, int(bins.offsets[-1]))
    return QualityModel(bins, weights, prior)


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` of each row: null and empty texts are scored like any
    other, repeated rows repeat, other columns are not read, an empty table stays empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([text_measures(t) for t in utf8(b.column(1))]).reshape(b.num_rows, N_FEATURES)
            yield batch(_SCORE, b.column(0), model.scores(values))

    return map_batches(docs.select(c(id_column).cast("long").alias("doc_id"), c(text_column).cast("string").alias("text")),
                       run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([text_measures(t) for t in utf8(b.column(at))]).reshape(b.num_rows, N_FEATURES)
            yield b.filter(pa.array(model.scores(values) >= threshold))

    return map_batches(plain, run, plain.schema).toDF(*names)
