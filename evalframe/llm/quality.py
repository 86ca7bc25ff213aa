"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, labelled_sample, utf8

FOLDS = 5
#: The classifier is fitted on at most so many labelled rows, of any length.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "non_ascii", "marks", "exclamations", "bars", "stops", "newlines",
    "line_words", "distinct", "repeats", "repeated_lines", "top_word", "long_words", "addresses", "brackets",
)


def _bytes_in(chars: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(chars, np.uint8), minlength=256).astype(bool)


_UPPER, _LETTERS = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes([*range(65, 91), *range(97, 123)]))
_DIGITS, _MARKS, _STOPS = _bytes_in(b"0123456789"), _bytes_in(b"#$%&*~^=+<>\\"), _bytes_in(b".,;:?")
_ADDRESSES, _BRACKETS = _bytes_in(b"@/_"), _bytes_in(b"()[]{}\"'`")


def statistics(text: bytes) -> np.ndarray:
    """The STATISTICS of one whole UTF-8 text; an empty text has zeros."""
    if not text:
        return np.zeros(len(STATISTICS), np.float32)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    n, w = len(text), max(1, len(words))
    seen = Counter(words)
    return np.array([
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, count[_UPPER].sum() / max(1, count[_LETTERS].sum()), count[_DIGITS].sum() / n,
        count[128:].sum() / n, count[_MARKS].sum() / w, count[33] / w, count[124] / w, count[_STOPS].sum() / w, count[10] / w,
        np.log1p(len(words) / max(1, len(lines))), len(seen) / w, sum(map(bytes.__eq__, words, words[1:])) / w, 1 - len(set(lines)) / max(1, len(lines)),
        max(seen.values(), default=0) / w, sum(x > 20 for x in map(len, words)) / w, count[_ADDRESSES].sum() / w, count[_BRACKETS].sum() / w,
    ], np.float32)


@dataclass
class Forest:
    """Boosted trees of one depth, flattened: node k of a tree has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # trees x inner nodes: over this value goes right
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, all rows and trees one level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.leaf.shape[1].bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[trees, node]] > self.above[trees, node])
        return self.base + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Forest:
    """Gradient boosting of the log loss; splits are found on histograms of the binned statistics.

    With no rows, or rows of one label only, every score is the smoothed share of label 1.
    """
    inner, leaves, n_features = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Forest(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves), np.float64))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    limit = np.full((n_features, bins), np.inf, np.float32)
    for f, c in enumerate(cuts):
        limit[f, : len(c)] = c
    flat = binned + np.arange(n_features)[None, :] * bins
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (n_features * bins) + flat).ravel()
            size = width * n_features * bins
            g = np.bincount(cell, np.repeat(gradient, n_features), size).reshape(width, n_features, bins).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hessian, n_features), size).reshape(width, n_features, bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            feature, at = best // bins, best % bins
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            model.feature[t, first : first + width] = feature
            model.above[t, first : first + width] = np.where(good, limit[feature, at], np.inf)
            own = node - first
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[own]] > model.above[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        model.leaf[t] = -rate * g / (h + l2)
        margin += model.leaf[t][leaf]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on a bounded sample of labelled rows (see ``labelled_sample``), none of the held-out fold; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, label, bucket("doc_id", FOLDS) != 0, rows, ["text"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(text) for text in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1), batch.column(2)], ["x", "y", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("text", F.col(label).cast("int"), "doc_id").mapInArrow(measure, f"x array<float>, y int, doc_id {kind}").toPandas().sort_values("doc_id")
    x = np.stack(got.x.to_list()) if len(got) else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x, got.y.to_numpy(np.float64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    The score is the fitted probability that ``labels.quality`` is 1; texts of any
    length are measured whole. Null and
    empty texts have all statistics zero and the score that follows from that.
    Documents without a label are scored like any; null ids are kept; repeated
    rows come out repeated; without usable labels every score is the same.
    Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            x = np.stack([statistics(text) for text in texts]) if texts else np.zeros((0, len(STATISTICS)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (bucket("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
