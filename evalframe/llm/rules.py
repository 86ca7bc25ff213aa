"""Quality rules: fixed limits, then gradient-boosted trees over document statistics that never count a fault in a document's favour.

Statistics that measure faults (symbols, repeated lines and words) are constrained:
whatever the other statistics are, more of them cannot raise the score. Trees grow
by their best leaf, keep bounds of each node's values, and are flattened into node
arrays that numpy walks for all rows and trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import bucket, labelled_sample, utf8

#: Least words, and most words in repeated windows, as a percentage.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SYMBOLS = quality._bytes_in(b"#*$%&|<>")
BLANKS = quality._bytes_in(b" \t\n\x0b\x0c\r")
#: The trees are fitted on at most so many labelled rows, of any length; rows of fold 0 are left for figures of what they are worth.
SAMPLE_ROWS, FOLDS = 12_000, 5
#: From this fitted probability of a good document on it is kept.
KEEP_FROM = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols", "repeated_lines_share", "repeated_words", "blank_lines", "longest_word")
#: The statistics that the trees see, and which way the score may go as one rises.
STATISTICS = (*SHARES, *quality.STATISTICS)
MONOTONE = {"symbols": -1, "repeated_lines_share": -1, "repeated_words": -1, "repeats": -1, "top_word": -1}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found more than once, its first place included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    window = ids
    for k in range(1, WINDOW):
        window = np.unique(window[:-1] * len(known) + ids[k:], return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k : n - WINDOW + 1 + k] |= again
    return int(covered.sum())


def measured(text: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """The COUNTS and the STATISTICS of one whole UTF-8 text."""
    octets = np.frombuffer(text, np.uint8)
    count = np.bincount(octets, minlength=256)
    words, lines = text.split(), text.split(b"\n")
    full = [line for line in lines if line.strip()]
    chars = int(len(octets) - ((octets & 0xC0) == 0x80).sum() - count[BLANKS].sum())
    counts = (len(words), chars, int(count[SYMBOLS].sum()), len(full) - len(set(full)), repeated_words(words))
    shares = (counts[2] / max(1, chars), counts[3] / max(1, len(full)), counts[4] / max(1, len(words)), 1 - len(full) / len(lines), np.log1p(max(map(len, words), default=0)))
    return counts, np.concatenate([np.array(shares, np.float32), quality.statistics(text)])


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child on both sides."""

    base: float
    root: np.ndarray
    feature: np.ndarray
    above: np.ndarray  # over this value goes right
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.root, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            further = np.where(x[row, self.feature[node]] > self.above[node], self.right[node], self.left[node])
            if np.array_equal(further, node):
                return self.base + self.value[node].sum(axis=1)
            node = further

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


@dataclass
class _Leaf:
    """A leaf while its tree grows: its node, rows and histograms, the bounds of its value, and its best split."""

    node: int
    rows: np.ndarray
    g: np.ndarray
    h: np.ndarray
    low: float
    high: float
    gain: float = 0.0
    feature: int = 0
    cell: int = 0
    values: tuple[float, float] = (0.0, 0.0)


class _Grower:
    def __init__(self, x: np.ndarray, bins: int, direction: np.ndarray, l2: float, least: float):
        self.direction, self.l2, self.least, self.bins = direction[:, None], l2, least, bins
        self.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
        self.cell = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(self.cuts, x.T, strict=True)], axis=1)
        self.flat = self.cell + np.arange(x.shape[1]) * bins

    def histograms(self, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (self.flat.shape[1], self.bins)
        at = self.flat[rows].ravel()
        return tuple(np.bincount(at, np.repeat(v[rows], shape[0]), shape[0] * shape[1]).reshape(shape) for v in (gradient, hessian))

    def split(self, leaf: _Leaf) -> None:
        """The best cut of a leaf whose two values keep to the leaf's bounds and to the feature's direction."""
        gl, hl = leaf.g.cumsum(axis=1), leaf.h.cumsum(axis=1)
        g, h = gl[:, -1:], hl[:, -1:]
        value = lambda g, h: np.clip(-g / (h + self.l2), leaf.low, leaf.high)
        worth = lambda g, h, v: -(2 * g * v + (h + self.l2) * v * v)
        a, b = value(gl, hl), value(g - gl, h - hl)
        gain = worth(gl, hl, a) + worth(g - gl, h - hl, b) - worth(g, h, value(g, h))
        gain[(hl < self.least) | (h - hl < self.least) | (self.direction * (b - a) < 0)] = 0
        best = int(gain.argmax())
        leaf.feature, leaf.cell = divmod(best, self.bins)
        leaf.gain, leaf.values = float(gain.flat[best]), (float(a.flat[best]), float(b.flat[best]))


def fit(x: np.ndarray, y: np.ndarray, direction: np.ndarray, trees: int = 80, leaves: int = 12, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Boost the log loss under the constraints of ``direction`` (1: rising, -1: falling, 0: free, for each column of x).

    With no rows, or rows of one label only, every score is the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), *(np.zeros(1, t) for t in (np.int64, np.int64, np.float32, np.int64, np.int64, np.float64)))
    if not 0 < y.sum() < len(y):
        return model
    grower = _Grower(x, bins, direction, l2, least)
    margin = np.full(len(y), model.base)
    nodes: list[list] = []  # feature, limit, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)

        def leaf_of(rows: np.ndarray, value: float, low: float, high: float, sums: tuple | None = None) -> _Leaf:
            nodes.append([0, np.inf, len(nodes), len(nodes), rate * value])
            leaf = _Leaf(len(nodes) - 1, rows, *(sums or grower.histograms(rows, gradient, hessian)), low, high)  # noqa: B023
            grower.split(leaf)
            return leaf

        every = np.arange(len(y))
        open_ = [leaf_of(every, float(-gradient.sum() / (hessian.sum() + l2)), -np.inf, np.inf)]
        roots.append(open_[0].node)
        done = []
        while open_ and len(open_) + len(done) < leaves:
            best = max(open_, key=lambda leaf: leaf.gain)
            if best.gain <= 1e-6:
                break
            open_.remove(best)
            f, (a, b) = best.feature, best.values
            goes = grower.cell[best.rows, f] > best.cell
            turn, middle = int(direction[f]), (a + b) / 2
            bounds = [(best.low, middle if turn > 0 else best.high), (middle if turn > 0 else best.low, best.high)] if turn >= 0 else [(middle, best.high), (best.low, middle)]
            small = bool(goes.sum() * 2 < len(goes))  # the smaller side is counted, the other is what is left
            sums = grower.histograms(best.rows[goes == small], gradient, hessian)
            rest = (best.g - sums[0], best.h - sums[1])
            sides = [leaf_of(best.rows[goes == k], (a, b)[k], *bounds[k], sums if k == small else rest) for k in (False, True)]
            nodes[best.node][:4] = [f, grower.cuts[f][best.cell] if best.cell < len(grower.cuts[f]) else np.inf, sides[0].node, sides[1].node]
            open_ += sides
        for leaf in open_:
            margin[leaf.rows] += nodes[leaf.node][4]
    columns = list(zip(*nodes, strict=True))
    return Trees(model.base, np.array(roots), *(np.array(c, t) for c, t in zip(columns, (np.int64, np.float32, np.int64, np.int64, np.float64), strict=True)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on a bounded sample of labelled rows (see ``labelled_sample``), none of fold 0; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, label, bucket("doc_id", FOLDS) != 0, rows, ["text"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measured(text)[1] for text in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1), batch.column(2)], ["x", "y", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("text", F.col(label).cast("int"), "doc_id").mapInArrow(measure, f"x array<float>, y int, doc_id {kind}").toPandas().sort_values("doc_id")
    x = np.stack(got.x.to_list()) if len(got) else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x, got.y.to_numpy(np.float64), np.array([MONOTONE.get(s, 0) for s in STATISTICS]))


def rules(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Judge every whole text: ``doc_id``, the COUNTS, ``base_failed, score, kept, reason``.

    The base fails texts of under LEAST_WORDS words, and those of whose words over
    MOST_REPEATED percent lie in repeated windows. Of the others, those with a score
    of at least ``keep_from`` are kept: the fitted probability that ``labels.quality`` is
    1. ``reason`` names what a document went by (``short``, ``repeats``, ``score``; null
    if it is kept). A null text has no words and fails the base. Documents without
    a label are judged like any; null ids are kept as ids; repeated rows come out
    repeated; without usable labels every score is the same, at least that of a
    coin. Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(text) for text in utf8(batch.column(1))]
            score = model.value.score(np.stack([x for _, x in found])) if found else np.zeros(0)
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T], pa.array(score, pa.float64())], ["doc_id", *COUNTS, "score"])

    judged = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, score double")
    short, repeats = F.col("n_words") < LEAST_WORDS, 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    reason = F.when(short, "short").when(repeats, "repeats").when(F.col("score") < keep_from, "score")
    return judged.select("doc_id", *COUNTS, (short | repeats).alias("base_failed"), "score", reason.isNull().alias("kept"), reason.alias("reason"))
