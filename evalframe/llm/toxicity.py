"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the vectors of hashes of the word and of its
beginnings, so that forms of one stem share what they teach. Filters of one, two
and three words slide over the whole text, each keeps its largest response, and
a logistic unit weighs those. Fitted in numpy on a bounded sample; a part of the
sample that the filters do not see calibrates the score and sets a threshold for
each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, labelled_sample, utf8, within_bytes
from .decontam import words

FOLDS, HELD_OUT = 4, 2
#: The classifier is fitted on at most so many labelled rows, of so many bytes together; texts of any length are among them.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 24_000_000
THRESHOLD = 0.3
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 8
WORD_ROWS, STEM_ROWS = 1 << 17, 1 << 16
#: A row of the table that stays zero; it stands in for rows that fewer than LEAST_TEXTS of the learned texts use.
UNUSED, LEAST_TEXTS = 2 * WORD_ROWS + STEM_ROWS, 3
#: A small sample is gone over more than EPOCHS times: until LEAST_STEPS steps are made, or VISITS words (a bound of the fit's time) are seen.
EPOCHS, BATCH, LEAST_STEPS, VISITS = 4, 32, 700, 8_000_000
#: Responses of so many words are remembered in a task at most.
REMEMBERED = 150_000
#: Positions of texts that are looked at together.
POSITIONS = 100_000
PARTS = [(w, j) for w in WIDTHS for j in range(w)]


def rows_of(word: bytes) -> tuple[int, int, int, int]:
    """Rows of the embedding table that make up a word: two of the word's own, two of its beginnings."""
    h = xxhash.xxh64_intdigest(word)
    stems = (xxhash.xxh64_intdigest(word[:k], k) % STEM_ROWS + 2 * WORD_ROWS for k in (4, 5))
    return (h % WORD_ROWS, (h >> 32) % WORD_ROWS + WORD_ROWS, *stems)


@dataclass
class Net:
    table: np.ndarray  # embedding rows x DIM
    filters: dict[tuple[int, int], np.ndarray]  # (width, place) -> DIM x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _new(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    filters = {part: rng.normal(0, 0.5, (DIM, FILTERS)).astype(np.float32) for part in PARTS}
    n = len(WIDTHS) * FILTERS
    return Net(np.zeros((UNUSED + 1, DIM), np.float32), filters, np.full(n, 0.05, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)


def _largest(parts: Callable[[int, int], dict[tuple[int, int], np.ndarray]], blank: np.ndarray, starts: np.ndarray, limit: int = POSITIONS) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each text, and its position.

    ``parts(a, b)`` says what each place of a filter adds at positions a to b. Two
    blank positions end each text, from which no filter reaches into the next.
    ``limit`` positions are looked at together, so a long text needs no more
    memory than many short ones.
    """
    n = len(blank)
    text = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    columns = len(WIDTHS) * FILTERS
    top, place = np.full((len(starts), columns), -np.inf, np.float32), np.zeros((len(starts), columns), np.int64)
    for a in range(0, n, limit):
        b = min(n, a + limit)
        part = parts(a, min(n, b + max(WIDTHS) - 1))
        response = np.empty((b - a, columns), np.float32)
        for k, w in enumerate(WIDTHS):
            own = part[w, 0][: b - a].copy()
            for j in range(1, w):
                more = part[w, j][j : j + b - a]
                own[: len(more)] += more
            response[:, k * FILTERS : (k + 1) * FILTERS] = own
        response[blank[a:b]] = 0
        of = text[a:b] - text[a]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        best = np.maximum.reduceat(response, first, axis=0)
        where, which = np.nonzero(response >= best[of])
        key, found = np.unique(of[where] * columns + which, return_index=True)
        at = np.zeros(best.size, np.int64)
        at[key] = where[found] + a
        own = slice(text[a], text[b - 1] + 1)
        better = best > top[own]
        place[own] = np.where(better, at.reshape(best.shape), place[own])
        top[own] = np.maximum(top[own], best)
    return top, place


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, key: object, value: np.ndarray, gradient: np.ndarray) -> None:
        total = self.sums.setdefault(key, np.full_like(value, 1e-3))
        total += gradient**2
        value -= self.rate * gradient / np.sqrt(total)


def epochs_for(texts: int, positions: int) -> int:
    """Times that a sample of so many texts, with so many words and blanks together, is gone over."""
    steps, visits = -(-texts // BATCH), VISITS // max(1, positions)
    return max(EPOCHS, min(-(-LEAST_STEPS // max(1, steps)), visits))


def _learn(net: Net, texts: list[np.ndarray], y: np.ndarray, batch: int = BATCH, rate: float = 0.08) -> None:
    """Train on texts given as (words + 2) x 4 arrays of table rows; the last two are blank (-1)."""
    rng = np.random.default_rng(11)
    used = np.zeros((2, UNUSED + 1))
    for rows, label in zip(texts, y, strict=True):
        used[int(label), np.unique(rows[:-2])] += 1
    texts = [np.where((rows >= 0) & (used.sum(axis=0)[rows] < LEAST_TEXTS), UNUSED, rows) for rows in texts]
    # The first coordinate begins with how much more often toxic texts use the row, shrunk where that rests on few texts.
    odds = np.log((used[1] + 0.5) / (used[0] + 0.5) * (y < 0.5).sum() / (y > 0.5).sum()) * used[1] / (used[1] + 3)
    net.table[:, 0] = 0.25 * np.maximum(odds, 0)
    net.table[UNUSED] = 0
    step = _Adagrad(rate)
    sums = np.full(len(net.table), 1e-3, np.float32)
    for _ in range(epochs_for(len(texts), sum(map(len, texts)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            rows = np.concatenate([texts[i] for i in own])
            starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])[:-1]])
            blank = rows[:, 0] < 0

            def vectors(rows: np.ndarray) -> np.ndarray:
                return np.where(rows[..., :1] < 0, np.float32(0), net.table[rows].sum(axis=-2))

            def parts(a: int, b: int, rows: np.ndarray = rows) -> dict[tuple[int, int], np.ndarray]:
                vector = vectors(rows[a:b])
                return {p: vector @ f for p, f in net.filters.items()}

            top, place = _largest(parts, blank, starts)
            top = top + net.bias
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.out_bias, -30, 30)))
            dz = ((p - y[own]) / len(own)).astype(np.float32)
            d_top = dz[:, None] * net.out[None, :] * (top > 0)
            touched, change, d_filter = [], [], {}
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    pos = np.where(rows[place[:, cols], 0] < 0, place[:, cols], np.minimum(place[:, cols] + j, len(rows) - 1))
                    g = d_top[:, cols]
                    d_filter[w, j] = np.einsum("nfd,nf->df", vectors(rows[pos]), g)
                    touched.append(pos.ravel())
                    change.append((g[:, :, None] * net.filters[w, j].T[None, :, :]).reshape(-1, DIM))
            pos, change = np.concatenate(touched), np.concatenate(change)
            live = (rows[pos, 0] >= 0) & (np.abs(change).sum(axis=1) > 0)
            pos, change = pos[live], change[live]
            if len(pos):
                target, back = np.unique(rows[pos].ravel(), return_inverse=True)
                gradient = np.zeros((len(target), DIM), np.float32)
                np.add.at(gradient, back, np.repeat(change, rows.shape[1], axis=0))
                sums[target] += (gradient**2).mean(axis=1)
                net.table[target] -= rate * gradient / np.sqrt(sums[target])[:, None] + 1e-4 * net.table[target]
                net.table[UNUSED] = 0
            for part, g in d_filter.items():
                step.step(part, net.filters[part], g)
            step.step("bias", net.bias, d_top.sum(axis=0))
            step.step("out", net.out, active.T @ dz)
            net.out_bias -= rate * float(dz.sum())


def _calibrate(net: Net, z: np.ndarray, y: np.ndarray, lang: np.ndarray, least: int = 8) -> None:
    """Fit probability = sigmoid(scale z + shift), then a threshold for each language: the middle of those with the best F1."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    at, drawn = np.array([1.0, 0.0]), np.array([1.0, 0.0])  # a weak pull keeps both finite where the classes lie apart

    def loss(at: np.ndarray) -> float:
        m = at[0] * z + at[1]
        return float((np.logaddexp(0, m) - target * m).sum() + 0.005 * ((at - drawn) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -30, 30)))
        w, r = p * (1 - p), p - target
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 0.01 * np.eye(2)
        change = np.linalg.solve(hessian, np.array([(r * z).sum(), r.sum()]) + 0.01 * (at - drawn))
        now, share = loss(at), 1.0
        while loss(at - share * change) > now and share > 1e-6:  # a whole step may overshoot
            share /= 2
        at = at - share * change
        if np.abs(share * change).max() < 1e-6:
            break
    if at[0] > 0:
        net.scale, net.shift = float(at[0]), float(at[1])
    p = net.probability(z)

    def best(p: np.ndarray, y: np.ndarray) -> float:
        grid = np.linspace(0.2, 0.7, 51)
        f1 = np.array([2 * (y[p >= t].sum()) / max(1, (p >= t).sum() + y.sum()) for t in grid])
        return float(grid[f1 >= f1.max() - 1e-9].mean())

    if y.sum() >= least:
        net.threshold = best(p, y)
    for code in sorted({x for x in lang if x is not None}):
        own = lang == code
        if y[own].sum() >= least:
            net.thresholds[code] = best(p[own], y[own])


class Scorer:
    """Scores texts in one task; what a word adds to the filters is worked out once."""

    def __init__(self, net: Net):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.part = {p: np.zeros((1, FILTERS), np.float32) for p in PARTS}

    def _add(self, new: list[bytes]) -> None:
        vector = self.net.table[np.array([rows_of(w) for w in new])].sum(axis=1)
        for p, f in self.net.filters.items():
            self.part[p] = np.concatenate([self.part[p], vector @ f])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def margins(self, texts: list[bytes], most_words: int = 200_000) -> np.ndarray:
        out: list[np.ndarray] = []
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            group.append(words(text))
            size += len(group[-1])
            if size >= most_words:
                out.append(self._group(group))
                group, size = [], 0
        return np.concatenate([*out, self._group(group)]) if group or out else np.zeros(0)

    def _group(self, group: list[list[bytes]]) -> np.ndarray:
        if not group:
            return np.zeros(0)
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list({w for found in group for w in found if w not in self.known})
        if new:
            self._add(new)
        flat = [w for found in group for w in (*found, b"", b"")]
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        starts = np.concatenate([[0], np.cumsum([len(found) + 2 for found in group])[:-1]])
        top, _ = _largest(lambda a, b: {p: x[index[a:b]] for p, x in self.part.items()}, index == 0, starts)
        return np.maximum(top + self.net.bias, 0) @ self.net.out + self.net.out_bias


def _as_rows(text: bytes) -> np.ndarray:
    return np.array([*map(rows_of, words(text)), (-1,) * 4, (-1,) * 4], np.int32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Net:
    """Fit on a bounded sample of labelled rows (see ``labelled_sample``), none of the held-out fold."""
    columns = ["text"] + ["lang"] * ("lang" in docs.columns)
    sample = labelled_sample(docs, labels, label, bucket("doc_id", FOLDS) != HELD_OUT, rows, columns)
    got = within_bytes(sample, SAMPLE_BYTES).toPandas().sort_values("doc_id")
    y = got[label].to_numpy(np.float64)
    net = _new()
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.scale, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    texts = [x.encode() for x in got.text]
    apart = np.array([xxhash.xxh32_intdigest(str(i)) % 5 == 0 for i in got.doc_id])
    if not 0 < y[apart].sum() < apart.sum() or y[~apart].sum() == 0:
        apart = np.zeros(len(y), bool)
    known: dict[bytes, np.ndarray] = {}
    learn_from = [known.setdefault(t, _as_rows(t)) if t not in known else known[t] for t, skip in zip(texts, apart, strict=True) if not skip]
    _learn(net, learn_from, y[~apart])
    check = apart if apart.any() else ~apart
    z = Scorer(net).margins([t for t, own in zip(texts, check, strict=True) if own])
    lang = got.lang.to_numpy(object) if "lang" in got else np.array([None] * len(got), object)
    _calibrate(net, z, y[check], lang[check])
    return net


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``, the columns in ``carry``, and ``rejected``.

    The score is the calibrated probability that ``labels.toxic`` is 1;
    ``predicted`` is 1 from ``threshold`` on; ``rejected`` applies the threshold
    calibrated for the document's language (``lang``, if there is such a column;
    that of all languages where it is null or was too rare to calibrate).
    Texts of any length are scored whole. Null and empty texts have no words: they
    score as a text in which no filter responds. Null ids are kept; repeated rows come out repeated; without usable
    labels every score is the same. Other columns are not looked at.
    """
    net = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"), *[c for c in carry if c not in ("doc_id", "text", "lang")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "text" or "text" in carry) + ", score double"
    names = [f.name for f in chosen.schema.fields if f.name != "text" or "text" in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(held.value)
            score = held.value.probability(scorer.margins(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(score, pa.float64())], [*names, "score"])

    limits = F.lit(net.threshold)
    for code, value in net.thresholds.items():
        limits = F.when(F.col("lang") == code, F.lit(value)).otherwise(limits)
    return chosen.mapInArrow(run, schema).select(
        "doc_id", *[c for c in carry if c != "doc_id"], (bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= limits).alias("rejected"),
    )
