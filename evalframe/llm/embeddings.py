"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its nearest reference points (pivots) in order. An
inverted list for every two pivots holds the vectors that have both among their
nearest; vectors on a common list that share enough pivots are compared exactly.
A pair belongs to the list of its two smallest shared pivots alone, so links are
counted once. The number of pivots grows with the square root of the number of
vectors, so that lists stay as long as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, forest, least_hashed

THRESHOLD = 0.98
#: Pivots for a mean list of LIST vectors, within these bounds; they come from up to SAMPLE vectors of least hash for each pivot.
LEAST_PIVOTS, MOST_PIVOTS, LIST, SAMPLE = 32, 16_384, 64, 4
#: Pivots are no closer than the first of these cosines; where that leaves too few, than the next.
APART = (0.9, 0.97, 0.99, 0.999, 0.9999)
#: A vector is described by its DEPTH nearest pivots; vectors that share SHARED of them are compared.
DEPTH, SHARED = 5, 2
#: A longer list is compared block by block.
BLOCK = 1024
#: Pairs of short lists that a task compares at a time; vectors that it describes at a time.
PAIRS, ROWS = 1 << 15, 1024


def pivots_for(n: int, depth: int = DEPTH) -> int:
    """Number of pivots for ``n`` vectors: a vector is on depth * (depth - 1) / 2 lists, and there is one for every two pivots."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(math.sqrt(depth * (depth - 1) * n / LIST))))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` unit vectors of the sample's rows, in their order, as far apart as APART says."""
    x = sample.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None] if len(x) else x
    chosen = np.zeros((0, x.shape[1]))
    for apart in APART:
        for start in range(0, len(x), 256):
            block = x[start : start + 256]
            far = block[(block @ chosen.T).max(axis=1) < apart] if len(chosen) else block
            taken: list[np.ndarray] = []
            for v in far:
                if len(chosen) + len(taken) < most and (not taken or float((np.stack(taken) @ v).max()) < apart):
                    taken.append(v)
            chosen = np.concatenate([chosen, np.stack(taken)]) if taken else chosen
            if len(chosen) == most:
                return chosen
    return chosen


def describe(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first. Rows of another length than the pivots' are cut or padded with zeros."""
    width = pivots.shape[1]
    x = x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    far = -(x @ pivots.T) / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    if depth < far.shape[1]:  # of the nearest alone, in order; ties by number
        near = np.sort(np.argpartition(far, depth - 1, axis=1)[:, :depth], axis=1)
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(far, axis=1, kind="stable")[:, :depth]


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    size = np.diff(ends)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        for start in range(0, len(rows), ROWS):
            own = rows[start : start + ROWS]
            yield own, flat[ends[own][:, None] + np.arange(dim)[None, :]]


def _described(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """The rows with ``dim`` and ``order``, the sorted numbers of their nearest pivots."""
    for batch in batches:
        for rows, x in _by_length(batch.column(3)):
            order = np.sort(describe(x.astype(np.float64), pivots, depth), axis=1).astype(np.int32)
            own = batch.take(pa.array(rows))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), order.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(rows), x.shape[1], np.int32)), lists], [*own.schema.names, "dim", "order"])


def _own(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, shared: int) -> np.ndarray:
    """Which pairs, of sorted pivots a and b, share enough of them, of which p and q are the smallest two."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    small = same & (a < q[:, None]) & (a != p[:, None])
    return (same.sum(axis=1) >= shared) & ~small.any(axis=1)


def _pairs(x: np.ndarray, order: np.ndarray, side: np.ndarray, p: np.ndarray, q: np.ndarray, ends: np.ndarray, threshold: float, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows. ``ends`` is where each row's list ends; of a list with two sides only pairs across are compared."""

    def checked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = (side[i] < 0) | (side[i] != side[j])
        i, j = i[fit], j[fit]
        fit = _own(order[i], order[j], p[i], q[i], shared)
        i, j = i[fit], j[fit]
        near = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
        return i[near], j[near]

    starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
    short = np.repeat(np.diff([*starts, len(ends)]) <= 32, np.diff([*starts, len(ends)]))
    ahead = np.where(short, ends - np.arange(len(ends)) - 1, 0)
    total, start = np.cumsum(ahead), 0
    while start < len(ends):  # the pairs of short lists, many lists at a time
        done = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        own = ahead[start:stop]
        i = np.repeat(np.arange(start, stop), own)
        yield checked(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own))
        start = stop
    for first in starts[~short[starts]]:  # a long list by matrices; what they find is worked out again pair by pair
        last = int(ends[first])
        for at in range(first, last, 256):
            i, j = np.nonzero(x[at : at + 256][: last - at] @ x[at:last].T >= threshold - 1e-9)
            yield checked(i[i < j] + at, j[i < j] + at)


def _lists(batches: Iterator[pa.RecordBatch], threshold: float, shared: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by list: how many vectors each links to, and a spanning forest of the links.

    Rows are (label, dim, p, q, b1, b2, rep, n, block, order, embedding). A list
    may go over several batches; it has at most two blocks.
    """
    held: pa.Table | None = None
    for batch in _then_none(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
        if held is None or not held.num_rows:
            return
        keys = [held.column(k).to_numpy() for k in range(6)]
        begins = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
        whole = int(begins[-1]) if batch is not None and len(begins) else 0 if batch is not None else held.num_rows
        if whole:
            yield from _compared(held.slice(0, whole).combine_chunks(), threshold, shared)
            held = held.slice(whole)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _compared(rows: pa.Table, threshold: float, shared: int) -> Iterator[pa.RecordBatch]:
    """The result of ``_lists`` for whole lists."""
    keys = [rows.column(k).to_numpy() for k in range(6)]
    bounds = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1, [rows.num_rows]])
    size = np.diff(bounds)
    alone = np.repeat(size == 1, size)
    for dim in np.unique(keys[1][~alone]):  # vectors of one length make a matrix
        own = np.flatnonzero((keys[1] == dim) & ~alone)
        picked = rows.take(pa.array(own))
        get = lambda name: picked.column(name).to_numpy()  # noqa: E731, B023
        matrix = lambda name: picked.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)  # noqa: E731, B023
        x = matrix("embedding").astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        _, first, lists = np.unique(np.repeat(np.arange(len(size)), size)[own], return_index=True, return_counts=True)
        ends = np.repeat(first + lists, lists)
        side = np.where(get("b1") == get("b2"), -1, get("block"))
        rep, n = get("rep"), get("n")
        links, left, right = np.zeros(len(own)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _pairs(x, matrix("order"), side, get("p"), get("q"), ends, threshold, shared):
            links += np.bincount(i, n[j], len(own)) + np.bincount(j, n[i], len(own))
            root = forest(len(own), i, j)
            child = np.flatnonzero(root != np.arange(len(own)))
            left.append(child)
            right.append(root[child])
        root = forest(len(own), np.concatenate(left), np.concatenate(right))
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])


def linked(distinct: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """``(a, b, links)`` for distinct vectors ``(label, rep, n, embedding)``: on some list, a is linked to ``links`` vectors and connected with b.

    The driver holds the sample, at most SAMPLE vectors for each pivot, and the
    pivots, at most MOST_PIVOTS, which it broadcasts.
    """
    if not 2 <= shared <= depth:
        raise ValueError("2 <= shared <= depth")
    none = distinct.sparkSession.createDataFrame([], "a long, b long, links long")
    most = pivots or pivots_for(distinct.count(), depth)
    least = least_hashed(distinct, F.xxhash64("embedding"), SAMPLE * most)
    sample = least.orderBy(F.xxhash64("embedding"), "rep").limit(SAMPLE * most).select("embedding").toArrow().column(0).combine_chunks()
    if not len(sample):
        return none
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False)
    common = int(np.bincount(sizes).argmax())  # the length that most of the sample have
    chosen = choose_pivots(np.concatenate([x for _, x in _by_length(sample.filter(pa.array(sizes == common)))]), most)
    used = min(depth, len(chosen))
    held = distinct.sparkSession.sparkContext.broadcast(chosen)
    element = distinct.schema["embedding"].dataType.simpleString()
    rows = distinct.select(F.col("label").cast("long").alias("label"), "rep", "n", "embedding")
    told = cut(rows.mapInArrow(lambda batches: _described(batches, held.value, used), f"label long, rep long, n long, embedding {element}, dim int, `order` array<int>"))
    at = lambda k: F.get("order", k)
    choices = list(combinations(range(used), 2)) or [(0, 0)]
    posted = F.explode(F.array(*[F.struct(at(a).alias("p"), at(b).alias("q")) for a, b in choices])).alias("list")
    keys = ["label", "dim", "p", "q"]
    hot = cut(told.select("label", "dim", posted).groupBy("label", "dim", "list.p", "list.q").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    lists = told.select("label", "dim", posted, "rep", "n", "order", "embedding").select("label", "dim", "list.*", "rep", "n", "order", "embedding")
    n_hot = hot.count()
    if n_hot:
        lists = lists.join(F.broadcast(hot) if n_hot <= 10_000 else hot, keys, "left")
        blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")
        lists = lists.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        lists = lists.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
    else:
        lists = lists.withColumn("block", F.lit(0)).withColumn("b1", F.lit(0)).withColumn("b2", F.lit(0))
    keys += ["b1", "b2"]
    dealt = lists.select(*keys, "rep", "n", "block", "order", "embedding").repartition(*keys).sortWithinPartitions(*keys)
    least = shared if used > 1 else 1
    return dealt.mapInArrow(lambda batches: _lists(batches, threshold, least), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """Vectors of equal label whose cosine is at least ``threshold``: ``vec_id, n_links, component_id, kept``.

    Every row is indexed; the pivots (``pivots`` of them, else as many as
    ``pivots_for`` says) come from a bounded sample. Only exact cosines in double
    precision make links, so none below the threshold; a pair that shares fewer
    than ``shared`` of its ``depth`` nearest pivots is missed (tests measure the
    recall). Null, empty or zero vectors, vectors with null or non-finite
    components, and null labels link with nothing, nor do vectors of different
    lengths; long vectors count whole. Identical vectors are compared once and
    counted by their number. A null vec_id has no links and null component and
    kept. Repeated rows count as vectors of their own. With one pivot, or none,
    all vectors of a label and length are on one list. Other columns are not
    looked at.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    whole = F.col("embedding").cast(kind)
    # Equal vectors are found by two hashes of 64 bits with different seeds.
    rows = vectors.select("vec_id", "label", whole.alias("embedding"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & (square > 0), F.lit(False))
    good = rows.where(usable)
    same = ["label", "h1", "h2"]
    distinct = cut(good.groupBy(*same).agg(F.first("embedding").alias("embedding"), F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("n")))
    found = cut(linked(distinct, threshold, depth, shared, pivots))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select("a", "b"))
    classes = distinct.select(*same, "rep", "n").join(counts, F.col("rep") == counts.a, "left").join(joined, F.col("rep") == joined.node, "left")
    classes = cut(classes.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    with_class = good.join(classes, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return with_class.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
