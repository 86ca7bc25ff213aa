"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests) a folder of our own is taken.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; on a cluster ``spark.checkpoint.dir`` must name it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches sorted by their first ``keys`` columns, cut so that no key goes over two pieces."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        new = tuple(column.to_numpy(zero_copy_only=False) for column in batch.columns)
        if not len(new[0]):
            continue
        begins = np.flatnonzero(np.any([c[1:] != c[:-1] for c in new[:keys]], axis=0)) + 1
        goes_on = held and all(held[-1][k][-1] == new[k][0] for k in range(keys))
        if goes_on and not len(begins):
            held.append(new)
            continue
        last = int(begins[-1]) if len(begins) else 0
        whole = [*held, tuple(c[:last] for c in new)] if last else held
        if whole:
            yield tuple(np.concatenate(c) for c in zip(*whole, strict=True))
        held = [tuple(c[last:] for c in new)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of ``n`` rows reaches by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def least_hashed(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """Of ``rows``, those that can be among the ``most`` of least hash: few more than these, so that what is sorted does not grow with the table.

    The first 16 bits of the hashes are counted, the counts (65,536 at most) added
    up on the driver, and rows beyond the cell that the last wanted row lies in left out.
    """
    cell = F.shiftright(hashed, 48)
    reached, limit = 0, None
    for r in sorted(rows.groupBy(cell.alias("cell")).count().collect(), key=lambda r: r.cell):
        reached, limit = reached + r["count"], r.cell
        if reached >= most:
            break
    return rows if limit is None else rows.where(cell <= limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, columns: list[str]) -> DataFrame:
    """At most ``most`` labelled documents to fit a classifier on, with ``label`` as 0 or 1.

    ``learn`` is the condition on ``doc_id`` under which a row may be learned
    from. The sample is the rows of least hash, so it is the same in each run.
    Documents without a text are not in it; one with more than one label has the
    largest. The chosen labels are at most ``most`` rows, which is why they may
    be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias(label))
    least = least_hashed(cut(known.where(learn)), F.xxhash64("doc_id"), most)
    chosen = least.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", *columns)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(*[F.min(c).alias(c) for c in columns])


def within_bytes(sample: DataFrame, most_bytes: int) -> DataFrame:
    """Rows of a sample (``doc_id, text``, as many as ``labelled_sample`` gives) in the order of their hash, up to the one whose text reaches ``most_bytes`` in all; a text's own length does not keep it out."""
    held = cut(sample)
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.select("doc_id", F.octet_length("text").cast("long").alias("n")).select("doc_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return held.join(F.broadcast(sizes.where(F.col("before") < most_bytes).select("doc_id")), "doc_id", "left_semi")


def bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` of non-null longs.

    Returns ``(node, component)`` for every node that is not the smallest of
    its component; ``component`` is the smallest node reachable.

    Alternating large-star and small-star rounds: a component of diameter d
    takes O(log d) of them. Every step is an aggregate that combines before its
    shuffle or a join of the edges with one row per node, read from checkpoints
    on both sides, so that adaptive execution can split a hub's partition.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    star, seen = cut(ends.distinct()), None
    for _ in range(most_rounds):
        state = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1000003)).first()
        if state == seen or not state[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
