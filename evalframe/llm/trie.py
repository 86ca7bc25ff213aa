"""Conversation prefix trie: what conversations begin with in common, rolled up to all ancestors by pointer jumping.

A node is a sequence of first turns, named by a digest of 128 bits, with an edge
to the digest of the sequence without its last turn. Digests are running sums of
hashes that know their place, so a conversation of any length is cut by ranges
and scanned in parallel. Sums over subtrees take as many rounds as the depth has
binary digits: in round k a node hands its sum so far to the ancestor 2^k above
and then points 2^(k+1) above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A conversation shares up to SHARED - 1 opening turns with the one whose id is the next lower multiple of BLOCK.
SHARED, BLOCK = 6, 100
#: Ids that are joined in one piece before pieces of a node meet.
PIECE = 4096
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows by range of ``key`` and ``order``, sorted, and written; ``__part`` is the number of the range. A key may go over several."""
    return cut(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__part", F.spark_partition_id()))


def running(rows: DataFrame, key: str, sums: list[str], count: str | None = None) -> DataFrame:
    """Running values along each ``key`` (a long, never null) of rows that ``dealt`` has dealt.

    Adds ``count``, the rows of the key so far, and for each column s of ``sums``
    (longs, added modulo 2^64) the sum with this row, under its own name, and
    ``s_before``, the sum without it. Only one row per range, what the range's last key
    has come to, passes the driver.
    """
    names, kind = rows.columns, rows.schema

    def along(batch: pa.RecordBatch, state: dict) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Counts, sums and values of a batch; ``state`` holds key, count and sums of the last row before it, and then of its own last row."""
        k = batch.column(names.index(key)).to_numpy(zero_copy_only=False).astype(np.int64)
        values = [np.ones(len(k), np.uint64), *[batch.column(names.index(s)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for s in sums]]
        begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        own = np.repeat(begins, np.diff(np.concatenate([begins, [len(k)]])))
        out = []
        for x, carried in zip(values, state["sums"], strict=True):
            all_ = np.cumsum(x, dtype=np.uint64)
            total = all_ - (all_ - x)[own]
            if state["key"] is not None and k[0] == state["key"]:
                first = slice(0, begins[1] if len(begins) > 1 else len(k))
                total[first] += carried
            out.append(total)
        state |= {"key": int(k[-1]), "sums": [x[-1] for x in out]}
        return out, values

    def fresh() -> dict:
        return {"key": None, "sums": [np.uint64(0)] * (1 + len(sums))}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = fresh(), None
        for batch in batches:
            if batch.num_rows:
                along(batch, state)
                part = batch.column(names.index("__part"))[0].as_py()
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "key": state["key"], "sums": [int(x.view(np.int64)) for x in state["sums"]]}], pa.schema([("part", pa.int32()), ("key", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    carried: dict[int, dict] = {}
    before = fresh()
    for r in sorted(rows.mapInArrow(ends, "part int, key long, sums array<long>").collect(), key=lambda r: r.part):
        carried[r.part] = before
        own = [np.int64(x).view(np.uint64) for x in r.sums]
        with np.errstate(over="ignore"):
            before = {"key": r.key, "sums": [a + b for a, b in zip(own, before["sums"], strict=True)] if r.key == before["key"] else own}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = dict(carried[batch.column(names.index("__part"))[0].as_py()])
            out, values = along(batch, state)
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            if count:
                columns[count] = pa.array(out[0].view(np.int64))
            for s, total, x in zip(sums, out[1:], values[1:], strict=True):
                columns[s], columns[f"{s}_before"] = pa.array(total.view(np.int64)), pa.array((total - x).view(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    return rows.mapInArrow(scan, schema + (f", `{count}` long" if count else "") + "".join(f", `{s}_before` long" for s in sums))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, said, chars`` of each turn: a SHA-256 of role and text, and the text's code points. Texts go no further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.length(text).cast("long").alias("chars"))


def opening(conv_id: Column) -> Column:
    """How many turns of its block's first conversation a conversation opens with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, said, chars``: each conversation with the opening of its block's first one in place of its own, in the order of ``at``; a row without ``said`` at 0 stands for the conversation itself."""
    placed = running(dealt(turns(conversations), "conv_id", ["turn", "said"]), "conv_id", [], "at").select("conv_id", "at", "said", "chars")
    known = placed.select("conv_id").distinct()
    heads = placed.where((F.col("conv_id") % BLOCK == 0) & (F.col("at") < SHARED)).withColumnRenamed("conv_id", "base")
    shared = known.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "base").where(F.col("at") <= opening(F.col("conv_id")))
    own = placed.where(F.col("at") > opening(F.col("conv_id")))
    itself = known.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(shared.select(*own.columns)).unionByName(itself)


@dataclass
class Trie:
    """``nodes`` with their sums, and ``ends``: the conversations that end at a node, each at one."""

    nodes: DataFrame  # depth, k1, k2, said, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    ends: DataFrame  # depth, k1, k2, conv_id


def build(conversations: DataFrame) -> Trie:
    """The trie over rows of ``conv_id, at, said, chars`` as ``rebuilt`` gives them: turns in the order of ``at``, after a row without ``said`` for each conversation."""
    deep = running(dealt(conversations, "conv_id", ["at"]), "conv_id", [], "depth").withColumn("depth", F.col("depth") - 1)
    lane = lambda *x: F.when(F.col("said").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*x))
    hashed = deep.withColumns({"k1": lane("depth", "said"), "k2": lane(F.lit("second"), "said", "depth")})
    steps = cut(running(hashed, "conv_id", ["k1", "k2"]).select(*NODE, F.col("k1_before").alias("p1"), F.col("k2_before").alias("p2"), "conv_id", "said", "chars"))
    one = [F.max(c).alias(c) for c in ("p1", "p2", "chars", "said")]  # alike in all conversations of a node
    nodes = cut(steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *one))
    children = cut(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")))
    whole = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}
    below = rolled_up(whole.select(*NODE, "p1", "p2", *[c.alias(n) for n, c in own.items()]), list(own))
    total = lambda n: (F.col(n) + F.coalesce(f"more_{n}", F.lit(0).cast("long"))).alias(n)
    summed = cut(whole.withColumns(own).join(below, NODE, "left").select(*whole.columns, *[total(n) for n in own]))
    above = cut(nodes.select(F.col("depth").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2"), F.col("conv_id").alias("parent_conv_id")))
    edge = (F.col("depth") - 1 == F.col("__d")) & (F.col("p1") == F.col("__1")) & (F.col("p2") == F.col("__2"))
    full = summed.join(above, edge, "left").select(*NODE, "said", "conv_id", "parent_conv_id", "n_convs", "n_children", *own)
    last = steps.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("end.*", "conv_id")
    return Trie(full, last)


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """What the descendants of each node have in sum: ``more_<value>`` by node, for nodes that have any.

    ``nodes`` are ``depth, k1, k2``, the parent's ``p1, p2`` and the values. In each
    round only nodes that still have an ancestor at the distance are looked at, so
    rounds after the first few are about long conversations alone; every sum combines
    before its shuffle, so a node may have a third of all nodes as its children.
    """
    active = nodes.where("depth > 0")
    handed, reach = [], 1
    while True:
        to = [(F.col("depth") - reach).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
        given = cut(active.groupBy(*to).agg(*[F.sum(v).alias(f"more_{v}") for v in values]))
        handed.append(given)
        still = active.where(F.col("depth") >= 2 * reach)
        if still.isEmpty():
            break
        # A node's pointer has a pointer of its own: that is where it points next.
        points = active.select(F.col("depth").alias("__d"), F.col("k1").alias("__1"), F.col("k2").alias("__2"), F.col("p1").alias("__p1"), F.col("p2").alias("__p2"))
        on = (F.col("depth") - reach == F.col("__d")) & (F.col("p1") == F.col("__1")) & (F.col("p2") == F.col("__2"))
        ahead = cut(still.join(points, on).select(*NODE, F.col("__p1").alias("p1"), F.col("__p2").alias("p2"), *values))
        grown = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0).cast("long"))).alias(v) for v in values]
        active = cut(ahead.join(given, NODE, "left").select(*NODE, "p1", "p2", *grown))
        reach *= 2
    every = reduce(DataFrame.unionByName, handed)
    return cut(every.groupBy(*NODE).agg(*[F.sum(f"more_{v}").alias(f"more_{v}") for v in values]))


def joined_digests(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` by node: SHA-256 of the ids in ascending order, joined by commas.

    Ids are joined in pieces by range; then a node's pieces run through one digest,
    batch after batch, so neither step holds a node's ids together.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, a, b, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            at = np.unique(np.concatenate([np.arange(f, t, PIECE) for f, t in zip(new, [*new[1:], len(d)], strict=True)]))
            text = [",".join(map(str, ids[f:t].tolist())) for f, t in zip(at, [*at[1:], len(d)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(a[at]), pa.array(b[at]), pa.array(ids[at]), pa.array(text)], [*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running_ = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *node, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if node != key:
                    if key is not None:
                        out.append((*key, running_.hexdigest()))
                    key, running_ = node, hashlib.sha256(ids.encode())
                else:
                    running_.update(b"," + ids.encode())
            yield rows(out)
        if key is not None:
            yield rows([(*key, running_.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    in_order = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = in_order.mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations of a table (``conv_id, turn, role, text``) after each took over the opening of its block (see ``rebuilt``).

    One row per node: ``conv_id`` (least member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256`` and ``node`` (its digest).
    Turns stand in the order of ``turn``, null first; those of one ``turn`` in
    that of the digest of role and text, and equal ones count as many times as
    they are there. Null roles and texts are empty. Rows without a ``conv_id``
    belong to no conversation and are left out. Other columns are not looked at. A
    table without conversations has no node.
    """
    trie = build(rebuilt(conversations))
    ends = cut(joined_digests(trie.ends))
    got = cut(trie.nodes).join(ends, NODE, "left")
    node = F.concat_ws("-", F.col("depth").cast("string"), F.lpad(F.lower(F.hex("k1")), 16, "0"), F.lpad(F.lower(F.hex("k2")), 16, "0"))
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), node.alias("node"))


def with_last_turn(trie: Trie, conversations: DataFrame) -> DataFrame:
    """The nodes with ``role`` and ``text`` of their last turn (the root has none)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said")
    texts = conversations.where(F.col("conv_id").isNotNull()).select(said, role, text).dropDuplicates(["said"])
    return trie.nodes.join(texts, "said", "left")
