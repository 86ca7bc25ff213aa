"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes a vector of eight bit counts, one for each segment
of eight bits. The Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints, nor does the difference of any sum of
counts. The range join runs on a grid: bits are dealt to G groups, and since a
distance of 3 touches three groups at most, linked fingerprints agree on all bits
of G - 3 groups. Each choice of those is a projection, whose cells (equal bits
there) have the count of the other bits as their coordinate. A fingerprint meets
those of its own and of the next three coordinates; the Manhattan bound and then
the exact Hamming distance decide. G grows with the number of fingerprints, so
that a cell holds few of them at every size; all choices find the same links.

A similarity of shingle sets such as 0.8 leaves more differing bits than 64 can
tell apart from chance, and more than three groups. ``one_of_each`` therefore
takes wide fingerprints, cells of equal bits in bands, and the same bound and
exact distance within a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, forest, utf8, whole_groups

WORDS, BITS = 3, 3
#: Numbers of groups; the first is taken that leaves MEET fingerprints or fewer to a cell if all are equally likely.
GROUPS, MEET = (4, 5, 6, 8, 10), 4
#: Cells of more fingerprints are joined through the fingerprints between, in rows that grow in proportion.
BLOCK = 1024
#: Pairs that a task compares at a time.
PAIRS = 1 << 20
#: Words of a wide fingerprint; fingerprints that share a key of a band on average, at most; probability with which bands bring a pair at the bound together.
WIDE, CELL, RECALL = 8, 64, 0.97
#: A segment's bits moved to its low end: the bits in which two of those differ are the difference of the counts.
UNARY = np.array([(1 << b.bit_count()) - 1 for b in range(256)], np.uint8)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``n``-word shingle, repeats included; a text of fewer words is one shingle, one of none has none."""
    found = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= n:
        shingles = [joined]
    else:
        stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        start = np.concatenate([[0], stop[:-1]])
        shingles = [joined[a:b] for a, b in zip(start[: len(found) - n + 1].tolist(), (stop[n - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """64-bit SimHash of the ``n``-word shingles, as a signed 64-bit integer; no words give 0."""
    h = shingle_hashes(text, n).astype("<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row; fp is the fingerprint as a long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(text) for text in utf8(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def groups_for(n: int) -> int:
    """Number of groups for ``n`` distinct fingerprints."""
    return next((g for g in GROUPS if n <= MEET << 64 * (g - BITS) // g), GROUPS[-1])


def projections(groups: int) -> list[int]:
    """Masks of the bits that must agree, one for each choice of all groups but three (signed)."""
    group = [sum(1 << b for b in range(64 * g // groups, 64 * (g + 1) // groups)) for g in range(groups)]
    masks = [sum(group[g] for g in chosen) for chosen in combinations(range(groups), groups - BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def embed(fp: np.ndarray) -> np.ndarray:
    """The eight segment counts in unary, packed in 64 bits: the bits in which two of these differ are their Manhattan distance."""
    return UNARY[np.ascontiguousarray(fp).view(np.uint8)].view(np.uint64)


def close(fp: np.ndarray, cell: np.ndarray, count: np.ndarray, bits: int = BITS, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Linked pairs of rows sorted by (cell, count), and how many candidates the grid gave for them; PAIRS words are compared at a time.

    ``fp`` has a row of 64-bit words for each fingerprint and ``count`` the ones
    among the bits in which those of a cell may differ. With ``side``, a pair on
    one side (0 or 1) is no candidate; -1 is on both.
    """
    words = fp.shape[1]
    key = cell * (64 * words + bits + 1) + count
    ahead = np.searchsorted(key, key + bits, "right") - np.arange(len(key)) - 1
    grid, total = embed(fp), np.cumsum(ahead)
    start = 0
    while start < len(key):
        done = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PAIRS // words, "right")))
        own = ahead[start:stop]
        i = np.repeat(np.arange(start, stop), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        if side is not None:
            across = (side[i] < 0) | (side[i] != side[j])
            i, j = i[across], j[across]
        near = np.bitwise_count(grid[i] ^ grid[j]).sum(axis=1, dtype=np.int32) <= bits
        a, b = i[near], j[near]
        near = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int32) <= bits
        yield a[near], b[near], len(i)
        start = stop


def _join(batches: Iterator[pa.RecordBatch], masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each cell's links, from rows (projection, code, fp, rep) sorted by cell."""
    for projection, code, fp, rep in whole_groups(batches, 2):
        fp = fp.view(np.uint64)
        count = np.bitwise_count(fp & ~masks[projection]).astype(np.int64)
        cell = np.cumsum(np.concatenate([[0], (projection[1:] != projection[:-1]) | (code[1:] != code[:-1])]))
        order = np.argsort(cell * 128 + count, kind="stable")
        fp, rep = fp[order], rep[order]
        for a, b, _ in close(fp[:, None], cell[order], count[order]):
            if len(a):
                root = forest(len(fp), a, b)
                child = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]])], ["a", "b"])


def _through(crowded: DataFrame, masks: list[int]) -> DataFrame:
    """Links of crowded cells, from rows (projection, fp, rep): enough of them to connect all that is linked.

    Of two fingerprints at distance 3 or less there is one between that one of
    them reaches by one flipped bit at most and the other by two. Each row is
    dealt to all that it reaches by two flips of the bits in which its cell may
    differ; those who meet at one that any of them reaches by one flip are
    connected. Rows and groups are bounded by the bits (1,177 at most), not by the cell.
    """
    free = [(k, [b - (1 << 64) if b >> 63 else b for b in (1 << p for p in range(64)) if not m & b]) for k, m in enumerate(masks)]
    table = F.broadcast(crowded.sparkSession.createDataFrame(free, "projection int, bits array<long>"))  # a row for each projection, at most 120
    two = F.flatten(F.transform("bits", lambda x, i: F.transform(F.slice("bits", i + 2, F.size("bits")), lambda y: x.bitwiseOR(y))))
    reached = crowded.join(table, "projection").select(
        "projection", "fp", "rep", F.size("bits").alias("one"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.col("bits"), two)).alias("at", "flip")
    )
    meets = reached.groupBy("projection", F.col("fp").bitwiseXOR(F.col("flip")).alias("between")).agg(
        F.max(F.col("at") <= F.col("one")).alias("by_one"), F.collect_list("rep").alias("reps")
    ).where("by_one and size(reps) > 1")
    return meets.select(F.explode("reps").alias("a"), F.array_min("reps").alias("b")).where("a <> b").distinct()


def links(distinct: DataFrame, groups: int | None = None) -> DataFrame:
    """Links between distinct fingerprints ``(fp, rep)`` as ``(a, b)`` of reps, enough of them to connect all that is linked.

    Cells of at most BLOCK fingerprints give a spanning forest of their links, in
    one task each. The fingerprints of larger ones meet through those between
    them (``_through``), so no cell is compared with all of itself.
    """
    masks = projections(groups or groups_for(distinct.count()))
    codes = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("projection", "code")
    cells = distinct.select("fp", "rep", codes)
    hot = cut(cells.groupBy("projection", "code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).drop("n"))
    n_hot = hot.count()
    keys = ["projection", "code"]
    rest = cells
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= 10_000 else hot
        rest = cells.join(hot, keys, "left_anti")
    dealt = rest.select(*keys, "fp", "rep").repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(lambda batches: _join(batches, np.array(masks, np.int64).view(np.uint64)), "a long, b long")
    return found.unionByName(_through(cells.join(hot, keys, "left_semi"), masks)) if n_hot else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicates: fingerprints link at BITS or fewer differing bits.

    Returns per input row the id, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable by links, itself included) and
    ``kept`` (the row's id is the component's). Texts of any length count whole.
    Null and empty texts and texts without words have the fingerprint zero, which
    links like any other. A row whose id is null gets its fingerprint, links
    nothing, and has a null component. Repeated rows come out repeated. Other
    columns are not looked at.
    """
    found = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text"))
    distinct = cut(found.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    # A fingerprint's own number is its node, so that different texts of one id are told apart.
    joined = connected_components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    group = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    least = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    component = cut(group.join(least, "group").select("fp", "component_id"))
    return found.join(component, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def wide_fingerprint(text: bytes, n: int) -> bytes:
    """SimHash of WIDE words of 64 bits over the set of ``n``-word shingles; no words give zeros."""
    h = np.unique(shingle_hashes(text, n))
    out = np.zeros((WIDE, 64), np.uint8)
    for k in range(WIDE if len(h) else 0):
        mixed = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)  # a different odd factor for each word
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(mixed), 65536):
            ones += np.unpackbits(mixed[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = 2 * ones > len(h)
    return np.packbits(out, bitorder="little").tobytes()


def bits_of(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which sets count as of this Jaccard similarity: what is expected there and one standard deviation.

    Sets of similarity s and equal size have the cosine 2 s / (1 + s); a bit
    differs with the angle's share of a half turn.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * WIDE * share + math.sqrt(64 * WIDE * share * (1 - share)))


def bands_for(n: int, bits: int) -> np.ndarray:
    """Which bits make up the key of each band, for ``n`` fingerprints.

    A band has as many bits as leave about CELL fingerprints to a key; there are
    as many bands as bring a pair at exactly ``bits`` differing bits together
    with probability RECALL, and closer pairs with a higher one.
    """
    size = max(4, n.bit_length() - CELL.bit_length())
    agree = (1 - bits / (64 * WIDE)) ** size
    rng = np.random.default_rng(size)
    return np.stack([rng.choice(64 * WIDE, size, replace=False) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))])


def wide_links(distinct: DataFrame, bits: int) -> DataFrame:
    """Links ``(a, b)`` between nodes of wide fingerprints ``(node, fp)`` that differ in ``bits`` or fewer bits: of each cell a spanning forest.

    A cell holds what agrees in all bits of a band; in it the Manhattan distance
    of the segment counts and then the exact distance decide. Cells of more than
    BLOCK are dealt out as pairs of blocks.
    """
    bands = bands_for(distinct.count(), bits)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WIDE)
            on = np.unpackbits(raw, axis=1, bitorder="little")
            codes = np.stack([on[:, band].astype(np.int64) @ (1 << np.arange(len(band))) for band in bands], axis=1)
            whole = raw.view("<i8")
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (whole, codes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["node", "words", "codes"])

    told = cut(distinct.select("node", "fp").mapInArrow(keys_of, "node long, words array<long>, codes array<long>"))
    cells = told.select("node", "words", F.posexplode("codes").alias("band", "code"))
    hot = cut(cells.groupBy("band", "code").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    n_hot = hot.count()
    if n_hot:
        cells = cells.join(F.broadcast(hot) if n_hot <= 10_000 else hot, ["band", "code"], "left")
    blocks = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int") if n_hot else F.lit(1)
    cells = cells.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["band", "code", "b1", "b2"]
    cells = cells.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
    dealt = cells.select(*keys, "block", "node", *[F.get("words", k).alias(f"w{k}") for k in range(WIDE)]).repartition(*keys).sortWithinPartitions(*keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, len(keys)):
            new = np.any([c[1:] != c[:-1] for c in columns[: len(keys)]], axis=0)
            fp = np.stack(columns[len(keys) + 2 :], axis=1).view(np.uint64)
            cell, count = np.cumsum(np.concatenate([[0], new])), np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
            order = np.lexsort((count, cell))
            fp, node, side = fp[order], columns[len(keys) + 1][order], np.where(columns[2] == columns[3], -1, columns[4])[order]
            for a, b, _ in close(fp, cell[order], count[order], bits, side):
                if len(a):
                    root = forest(len(fp), a, b)
                    child = np.flatnonzero(root != np.arange(len(fp)))
                    yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], ["a", "b"])

    return dealt.mapInArrow(join, "a long, b long")


def one_of_each(docs: DataFrame, columns: tuple[str, ...], words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with ``columns``: that of the smallest id.

    Texts are near copies if the sets of their ``words``-word shingles have, as
    their wide fingerprints tell, a Jaccard similarity of ``similarity`` or more;
    groups are what such links connect. Texts of any length count whole. Null and
    empty texts and texts without words are copies of each other. Null ids come
    after all others; of rows of one id the one that is first by its other columns
    stays, and different texts of one id are in groups of their own. Repeated rows
    are copies. An empty table gives no rows. Other columns are not looked at.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            fp = pa.array([wide_fingerprint(text, words) for text in utf8(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, "__fp"])

    told = docs.select(*columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", `__fp` binary")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *[F.col(c) for c in columns if c != id_col])
    first = told.groupBy(F.col("__fp").alias("fp")).agg(F.min_by(F.struct(*columns), order).alias("row")).withColumn("node", F.monotonically_increasing_id())
    distinct = cut(first)
    joined = connected_components(wide_links(distinct, bits_of(similarity)))
    ids = distinct.select("node", "fp", F.col("row")[id_col].alias("id"))
    group = ids.join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("group", F.coalesce("component", "node"))
    kept = group.groupBy("group").agg(F.min_by("node", F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("node"))
    return distinct.join(kept.select("node"), "node", "left_semi").select("row.*")
