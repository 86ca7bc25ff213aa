"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of the benchmark's normalised questions and
answers. Each document is normalised and scanned once; matches are carried back
to words and to offsets in the original text. An automaton takes about thirty
times the bytes of its windows, so a benchmark of more than AUTOMATON_BYTES is
cut into blocks: a task holds one block's automaton, and every block is one more
scan of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WINDOW = 10
#: Bytes of windows (an item's bytes times the words of a window) that one automaton takes: about 250 MB of a task.
AUTOMATON_BYTES = 8_000_000

# a-z, 0-9 and every byte of a non-ASCII character make up words; A-Z become lower case; the rest separates.
_WORD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_WORD).split()


def windows(text: bytes, size: int = WINDOW) -> set[tuple[bytes, int]]:
    """Windows of ``size`` words as ``(b" w1 ... wn ", n)``; a shorter text that has words is one window."""
    found = words(text)
    if not found:
        return set()
    n = min(size, len(found))
    return {(b" " + b" ".join(found[i : i + n]) + b" ", n) for i in range(len(found) - n + 1)}


def automaton_of(items: Iterable[tuple[str, bytes]], size: int = WINDOW) -> ahocorasick.Automaton:
    """Automaton over the windows of ``(item_id, text)``; a match's value is ``(words, item ids)``."""
    owners: dict[tuple[bytes, int], set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for (window, n), ids in owners.items():
        automaton.add_word(window.decode("latin-1"), (n, tuple(sorted(ids))))
    if owners:
        automaton.make_automaton()
    return automaton


class Scan:
    """What the automaton finds in one text: ``hit`` marks words, ``items`` has the items' ids."""

    def __init__(self, text: bytes, automaton: ahocorasick.Automaton):
        found = words(text)
        self.n_words, self.items, self.hit = len(found), set(), None
        if not found or not len(automaton):
            return
        ends = None
        for end, (n, ids) in automaton.iter(" " + b" ".join(found).decode("latin-1") + " "):
            if ends is None:
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
                cover = np.zeros(len(found) + 1, np.int32)
            last = int(np.searchsorted(ends, end))
            cover[last - n + 1] += 1
            cover[last + 1] -= 1
            self.items.update(ids)
        if ends is not None:
            self.hit = np.cumsum(cover[:-1]) > 0

    def runs(self) -> list[int]:
        """Where runs of hit words begin and end, in turn."""
        return [] if self.hit is None else turns(self.hit)


def turns(hit: np.ndarray) -> list[int]:
    on = np.concatenate([[False], hit, [False]])
    return np.flatnonzero(on[1:] != on[:-1]).tolist()


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that runs of hit words cover."""
    mapped = np.frombuffer(b" " + text.translate(_WORD) + b" ", np.uint8) != 32
    edges = np.flatnonzero(mapped[1:] != mapped[:-1])
    starts, ends = edges[::2], edges[1::2]
    at = turns(hit)
    first = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # characters before a byte
    return [(int(first[starts[a]]), int(first[ends[b - 1]])) for a, b in zip(at[::2], at[1::2], strict=True)]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks whose windows have at most about ``limit`` bytes each; the driver holds one block at a time.

    An item of more is a block of its own.
    """
    block: list[tuple[str, bytes]] = []
    used = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        text = (row.t or "").encode()
        cost = len(text) * size
        if used + cost > limit and block:
            yield block
            block, used = [], 0
        block.append((row.i or "", text))
        used += cost
    yield block


def _found(batches: Iterator[pa.RecordBatch], held: Broadcast, size: int, keep: bool) -> Iterator[tuple[pa.RecordBatch, list[Scan]]]:
    """The batches with a scan of each text in their second column. With ``keep`` the automaton stays with the worker's copy of the broadcast for its next tasks."""
    automaton = held.value.get("automaton")
    if automaton is None:
        automaton = automaton_of(held.value["items"], size)
        if keep:
            held.value["automaton"] = automaton
    for batch in batches:
        yield batch, [Scan(text, automaton) for text in utf8(batch.column(1))]


HITS = "hits struct<runs:array<long>,items:array<string>>"
RUNS, ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())


def _as_hits(scans: list[Scan]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([s.runs() for s in scans], RUNS), pa.array([sorted(s.items) for s in scans], ITEMS)], ["runs", "items"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep_spans: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Mark the words of each document that lie in a benchmark window.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window. Returns per input row: the id, the columns
    named in ``carry``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``
    (of the item ids found, sorted as strings and comma-joined), ``contaminated``
    and with ``keep_spans`` ``spans`` (array of start and end, in characters of
    the original text). Texts of any length are scanned whole. Null and empty
    texts have no words and no hits; an empty benchmark hits nothing; a null item
    id counts as the empty string; repeated rows give repeated rows. Other
    columns are not looked at.

    A benchmark of one block is scanned for in one narrow pass. Of a larger one
    every block has a pass of its own, which gives what it hits by the text's
    digest; those are put together and joined with the documents.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast({"items": block}) for block in benchmark_blocks(benchmark, item_col, item_text_col, size, AUTOMATON_BYTES)]
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), *[c for c in carry if c not in (id_col, text_col)])
    kept = [f for f in chosen.schema.fields if f.name in (id_col, *carry)]
    kept_names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", spans array<struct<start:long,end:long>>" * keep_spans

    def result(batch: pa.RecordBatch, n_words: list[int], hits: list[np.ndarray | None], items: list[Iterable[str]]) -> pa.RecordBatch:
        n_hit = [0 if hit is None else int(hit.sum()) for hit in hits]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept_names]
        columns += [pa.array(x, pa.int64()) for x in (n_words, n_hit, [len(x) for x in items])]
        columns += [pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
        names = [*kept_names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        if keep_spans:
            found = [[] if hit is None else [{"start": a, "end": b} for a, b in spans(text, hit)] for text, hit in zip(utf8(batch.column(1)), hits, strict=True)]
            columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            names.append("spans")
        return pa.RecordBatch.from_arrays(columns, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scans in _found(batches, blocks[0], size, True):
            yield result(batch, [s.n_words for s in scans], [s.hit for s in scans], [s.items for s in scans])

    if len(blocks) == 1:
        return chosen.mapInArrow(scan, schema)

    def hits_of(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, scans in _found(batches, held, size, False):
                some = [i for i, s in enumerate(scans) if s.items]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), _as_hits([scans[i] for i in some])], ["digest", "hits"])

        return chosen.select(digest.alias("digest"), F.col(text_col)).mapInArrow(run, f"digest string, {HITS}")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits, items = [], [], []
            for text, found in zip(utf8(batch.column(1)), batch.column(batch.schema.get_field_index("__hits")).to_pylist(), strict=True):
                n_words.append(len(words(text)))
                hits.append(np.zeros(n_words[-1], bool) if found else None)
                items.append({x for block in found or [] for x in block["items"]})
                for block in found or []:
                    for a, b in zip(block["runs"][::2], block["runs"][1::2], strict=True):
                        hits[-1][a:b] = True
            yield result(batch, n_words, hits, items)

    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    of_blocks = reduce(DataFrame.unionByName, [hits_of(held).distinct() for held in blocks])
    together = of_blocks.groupBy(F.col("digest").alias("__digest")).agg(F.collect_list("hits").alias("__hits"))  # one of each block at most
    joined = chosen.withColumn("__own", digest).join(together, F.col("__own") == F.col("__digest"), "left").select(*chosen.columns, "__hits")
    return joined.mapInArrow(put_together, schema)
