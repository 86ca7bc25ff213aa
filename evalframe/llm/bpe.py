"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Spark deals the documents to tasks; a task splits each text with the
tokenizer's pattern, merges every distinct piece of a batch once, and puts the
ids together. Pieces of one length bucket form a padded numpy matrix of token
ids: in each round every row merges its leftmost pair of least rank, found in a
hashed pair table, and finished rows leave the matrix (compaction).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

NONE = np.int64(1 << 40)
#: Pieces of more bytes merge one by one from a heap: a matrix of them would take rounds by their length.
LONGEST_ROW = 256
#: Cells of one matrix at most, and remembered pieces of one task at most.
MATRIX_CELLS, REMEMBERED = 1 << 20, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has the token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of their merge, looked up in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        key, value = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # all that are left try their slot; one of each slot gets it, the rest go on to the next
            free = self.keys[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = key[won], value[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = slot[left] + 1 & len(self.keys) - 1
        self.pairs = dict(zip(keys, merged, strict=True))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where the two do not merge or one is padding."""
        key = left << 32 | right  # below 0 with padding, as no key is
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        probe = np.nonzero((found != key) & (found >= 0) & (left >= 0) & (right >= 0))
        slot, key = slot[probe], key[probe]
        result = np.full(len(key), NONE, dtype=np.int64)
        left = np.arange(len(key))
        while len(left):
            slot[left] = slot[left] + 1 & len(self.keys) - 1
            found = self.keys[slot[left]]
            hit = found == key[left]
            result[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        out[probe] = result
        return out


def merge_matrix(rows: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Merge every row (token ids, padded with -1 at the end) to its end; ids by row."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
    owner, tokens = np.arange(len(rows)), rows
    rank = table.merges(tokens[:, :-1], tokens[:, 1:])
    while len(owner):
        at = rank.argmin(axis=1)  # the leftmost of the least
        least = rank[np.arange(len(owner)), at]
        done = least >= NONE
        if done.any():
            for row, who in zip(tokens[done], owner[done], strict=True):
                out[who] = row[row >= 0]
            going = ~done
            owner, tokens, rank, at, least = owner[going], tokens[going], rank[going], at[going], least[going]
            if not len(owner):
                break
        width = tokens.shape[1]
        column = np.arange(width - 1)
        # close the gap that the pair leaves: columns after the pair move one to the left
        moved = np.where(column[None, :] > at[:, None], tokens[:, 1:], tokens[:, :-1])
        line = np.arange(len(owner))
        moved[line, at] = least
        if width == 2:
            tokens, rank = np.concatenate([moved, np.full((len(owner), 1), -1)], axis=1), np.full((len(owner), 1), NONE)
            continue
        rank = np.where(column[None, :-1] > at[:, None], rank[:, 1:], rank[:, :-1])
        next_to = np.minimum(at + 1, width - 2)
        after = np.where(at + 1 <= width - 2, moved[line, next_to], -1)
        new_right = table.merges(least, after)
        inside = at <= width - 3
        rank[line[inside], at[inside]] = new_right[inside]
        left = at > 0
        rank[line[left], at[left] - 1] = table.merges(moved[line[left], at[left] - 1], least[left])
        tokens = moved
        most = int((tokens >= 0).sum(axis=1).max())
        if most < tokens.shape[1] and most >= 2:
            tokens, rank = tokens[:, :most], rank[:, : most - 1]
    return out


def merge_long(piece: bytes, table: PairTable) -> np.ndarray:
    """One long piece: the same merges, taken from a heap of (rank, position)."""
    ids = table.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := table.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = following[i]
        if ids[i] < 0 or j >= n or table.pairs.get(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
            if (r := table.pairs.get(rank << 32 | ids[following[i]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := table.pairs.get(ids[before[i]] << 32 | rank)) is not None:
            heapq.heappush(heap, (r, before[i]))
    return np.array([x for x in ids if x >= 0], dtype=np.int64)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.table = PairTable(ranks)
        self.token = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: list[str]) -> None:
        """Merge the distinct pieces that are not known yet, by length bucket."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = (rank,)
            elif len(raw) > LONGEST_ROW:
                self.known[piece] = tuple(merge_long(raw, self.table).tolist())
            else:
                buckets.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), np.uint8)
                rows = self.table.byte_id[flat].reshape(len(part), width)
                length = np.array([len(raw) for _, raw in part])
                rows[np.arange(width)[None, :] >= length[:, None]] = -1
                for (piece, _), ids in zip(part, merge_matrix(rows, self.table), strict=True):
                    self.known[piece] = tuple(ids.tolist())

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for group in _groups(texts):
            split = [self.split(text) for text in group]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = set()
            for pieces in split:
                new.update(pieces)
            self.learn([piece for piece in new if piece not in self.known])
            for pieces in split:
                ids: list[int] = []
                for got in map(self.known.__getitem__, pieces):
                    ids += got
                yield np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def _groups(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, keep_decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, then decode the ids again.

    Returns one row per input row: the id, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256``, with ``keep_ids`` also ``ids`` (array of int) and with
    ``keep_decoded`` also ``decoded`` (binary). Texts of any length are
    encoded whole. Null and empty texts have no tokens. Rows that repeat
    give repeated rows; a null id is kept; other columns of ``docs`` are not
    looked at. The rank file is read on the driver (it has a fixed size) and
    sent with the tasks.
    """
    ranks = load_ranks(ranks_path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded
    held = docs.sparkSession.sparkContext.broadcast({"ranks": ranks})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "codec" not in held.value:  # the worker's copy of the broadcast keeps it for its next tasks
            held.value["codec"] = Codec(held.value["ranks"], pattern)
        codec = held.value["codec"]
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in utf8(batch.column(1))]
            n, ids_sha, decoded_sha, all_ids, all_decoded = [], [], [], [], []
            for ids in codec.encode(texts):
                decoded = codec.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    all_ids.append(ids.astype(np.int32))
                if keep_decoded:
                    all_decoded.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            if keep_decoded:
                columns, names = [*columns, pa.array(all_decoded, pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
