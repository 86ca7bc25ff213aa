from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from evalframe.llm import common, simhash


def brute_fingerprint(text: str) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_wide_fingerprint(text: str, n: int) -> int:
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", found)
    h = {xxhash.xxh64_intdigest(" ".join(found[i : i + n]).encode(), 42) for i in range(max(1, len(found) - n + 1))} if found else set()
    cut, out = (1 << 64) - 1, 0
    for k in range(simhash.WIDE):
        counts = [0] * 64
        for x in h:
            m = (x ^ x >> 31) * (0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & cut) & cut
            m = (m ^ m >> 29) * 0xBF58476D1CE4E5B9 & cut
            m ^= m >> 32
            for b in range(64):
                counts[b] += m >> b & 1
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * counts[b] > len(h))
    return out


def brute_components(fps: dict[int, int], bits: int = 3) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \x0b\t", "one", "One two", "a b c", "a b c d A B C D", "ÄÖ ü\u00a0x y z", "x " * 5000])
def test_fingerprint(text):
    got = simhash.fingerprint(text.encode()) & (1 << 64) - 1
    assert got == brute_fingerprint(text)


def test_whole_table_against_all_pairs(spark, middle):
    docs = common.read(spark, middle, "documents")
    fps = {r.doc_id: brute_fingerprint(r.text or "") for r in docs.select("doc_id", "text").collect()}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}
    assert sum(r.kept for r in got) == len(set(want.values())) < len(want)


@pytest.mark.parametrize(("block", "n"), [(2048, 300), (16, 300)])
def test_crowded_cells_lose_no_link(spark, monkeypatch, block, n):
    """Fingerprints that differ in few bits crowd the cells, up to several blocks of one."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {i: base[i % 4] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(n)}
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in fps.items()}
    firsts: dict[int, int] = {}
    for i, v in signed.items():
        firsts.setdefault(v, i)
    distinct = spark.createDataFrame([(v, i) for v, i in firsts.items()], "fp long, rep long")
    joined = {r.node: r.component for r in common.connected_components(simhash.links(distinct)).collect()}
    want = brute_components({i: fps[i] for i in firsts.values()})
    assert {i: joined.get(i, i) for i in firsts.values()} == want


def test_the_embedding_bounds_the_distance():
    rng = random.Random(3)
    rows = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)]
    rows += [(a, a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)) for a, _ in rows]
    for a, b in rows:
        x, y = simhash.embed(np.array([a, b], np.uint64)).tolist()
        counts = lambda v: [(v >> 8 * k & 255).bit_count() for k in range(8)]
        manhattan = sum(abs(p - q) for p, q in zip(counts(a), counts(b), strict=True))
        assert (x ^ y).bit_count() == manhattan <= (a ^ b).bit_count()


@pytest.mark.parametrize("groups", simhash.GROUPS)
@pytest.mark.parametrize("block", [1024, 3])
def test_every_number_of_groups_finds_the_same(spark, monkeypatch, groups, block):
    """Balls of fingerprints around a few, with all cells compared in place or through those between."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(groups)
    base = [rng.getrandbits(64) for _ in range(5)]
    found = sorted({base[i % 5] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for i in range(120)})
    fps = dict(enumerate(found))
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in fps.items()], "fp long, rep long")
    edges = simhash.links(distinct, groups).collect()
    joined = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: joined.get(i, i) for i in fps} == brute_components(fps)


def test_candidates_grow_more_slowly_than_pairs():
    """Random fingerprints: the grid's candidates of each, by number of fingerprints, with the groups chosen for it."""
    rng = np.random.default_rng(1)
    met = {}
    for n in (1 << 15, 1 << 18, 1 << 20):
        groups, candidates = simhash.groups_for(n), 0
        fp = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        for mask in np.array(simhash.projections(groups), np.int64).view(np.uint64):
            _, cell = np.unique(fp & mask, return_inverse=True)
            count = np.bitwise_count(fp & ~mask).astype(np.int64)
            order = np.argsort(cell * 128 + count, kind="stable")
            candidates += sum(k for _, _, k in simhash.close(fp[order][:, None], cell[order], count[order]))
        met[n] = candidates / n
    assert met[1 << 18] < 4 * simhash.MEET and met[1 << 20] < 1
    assert [simhash.groups_for(n) for n in (1, 1 << 18, 1 << 19, 1 << 30, 1 << 40)] == [4, 4, 5, 6, 8]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 500)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 500)}


@pytest.mark.parametrize("text", ["", "one", "a b c d", "a b c d e f g A B C", "x " * 5000])
def test_wide_fingerprint(text):
    assert int.from_bytes(simhash.wide_fingerprint(text.encode(), 5), "little") == brute_wide_fingerprint(text, 5)


def test_bits_of_a_similarity_and_bands_for_it():
    assert simhash.bits_of(1.0) == 0 < simhash.bits_of(0.9) < simhash.bits_of(0.8) == 85
    for n in (10, 1 << 18, 1 << 30):
        bands = simhash.bands_for(n, 85)
        assert (1 << bands.shape[1]) * simhash.CELL >= n and 1 - (1 - (1 - 85 / 512) ** bands.shape[1]) ** len(bands) >= simhash.RECALL


def test_near_copies_by_exact_similarity(spark, middle):
    """Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 keep one text; what else goes is not far below that."""
    docs = common.read(spark, middle, "documents")
    sets = {r.doc_id: frozenset(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.select("doc_id", "text").collect()}
    ids, root, nearest = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0.0)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.6 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                similarity = both / (len(sets[a]) + len(sets[b]) - both) if sets[a] else 1.0
                nearest[b] = max(nearest[b], similarity)
                if similarity >= 0.8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    want = {find(i) for i in ids}
    kept = {r.doc_id for r in simhash.one_of_each(docs, ("doc_id", "text")).collect()}
    assert len(want) < len(ids) and len(kept - want) <= 1
    assert len(want - kept) <= 0.01 * len(want) and all(nearest[i] >= 0.7 for i in want - kept)


@pytest.mark.parametrize("block", [1024, 16])
def test_a_crowd_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join("z" if rng.random() < 0.004 else w for w in base)) for i in range(200)] + [(1000 + i, " ".join(f"v{i}x{k}" for k in range(50))) for i in range(50)]
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id", "text")).collect())
    assert kept == [0, *range(1000, 1050)]
