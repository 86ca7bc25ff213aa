from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from evalframe.llm import common, embeddings, oracles, queries


def brute(rows) -> tuple[dict[int, int], set[tuple[int, int]]]:
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = set()
    for k, (i, v, lab) in enumerate(good):
        for j, w, other in good[k + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= embeddings.THRESHOLD:
                links.add((min(i, j), max(i, j)))
    count = {i: 0 for i, _, _ in rows}
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return count, links


@pytest.mark.parametrize("table", ["small", "middle"])
def test_against_all_pairs(spark, request, table):
    vectors = common.read(spark, request.getfixturevalue(table), "embeddings")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    want, _ = brute(rows)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(vectors).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_recall_on_random_clusters(spark, monkeypatch):
    """Noisy copies of random directions, some of them in one crowded list of several blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(60):
        centre = rng.normal(size=32)
        for _ in range(1 + (200 if c == 0 else c % 7)):
            v = centre + rng.normal(size=32) * 0.08 * rng.random()
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], c % 3))
    want, links = brute(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    n = {r.vec_id: r.n_links for r in got}
    assert all(n[i] <= k for i, k in want.items()) and sum(n.values()) >= 0.95 * 2 * len(links)
    assert all(r.component_id <= r.vec_id and r.kept == (r.component_id == r.vec_id) for r in got)


def clusters(n: int, seed: int, dim: int = 64) -> list[tuple]:
    """Vectors in groups of one to six noisy copies of random directions, and one large group; two labels and some null."""
    rng = np.random.default_rng(seed)
    rows: list[tuple] = []
    while len(rows) < n:
        centre = rng.normal(size=dim)
        for _ in range(n // 20 if not rows else rng.integers(1, 7)):
            v = centre + rng.normal(size=dim) * 0.2 * rng.random()
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], [0, 1, 1, None][len(rows) % 4]))
    return rows


def link_counts(rows: list[tuple]) -> dict[int, int]:
    """By whole matrices of cosines."""
    want = {r[0]: 0 for r in rows}
    for label in {r[2] for r in rows} - {None}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for at in range(0, len(x), 1000):
            n = (x[at : at + 1000] @ x.T >= embeddings.THRESHOLD).sum(axis=1) - 1
            want |= {r[0]: int(k) for r, k in zip(own[at : at + 1000], n, strict=True)}
    return want


@pytest.mark.parametrize("pivots", [None, 1024])
def test_recall_on_twelve_thousand_vectors(spark, pivots):
    rows = clusters(12_000, 7)
    want = link_counts(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, pivots=pivots).collect()}
    found, all_links = sum(got.values()), sum(want.values())
    print(f"{pivots or embeddings.pivots_for(len(rows))} pivots: {found} of {all_links} link ends")
    assert all_links > 10_000 and all(got[i] <= n for i, n in want.items()) and found >= 0.97 * all_links


def test_pivots_grow_with_the_table_and_settle_for_closer_ones():
    assert embeddings.pivots_for(0) == 32 < embeddings.pivots_for(10**6) == 560 < embeddings.pivots_for(10**8) == 5591 < embeddings.pivots_for(10**12) == 16_384
    rng = np.random.default_rng(3)
    cone = np.ones((500, 64)) + 0.1 * rng.normal(size=(500, 64))
    assert len(embeddings.choose_pivots(cone, 100)) == 100
    assert len(embeddings.choose_pivots(np.repeat(cone[:3], 50, axis=0), 100)) == 3
    x, pivots = rng.normal(size=(50, 64)), embeddings.choose_pivots(rng.normal(size=(200, 64)), 90)
    assert (embeddings.describe(x, pivots, 5) == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :5]).all()


def test_registered_query_against_sql_with_planted_links(spark, tmp_path):
    rows = [*clusters(400, 9), (900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 1)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: tuple(r) for r in con.execute(f"select vec_id, n_links, component_id, kept from ({oracles.OP3})").fetchall()}
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op3_embeddings(spark, str(tmp_path)).collect()}
    assert got == want and sum(r[1] for r in got.values()) > 300


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("pivots", [1, 2])
def test_one_list_is_compared_in_the_precision_of_the_column(spark, kind, pivots):
    """With one pivot or two, all are on one list. In double precision the second pair is just below the threshold, rounded to floats it may not be."""
    c = embeddings.THRESHOLD
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 1), (4, [(1 - (c - 1e-12) ** 2) ** 0.5, c - 1e-12], 1), (5, [1.0], 0), (6, [2.0], 0)]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"), pivots=pivots).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 6)] == [1, 1, 3, 5, 5] and (kind == "float" or got[4] == 4)


LARGER = "/root/testdata/check_s"


@pytest.mark.skipif(not Path(LARGER).exists(), reason="no larger tables here")
def test_recall_on_a_larger_table(spark):
    """Links by label from whole matrices of cosines against those of the index."""
    vectors = common.read(spark, LARGER, "embeddings")
    frame = vectors.select("vec_id", "embedding", "label").toPandas()
    want = {}
    for _, own in frame[frame.label.notna()].groupby("label"):
        own = own[[v is not None and len(v) > 0 and np.isfinite(np.array(v, float)).all() and np.any(v) for v in own.embedding]]
        x = np.stack([np.array(v, np.float64) for v in own.embedding])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for start in range(0, len(x), 1000):
            n = (x[start : start + 1000] @ x.T >= embeddings.THRESHOLD).sum(axis=1) - 1
            want |= dict(zip(own.vec_id[start : start + 1000], n, strict=True))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(vectors).collect()}
    found, all_links = sum(got.values()), sum(want.values())
    print(f"{found} of {all_links} link ends")
    assert set(got) == set(frame.vec_id) and 0.97 * all_links <= found <= all_links > 0
