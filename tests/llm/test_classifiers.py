"""Held-out accuracy of the two classifiers, and their parts against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import common, quality, queries, toxicity


def auc(score: np.ndarray, y: np.ndarray) -> float:
    above = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    return above + (score[y == 1][:, None] == score[y == 0][None, :]).mean() / 2


@pytest.mark.parametrize(("query", "label", "least"), [("op1_quality", "quality", 0.98), ("op6_toxicity", "toxic", 0.9)])
def test_held_out(spark, middle, query, label, least):
    labels = common.read(spark, middle, "labels")
    got = queries.queries()[query](spark, middle)
    assert got.count() == common.read(spark, middle, "documents").count()
    rows = got.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").toPandas()
    parts, rest = (5, 0) if query == "op1_quality" else (4, 2)
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % parts == rest for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3).astype(int)).all() and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    assert auc(held.score.to_numpy(), held.y.to_numpy()) >= least


def test_held_out_labels_are_not_learned(spark, middle):
    docs, labels = common.read(spark, middle, "documents"), common.read(spark, middle, "labels")
    flip = lambda column, hidden: labels.withColumn(column, F.when(hidden, 1 - F.col(column)).otherwise(F.col(column)))
    a, b = quality.train(docs, labels), quality.train(docs, flip("quality", common.bucket("doc_id", 5) == 0))
    assert (a.feature == b.feature).all() and (a.leaf == b.leaf).all()
    c, d = toxicity.train(docs, labels), toxicity.train(docs, flip("toxic", common.bucket("doc_id", 4) == 2))
    assert (c.table == d.table).all() and c.thresholds == d.thresholds


def test_neighbours_do_not_move_scores(spark, middle):
    docs, labels = common.read(spark, middle, "documents"), common.read(spark, middle, "labels")
    net, forest = toxicity.train(docs, labels), quality.train(docs, labels)
    text = b"some text to score"
    for mine in (text, b"", b"one"):
        for other in (b"", b"another", b"worthless scum and trash"):
            assert toxicity.Scorer(net).margins([mine]) == pytest.approx(toxicity.Scorer(net).margins([other, mine, other])[1:2], abs=1e-6)
    assert forest.score(np.stack([quality.statistics(text)])) == forest.score(np.stack([quality.statistics(text), quality.statistics(b"")]))[:1]


def test_flat_trees_as_walked_one_by_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)

    def walk(row: np.ndarray) -> float:
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.above[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        return total

    assert np.allclose(model.margin(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_filters_as_slid_word_by_word():
    net = toxicity._new()
    rng = np.random.default_rng(4)
    net.table[:] = rng.normal(size=net.table.shape).astype(np.float32)
    text = b"several words of some text with several words"
    found = [*toxicity.words(text), b"", b""]
    vector = [net.table[list(toxicity.rows_of(w))].sum(axis=0) if w else np.zeros(toxicity.DIM) for w in found]
    tops = []
    for k, w in enumerate(toxicity.WIDTHS):
        slide = [sum(vector[i + j] @ net.filters[w, j] for j in range(w)) for i in range(len(found) - 2)] + [np.zeros(toxicity.FILTERS)]
        tops.append(np.max(slide, axis=0) + net.bias[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS])
    want = np.maximum(np.concatenate(tops), 0) @ net.out + net.out_bias
    assert toxicity.Scorer(net).margins([text])[0] == pytest.approx(want, rel=1e-4)


def test_thresholds_by_language(spark):
    rows = [(i, ("rotten scum here " if i % 3 == 0 else "kind words here ") + f"w{i % 17} x{i % 5}", "de" if i % 2 else "en", int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(df, df.select("doc_id", "toxic"))
    assert set(net.thresholds) == {"de", "en"}
    got = toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic"), carry=("text",)).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) == 1 == np.mean([int(r.rejected) == r.toxic for r in got])


@pytest.mark.parametrize("gap", [0.1, 3, 30])
def test_calibration_where_classes_lie_apart(gap):
    rng = np.random.default_rng(8)
    y = (np.arange(2000) % 10 == 0).astype(float)
    z = np.where(y > 0, gap, -gap) * (1 + rng.random(2000)) + rng.normal(size=2000) * 0.01
    net = toxicity._new()
    toxicity._calibrate(net, z, y, np.array(["en"] * 2000, object))
    p = net.probability(z)
    assert 0 < net.scale < 200 and ((p >= toxicity.THRESHOLD) == (y > 0)).all() and ((p >= net.thresholds["en"]) == (y > 0)).all()
    assert abs(p.mean() - y.mean()) < 0.02


def test_calibration_gives_shares():
    rng = np.random.default_rng(9)
    z = rng.normal(size=20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    net = toxicity._new()
    toxicity._calibrate(net, z, y, np.array([None] * len(z), object))
    assert net.scale == pytest.approx(0.5, abs=0.05) and net.shift == pytest.approx(-1, abs=0.1)


def test_long_texts_are_learned_from(spark):
    """All that tells the labels apart is in texts of over 12,000 bytes."""
    word = lambda k: f"w{k * 7919 % 1000}"
    long = lambda i, mark: " ".join(mark if k == 2_900 else word(k + i) for k in range(3_000))
    rows = [(i, long(i, "scoundrel" if i % 2 else "gentleman") if i < 60 else "plain words " + word(i), "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 60 and i % 2), int(i < 60 and i % 2)) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(60) if got[i].held_out]
    assert len(held) > 5 and all((got[i].score > 0.5) == bool(i % 2) for i in held)
    assert quality.train(docs, labels).feature.any()


def test_a_sample_is_cut_by_bytes_and_not_by_length(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 3 else 5000)) for i in range(300)], "doc_id long, text string")
    kept = common.within_bytes(docs, 100_000).collect()
    assert 100_000 <= sum(len(r.text) for r in kept) < 105_000 and 0.2 < sum(r.doc_id % 3 == 0 for r in kept) / len(kept) < 0.5


def test_pieces_of_a_text_respond_as_the_whole():
    rng = np.random.default_rng(1)
    rows = np.concatenate([np.concatenate([rng.integers(0, 500, (n, 4)), np.full((2, 4), -1)]) for n in (5, 0, 700, 1, 3)])
    starts = np.array([0, 7, 9, 711, 714])
    part = {p: np.where(rows[:, :1] < 0, 0, rng.normal(size=(len(rows), toxicity.FILTERS))).astype(np.float32) for p in toxicity.PARTS}
    whole = toxicity._largest(lambda a, b: {p: x[a:b] for p, x in part.items()}, rows[:, 0] < 0, starts)
    for limit in (1, 7, 100):
        pieces = toxicity._largest(lambda a, b: {p: x[a:b] for p, x in part.items()}, rows[:, 0] < 0, starts, limit)
        assert (pieces[0] == whole[0]).all() and (pieces[1] == whole[1]).all()


def test_a_fit_is_bounded_by_steps_and_by_words():
    assert toxicity.epochs_for(3, 60) == toxicity.LEAST_STEPS  # one step an epoch, however small
    assert toxicity.epochs_for(12_000, 4_000_000) == toxicity.EPOCHS == toxicity.epochs_for(3, 400_000_000)
    for texts, positions in ((3, 400_000), (240, 4_000_000), (500, 150_000)):
        epochs = toxicity.epochs_for(texts, positions)
        assert epochs == toxicity.EPOCHS or (epochs * positions <= toxicity.VISITS and (epochs - 1) * -(-texts // toxicity.BATCH) < toxicity.LEAST_STEPS)


def test_a_sample_is_taken_of_few_rows(spark):
    rows = spark.range(200_000).select((F.col("id") * 7).alias("doc_id")).repartition(5)
    least = common.least_hashed(rows, F.xxhash64("doc_id"), 1000)
    assert 1000 <= least.count() < 1100
    top = lambda df: [r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(1000).collect()]
    assert top(least) == top(rows)
    assert common.least_hashed(rows.limit(5), F.xxhash64("doc_id"), 1000).count() == 5 and common.least_hashed(rows.limit(0), F.xxhash64("doc_id"), 10).count() == 0
    labels = rows.select("doc_id", F.lit(1).alias("quality"))
    sample = common.labelled_sample(rows.withColumn("text", F.lit("x")), labels, "quality", F.lit(True), 1000, ["text"])
    assert sorted(r.doc_id for r in sample.collect()) == sorted(top(rows))
