"""Quality rules: counts against plain versions on whole tables, monotone trees, held-out labels, edge cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalframe.llm import common, queries, rules
from tests.llm.test_classifiers import auc

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 400 else len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\r#<é ☃", max_size=60))
def test_counts_of_any_text(text):
    assert rules.measured(text.encode())[0] == plain(text)


def test_registered_query_against_plain_counts(spark, middle):
    got = queries.op11_rules(spark, middle).toPandas().set_index("doc_id")
    docs = common.read(spark, middle, "documents").toPandas()
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        want, row = plain(text), got.loc[i]
        assert tuple(row[list(rules.COUNTS)]) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert row.kept == (not row.base_failed and row.score >= rules.KEEP_FROM) == (row.reason is None)


def test_held_out_labels(spark, middle):
    labels = common.read(spark, middle, "labels").where("quality in (0, 1)").select("doc_id", "quality")
    rows = queries.op11_rules(spark, middle).withColumn("held", common.bucket("doc_id", rules.FOLDS) == 0).join(labels, "doc_id").toPandas()
    held = rows[rows.held]
    good, bad = held[(held.quality == 1) & ~held.base_failed], held[(held.quality == 0)]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) >= 0.98
    assert good.kept.mean() >= 0.97 and bad.kept.mean() <= 0.2
    flipped = common.read(spark, middle, "labels").withColumn("quality", F.when(common.bucket("doc_id", rules.FOLDS) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (rules.train(common.read(spark, middle, "documents"), x) for x in (common.read(spark, middle, "labels"), flipped))
    assert (a.feature == b.feature).all() and (a.value == b.value).all()


def test_trees_keep_to_their_directions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = (np.sin(2 * x[:, 0]) - x[:, 1] + 0.5 * np.cos(3 * x[:, 1]) + x[:, 2] + rng.normal(size=3000) > 0).astype(float)
    free, held = (rules.fit(x, y, np.array(d), trees=40) for d in ([0, 0, 0, 0], [0, -1, 1, -1]))
    grid = np.linspace(-4, 4, 161, dtype=np.float32)
    turns = 0
    for row in rng.normal(size=(60, 4)).astype(np.float32):
        for f, way in ((1, -1), (2, 1), (3, -1)):
            probe = np.repeat(row[None], len(grid), 0)
            probe[:, f] = grid
            assert (way * np.diff(held.margin(probe)) >= -1e-9).all()
            turns += (way * np.diff(free.margin(probe)) < -1e-9).any()
    assert turns > 0  # without the constraints they do turn
    assert auc(held.score(x), y) > auc(free.score(x), y) - 0.05


def test_flat_nodes_as_walked_one_by_one():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, size=(800, 3)).astype(np.float32)
    model = rules.fit(x, ((x[:, 0] > 4) ^ (x[:, 1] > 2)).astype(float), np.zeros(3, int), trees=15, leaves=6)

    def walk(row):
        total = model.base
        for node in model.root:
            while model.left[node] != node:
                node = (model.right if row[model.feature[node]] > model.above[node] else model.left)[node]
            total += model.value[node]
        return total

    assert np.allclose(model.margin(x), [walk(r) for r in x])
    assert auc(model.score(x), (x[:, 0] > 4) ^ (x[:, 1] > 2)) > 0.99


def test_more_faults_do_not_raise_a_score(spark, middle):
    model = rules.train(common.read(spark, middle, "documents"), common.read(spark, middle, "labels"))
    texts = [r.text for r in common.read(spark, middle, "documents").where("doc_id % 20 = 0").collect()]
    x = np.stack([rules.measured((t or "").encode())[1] for t in texts])
    for name, way in rules.MONOTONE.items():
        more = x.copy()
        more[:, rules.STATISTICS.index(name)] += 0.3
        assert (way * (model.margin(more) - model.margin(x)) >= -1e-9).all()


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0), (6, 0), (None, 1), (3, None), (4, 7)]])
def test_odd_documents(spark, labelled):
    long = "a very long text with lines\n" * 60_000
    docs = [(1, "word " * 60), (1, "word " * 60), (2, " ".join(f"w{k}" for k in range(60))), (3, None), (4, ""), (5, " \n\t"), (None, " ".join(f"v{k}" for k in range(70))), (6, long)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "kept", "n_words", "quality", "lang", "reason", "x", "y")}).repartition(3)
    labels = spark.createDataFrame(labelled, "doc_id long, quality int").withColumns({"text": F.lit("clash"), "toxic": F.lit(1)})
    rows = rules.rules(frame, labels).collect()
    assert len(rows) == len(docs) and sorted(tuple(r[c] for c in rules.COUNTS) for r in rows) == sorted(plain(t) for _, t in docs)
    by = {r.doc_id: r for r in rows}
    assert [by[k].reason for k in (1, 3, 4, 5, 6)] == ["repeats", "short", "short", "short", "repeats"] and not by[2].base_failed and not by[None].base_failed
    assert rules.rules(frame.limit(0), labels).collect() == []
