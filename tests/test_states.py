"""Metrics kept up to date against a full count after each batch; failures at any point; streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalframe.operators import accuracy
from evalframe.operators.items import by_item
from evalframe.sources import store as stored
from evalframe.sources.schema import ERROR, RESPONSES
from evalframe.sources.store import Folder, Store
from evalframe.streaming import states


def _items(spark):
    rows = [(f"i{k}", ("arithmetic", "ordering")[k % 2], k % 3, ("base", "distractor", "base")[k % 3], "int", str(k), []) for k in range(60)]
    return spark.createDataFrame(rows, "item_id string, family string, difficulty int, probe string, answer_type string, gold string, choices array<string>")


def _batch(spark, n):
    """Responses of batch n: some new, some that replace others', right or wrong or failed by a rule; some to unknown items; some without a first sample."""
    rows = []
    for k in range(80):
        for run in ("a", "b"):
            for sample in range(3):
                h = (k * 31 + n * 17 + sample * 7 + (run == "b")) % 13
                if h < 6 and not (k % 20 == 19 and sample == 0):
                    right = h % 2 == 0
                    raw = ERROR if h == 5 else f"ANSWER: {k if right else k + 1}" if h < 4 else f"maybe {k}"
                    rows.append((run, f"i{k}", sample, raw, str(k), None if h == 5 else right, None, 1, None, None, ("marker", None, None)))
    return spark.createDataFrame(rows, RESPONSES)


def _same(kept, store):
    frame = by_item(store.read("responses"), store.read("items"))
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for name in ("coverage", "overall", "by_family", "degradation", "strict"):
        want = getattr(accuracy, name)(frame)
        assert rounded(getattr(kept, name)().select(*want.columns)) == rounded(want), name


def test_after_each_batch_as_counted_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    store.upsert("items", _items(spark))
    kept = states.MetricStates(store)
    assert kept.sums().collect() == []
    for n in range(5):
        kept.upsert(_batch(spark, n), f"b{n}")
        _same(kept, store)
        if n == 2:
            kept.fold()
            _same(kept, store)
    kept.upsert(_batch(spark, 0), "b4")  # delivered again: neither stored nor counted
    _same(kept, store)
    kept.fold()
    kept.fold()
    assert len([n for n in kept.log.names() if not n.startswith(".")]) == 1
    _same(kept, store)
    assert all(r.items > 0 for r in kept.sums().collect())


@pytest.mark.parametrize("lost", ["responses", "facts", "changes"])
def test_a_batch_that_failed_half_way_is_counted_once(spark, tmp_path, monkeypatch, lost):
    store = Store(spark, str(tmp_path), 2)
    store.upsert("items", _items(spark))
    kept = states.MetricStates(store)
    kept.upsert(_batch(spark, 0), "b0")
    put = store.upsert

    def stop(table, rows, name=None):
        out = put(table, rows, name)
        if table == lost:
            raise OSError("lost")
        return out

    monkeypatch.setattr(store, "upsert", stop)
    if lost == "changes":
        monkeypatch.setattr(states, "_adds", lambda facts, sign: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        kept.upsert(_batch(spark, 1), "b1")
    monkeypatch.undo()
    kept.upsert(_batch(spark, 1), "b1")
    _same(kept, store)


def test_facts_are_found_where_they_lie(spark, tmp_path, monkeypatch):
    """Of the facts stored before, none is shuffled and no text is read for the items of a batch."""
    store = Store(spark, str(tmp_path), 4)
    store.upsert("items", _items(spark))
    kept = states.MetricStates(store)
    for n in range(2):
        kept.upsert(_batch(spark, n), f"b{n}")
    mine = kept._of(store.read("facts"), spark.createDataFrame([("a", "i3"), ("b", "no")], "run_id string, item_id string"))
    assert [(r.run_id, r.item_id) for r in mine.collect()] == [("a", "i3")]
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan and "raw" not in plan
    monkeypatch.setattr(states, "BROADCAST", 1)  # a larger batch takes the other way
    kept.upsert(_batch(spark, 2), "b2")
    _same(kept, store)


def test_a_stream_keeps_them(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 2)
    store.upsert("items", _items(spark))
    for n in range(3):
        _batch(spark, n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = states.MetricStates(store)
    stream = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states.keep_metrics(stream, kept, str(tmp_path / "check")).awaitTermination()
    _same(kept, store)
    assert len([n for n in Folder(spark, kept.path).names() if n.startswith("changes-")]) == 3
    assert store.read("responses").where(F.col("raw").isNull()).count() == 0


def _stored_twice(spark, folder):
    """A store with two batches counted, the second of which is large."""
    store = Store(spark, str(folder), 4)
    store.upsert("items", _items(spark))
    kept = states.MetricStates(store)
    for n in range(2):
        kept.upsert(_batch(spark, n), f"b{n}")
    return store, kept


def test_a_large_batch_meets_items_and_facts_where_they_lie(spark, tmp_path, monkeypatch):
    """Rows of the batch are dealt to the buckets; nothing that is stored is shuffled, and no keys are written beside."""
    monkeypatch.setattr(states, "BROADCAST", 1)
    monkeypatch.setattr(states, "materialise", lambda df: pytest.fail("keys of a large batch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store, kept = _stored_twice(spark, tmp_path)
        rows = store.stored("responses")
        facts = kept._facts(rows)
        dealt = store._bucketed(facts.withColumns({"_batch": F.lit("x"), "was": F.lit(None)}), "facts")
        for plan, scans in ((facts, 3), (kept._merged(dealt, rows), 4)):
            shown = plan._jdf.queryExecution().executedPlan().toString()
            for table in ("items_", "facts_"):
                for part in shown.split("Scan parquet")[1:]:
                    assert table not in part.split("[")[0] or "Bucketed: true" in part
            joins = [x for x in shown.split("\n") if "SortMergeJoin" in x]
            assert joins and all("[_hash#" in x and "[__hash#" in x for x in joins)
            assert shown.count("REPARTITION_BY_NUM") == (1 if scans == 3 else 2) and shown.count("Exchange hashpartitioning") == shown.count("REPARTITION_BY_NUM") + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    _same(kept, store)


def test_a_fact_tells_what_it_replaced(spark, tmp_path):
    """The changes of a batch come of its own facts, also when the facts were compacted before they were counted."""
    store, kept = _stored_twice(spark, tmp_path)
    batch = store.upsert("responses", _batch(spark, 2), "b2")
    rows = store.stored("responses").where(F.col("_batch") == batch)
    store.upsert("facts", stored.Merging(kept._facts(rows), lambda facts: kept._merged(facts, rows)), f"facts-{batch}")
    store.compact("facts")
    kept.advance(batch)
    _same(kept, store)


def test_equal_hashes_do_not_make_equal_keys(spark, tmp_path, monkeypatch):
    """Rows meet by the hash, and their keys decide: here all hashes are one."""
    monkeypatch.setattr(stored, "hash_of", lambda table: F.lit(7).cast("long"))
    monkeypatch.setattr(states, "BROADCAST", 1)
    store, kept = _stored_twice(spark, tmp_path)
    _same(kept, store)
