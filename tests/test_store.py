from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalframe.operators import accuracy
from evalframe.operators.items import by_item
from evalframe.sources import store as s
from evalframe.sources.schema import ERROR, RESPONSES


def _row(item, sample, raw, correct=True):
    return ("r", item, sample, raw, "7", correct, None, 1, None, None, ("marker", None, None))


def test_upsert_replaces_by_key(spark, tmp_path):
    store = s.Store(spark, str(tmp_path))
    assert store.read("responses").count() == 0
    store.upsert("responses", spark.createDataFrame([_row("a", 0, "x"), _row("b", 0, "x"), _row("a", 1, "x")], RESPONSES))
    store.upsert("responses", spark.createDataFrame([_row("a", 0, "y")], RESPONSES))
    got = {(r.item_id, r.sample_idx): r.raw for r in store.read("responses").collect()}
    assert got == {("a", 0): "y", ("a", 1): "x", ("b", 0): "x"}
    store.compact("responses")
    assert {(r.item_id, r.sample_idx): r.raw for r in store.read("responses").collect()} == got
    store.upsert("responses", spark.createDataFrame([_row("b", 0, "z")], RESPONSES))
    assert store.read("responses").where("item_id = 'b'").first().raw == "z"


def test_a_batch_keeps_one_row_of_a_key(spark, tmp_path):
    store = s.Store(spark, str(tmp_path))
    batch = spark.createDataFrame([_row("a", 0, x) for x in "xyz"] + [(None, *_row("a", 0, "n")[1:])], RESPONSES)
    store.upsert("responses", batch.repartition(4))
    kept = sorted((r.run_id or "", r.raw) for r in store.read("responses").collect())
    assert len(kept) == 2 and kept[0] == ("", "n")
    store.upsert("responses", batch.repartition(1))
    assert sorted((r.run_id or "", r.raw) for r in store.read("responses").collect()) == kept


def test_texts_are_neither_read_nor_shuffled_by_metrics_without_them(spark, tmp_path):
    store = s.Store(spark, str(tmp_path))
    store.upsert("responses", spark.createDataFrame([_row("a", 0, "x"), _row("b", 0, "x")], RESPONSES))
    store.upsert("items", spark.createDataFrame([("a", "arithmetic", 1, "base"), ("b", "arithmetic", 2, "base")], "item_id string, family string, difficulty int, probe string"))
    overall = accuracy.overall(by_item(store.read("responses"), store.read("items")))
    assert overall.first().accuracy == 1.0
    plan = overall._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and not re.search(r"\braw\b", plan) and not re.search(r"\bprompt\b", plan)


def test_secrets_do_not_reach_the_store(spark, tmp_path):
    store = s.Store(spark, str(tmp_path))
    store.upsert("runs", spark.createDataFrame([("r", "m", {"api_key": "sk-1", "mode": "x"})], "run_id string, model string, params map<string,string>"))
    r = store.runs().first()
    assert r.params == {"api_key": "***", "mode": "x"} and r.created_at is not None


def test_done_and_todo(spark):
    responses = spark.createDataFrame([_row("a", 0, "x"), _row("b", 0, "x"), _row("b", 1, ERROR, None)], RESPONSES)
    assert [r.item_id for r in s.done_items(responses).collect()] == ["a"]
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    assert sorted(r.item_id for r in s.todo(items, responses, "r").collect()) == ["b", "c"]
    assert s.todo(items, responses, "other").count() == 3


def test_telemetry_round_trip(spark, tmp_path):
    store = s.Store(spark, str(tmp_path))
    row = spark.range(1).select(F.lit("r").alias("run_id"), F.lit("a").alias("item_id"), F.lit(0).alias("sample_idx"), F.array(F.lit("chat")).alias("capabilities"), F.create_map(F.lit("k"), F.lit("v")).alias("unobservable_fields"))
    store.upsert("telemetry", row)
    got = store.telemetry_of("r", "a", 0).first()
    assert got.capabilities == ["chat"] and got.unobservable_fields == {"k": "v"} and got.ttft_ms is None
    assert store.telemetry_of("r", "a", 1).count() == 0


def _responses(spark, n, text, first=0):
    return spark.range(first, first + n).select(
        F.lit("r").alias("run_id"), F.col("id").cast("string").alias("item_id"), F.lit(0).alias("sample_idx"), F.concat(F.lit(text), F.col("id").cast("string")).alias("raw"), F.lit(True).alias("correct"),
    )


def _files(tmp_path, table="responses"):
    return {f.name: int(re.search(r"_(\d+)\.c", f.name)[1]) for f in Path(tmp_path, table).glob("*.parquet")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reading_needs_no_shuffle(spark, tmp_path):
    store = s.Store(spark, str(tmp_path), 4)
    for text in "abc":
        store.upsert("responses", _responses(spark, 200, text))
    assert "Exchange" not in _plan(store.read("responses")) and "Bucketed: true" in _plan(store.read("responses"))
    assert {r.raw[0] for r in store.read("responses").collect()} == {"c"} and store.read("responses").count() == 200
    other = s.Store(spark.newSession(), str(tmp_path))  # another session finds the number of buckets by the folder
    assert "Exchange" not in _plan(other.read("responses")) and other.read("responses").count() == 200
    # Two tables of one key meet where they lie.
    telemetry = _responses(spark, 200, "x").withColumn("reasoning_tokens", F.lit(3))
    store.upsert("telemetry", telemetry)
    both = store.stored("responses").groupBy(s.HASH).count().join(store.stored("telemetry").groupBy(s.HASH).count().withColumnRenamed("count", "m").hint("merge"), s.HASH)
    assert "Exchange" not in _plan(both) and both.count() == 200


def test_compaction_leaves_buckets_alone_that_did_not_change(spark, tmp_path):
    store = s.Store(spark, str(tmp_path), 8)
    store.upsert("responses", _responses(spark, 300, "a"))
    before = _files(tmp_path)
    assert sorted(before.values()) == list(range(8)) and store.compact("responses") == []
    store.upsert("responses", _responses(spark, 1, "b"))
    touched = {b for f, b in _files(tmp_path).items() if f not in before}
    assert len(touched) == 1 and store.compact("responses") == sorted(touched)
    after = _files(tmp_path)
    assert {f for f in before if before[f] not in touched} <= set(after) and len(after) == 8
    got = {r.item_id: r.raw for r in store.read("responses").collect()}
    assert got == {str(k): ("b" if k == 0 else "a") + str(k) for k in range(300)}


def test_a_compaction_broken_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = s.Store(spark, str(tmp_path), 2)
    for text in "ab":
        store.upsert("responses", _responses(spark, 50, text))
    want = sorted(map(str, store.read("responses").collect()))

    def stop(self, name):
        raise KeyboardInterrupt

    monkeypatch.setattr(s.Folder, "remove", stop)
    with pytest.raises(KeyboardInterrupt):
        store.compact("responses")
    assert len(_files(tmp_path)) == 6 and sorted(map(str, store.read("responses").collect())) == want
    monkeypatch.undo()
    assert store.compact("responses") == [0, 1] and len(_files(tmp_path)) == 2 and sorted(map(str, store.read("responses").collect())) == want


def test_unfinished_batches_are_not_seen(spark, tmp_path, monkeypatch):
    store = s.Store(spark, str(tmp_path), 2)
    store.upsert("responses", _responses(spark, 20, "a"))
    monkeypatch.setattr(s.Folder, "remove", lambda self, name: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.upsert("responses", _responses(spark, 30, "b"))
    monkeypatch.undo()
    assert store.read("responses").count() == 20 and {r.raw[0] for r in store.read("responses").collect()} == {"a"}
    store.compact("responses")
    assert store.read("responses").count() == 20 and not store._log("responses", "pending").names()
    failing = _responses(spark, 5, "c").withColumn("raw", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        store.upsert("responses", failing)
    assert store.read("responses").count() == 20


def test_a_named_batch_is_stored_once(spark, tmp_path, monkeypatch):
    store = s.Store(spark, str(tmp_path), 2)
    first = store.upsert("responses", _responses(spark, 5, "a"), "epoch-1")
    assert store.upsert("responses", _responses(spark, 5, "b"), "epoch-1") == first == store.batch_named("responses", "epoch-1")
    assert {r.raw[0] for r in store.read("responses").collect()} == {"a"}
    monkeypatch.setattr(s.Folder, "put", lambda self, name, text, put=s.Folder.put: put(self, name, text) if name != "epoch-2" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.upsert("responses", _responses(spark, 9, "c"), "epoch-2")
    assert store.read("responses").count() == 5 and store.batch_named("responses", "epoch-2") is None
    monkeypatch.undo()
    second = store.upsert("responses", _responses(spark, 7, "d"), "epoch-2")
    assert {r.raw[0] for r in store.read("responses").collect()} == {"d"} and store.read("responses").count() == 7
    assert store.read("responses", before=second).count() == 5 == store.read("responses", until=first).count()


def test_a_row_is_looked_up_in_one_bucket(spark, tmp_path):
    store = s.Store(spark, str(tmp_path), 8)
    rows = _responses(spark, 4000, "x").withColumns({"reasoning_tokens": F.col("item_id").cast("int"), "unobservable_fields": F.create_map(F.lit("k"), F.lit("v"))})
    store.upsert("telemetry", rows)
    found = store.telemetry_of("r", "1234", 0)
    assert [r.reasoning_tokens for r in found.collect()] == [1234] and store.telemetry_of("r", "none", 0).collect() == []
    plan = _plan(found)
    assert "SelectedBucketsCount: 1 out of 8" in plan and "Exchange" not in plan and "_hash" in plan.split("PushedFilters")[1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = store.telemetry_of("r", "77", 0)
        scan = found._jdf.queryExecution().executedPlan()
        found._jdf.queryExecution().toRdd().count()
        while scan.children().size():
            scan = scan.children().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
        assert 1 <= read < 800  # of one bucket's file, not of the eight that hold 4,000 rows
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_the_row_of_a_null_key_is_found(spark, tmp_path):
    store = s.Store(spark, str(tmp_path), 2)
    store.upsert("responses", spark.createDataFrame([(None, *_row("a", 0, "n")[1:]), _row("a", 0, "x")], RESPONSES))
    assert [r.raw for r in store.find("responses", None, "a", 0).collect()] == ["n"] and [r.raw for r in store.find("responses", "r", "a", 0).collect()] == ["x"]
