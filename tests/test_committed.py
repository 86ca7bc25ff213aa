"""A run that stores as it goes: broken off, resumed, delivered twice, watched."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalframe.operators import respond
from evalframe.render import text
from evalframe.sources.store import Store
from evalframe.streaming import committed


def _items(spark, n):
    return spark.range(n).select(F.format_string("i%04d", "id").alias("item_id"), F.lit("f").alias("family"), F.lit("int").alias("answer_type"), F.lit("7").alias("gold"), F.col("id").cast("string").alias("prompt"))


def _respond(asked, stop_at=None):
    """Answers 7, fails for ids that end in 9, and notes which items each step asked; the job of step ``stop_at`` breaks."""

    def client():
        def ask(messages):
            if messages[-1]["content"].split("\n")[0].endswith("9"):
                raise ValueError("no")
            return respond.Reply("ANSWER: 7")

        return ask

    def put(items):
        asked.append({r.item_id for r in items.select("item_id").collect()})
        answers = respond.run_client(items, "r", client)
        return answers.withColumn("raw", F.raise_error(F.lit("lost"))) if stop_at == len(asked) else answers

    return put


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path), 2)
    store.upsert("items", _items(spark, 53))
    asked, told = [], []
    with pytest.raises(Exception, match="lost"):
        committed.run_in_steps(store, "r", _respond(asked, 4), 10, watch=lambda p: told.append((p.done, p.right, p.failed, p.remaining)))
    assert all(len(x) <= 10 for x in asked) and [x[0] for x in told] == sorted({x[0] for x in told}) and len(told) == 3
    kept = {r.item_id for r in store.read("responses").collect()}
    assert kept == set().union(*asked[:3]) and committed.progress_of(store, "r").done == len(kept)
    again, more = [], []
    store.upsert("items", _items(spark, 54))  # one came meanwhile
    last = committed.run_in_steps(store, "r", _respond(again), 10, watch=lambda p: more.append((p.done, p.right, p.failed)))
    assert asked[3] == again[0]  # the step that was lost comes again
    failed = {f"i{k:04d}" for k in range(54) if k % 10 == 9}
    assert set().union(*again) & kept == failed & kept  # of what is stored, only what failed
    final = {r.item_id: r.correct for r in store.read("responses").collect()}
    assert len(final) == 54 and {i for i, c in final.items() if c is None} == failed and all(c for i, c in final.items() if i not in failed)
    assert more == sorted(more) and last.remaining == 0 and last.remaining_seconds == 0 and last.asked == sum(map(len, again))
    none = []
    committed.run_in_steps(store, "r", _respond(none), 10)
    assert set().union(*none) == failed
    everything = []
    committed.run_in_steps(store, "r", _respond(everything), 30, resume=False)
    assert len(set().union(*everything)) == 54 and store.read("responses").count() == 54


def test_a_step_that_is_delivered_again_is_not_asked_again(spark, tmp_path, monkeypatch):
    """The job ends after a step is stored and before the stream has noted it."""
    store = Store(spark, str(tmp_path), 2)
    store.upsert("items", _items(spark, 8))
    asked = []
    put = store.upsert

    def then_stop(table, rows, name=None):
        out = put(table, rows, name)
        if table == "responses" and len(asked) == 2:
            raise OSError("gone")
        return out

    monkeypatch.setattr(store, "upsert", then_stop)
    with pytest.raises(Exception, match="gone"):
        committed.run_in_steps(store, "r", _respond(asked), 3)
    monkeypatch.undo()
    stored = set().union(*asked)
    again = []
    committed.run_in_steps(store, "r", _respond(again), 3)
    assert not stored & set().union(*again) and store.read("responses").count() == 8


def test_long_runs_take_no_more_steps_than_told(spark, tmp_path):
    store = Store(spark, str(tmp_path), 2)
    store.upsert("items", _items(spark, 40))
    asked = []
    done = committed.run_in_steps(store, "r", _respond(asked), 2, steps=3)
    assert len(asked) <= 3 and done.remaining == 0 and set().union(*asked) == {f"i{k:04d}" for k in range(40)} and sum(map(len, asked)) == 40
    assert store.read("responses").count() == 40
    few = []
    committed.run_in_steps(store, "r", _respond(few), 2, steps=3)  # the four that failed: steps of two, as without
    assert all(len(x) <= 2 for x in few) and set().union(*few) == {f"i{k:04d}" for k in range(40) if k % 10 == 9}


def test_samples_and_no_items(spark, tmp_path):
    store = Store(spark, str(tmp_path), 2)
    store.upsert("items", _items(spark, 5))
    two = lambda items: respond.run_client(items, "a/b c", lambda: lambda messages: respond.Reply("ANSWER: 8"), 2)
    done = committed.run_in_steps(store, "a/b c", two, 2, files=2)
    assert (done.done, done.right, done.failed) == (5, 0, 0) and store.read("responses").count() == 10
    assert committed.run_in_steps(store, "a/b c", two).items == 0 and committed.progress_of(store, "other") is None


def test_progress_in_words():
    p = committed.Progress(200, 50, 30, 4, 10.0, 50)
    assert text.progress(p) == "#####............... 50/200 items, 30 right, 4 failed, 0:30 left"
    assert text.progress(committed.Progress(0)).endswith("0/0 items, 0 right, 0 failed, unknown left")
