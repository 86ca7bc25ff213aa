from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalframe.operators import messages, respond, telemetry
from evalframe.problems import build, spec
from evalframe.sources.schema import ERROR, EVENTS, LOGPROBS
from evalframe.sources.store import Store
from evalframe.streaming import live


@pytest.fixture(scope="module")
def items(spark):
    df = build.make(spec.specifications(spark, ["arithmetic", "ordering", "dynamic_pivot", "knights_knaves"], 1, 3, 2)).cache()
    df.count()
    return df


def test_a_perfect_stand_in(items):
    r = respond.run_mock(items, "r", "perfect", 2)
    assert r.count() == items.count() * 2 and r.where("not correct").count() == 0
    two = r.join(items.where("subgold is not null").select("item_id"), "item_id", "left_semi")
    assert two.count() > 0 and two.where("metadata.intermediate_correct").count() == two.count()


def test_run_resumes(spark, items, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("items", items)
    respond.run(store, "r", lambda x: respond.run_mock(x, "r", "noisy", 2))
    first = store.read("responses").orderBy("item_id", "sample_idx").collect()
    asked = []
    respond.run(store, "r", lambda x: asked.append(x.count()) or respond.run_mock(x, "r", "noisy", 2))
    assert asked == [0] and store.read("responses").orderBy("item_id", "sample_idx").collect() == first
    respond.run(store, "r", lambda x: respond.run_mock(x, "r", "noisy", 2), resume=False)
    assert store.read("responses").count() == len(first)


def test_any_client(spark, items):
    def make():
        tries = {}

        def ask(asked):
            key = json.dumps(asked)
            tries[key] = tries.get(key, 0) + 1
            if tries[key] == 1:
                raise respond.RetryLater("busy", 0)
            if "tallest" in key:
                raise ValueError("bad body")
            return respond.Reply(f"{len(asked)} messages\nANSWER: 1\nCONFIDENCE: 60", 5, 6)

        return ask

    got = respond.run_client(items, "r", make, 1, True, 2, lambda s: None).join(items.select("item_id", "family", "subgold", "prompt"), "item_id").collect()
    for r in got:
        failed = r.family == "ordering" and "tallest" in r.prompt
        assert (r.raw == ERROR) == failed and (r.correct is None) == failed
        if r.family == "dynamic_pivot":
            assert r.raw.startswith("4 messages") and r.metadata.intermediate_parsed == "1"
        elif not failed:
            assert r.raw.startswith("2 messages") and (r.prompt_tokens, r.completion_tokens, r.confidence) == (5, 6, 60)


def test_backoff():
    assert [respond.backoff(respond.RetryLater("x"), a) for a in (0, 2, 9)] == [1, 4, 8]
    assert respond.backoff(respond.RetryLater("x", 500), 0) == 60


def test_messages(spark):
    df = spark.createDataFrame([("p", None, "choice", ["a", "b"]), ("p", ["one", "two"], "int", None)], "prompt string, turns array<string>, kind string, choices array<string>")
    how = messages.instructions(F.col("kind"), F.col("choices"))
    single, several = df.select(messages.build(F.col("prompt"), F.col("turns"), how).alias("m"), messages.by_role(messages.build(F.col("prompt"), F.col("turns"), how)).alias("r")).collect()
    assert [m.role for m in single.m] == ["system", "user"] and single.m[1].content.endswith(messages.OPTIONS + "a, b.")
    assert [m.role for m in several.m] == ["system", "user", "assistant", "user"] and several.m[1].content == "one" and several.m[3].content.startswith("two\n\n")
    assert several.r.system == messages.SYSTEM and [m.role for m in several.r.chat] == ["user", "assistant", "user"]
    nxt = df.where("turns is not null").select(messages.next_turn(F.col("turns"), F.array(F.lit("mine")), F.lit("how")).alias("m")).first().m
    assert [(m.role, m.content) for m in nxt[1:]] == [("user", "one\n\nhow"), ("assistant", "mine"), ("user", "two\n\nhow")]


def test_token_entropy(spark):
    import math

    half = [("a", math.log(0.5)), ("b", math.log(0.5))]
    rows = [([("a", -0.7, half)],), ([("a", -3.0, half), ("b", -0.1, [("b", 0.0)])],), ([],), (None,), ([("a", -0.1, None)],), ([("a", None, [("x", None)])],)]
    got = [r.e for r in spark.createDataFrame(rows, f"c {LOGPROBS}").select(telemetry.token_entropy(F.col("c")).alias("e")).collect()]
    assert got[0].token_entropy_mean == pytest.approx(1) and got[0].logprob_divergence_spikes == 0
    assert got[1].logprob_divergence_spikes == 1 and got[1].n_tokens_scored == 2 and got[1].token_entropy_max == pytest.approx(1)
    assert got[2:] == [None] * 4


def test_event_stream(spark):
    e = lambda at, kind, block=None, text=None, i=None, o=None, t=None: (at, kind, block, text, i, o, t)
    rows = [([e(0.1, "message_start", i=10), e(0.2, "content_block_start", "thinking"), e(0.5, "content_block_start", "text"), e(0.6, "content_block_delta", "text", "a"), e(0.7, "content_block_delta", "text", "b"), e(0.8, "message_delta", o=100, t=30)],), ([],)]
    full, empty = [r.s for r in spark.createDataFrame(rows, f"e {EVENTS}").select(telemetry.stream_summary(F.col("e")).alias("s")).collect()]
    assert tuple(full) == ("ab", 10, 100, 30, 0.1, 0.2, 0.5) and tuple(empty) == ("", None, None, 0, None, None, None)


def test_telemetry_is_honest(spark):
    schema = "run_id string, item_id string, sample_idx int, capabilities array<string>, prompt_tokens int, completion_tokens int, thinking_tokens int, ttft double, first_reasoning double, answer_wall double, entropy struct<token_entropy_mean:double,token_entropy_max:double,friction_transitions:int,logprob_divergence_spikes:int,n_tokens_scored:int>"
    rows = [("r", "a", 0, [], 10, 100, 30, 0.1, 0.2, 0.5, None), ("r", "b", 0, [], 10, 100, 0, 0.1, None, None, None)]
    a, b = telemetry.build(spark.createDataFrame(rows, schema)).orderBy("item_id").collect()
    assert (a.reasoning_token_source, a.reasoning_tokens, a.reasoning_wall_ms, a.answer_wall_ms) == ("native_usage", 30, 400, 500)
    assert (b.reasoning_token_source, b.reasoning_tokens, b.reasoning_density_proxy) == ("unavailable", 0, None) and b.unobservable_fields["reasoning_tokens"] == "not_exposed_by_provider"


def test_streamed_upserts(spark, items, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batch = respond.run_mock(items, "r", "noisy", 2)
    batch.write.parquet(str(tmp_path / "in"))
    batch.withColumn("latency_ms", F.lit(5)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    live.upsert_stream(stream, store, str(tmp_path / "check")).awaitTermination()
    assert store.read("responses").count() == batch.count()


def test_late_rows_and_repeated_arrivals(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k, 1.0 v union all select timestamp'2024-01-01 00:20:00', 'a', 3.0 union all select timestamp'2024-01-01 01:05:00', 'b', 5.0")
    rows.write.parquet(str(tmp_path / "in"))
    got = {(str(r.window_start), r.k): (r.n, r["mean"]) for r in live.rates_so_far(spark, str(tmp_path / "in"), "ts", ["k"], "v").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): (2, 2.0), ("2024-01-01 01:00:00", "b"): (1, 5.0)}
    later = spark.sql("select timestamp'2024-01-09 00:00:00' ts, 'a' k, 7.0 v")  # files out of order, one a batch: the last is a week behind
    for part in (later, spark.sql("select timestamp'2024-01-01 00:59:00' ts, 'a' k, 5.0 v")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one_by_one = {(str(r.window_start), r.k): (r.n, r["mean"]) for r in live.rates_so_far(spark, str(tmp_path / "in"), "ts", ["k"], "v", files=1).collect()}
    assert one_by_one == {("2024-01-01 00:00:00", "a"): (3, 3.0), ("2024-01-01 01:00:00", "b"): (1, 5.0), ("2024-01-09 00:00:00", "a"): (1, 7.0)}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = live.first_arrivals(stream, ["k"], "ts").writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert spark.table("arrivals").count() == 2
    assert Path(tmp_path / "c").exists()
