"""Message events that arrive as rows, against the fold of whole arrays."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evalframe.operators.telemetry import stream_summary
from evalframe.sources.schema import EVENTS
from evalframe.streaming import live

ROW = "k string, seq int, at double, type string, block string, text string, input_tokens int, output_tokens int, thinking_tokens int"


def _message(k, n, end=True):
    rows = [(k, 0, 0.1, "message_start", None, None, 9, None, None), (k, 1, 0.2, "content_block_start", "text", None, None, None, None)]
    rows += [(k, 2 + i, 0.3 + i, "content_block_delta", "text", f"{k}{i} ", None, None, None) for i in range(n)]
    return rows + ([(k, 2 + n, 1.0 + n, "message_delta", None, None, None, n, 3)] if end else [])


def test_any_order_and_repetitions(spark, tmp_path):
    messages = {f"m{j}": _message(f"m{j}", j) for j in range(12)}
    want = {r.k: tuple(r.s) for r in spark.createDataFrame([(k, [x[2:] for x in v]) for k, v in messages.items()], f"k string, e {EVENTS}").select("k", stream_summary(F.col("e")).alias("s")).collect()}
    rows = [x for v in messages.values() for x in v]
    rows += random.Random(1).sample(rows, 40)
    random.Random(2).shuffle(rows)
    for part in range(6):
        spark.createDataFrame(rows[part::6], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = live.folds_so_far(spark, str(tmp_path / "in"), ["k"], files=1).collect()
    assert {r.k: tuple(r)[1:8] for r in got} == want and all(r.complete and r.n_events == len(messages[r.k]) for r in got)


def test_unfinished_and_broken_messages(spark):
    gone = [x for x in _message("gone", 4) if x[1] != 3]
    two = [*_message("two", 1), ("two", 2, 0.3, "content_block_delta", "text", "other", None, None, None)]
    got = {r.k: r for r in live.folded(spark.createDataFrame([*_message("open", 2, end=False), *gone, *two], ROW), ["k"]).collect()}
    assert {k: (r.complete, r.text) for k, r in got.items()} == {"open": (False, "open0 open1 "), "gone": (False, "gone0 gone2 gone3 "), "two": (True, "othertwo0 ")}
    assert got["two"].n_events == 5 and got["open"].completion_tokens is None


def test_messages_close_when_nothing_comes(spark, tmp_path):
    """By event time: a pause longer than the limit closes a message, finished or not, and each is given once."""
    def write(rows, minutes):
        stamped = spark.createDataFrame([(*x, m) for x, m in zip(rows, minutes, strict=True)], ROW + ", m int").withColumn("arrived", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)")).drop("m")
        stamped.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    a, b = _message("a", 2), _message("b", 2, end=False)
    write(a[2:] + b[:2], [3, 4, 5, 0, 1])
    write(a[:2] + b[2:], [1, 2, 40, 41])
    write(_message("late", 0), [300, 301, 302])
    write(_message("last", 0), [600, 601, 602])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.folded(stream, ["k"], "arrived").writeStream.format("memory").queryName("folds").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = sorted((r.k, r.n_events, r.complete, r.text) for r in spark.table("folds").collect())
    assert got == [("a", 5, True, "a0 a1 "), ("b", 2, False, ""), ("b", 2, False, "b0 b1 "), ("late", 3, True, "")]
