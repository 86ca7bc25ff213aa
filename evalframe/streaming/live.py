"""Results as they arrive (beyond what the batch tables need): windowed rates, first arrivals, and streamed upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.telemetry import stream_summary
from ..sources.schema import EVENT_FIELDS
from ..sources.store import Store, newest, shared_folder


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Number, sum and mean of a value by tumbling window and keys; state is dropped once the watermark has passed a window, and kept without one (``late`` None)."""
    marked = events.withWatermark(time, late) if events.isStreaming and late else events
    rates = marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    return rates.select(F.col("w.start").alias("window_start"), *keys, "n", "total", (F.col("total") / F.col("n")).alias("mean"))


def first_arrivals(events: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """A stream without the repetitions of a key that arrive within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(responses: DataFrame, store: Store, checkpoint: str, table: str = "responses") -> StreamingQuery:
    """Store every batch of a stream of responses; a batch that is delivered again replaces its own rows, so nothing is counted twice."""
    return responses.writeStream.foreachBatch(lambda batch, _: store.upsert(table, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(events: DataFrame, keys: list[str], arrived: str | None = None, idle: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """The fold of each message (``telemetry.stream_summary``) from rows of its events, in whatever order they come: ``keys, seq`` and the event's fields.

    Events count in the order of ``seq``. One that comes again counts once; of
    different ones with one ``seq`` both count, in the order of their fields.
    ``n_events`` says how many there are, and ``complete`` whether the message has
    ended and none is missing before its last.

    With ``arrived`` a message is closed, and given once, when nothing has come for
    ``idle`` and the watermark has passed that: one that never ends is given as far as
    it came, and what comes after a longer pause is a message of its own. Without, each
    message's fold is given anew whenever something comes.
    """
    event = F.struct("seq", *EVENT_FIELDS)
    if arrived:
        marked = events.withWatermark(arrived, late) if events.isStreaming else events
        groups = marked.groupBy(*keys, F.session_window(arrived, idle).alias("open"))
    else:
        groups = events.groupBy(*keys)
    ordered = F.array_sort("events")
    ended = F.exists("events", lambda e: e["type"] == "message_delta")
    whole = F.size(F.array_distinct(F.transform("events", lambda e: e["seq"]))) == F.array_max(F.transform("events", lambda e: e["seq"])) + 1
    got = groups.agg(F.collect_set(event).alias("events")).withColumn("s", stream_summary(ordered))
    return got.select(*keys, "s.*", F.size("events").alias("n_events"), (ended & whole).alias("complete"), *([F.col("open.start").alias("opened")] if arrived else []))


def folds_so_far(spark: SparkSession, source: str, keys: list[str], files: int = 64) -> DataFrame:
    """Read a folder of event rows as a stream to its present end, ``files`` files a batch, and give each message's latest fold."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(source)
    return _latest_states(folded(rows, keys), keys, folder)


def _latest_states(states: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a stream of states to its end; each batch's go to the folder, and the last of each key counts."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/states/batch-{number}")

    query = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return newest(states.sparkSession.read.parquet(f"{folder}/states/batch-*"), keys, "_batch").drop("_batch")


def rates_so_far(spark: SparkSession, source: str, time: str, keys: list[str], value: str, width: str = "1 hour", files: int = 64) -> DataFrame:
    """Read a parquet folder as a stream to its present end, ``files`` files a batch, and give each window's latest state.

    Updates go to the shared checkpoint folder as the stream emits them, batch
    by batch, and the last one of each window counts. The read is bounded, so
    there is no watermark: rows count however late their file comes.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{source}*").withColumn(time, F.col(time).cast("timestamp"))  # windows need instants
    states = windowed(rows, time, keys, value, width, late=None)

    return _latest_states(states, ["window_start", *keys], folder).withColumn("window_start", F.col("window_start").cast(schema[time].dataType))
