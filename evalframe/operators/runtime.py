"""What a run cost: calls, latencies, tokens, hidden reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from ..sources.store import materialise
from .items import slim
from .sampling import percentiles


def whole(x: Column) -> Column:
    """To the nearest integer, halves to the even one; what only floating point tells apart counts as a half."""
    return F.bround(F.round(x, 6)).cast("long")


def latency(responses: DataFrame) -> DataFrame:
    """Calls, failed ones, and latencies of all calls in whole milliseconds (0 where none is known)."""
    narrow = materialise(slim(responses).select("run_id", "latency_ms", "call_failed"))  # gone over several times
    calls = narrow.groupBy("run_id").agg(F.count("*").alias("n_calls"), st.count_if(F.col("call_failed")).alias("errored"), F.avg("latency_ms").alias("mean"))
    found = percentiles(narrow, ["run_id"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    some = lambda c: F.coalesce(whole(F.col(c)), F.lit(0).cast("long"))
    return calls.join(found, "run_id", "left").select(
        "run_id", "n_calls", "errored", some("p50").alias("latency_p50_ms"), some("p95").alias("latency_p95_ms"), some("mean").alias("latency_mean_ms")
    )


def tokens(responses: DataFrame) -> DataFrame:
    """Token totals of calls whose usage is known."""
    none = F.lit(0).cast("long")
    return responses.groupBy("run_id").agg(
        (F.count("completion_tokens") > 0).alias("tokens_available"), F.coalesce(F.sum("prompt_tokens"), none).alias("prompt_tokens_total"),
        F.coalesce(F.sum("completion_tokens"), none).alias("completion_tokens_total"), F.coalesce(whole(F.avg("completion_tokens")), none).alias("completion_tokens_mean"),
    )


def observable(telemetry: DataFrame) -> DataFrame:
    """Telemetry whose reasoning tokens a provider really reported."""
    return telemetry.where("reasoning_token_source is not null and reasoning_token_source <> 'unavailable' and reasoning_tokens is not null")


def reasoning(responses: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Hidden reasoning of each run: total, mean, share of the completion, tokens per right answer; nulls where none was reported."""
    run = responses.groupBy("run_id").agg(F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion"), st.count_if(F.col("correct")).alias("right"))
    seen = observable(telemetry).groupBy("run_id").agg(F.sum("reasoning_tokens").alias("total"), F.avg("reasoning_tokens").alias("mean"))
    none = F.lit(0).cast("long")
    return run.join(seen, "run_id", "left").select(
        "run_id", F.col("total").isNotNull().alias("reasoning_available"), F.coalesce("total", none).alias("reasoning_tokens_total"), F.coalesce(whole(F.col("mean")), none).alias("reasoning_tokens_mean"),
        st.share(F.col("total"), F.col("completion")).alias("reasoning_fraction"), st.share(F.col("total"), F.col("right")).alias("reasoning_tokens_per_correct"),
    )


def reasoning_rows(responses: DataFrame, telemetry: DataFrame, items: DataFrame) -> DataFrame:
    """Responses whose reasoning was reported, with difficulty and grade."""
    key = ["run_id", "item_id", "sample_idx"]
    graded = responses.select(*key, "correct")
    return observable(telemetry).select(*key, "reasoning_tokens").join(graded, key).join(items.select("item_id", "difficulty"), "item_id")


def reasoning_by_difficulty(rows: DataFrame) -> DataFrame:
    right = F.coalesce("correct", F.lit(False))
    return rows.groupBy("run_id", "difficulty").agg(whole(F.avg("reasoning_tokens")).alias("mean_reasoning_tokens"), st.mean_of(right).alias("accuracy"), F.count("*").alias("n"))


def reasoning_efficiency(rows: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Right answers per thousand reasoning tokens, and the mean effort on the easiest over that on the hardest difficulty."""
    tier = rows.groupBy("run_id", "difficulty").agg(F.avg("reasoning_tokens").alias("mean"), st.count_if(F.col("correct")).alias("right"))
    run = tier.groupBy("run_id").agg(F.sum("right").alias("right"), F.count("*").alias("tiers"), F.min_by("mean", "difficulty").alias("easy"), F.max_by("mean", "difficulty").alias("hard"))
    total = observable(telemetry).groupBy("run_id").agg(F.sum("reasoning_tokens").alias("total"))
    effort = F.when((F.col("tiers") > 1) & (F.col("hard") > 0), F.col("easy") / F.col("hard"))
    return total.join(run, "run_id", "left").select("run_id", st.share(F.coalesce("right", F.lit(0)) * 1000, F.col("total")).alias("correct_per_1k"), effort.alias("effort_scaling"))
