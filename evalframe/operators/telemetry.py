"""Telemetry of single responses: token entropies, event streams, and what could not be observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

LOW_LOGPROB, SPREAD = -2.0, 2.0


def token_entropy(content: Column) -> Column:
    """Struct of entropy statistics over an array of tokens with their likeliest alternatives, or null if no token has any.

    Each token's entropy is that of its alternatives after they are made to sum
    to 1. Friction counts tokens over the mean plus two deviations, spikes those
    whose own log probability is under -2.
    """

    def measured(token: Column) -> Column:
        given = F.transform(F.filter(token["top_logprobs"], lambda e: e["logprob"].isNotNull()), lambda e: F.exp(e["logprob"]))

        def of(p: Column, z: Column) -> Column:
            h = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / z * F.log2(x / z)).otherwise(0.0))
            return F.when(z > 0, F.struct(h.alias("h"), F.coalesce(token["logprob"] < LOW_LOGPROB, F.lit(False)).alias("spike")))

        return let(given, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), lambda z: of(p, z)))

    def spread(tokens: Column, n: Column, mean: Column, deviation: Column) -> Column:
        return F.struct(
            mean.alias("token_entropy_mean"), F.array_max(F.transform(tokens, lambda x: x["h"])).alias("token_entropy_max"),
            F.size(F.filter(tokens, lambda x: (deviation > 0) & (x["h"] > mean + deviation * SPREAD))).alias("friction_transitions"),
            F.size(F.filter(tokens, lambda x: x["spike"])).alias("logprob_divergence_spikes"), n.alias("n_tokens_scored"),
        )

    def summary(tokens: Column) -> Column:
        n = F.size(tokens)
        mean = F.aggregate(tokens, F.lit(0.0), lambda s, x: s + x["h"]) / n
        square = lambda m: F.aggregate(tokens, F.lit(0.0), lambda s, x: s + (x["h"] - m) * (x["h"] - m))
        return F.when(n > 0, let(mean, lambda m: let(F.sqrt(square(m) / n), lambda sd: spread(tokens, n, m, sd))))

    return let(F.filter(F.transform(content, measured), lambda x: x.isNotNull()), summary)


def stream_summary(events: Column) -> Column:
    """Fold a message stream, in order: text, token counts, and when the first event, reasoning and answer came (seconds from the request)."""
    of = lambda keep: F.filter(events, keep)
    first = lambda keep: F.get(F.transform(of(keep), lambda e: e["at"]), 0)
    last = lambda keep, name: F.try_element_at(F.transform(of(keep), lambda e: e[name]), F.lit(-1))
    is_delta = lambda e: e["type"] == "content_block_delta"
    starts = lambda e, kind: (e["type"] == "content_block_start") & (e["block"] == kind)
    text = lambda e: is_delta(e) & (e["block"] == "text")
    ended = lambda e: e["type"] == "message_delta"
    return F.struct(
        F.array_join(F.transform(of(text), lambda e: e["text"]), "").alias("text"),
        last(lambda e: e["type"] == "message_start", "input_tokens").alias("prompt_tokens"),
        last(ended, "output_tokens").alias("completion_tokens"),
        F.coalesce(last(lambda e: ended(e) & e["thinking_tokens"].isNotNull(), "thinking_tokens"), F.lit(0)).alias("thinking_tokens"),
        F.get(F.transform(events, lambda e: e["at"]), 0).alias("ttft"),
        first(lambda e: starts(e, "thinking") | (is_delta(e) & (e["block"] == "thinking"))).alias("first_reasoning"),
        first(lambda e: starts(e, "text") | text(e)).alias("answer_wall"),
    )


def _ms(seconds: Column) -> Column:
    return F.bround(F.round(seconds * 1000, 6)).cast("int")


def build(calls: DataFrame) -> DataFrame:
    """Telemetry rows from calls ``(run_id, item_id, sample_idx, capabilities, prompt_tokens, completion_tokens, thinking_tokens, ttft, first_reasoning, answer_wall, entropy)``.

    What a provider does not show is null, with the reason in
    ``unobservable_fields``; reasoning tokens are 0 with source ``unavailable``.
    ``entropy`` is what ``token_entropy`` gives, or null.
    """
    shown = F.coalesce("thinking_tokens", F.lit(0)) != 0
    reasoning = F.when(shown, F.col("thinking_tokens")).otherwise(F.lit(0))
    answer = F.greatest(F.col("completion_tokens") - reasoning, F.lit(1))
    density = F.when(shown & (F.coalesce("completion_tokens", F.lit(0)) != 0), (F.col("completion_tokens") - answer) / answer)
    ttft, first, wall = (_ms(F.col(c)) for c in ("ttft", "first_reasoning", "answer_wall"))
    measured = F.col("entropy").isNotNull()
    # Fields that may be unobservable, and why.
    reasons = (
        (~shown, "reasoning_tokens", "not_exposed_by_provider"), (density.isNull() & ~shown, "reasoning_density_proxy", "reasoning_tokens_unavailable"),
        (first.isNotNull(), "first_reasoning_ms", "ops_only_equals_ttft_when_display_omitted"), (wall.isNull() | ttft.isNull(), "reasoning_wall_ms", "ttft_or_answer_wall_unavailable"),
        (~measured, "token_entropy", "requires_provider_logprobs"), (F.lit(True), "thinking_tps", "unobservable"), (F.lit(True), "tot_branch_map", "unobservable_without_raw_cot"),
    )
    entries = F.array(*[F.when(on, F.struct(F.lit(name).alias("key"), F.lit(why).alias("value"))) for on, name, why in reasons])
    e = lambda name: F.col("entropy")[name].alias(name)
    return calls.select(
        "run_id", "item_id", "sample_idx", "capabilities", F.when(shown, "native_usage").otherwise("unavailable").alias("reasoning_token_source"), "prompt_tokens", "completion_tokens",
        reasoning.cast("int").alias("reasoning_tokens"), density.alias("reasoning_density_proxy"), ttft.alias("ttft_ms"), first.alias("first_reasoning_ms"),
        F.when(wall.isNotNull() & ttft.isNotNull(), F.greatest(wall - ttft, F.lit(0))).alias("reasoning_wall_ms"), wall.alias("answer_wall_ms"),
        e("token_entropy_mean"), e("token_entropy_max"), e("friction_transitions"), e("logprob_divergence_spikes"),
        F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("unobservable_fields"),
    )
