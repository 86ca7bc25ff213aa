"""From responses to one row per run and item, the frame that most metrics start from.

All aggregates here combine before their shuffle, so an item with very many
samples is no hot spot, and columns that a metric does not use are pruned. Keys begin
with the item, so what is sorted for an aggregate is sorted for the join after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grading, text
from ..functions.stats import count_if
from ..sources.schema import ERROR

DIMENSIONS = ("family", "difficulty", "probe", "grp", "answer_type", "gold", "choices")


def slim(responses: DataFrame) -> DataFrame:
    """Responses without their texts: of a text, whether the call failed (``call_failed``) and what the first sample's marker holds (``marker``)."""
    if "raw" not in responses.columns:
        return responses
    first = F.when(F.col("sample_idx") == 0, text.answer_marker(F.col("raw")))
    return responses.withColumns({"call_failed": F.coalesce(F.col("raw") == ERROR, F.lit(False)), "marker": first}).drop("raw")


def by_item(responses: DataFrame, items: DataFrame) -> DataFrame:
    """One row per (run_id, item_id) of items that are known; other responses vanish.

    ``s0_*`` come from sample 0 and are null if it is missing; ``s0_correct`` is
    null too where its call failed. ``n`` samples, of which ``failed`` have no
    answer, ``graded`` are right or wrong and ``right`` are right; ``k`` is the
    largest sample number plus one.
    """
    first = F.col("sample_idx") == 0
    s0 = lambda c: F.max(F.when(first, F.col(c)))
    state = slim(responses).groupBy("item_id", "run_id").agg(
        F.count("*").alias("n"), (F.max("sample_idx") + 1).alias("k"), count_if(F.col("call_failed")).alias("failed"),
        F.count("correct").alias("graded"), count_if(F.col("correct")).alias("right"),
        s0("correct").alias("s0_correct"), s0("parsed").alias("s0_parsed"), s0("confidence").alias("s0_confidence"), s0("marker").alias("s0_marker"),
        s0("metadata.intermediate_correct").alias("s0_intermediate"),
    )
    return state.join(items.select("item_id", *DIMENSIONS), "item_id").withColumn("answered", F.col("s0_correct").isNotNull())


def by_item_voted(responses: DataFrame, items: DataFrame) -> DataFrame:
    """``by_item`` with the votes of each item beside it: ``winner, n_votes, n_options, entropy`` (see ``votes``; null where nothing was parsed), and ``winner_right`` for base items.

    Samples are first summed by answer and then by item, so equal answers meet
    before their item does, and frame and votes come of one pass.
    """
    first, given = F.col("sample_idx") == 0, F.col("parsed").isNotNull()
    s0 = lambda c: F.max(F.when(first, F.col(c)))
    carried = ("s0_correct", "s0_confidence", "s0_marker", "s0_intermediate")
    answers = slim(responses).groupBy("item_id", "run_id", "parsed").agg(
        F.count("*").alias("n"), F.min("sample_idx").alias("at"), F.max("sample_idx").alias("last"), count_if(F.col("call_failed")).alias("failed"), F.count("correct").alias("graded"), count_if(F.col("correct")).alias("right"),
        s0("correct").alias("s0_correct"), s0("parsed").alias("s0_parsed"), s0("confidence").alias("s0_confidence"), s0("marker").alias("s0_marker"), s0("metadata.intermediate_correct").alias("s0_intermediate"),
    )
    size = F.when(given, F.col("n").cast("double"))
    state = answers.groupBy("item_id", "run_id").agg(
        F.sum("n").alias("n"), (F.max("last") + 1).alias("k"), *[F.sum(c).alias(c) for c in ("failed", "graded", "right")], F.max("s0_parsed").alias("s0_parsed"), *[F.max(c).alias(c) for c in carried],
        F.max_by("parsed", F.when(given, F.struct(F.col("n"), -F.col("at"), F.col("parsed")))).alias("winner"), F.sum(F.when(given, F.col("n"))).alias("n_votes"), F.count("parsed").alias("n_options"),
        F.abs(F.log2(F.sum(size)) - F.sum(size * F.log2(size)) / F.sum(size)).alias("entropy"),
    )
    frame = state.join(items.select("item_id", *DIMENSIONS), "item_id").withColumn("answered", F.col("s0_correct").isNotNull())
    right = F.when((F.col("probe") == "base") & F.col("winner").isNotNull(), grading.is_right(F.col("winner"), F.col("gold"), F.col("answer_type")))
    return frame.withColumn("winner_right", right)


def base_answered(frame: DataFrame) -> DataFrame:
    """Base items whose first sample was answered."""
    return frame.where((F.col("probe") == "base") & F.col("answered"))


def votes(responses: DataFrame) -> DataFrame:
    """``(run_id, item_id, winner, n_votes, n_options, entropy)`` of items with a parsed answer.

    The winner has most votes; of those with as many, it is the one that the
    earliest sample gave. The entropy is in bits.
    """
    given = responses.where(F.col("parsed").isNotNull()).groupBy("item_id", "run_id", "parsed").agg(F.count("*").alias("n"), F.min("sample_idx").alias("at"))
    n = F.col("n").cast("double")
    voted = given.groupBy("item_id", "run_id").agg(
        F.max_by("parsed", F.struct(F.col("n"), -F.col("at"), F.col("parsed"))).alias("winner"),
        F.sum("n").alias("n_votes"),
        F.count("*").alias("n_options"),
        F.abs(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"),
    )
    return voted.select("run_id", "item_id", "winner", "n_votes", "n_options", "entropy")


def voted(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Votes on base items, with ``winner_right``."""
    base = items.where(F.col("probe") == "base").select("item_id", "family", "gold", "answer_type")
    return votes(responses).join(base, "item_id").withColumn("winner_right", grading.is_right(F.col("winner"), F.col("gold"), F.col("answer_type")))
