"""Outcome of each item in a run, with the reason, and the counts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.text import quoted
from ..sources.schema import ERROR
from .sampling import numbered

OUTCOMES = ("solved", "wrong", "errored")


def _reason(outcome: Column, n: Column, right: Column, source: Column, parsed: Column, gold: Column) -> Column:
    """The sentences that tell why."""
    got = F.concat(F.lit("got "), quoted(parsed), F.lit(", expected "), quoted(gold))
    split = F.concat(right.cast("string"), F.lit("/"), n.cast("string"))
    solved = (
        F.when(source == "fallback", "correct, but the ANSWER: marker was missing — rescued by fallback parse")
        .when((n > 1) & (right < n), F.concat(F.lit("correct by majority ("), split, F.lit(" samples agreed)")))
        .otherwise("correct")
    )
    wrong = (
        F.when((source == "none") | (F.coalesce(parsed, F.lit("")) == ""), "no parseable answer — the response had no ANSWER: line and no usable fallback")
        .when(source == "fallback", F.concat(F.lit("wrong answer ("), got, F.lit("); format off — taken from fallback parse")))
        .when((n > 1) & (right > 0), F.concat(F.lit("wrong by majority ("), got, F.lit("; only "), split, F.lit(" correct)")))
        .otherwise(F.concat(F.lit("wrong answer ("), got, F.lit(")")))
    )
    failed = F.lit("model call failed — no answer was recorded (transport/HTTP/parse error)")
    return F.when(outcome == "errored", failed).when(outcome == "solved", solved).otherwise(wrong)


def item_outcomes(responses: DataFrame, items: DataFrame) -> DataFrame:
    """``(run_id, item_id, family, difficulty, probe, gold, outcome, reason)``: errored if any sample failed, solved if most are right, else wrong.

    Responses to unknown items stay, with null dimensions.
    """
    first = F.min_by(F.struct("parsed", F.col("metadata.parse_source").alias("source")), F.col("sample_idx"))
    state = responses.groupBy("item_id", "run_id").agg(
        F.count("*").alias("n"), st.count_if(F.col("correct")).alias("right"), st.count_if(F.col("raw") == ERROR).alias("failed"), first.alias("s")
    )
    rated = state.withColumn("outcome", F.when(F.col("failed") > 0, "errored").when(F.col("right") * 2 > F.col("n"), "solved").otherwise("wrong"))
    known = rated.join(items.select("item_id", "family", "difficulty", "probe", "gold"), "item_id", "left")
    reason = _reason(F.col("outcome"), F.col("n"), F.col("right"), F.col("s.source"), F.col("s.parsed"), F.col("gold"))
    return known.select("run_id", "item_id", "family", "difficulty", "probe", "gold", "outcome", reason.alias("reason"))


def in_order(outcomes: DataFrame) -> DataFrame:
    """By family, difficulty and item; unknown ones first."""
    return outcomes.orderBy("run_id", F.coalesce("family", F.lit("")), F.coalesce("difficulty", F.lit(0)), "item_id")


def with_place(outcomes: DataFrame) -> DataFrame:
    """Outcomes with their ``position``, from 0, in that order over all runs; no task sees all of them."""
    told = outcomes.withColumns({"__family": F.coalesce("family", F.lit("")), "__difficulty": F.coalesce("difficulty", F.lit(0))})
    return numbered(told, ["run_id", "__family", "__difficulty", "item_id"]).drop("__family", "__difficulty")


def by_family(outcomes: DataFrame) -> DataFrame:
    """Counts of each outcome and the accuracy among answered items, by family."""
    family = F.coalesce("family", F.lit("(unknown)"))
    counts = outcomes.groupBy("run_id", family.alias("family")).agg(*[st.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("total"))
    return counts.withColumn("accuracy", F.coalesce(st.share(F.col("solved"), F.col("solved") + F.col("wrong")), F.lit(0.0)))


def totals(outcomes: DataFrame) -> DataFrame:
    counts = outcomes.groupBy("run_id").agg(*[st.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("total"))
    return counts.withColumn("accuracy", F.coalesce(st.share(F.col("solved"), F.col("solved") + F.col("wrong")), F.lit(0.0)))
