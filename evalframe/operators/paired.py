"""Paired probes: each base item against its variants of the same group, in one aggregate and without a self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st


def _of(probe: str, column: str) -> F.Column:
    return F.max(F.when(F.col("probe") == probe, F.col(column)))


def _groups(frame: DataFrame) -> DataFrame:
    """One row per run and group: the base item's family, grade and answer, its distractor's grade, and what its surface variants came to.

    That all variants agree shows in the least and the greatest of their answers, so nothing is collected.
    """
    surface = F.col("probe") == "surface"
    parsed = F.when(surface, F.col("s0_parsed"))
    group = frame.where(F.col("probe").isin("base", "distractor", "surface")).groupBy("run_id", "grp").agg(
        _of("base", "family").alias("family"), _of("base", "s0_correct").alias("base"), _of("distractor", "s0_correct").alias("other"), _of("base", "s0_parsed").alias("answer"),
        st.count_if(surface).alias("variants"), F.count(parsed).alias("parsed"), F.min(parsed).alias("least"), F.max(parsed).alias("greatest"),
        st.count_if(surface & F.col("answered")).alias("total"), st.count_if(surface & F.col("s0_correct")).alias("right"),
    )
    same = (F.col("parsed") == F.col("variants")) & (F.col("least") == F.col("answer")) & (F.col("greatest") == F.col("answer"))
    varied = F.col("answer").isNotNull() & (F.col("variants") > 0)
    return group.select("run_id", "grp", "family", "base", "other", varied.alias("varied"), (~F.coalesce(same, F.lit(False))).alias("flipped"), "total", "right")


def sums_of(frame: DataFrame) -> DataFrame:
    """What both probes come to by run and family, as sums: of pairs of base and distractor, and of groups with variants."""
    both = F.col("base").isNotNull() & F.col("other").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(F.col("varied"), F.col(c))), F.lit(0).cast("long")).alias(c)
    return _groups(frame).groupBy("run_id", "family").agg(
        st.count_if(both).alias("n"), st.count_if(both & F.col("base")).alias("base"), st.count_if(both & F.col("other")).alias("other"), st.count_if(both & F.col("base") & ~F.col("other")).alias("hurt"),
        st.count_if(both & ~F.col("base") & F.col("other")).alias("helped"), st.count_if(F.col("varied")).alias("groups"), st.count_if(F.col("varied") & F.col("flipped")).alias("flips"), of("total"), of("right"),
    )


def distractibility(frame: DataFrame) -> DataFrame:
    """By family, over groups whose base and distractor item were both answered: accuracies, their difference, how many it hurt and helped."""
    return distractibility_of(sums_of(frame))


def distractibility_of(sums: DataFrame) -> DataFrame:
    some = sums.where("n > 0")
    rates = {f"{c}_accuracy": st.share(F.col(x), F.col("n")) for c, x in (("base", "base"), ("distractor", "other"))}
    return some.select("run_id", "family", "n", *[c.alias(name) for name, c in rates.items()], "hurt", "helped").withColumn("drop", F.col("base_accuracy") - F.col("distractor_accuracy"))


def surface_groups(frame: DataFrame) -> DataFrame:
    """Groups with a parsed base answer and surface variants: ``flipped`` unless every variant gave the base's answer; a variant without one flips."""
    return _groups(frame).where("varied").select("run_id", "grp", "family", "flipped", "total", "right")


def invariance(frame: DataFrame, *keys: str) -> DataFrame:
    """Flip rate, consistency and surface accuracy of each run, or also by ``family``."""
    return invariance_of(sums_of(frame), *keys)


def invariance_of(sums: DataFrame, *keys: str) -> DataFrame:
    rates = sums.groupBy("run_id", *keys).agg(*[F.sum(c).alias(c) for c in ("groups", "flips", "total", "right")]).where("groups > 0")
    return rates.select(
        "run_id", *keys, "groups", st.share(F.col("flips"), F.col("groups")).alias("answer_flip_rate"), st.share(F.col("groups") - F.col("flips"), F.col("groups")).alias("consistent_rate"),
        st.share(F.col("right"), F.col("total")).alias("surface_accuracy"),
    )
