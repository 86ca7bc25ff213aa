"""Accuracy, coverage and what they rest on: degradation curves, chance, strictness, ill-posed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grading
from ..functions import stats as st
from ..sources.schema import ERROR
from .items import base_answered


#: Sums of one aggregate by their names, and the columns that are made of them.
Terms = tuple[dict[str, Column], list[Column]]


def per_run(frame: DataFrame, *terms: Terms) -> DataFrame:
    """Several metrics of each run by one conditional aggregate."""
    sums = {name: c for s, _ in terms for name, c in s.items()}
    return frame.groupBy("run_id").agg(*[c.alias(name) for name, c in sums.items()]).select("run_id", *[c for _, out in terms for c in out])


def coverage_terms() -> Terms:
    n, answered = F.col("__items"), F.col("__answered")
    sums = {"__items": F.count("*"), "__answered": st.count_if(F.col("answered")), "__samples": F.max("k")}
    return sums, [n.alias("n_items"), F.col("__samples").alias("samples_per_item"), answered.alias("answered"), (n - answered).alias("errored"), st.share(answered, n).alias("coverage")]


def coverage(frame: DataFrame) -> DataFrame:
    """Items, those whose first sample was answered, the rest, and the share answered, of each run. A missing first sample counts as an error."""
    return per_run(frame, coverage_terms())


def overall_terms(accuracy: str = "accuracy", n: str = "n") -> Terms:
    right = F.when((F.col("probe") == "base") & F.col("answered"), F.col("s0_correct").cast("double"))
    return {"__accuracy": F.avg(right), "__n": F.count(right)}, [F.coalesce("__accuracy", F.lit(0.0)).alias(accuracy), F.col("__n").alias(n)]


def overall(frame: DataFrame) -> DataFrame:
    """Mean of right first samples over answered base items; 0 for a run without any."""
    return per_run(frame, overall_terms())


def by_family(frame: DataFrame) -> DataFrame:
    return base_answered(frame).groupBy("run_id", "family").agg(st.mean_of(F.col("s0_correct")).alias("accuracy"), F.count("*").alias("n"))


def with_totals(frame: DataFrame) -> DataFrame:
    """Accuracy by family and, with a null family, of the whole run; the sets are formed over the families' sums, not over the rows."""
    sums = base_answered(frame).groupBy("run_id", "family").agg(st.count_if(F.col("s0_correct")).alias("k"), F.count("*").alias("n"))
    sets = sums.groupingSets([["run_id"], ["run_id", "family"]], "run_id", "family").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), (F.grouping_id() != 0).alias("total"))
    return sets.select("run_id", "family", "total", "n", st.share(F.col("k"), F.col("n")).alias("accuracy"))


def golds_of(frame: DataFrame) -> DataFrame:
    """Sums that curves and chance are made of: ``n`` answered base items and ``k`` right ones by run, family, difficulty and gold."""
    return base_answered(frame).groupBy("run_id", "family", "difficulty", "gold").agg(F.count("*").alias("n"), st.count_if(F.col("s0_correct")).alias("k"))


def degradation(frame: DataFrame) -> DataFrame:
    """Accuracy along each family's difficulty with its Wilson interval and population standard deviation."""
    return degradation_of(base_answered(frame).select("run_id", "family", "difficulty", F.lit(1).alias("n"), F.col("s0_correct").cast("int").alias("k")))


def degradation_of(golds: DataFrame) -> DataFrame:
    cell = golds.groupBy("run_id", "family", "difficulty").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    p = F.col("k") / F.col("n")
    return cell.withColumn("w", st.wilson(F.col("k"), F.col("n"))).select("run_id", "family", "difficulty", "n", "w.mean", "w.lo", "w.hi", F.sqrt(p * (1 - p)).alias("std"))


def error_bars(curve: DataFrame) -> DataFrame:
    """The points of ``degradation`` with the lengths of their error bars; rounding never makes one negative."""
    length = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0.0))
    return curve.select("run_id", "family", "difficulty", "mean", length("mean", "lo").alias("below"), length("hi", "mean").alias("above"))


def chance(frame: DataFrame) -> DataFrame:
    """By family: accuracy, what always guessing the commonest gold would reach, and accuracy above that. Unbounded integers have no chance."""
    return chance_of(base_answered(frame).select("run_id", "family", "gold", F.lit(1).alias("n"), F.col("s0_correct").cast("int").alias("k")))


def chance_of(golds: DataFrame) -> DataFrame:
    by_gold = golds.groupBy("run_id", "family", "gold").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    family = by_gold.groupBy("run_id", "family").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("n").alias("mode"))
    guess = F.when(F.col("family").isin(*st.UNBOUNDED), F.lit(0.0)).otherwise(F.col("mode") / F.col("n"))
    rated = family.select("run_id", "family", "n", (F.col("k") / F.col("n")).alias("accuracy"), guess.alias("chance"))
    return rated.withColumn("above_chance", st.above_chance(F.col("accuracy"), F.col("chance")))


def macro_above_chance(frame: DataFrame) -> DataFrame:
    """Unweighted mean of accuracy above chance over a run's families."""
    return macro_of(chance(frame))


def macro_of(rated: DataFrame) -> DataFrame:
    return rated.groupBy("run_id").agg(F.avg("above_chance").alias("above_chance"), F.count("*").alias("families"))


def with_strict(frame: DataFrame) -> DataFrame:
    """The frame with ``__strict``: whether an answered base item is right by its marker alone."""
    marker = grading.of_marker(F.col("s0_marker"), F.col("answer_type"), F.col("choices"))
    return frame.withColumn("__strict", F.when(F.col("answered") & (F.col("probe") == "base"), grading.is_right(marker, F.col("gold"), F.col("answer_type"))))


def strict_terms() -> Terms:
    """Of a frame ``with_strict``."""
    sums = {"__strictly": st.mean_of(F.col("__strict")), "__loose": st.count_if(F.col("s0_correct") & ~F.col("__strict")), "__given": st.count_if(F.col("answered"))}
    return sums, [F.coalesce("__strictly", F.lit(0.0)).alias("strict_accuracy"), st.share(F.col("__loose"), F.col("__given")).alias("fallback_reliance")]


def strict(frame: DataFrame) -> DataFrame:
    """Accuracy by the marker alone, and the share of answered items (of all probes) that only a fallback made right."""
    return per_run(with_strict(frame), strict_terms())


def fragility(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the answered samples of base items that give another answer by the marker than by the prose."""
    base = items.where(F.col("probe") == "base").select("item_id", "answer_type", "choices")
    said = responses.where(F.col("raw").isNotNull() & (F.col("raw") != ERROR)).select("run_id", "item_id", "raw").join(base, "item_id")
    args = (F.col("raw"), F.col("answer_type"), F.col("choices"))
    differ = ~grading.marker_only(*args).eqNullSafe(grading.prose_only(*args))
    return said.select("run_id", differ.alias("differ")).groupBy("run_id").agg(F.count("*").alias("n"), st.mean_of(F.col("differ")).alias("fragility"))


def ill_posed_terms() -> Terms:
    base = F.col("probe") == "base"
    ill, sentinel = st.is_sentinel(F.col("gold")), F.coalesce(st.is_sentinel(F.col("s0_parsed")), F.lit(False))
    definite = F.col("answered") & (F.coalesce("s0_parsed", F.lit("")) != "") & ~sentinel
    sums = {"__ill": st.count_if(base & ill), "__well": st.count_if(base & ~ill), "__definite": st.count_if(base & ill & definite), "__sentinel": st.count_if(base & ~ill & sentinel)}
    return sums, [
        st.share(F.col("__definite"), F.col("__ill")).alias("confabulation_rate"), st.share(F.col("__sentinel"), F.col("__well")).alias("false_undetermined_rate"), F.col("__ill").alias("n_ill_posed"), F.col("__well").alias("n_well_posed"),
    ]


def ill_posed(frame: DataFrame) -> DataFrame:
    """Confabulation: ill-posed base items answered with something definite; false sentinels: well-posed ones answered with a sentinel. Failed items count below the line."""
    return per_run(frame.where(F.col("probe") == "base"), ill_posed_terms())


def backtracking_terms(family: str = "dynamic_pivot") -> Terms:
    own, committed = (F.col("probe") == "base") & (F.col("family") == family), F.col("s0_intermediate")
    sums = {
        "__own": st.count_if(own), "__first": st.mean_of(F.when(own, committed)), "__last": st.mean_of(F.when(own, F.col("s0_correct"))),
        "__committed": st.count_if(own & committed), "__revised": st.count_if(own & committed & F.coalesce("s0_correct", F.lit(False))),
    }
    return sums, [F.when(F.col("__own") > 0, F.struct(
        F.col("__own").alias("n"), F.col("__first").alias("intermediate_accuracy"), F.col("__last").alias("final_accuracy"), st.share(F.col("__revised"), F.col("__committed")).alias("revision_success"),
    )).alias("backtracking")]


def backtracking(frame: DataFrame, family: str = "dynamic_pivot") -> DataFrame:
    """Items that commit to an answer and must then revise it: both accuracies, and how often a right commitment was revised rightly."""
    return per_run(frame, backtracking_terms(family)).where("backtracking is not null").select("run_id", "backtracking.*")
