"""Stated and behavioural uncertainty: calibration, repeated samples, disagreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from .accuracy import Terms, per_run
from .items import base_answered


def calibration_bins(frame: DataFrame) -> DataFrame:
    """Answered base items that state a confidence, in bins of ten: number, mean confidence (0 to 1), accuracy."""
    stated = base_answered(frame).where(F.col("s0_confidence").isNotNull()).withColumn("b", st.confidence_bin(F.col("s0_confidence")))
    bins = stated.groupBy("run_id", "b").agg(F.count("*").alias("n"), (F.avg("s0_confidence") / 100).alias("mean_confidence"), st.mean_of(F.col("s0_correct")).alias("accuracy"))
    return bins.select("run_id", "b", st.bin_label(F.col("b")).alias("bin"), "n", "mean_confidence", "accuracy")


def calibration_terms(ece: str = "ece", n: str = "n") -> Terms:
    """The bins as conditional sums of one aggregate."""
    stated = (F.col("probe") == "base") & F.col("answered") & F.col("s0_confidence").isNotNull()
    own = lambda b: stated & (st.confidence_bin(F.col("s0_confidence")) == b)
    sums = {f"__n{b}": st.count_if(own(b)) for b in range(10)} | {f"__c{b}": F.sum(F.when(own(b), F.col("s0_confidence"))) for b in range(10)} | {f"__r{b}": st.count_if(own(b) & F.col("s0_correct")) for b in range(10)}
    # Of a bin with n items, n times the difference of its means is the difference of its sums.
    off = [F.coalesce(F.abs(F.col(f"__r{b}") - F.col(f"__c{b}") / F.lit(100.0)), F.lit(0.0)) for b in range(10)]
    total = reduce(lambda a, b: a + b, [F.col(f"__n{b}") for b in range(10)])
    return sums, [st.share(reduce(lambda a, b: a + b, off), total).alias(ece), total.alias(n)]


def calibration_error(frame: DataFrame) -> DataFrame:
    """Expected calibration error over those bins; no row for a run without confidences."""
    return per_run(frame, calibration_terms()).where("n > 0")


def pass_terms() -> Terms:
    """Of a frame with votes (``items.by_item_voted``); null for runs of one sample per item."""
    base = (F.col("probe") == "base") & (F.col("graded") > 0)
    sums = {
        "__largest": F.max("k"), "__single": F.avg(F.when(base & F.col("answered"), F.col("s0_correct").cast("double"))), "__best": F.avg(F.when(base, (F.col("right") > 0).cast("double"))),
        "__maj": st.mean_of(F.when(base, F.col("winner_right"))),
    }
    single, best, maj = (F.coalesce(c, F.lit(0.0)) for c in ("__single", "__best", "__maj"))
    told = {"k": F.col("__largest"), "pass_at_1": single, "maj_at_k": maj, "pass_at_k_oracle": best, "selfconsistency_gap": maj - single, "frontier_headroom": best - single}
    return sums, [F.when(F.col("__largest") > 1, c).alias(name) for name, c in told.items()]


def with_votes(frame: DataFrame, votes: DataFrame | None) -> DataFrame:
    """A frame that has its votes (``items.by_item_voted``) as it is; another with those of ``items.voted`` beside it."""
    if "winner_right" in frame.columns or votes is None:
        return frame
    return frame.join(votes.select("run_id", "item_id", "entropy", "winner_right"), ["run_id", "item_id"], "left")


def pass_at_k(frame: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """pass@1, majority vote and best of k over base items with any graded sample, for runs with more than one sample per item; ``votes`` for a frame without."""
    return per_run(with_votes(frame, votes), pass_terms()).where("k is not null")


def disagreement_terms() -> Terms:
    entropy = F.when(F.col("probe") == "base", F.col("entropy"))
    return {"__entropy": F.avg(entropy), "__voted": F.count(entropy)}, [F.coalesce("__entropy", F.lit(0.0)).alias("disagreement_entropy"), F.col("__voted").alias("n_voted")]


def disagreement(frame: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Mean entropy of the votes on base items; 0 for a run without votes."""
    return per_run(with_votes(frame, votes), disagreement_terms())


def behaviour(frame: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Disagreement, what voting gains, and calibration error side by side."""
    return per_run(with_votes(frame, votes), disagreement_terms(), pass_terms(), calibration_terms()).select("run_id", "disagreement_entropy", "selfconsistency_gap", F.col("ece").alias("stated_confidence_ece"))
