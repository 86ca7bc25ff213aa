"""Profiles of runs: one wide row each, and the long form in which they are stored."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise
from . import accuracy, outcomes, paired, runtime, uncertainty
from .items import by_item_voted, slim


@dataclass
class Evaluation:
    """The tables of some runs, and the frames that their metrics share; each is worked out once."""

    items: DataFrame
    responses: DataFrame
    telemetry: DataFrame | None = None

    @cached_property
    def slim(self) -> DataFrame:
        """The responses without their texts, written to the checkpoint folder."""
        return materialise(slim(self.responses))

    @cached_property
    def frame(self) -> DataFrame:
        """One row per run and item with its votes, written to the checkpoint folder: without texts, a row for all samples."""
        return materialise(self.lazy_frame)

    @property
    def lazy_frame(self) -> DataFrame:
        """The same, worked out where it is used: for what goes over it once."""
        return by_item_voted(self.slim if "slim" in self.__dict__ else self.responses, self.items)

    @property
    def votes(self) -> DataFrame:
        """The votes on base items, out of the frame."""
        own = self.frame.where((F.col("probe") == "base") & F.col("winner").isNotNull())
        return own.select("run_id", "item_id", "winner", "n_votes", "n_options", "entropy", "family", "gold", "answer_type", "winner_right")

    @cached_property
    def golds(self) -> DataFrame:
        return materialise(accuracy.golds_of(self.frame))

    @cached_property
    def pairs(self) -> DataFrame:
        return materialise(paired.sums_of(self.frame))

    @cached_property
    def reasoning_rows(self) -> DataFrame:
        return runtime.reasoning_rows(self.slim, self.telemetry, self.items)

    def headline(self, *more: accuracy.Terms) -> DataFrame:
        """One row per run with the metrics that runs are compared by: one aggregate for all but those by groups of items."""
        single = accuracy.per_run(
            accuracy.with_strict(self.frame), accuracy.coverage_terms(), accuracy.overall_terms("overall_accuracy", "n_base"), accuracy.strict_terms(), accuracy.ill_posed_terms(), uncertainty.calibration_terms("ece", "n_stated"),
            uncertainty.pass_terms(), *more,
        )
        return single.drop("n_base", "n_ill_posed", "n_well_posed", "n_stated").join(paired.invariance_of(self.pairs), "run_id", "left")

    def profile(self) -> DataFrame:
        """One row per run with every metric that is a single number; null where the run gives no ground for one."""
        narrow = self.slim
        parts = [
            self.headline(accuracy.backtracking_terms(), uncertainty.disagreement_terms()).drop("n_voted"), accuracy.macro_of(accuracy.chance_of(self.golds)).select("run_id", "above_chance"),
            accuracy.fragility(self.responses, self.items).select("run_id", F.col("fragility").alias("grading_fragility")),
            runtime.latency(narrow).withColumnRenamed("errored", "failed_calls"), runtime.tokens(narrow),
        ]
        if self.telemetry is not None:
            parts += [runtime.reasoning(narrow, self.telemetry), runtime.reasoning_efficiency(self.reasoning_rows, self.telemetry)]
        return reduce(lambda a, b: a.join(b, "run_id", "left"), parts)

    def outcomes(self) -> DataFrame:
        return outcomes.item_outcomes(self.responses, self.items)

    def tidy(self) -> DataFrame:
        """``(run_id, metric, family, difficulty, value)``, rounded to four places; metrics that a run does not have are absent."""
        def long(rows: DataFrame, family: Column | None = None, difficulty: Column | None = None, **metrics: str) -> DataFrame:
            entries = F.array(*[F.struct(F.lit(name).alias("metric"), F.round(F.col(column).cast("double"), 4).alias("value")) for name, column in metrics.items()])
            f = F.lit(None).cast("string") if family is None else family
            d = F.lit(None).cast("int") if difficulty is None else difficulty
            told = rows.select("run_id", f.alias("family"), d.alias("difficulty"), F.explode(entries).alias("m"))
            return told.select("run_id", "m.metric", "family", "difficulty", "m.value").where(F.col("value").isNotNull())

        family, difficulty = F.col("family"), F.col("difficulty")
        run = materialise(self.headline())
        pieces = [
            long(
                run, overall_accuracy="overall_accuracy", overall_accuracy_strict="strict_accuracy", fallback_reliance="fallback_reliance", answer_flip_rate="answer_flip_rate", ece="ece", confabulation_rate="confabulation_rate",
                **{"pass@k_oracle": "pass_at_k_oracle"},
            ),
            long(run.where("errored > 0"), coverage="coverage"), long(accuracy.chance_of(self.golds), family, family_accuracy="accuracy", acc_above_chance="above_chance"),
            long(accuracy.degradation_of(self.golds), family, difficulty, acc_mean="mean", acc_ci_lo="lo", acc_ci_hi="hi"), long(paired.distractibility_of(self.pairs), family, distractor_drop="drop"),
            long(paired.invariance_of(self.pairs, "family"), family, answer_flip_rate="answer_flip_rate"),
        ]
        return reduce(DataFrame.unionByName, pieces)
