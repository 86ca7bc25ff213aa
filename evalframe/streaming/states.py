"""Metrics that are kept up to date: sums by cell, to which each stored batch adds what it brings and takes back what it replaces.

A cell is (run, family, difficulty, probe, samples of the item). What an item adds to
its cell is kept as its facts, a narrow stored table in hash buckets, so a batch is
held against the facts of its own items, where they lie, and neither texts nor
other items are read again. The changes of a batch are written under its number: work
that is done again writes the same changes in the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import grading
from ..functions import stats as st
from ..operators.items import slim
from ..sources.store import BATCH, HASH, Folder, Merging, Store, materialise

CELL = ["run_id", "family", "difficulty", "probe", "k"]
WAS = [*CELL, "answered", "right", "strict_right"]
SUMS = ["items", "answered", "right", "base_answered", "base_right", "strict_right", "fallback_right"]
#: Rows of a batch whose keys may be broadcast, some tens of megabytes; a larger batch goes through all facts, each in its bucket.
BROADCAST = 500_000


def _adds(facts: DataFrame, sign: int) -> DataFrame:
    """What each row of facts adds to the sums of its cell, or takes from them."""
    base = F.col("probe") == "base"
    flags = {
        "items": F.lit(True), "answered": F.col("answered"), "right": F.col("right"), "base_answered": base & F.col("answered"), "base_right": base & F.col("right"),
        "strict_right": base & F.col("strict_right"), "fallback_right": base & F.col("right") & ~F.col("strict_right"),
    }
    return facts.select(*CELL, *[F.when(flags[s], F.lit(sign)).otherwise(F.lit(0)).cast("long").alias(s) for s in SUMS])


class MetricStates:
    """The sums over a store's responses, in the folder ``metric-states`` beside its tables.

    Items must be stored before their responses come; responses to unknown items do
    not count. One writer at a time.
    """

    def __init__(self, store: Store):
        self.store, self.path = store, f"{store.folder}/metric-states"
        self.log = Folder(store.spark, self.path)

    def upsert(self, rows: DataFrame, name: str | None = None) -> None:
        """Store a batch of responses and bring the sums up to date. With a ``name`` it may be done again after any failure."""
        batch = self.store.upsert("responses", rows, name)
        self.advance(batch)

    def advance(self, batch: str) -> None:
        """Count in a stored batch of responses, once. Batches are counted in the order in which they were stored."""
        if f"changes-{batch}" in self.log.names():
            return
        rows = self.store.stored("responses").where(F.col(BATCH) == batch)
        facts = self.store.upsert("facts", Merging(self._facts(rows), lambda facts: self._merged(facts, rows)), f"facts-{batch}")
        new = self.store.stored("facts").where(F.col(BATCH) == facts)
        change = _adds(new, 1).unionByName(_adds(new.where("was is not null").select("was.*"), -1)).groupBy(*CELL).agg(*[F.sum(s).alias(s) for s in SUMS])
        change.where(" or ".join(f"{s} <> 0" for s in SUMS)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/.{batch}")
        self.log.fs.rename(self.log._at(f".{batch}"), self.log._at(f"changes-{batch}"))

    @staticmethod
    def _of(facts: DataFrame, batch: DataFrame) -> DataFrame:
        """The facts of a batch's items; up to BROADCAST keys of a batch are broadcast, so that the facts of all items stay where they lie."""
        keys = materialise(batch.select("run_id", "item_id").distinct())
        return facts.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, ["run_id", "item_id"], "left_semi")

    def _facts(self, rows: DataFrame) -> DataFrame:
        """The facts of a batch's items by its own rows: how many samples it tells of, and whether and what it has of the first.

        Later samples are counted apart from first ones, of which an item has one, so
        what is dealt out to meet the items is two rows of each at most.
        """
        later = ~F.col("sample_idx").eqNullSafe(0)
        samples = rows.where(later).groupBy("run_id", "item_id").agg((F.max("sample_idx") + 1).alias("k"))
        first = slim(rows.where(~later)).select("run_id", "item_id", F.lit(1).alias("k"), F.lit(True).alias("has_first"), "correct", "marker")
        told = self.store.dealt(first.unionByName(samples, allowMissingColumns=True), "items")
        own = told.groupBy(HASH, "run_id", "item_id").agg(*[F.max(c).alias(c) for c in ("k", "has_first", "correct", "marker")])
        both = self.store.beside(own, "items", self.store.held("items"), "item", ["family", "difficulty", "probe", "gold", "answer_type", "choices"], "inner")
        item = F.col("item")
        strict = grading.is_right(grading.of_marker(F.col("marker"), item["answer_type"], item["choices"]), item["gold"], item["answer_type"])
        answered = F.col("correct").isNotNull()
        return both.select(
            "run_id", "item_id", "item.family", "item.difficulty", "item.probe", "k", F.coalesce("has_first", F.lit(False)).alias("has_first"), answered.alias("answered"),
            F.coalesce("correct", F.lit(False)).alias("right"), (answered & strict).alias("strict_right"),
        )

    def _merged(self, facts: DataFrame, rows: DataFrame) -> DataFrame:
        """The facts of the batch's items after it, with what they were before: the first sample's from the batch if that has it, else as they were."""
        held = self.store.held("facts")
        if rows.count() <= BROADCAST:
            held = self._of(held, rows)
        both = self.store.beside(facts.drop("was"), "facts", held, "was", WAS)
        kept = {c: F.when(F.col("has_first"), F.col(c)).otherwise(F.coalesce(F.col("was")[c], F.lit(False))) for c in ("answered", "right", "strict_right")}
        return both.withColumns(kept | {"k": F.greatest("k", F.col("was")["k"])})

    def sums(self) -> DataFrame:
        """The sums by cell; cells that nothing is left in are gone."""
        parts = self._live()
        if not parts:
            return self.store.spark.createDataFrame([], "run_id string, family string, difficulty int, probe string, k int, " + ", ".join(f"{s} long" for s in SUMS))
        every = self.store.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])
        return every.groupBy(*CELL).agg(*[F.sum(s).alias(s) for s in SUMS]).where("items <> 0")

    def _live(self) -> list[str]:
        """The last fold and the changes after it."""
        names = self.log.names()
        fold = max((n for n in names if n.startswith("sums-")), default="")
        after = fold.removeprefix("sums-")
        return [n for n in names if n == fold or n.startswith("changes-") and n.removeprefix("changes-") > after]

    def fold(self) -> None:
        """Write the sums of all changes so far as one, and remove those; broken off, it changes nothing."""
        parts = self._live()
        if len(parts) < 2:
            return
        last = parts[-1].partition("-")[2] if parts[-1].startswith("changes-") else max(p.removeprefix("changes-") for p in parts if p.startswith("changes-"))
        self.sums().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/.{last}")
        self.log.fs.rename(self.log._at(f".{last}"), self.log._at(f"sums-{last}"))
        for n in self.log.names():
            if n != f"sums-{last}" and n.partition("-")[2] <= last:
                self.log.fs.delete(self.log._at(n), True)

    def coverage(self) -> DataFrame:
        """As ``accuracy.coverage`` of all responses."""
        run = self.sums().groupBy("run_id").agg(F.sum("items").alias("n_items"), F.max("k").alias("samples_per_item"), F.sum("answered").alias("answered"))
        return run.select("run_id", "n_items", "samples_per_item", "answered", (F.col("n_items") - F.col("answered")).alias("errored"), st.share(F.col("answered"), F.col("n_items")).alias("coverage"))

    def overall(self) -> DataFrame:
        run = self._base("run_id")
        return run.select("run_id", F.coalesce(st.share(F.col("right"), F.col("n")), F.lit(0.0)).alias("accuracy"), "n")

    def by_family(self) -> DataFrame:
        return self._base("run_id", "family").where("n > 0").select("run_id", "family", st.share(F.col("right"), F.col("n")).alias("accuracy"), "n")

    def degradation(self) -> DataFrame:
        cell = self._base("run_id", "family", "difficulty").where("n > 0")
        p: Column = F.col("right") / F.col("n")
        return cell.withColumn("w", st.wilson(F.col("right"), F.col("n"))).select("run_id", "family", "difficulty", "n", "w.mean", "w.lo", "w.hi", F.sqrt(p * (1 - p)).alias("std"))

    def strict(self) -> DataFrame:
        run = self.sums().groupBy("run_id").agg(*[F.sum(s).alias(s) for s in ("answered", "base_answered", "strict_right", "fallback_right")])
        return run.select(
            "run_id", F.coalesce(st.share(F.col("strict_right"), F.col("base_answered")), F.lit(0.0)).alias("strict_accuracy"), st.share(F.col("fallback_right"), F.col("answered")).alias("fallback_reliance")
        )

    def _base(self, *keys: str) -> DataFrame:
        return self.sums().groupBy(*keys).agg(F.sum("base_answered").alias("n"), F.sum("base_right").alias("right"))


def keep_metrics(responses: DataFrame, states: MetricStates, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Store a stream of responses and keep the sums of all that is stored up to date, batch by batch.

    A batch that is delivered again, after a failure anywhere, is neither stored
    nor counted twice; ``name`` tells this stream's batches from those of others.
    """
    return responses.writeStream.foreachBatch(lambda batch, number: states.upsert(batch, f"{name}-{number:08d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
