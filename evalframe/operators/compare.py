"""Runs side by side: tags, families, labels, leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise
from .sampling import numbered

#: Label, column of a profile, and whether more is better.
ROWS = (
    ("overall acc", "overall_accuracy", True), ("strict acc", "strict_accuracy", True), ("coverage", "coverage", True), ("calibration ECE", "ece", False),
    ("answer-flip", "answer_flip_rate", False), ("confabulation", "confabulation_rate", False), ("maj@k", "maj_at_k", True),
)
#: Families that a mask holds.
WORD = 64
#: Classes are dealt into so many blocks at least, of which each meets each.
BLOCKS = 8
#: Bytes of families' names in a block, about, and classes at most. Parquet's writer holds 1 MB of different texts as a dictionary; beyond, it writes each text out.
BLOCK_BYTES, BLOCK_ROWS = 768 << 10, 4096


def run_families(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct families of each run."""
    asked = responses.select("run_id", "item_id").join(items.select("item_id", "family"), "item_id")
    return asked.groupBy("run_id", "family").agg(F.count("*").alias("__n")).drop("__n")


def families_together(families: DataFrame) -> DataFrame:
    """``(family, n_runs, in_all)`` from the families of each run: all that any run has, and whether every run has it."""
    runs = families.agg(F.countDistinct("run_id").alias("of"))
    counted = families.groupBy("family").agg(F.count("*").alias("n_runs"))
    return counted.crossJoin(F.broadcast(runs)).select("family", "n_runs", (F.col("n_runs") == F.col("of")).alias("in_all"))  # one row beside each family


def run_classes(runs: DataFrame, families: DataFrame) -> DataFrame:
    """``(run_id, tag, families)``: each run with its dataset tag and its set of families, sorted and joined by commas; runs alike in both are of one class.

    Runs without families have the empty set, and those without a tag the empty one.
    """
    own = families.where(F.col("family").isNotNull()).groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))  # as many as there are families, at most
    return runs.select("run_id", F.coalesce("dataset_tag", F.lit("")).alias("tag")).join(own, "run_id", "left").select("run_id", "tag", F.coalesce("families", F.lit("")).alias("families"))


def class_mismatch(classes: DataFrame) -> DataFrame:
    """Pairs of classes over different tags that share families: ``tag_1, families_1, n_runs_1, tag_2, families_2, n_runs_2, shared_families``.

    However many runs there are, pairs are made of classes. The first of a pair has
    the smaller tag. Families are numbered. Up to WORD of them are bits of one mask,
    and the classes are stored in blocks, of which each meets each in a task that
    reads the two: no class is shuffled once for every block that it meets, and a
    task's pairs have few enough texts that a file holds each of them once.
    """
    counted = materialise(classes.where("families <> ''").groupBy("tag", "families").agg(F.count("*").alias("n_runs")))
    each = counted.withColumn("family", F.explode(F.array_distinct(F.split("families", ","))))
    numbers = numbered(each.select("family").distinct(), ["family"])
    if numbers.limit(WORD + 1).count() > WORD:
        return _by_word(each, numbers)
    bit = F.expr("shiftleft(1L, int(position))")
    masked = each.join(F.broadcast(numbers), "family").groupBy("tag", "families", "n_runs").agg(F.bit_or(bit).alias("mask"))  # WORD rows at most
    rows, size = counted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("families")), F.lit(0))).first()
    blocks = max(BLOCKS, -(-rows // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    dealt = materialise(masked.repartition(blocks).sortWithinPartitions("tag", "n_runs"))
    a, b = (dealt.select(*[F.col(c).alias(f"{c}_{k}") for c in ("tag", "families", "n_runs", "mask")]) for k in (1, 2))
    both = F.col("mask_1").bitwiseAND(F.col("mask_2"))
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("tag_1") < F.col("tag_2")) & (both != 0))
    return pairs.select("tag_1", "families_1", "n_runs_1", "tag_2", "families_2", "n_runs_2", F.bit_count(both).cast("long").alias("shared_families"))


def _by_word(each: DataFrame, numbers: DataFrame) -> DataFrame:
    """The pairs over more than WORD families, of a row for each class and family.

    Classes meet at each word of WORD families of which they share any; a pair is
    told at the first such word, so pairs are neither shuffled nor kept. The classes
    of a word are dealt into BLOCKS that meet each other in tasks of their own.
    """
    whole = each.join(numbers, "family").groupBy("tag", "families", "n_runs").agg(F.sort_array(F.collect_list("position")).alias("own"))
    of = whole.withColumns({"block": F.pmod(F.xxhash64("tag", "families"), F.lit(BLOCKS)).cast("int"), "at": F.explode("own")})
    mask = F.bit_or(F.expr(f"shiftleft(1L, int(at % {WORD}))")).alias("mask")
    words = materialise(of.groupBy("tag", "families", "n_runs", "own", "block", F.floor(F.col("at") / WORD).alias("word")).agg(mask))
    told = words.withColumn("against", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    tasks = max(BLOCKS * BLOCKS, each.sparkSession.sparkContext.defaultParallelism)
    a, b = (
        told.select("word", F.col(first).alias("block_1"), F.col(second).alias("block_2"), *[F.col(c).alias(f"{c}_{k}") for c in ("tag", "families", "n_runs", "own", "mask")]).repartition(tasks, "word", "block_1", "block_2")
        for k, first, second in ((1, "block", "against"), (2, "against", "block"))
    )
    shared = F.array_intersect("own_1", "own_2")  # in the order of the first
    meet = reduce(Column.__and__, [a[c] == b[c] for c in ("word", "block_1", "block_2")])
    pairs = a.join(b, meet & (F.col("tag_1") < F.col("tag_2")) & (F.col("mask_1").bitwiseAND(F.col("mask_2")) != 0) & (F.floor(F.get(shared, F.lit(0)) / WORD) == a.word))
    return pairs.select("tag_1", "families_1", "n_runs_1", "tag_2", "families_2", "n_runs_2", F.size(shared).cast("long").alias("shared_families"))


def tag_mismatch(runs: DataFrame, families: DataFrame) -> DataFrame:
    """Pairs of runs over different dataset tags that share families, with how many they share; as many rows as there are such pairs, so for few runs."""
    classes = materialise(run_classes(runs, families))
    a, b = (classes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("tag", "families")], F.col("run_id").alias(f"r{k}")) for k in (1, 2))
    pairs = class_mismatch(classes).join(a, ["tag_1", "families_1"]).join(b, ["tag_2", "families_2"])
    first = F.col("r1") < F.col("r2")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    return pairs.select(pick("r1", "r2").alias("run_1"), pick("r2", "r1").alias("run_2"), pick("tag_1", "tag_2").alias("tag_1"), pick("tag_2", "tag_1").alias("tag_2"), "shared_families")


def run_labels(runs: DataFrame) -> DataFrame:
    """A run's label: its model, or its id where several runs have that model."""
    uses = runs.groupBy("model").agg(F.count("*").alias("uses"))
    return runs.join(uses, "model").select("run_id", "model", F.when(F.col("uses") > 1, F.col("run_id")).otherwise(F.col("model")).alias("label"))


def goodness(value: Column, higher: Column) -> Column:
    return F.when(higher, value).otherwise(F.lit(1.0) - value)


def leaderboard(profile: DataFrame) -> DataFrame:
    """``(metric, run_id, value, higher_is_better, goodness, scaled)``: a row per run and metric that the run has.

    ``scaled`` is the goodness over the best run's; where that is 0, over 1.
    """
    entries = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(column).cast("double").alias("value"), F.lit(up).alias("higher_is_better")) for label, column, up in ROWS])
    long = profile.select("run_id", F.explode(entries).alias("m")).select("run_id", "m.*").where(F.col("value").isNotNull())
    rated = long.withColumn("goodness", goodness(F.col("value"), F.col("higher_is_better")))
    best = rated.groupBy("metric").agg(F.max("goodness").alias("best"))
    scaled = F.col("goodness") / F.coalesce(F.nullif(F.col("best"), F.lit(0.0)), F.lit(1.0))
    return rated.join(best, "metric").select("metric", "run_id", "value", "higher_is_better", "goodness", scaled.alias("scaled"))
