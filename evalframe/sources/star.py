"""The evaluation star over the driver's tables: orders become items, line items become responses.

The rules below decide each column from the row's own values, so that SQL can
say the same. A response key occurs repeatedly among the line items; the latest
one counts, as in a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ERROR
from .store import latest

#: Family by group number.
FAMILIES = ("arithmetic", "ordering", "knights_knaves", "unsat_csp", "dynamic_pivot")

#: Line items in a task, about, and in one of a table that is dealt to more tasks than ``_unsorted`` says.
ROWS = 400_000
FULL = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, for work that is dear for each of them: a scan of fewer splits than cores is dealt out, a larger one is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, family, difficulty, probe, has_distractor, grp, answer_type, gold, choices``."""
    key = F.col("o_orderkey")
    grp = F.floor(key / 4)
    return table(spark, sf_dir, "orders").select(
        key.alias("item_id"),
        F.get(F.array(*map(F.lit, FAMILIES)), F.pmod(grp, F.lit(len(FAMILIES))).cast("int")).alias("family"),
        (F.pmod(F.floor(key / 20), F.lit(6)) + 1).cast("int").alias("difficulty"),
        F.when(key % 4 == 0, "base").when(key % 4 == 1, "distractor").otherwise("surface").alias("probe"),
        (key % 4 == 1).alias("has_distractor"),
        grp.alias("grp"),
        F.lit("choice").alias("answer_type"),
        F.when(F.col("o_orderstatus") == "P", "UNDETERMINED").otherwise(F.col("o_orderstatus")).alias("gold"),
        F.array(F.lit("O"), F.lit("F"), F.lit("UNDETERMINED")).alias("choices"),
    )


def _unsorted(spark: SparkSession) -> int:
    """Partitions up to which Spark writes a shuffle's rows as they come; for more, a task holds and sorts all rows of its split."""
    return int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of ROWS, as many as are written unsorted; from there on they fill up to FULL times ROWS before there are more."""
    return max(spark.sparkContext.defaultParallelism, min(-(-rows // ROWS), _unsorted(spark)), -(-rows // (FULL * ROWS)))


def _dealt(lines: DataFrame) -> DataFrame:
    """Line items by their item, in tasks that grow in number with the table and in size up to a bound.

    What follows by item, the latest of each key, golds, frames and votes, goes on
    where the rows lie: they are shuffled once and not sorted before. Responses and
    telemetry take the same rows, so one shuffle serves both.
    """
    return lines.repartition(_tasks(lines.sparkSession, lines.count()), "item_id")


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets for a store of the responses: as many for each core, of five times ROWS at most."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-table(spark, sf_dir, "lineitem").count() // (FULL * ROWS * cores)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "run_id": F.concat(F.lit("r"), (F.col("l_suppkey") % 2).cast("string")), "item_id": F.col("l_orderkey"), "sample_idx": ((F.col("l_linenumber") - 1) % 3).cast("int"),
    })
    return rows.select(
        "run_id", "item_id", "sample_idx", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber",
    )


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item for each response key: the last shipped, ties by the other columns in the order of ``_lines``."""
    return _latest(_lines(spark, sf_dir))


def _latest(lines: DataFrame) -> DataFrame:
    return latest(_dealt(lines), ["item_id", "run_id", "sample_idx"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])


def waves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The responses as they came, in five waves by the year of shipment; a later wave replaces what earlier ones said."""
    lines, year = _lines(spark, sf_dir), F.year("l_shipdate")
    parts = [year <= 1993, year == 1994, year == 1995, year == 1996, (year >= 1997) | year.isNull()]
    return [responses(spark, sf_dir, _latest(lines.where(p))) for p in parts]


def responses(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Responses to the items above, to the latest line items if no others are given: ``run_id, item_id, sample_idx, raw, parsed, correct, confidence, latency_ms, prompt_tokens, completion_tokens, metadata``."""
    discount, tax = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    error = discount == 10
    given = latest_lines(spark, sf_dir) if lines is None else lines
    lines = given.withColumn("parsed", F.when(error | (tax == 0), None).when(F.col("l_returnflag") == "N", "UNDETERMINED").otherwise(F.col("l_linestatus")))
    shape = F.pmod(F.col("l_partkey"), F.lit(4))
    confidence = F.when(tax == 1, None).otherwise(F.round(F.col("l_quantity") * 2).cast("int"))
    stated = F.coalesce(F.concat(F.lit("\nCONFIDENCE: "), confidence.cast("string")), F.lit(""))
    said = F.when(shape == 0, F.concat(F.lit("ANSWER: "), "parsed")).when(shape == 1, F.concat(F.lit("so it must be "), "parsed", F.lit("."))).when(
        shape == 2, F.concat(F.lit("It is not F.\nanswer = "), "parsed", F.lit(" \nas said"))).otherwise(F.concat(F.lit("ANSWER: "), "parsed", F.lit("\nThough O comes close.")))
    rows = lines.select(
        "run_id", "item_id", "sample_idx", F.when(error, ERROR).otherwise(F.concat(F.coalesce(said, F.lit("no idea")), stated)).alias("raw"), "parsed",
        error.alias("error"), confidence.alias("confidence"), F.floor("l_extendedprice").cast("int").alias("latency_ms"),
        F.when(~error & (tax != 2), (F.col("l_partkey") % 500).cast("int")).alias("prompt_tokens"), F.when(~error & (tax != 2), (F.col("l_suppkey") % 900 + 100).cast("int")).alias("completion_tokens"),
        F.when(~error, F.struct(F.when(F.col("parsed").isNull(), "none").when(shape == 1, "fallback").otherwise("marker").alias("parse_source"),
               F.when(tax != 3, F.col("l_linestatus") == "O").alias("intermediate_correct"), F.col("l_linestatus").alias("intermediate_parsed"))).alias("metadata"),
    )
    gold = items(spark, sf_dir).select("item_id", "gold")
    correct = F.when(~F.col("error"), F.coalesce(F.col("parsed") == F.col("gold"), F.lit(False)))
    return rows.join(gold, "item_id").select(
        "run_id", "item_id", "sample_idx", "raw", "parsed", correct.alias("correct"), "confidence", "latency_ms", "prompt_tokens", "completion_tokens", "metadata"
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the responses; odd line numbers expose reasoning tokens."""
    odd = F.col("l_linenumber") % 2 == 1
    return latest_lines(spark, sf_dir).select(
        "run_id", "item_id", "sample_idx", F.when(odd, "native_usage").otherwise("unavailable").alias("reasoning_token_source"),
        (F.col("l_partkey") % 500).cast("int").alias("prompt_tokens"), (F.col("l_suppkey") % 900 + 100).cast("int").alias("completion_tokens"),
        F.when(odd, F.floor((F.col("l_suppkey") % 900 + 100) / 3)).otherwise(0).cast("int").alias("reasoning_tokens"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each parity of supplier: ``run_id, model, dataset_tag, created_at`` (its first shipment)."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 2).alias("k")).agg(F.min("l_shipdate").alias("created_at"))
    return lines.select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("run_id"), F.lit("model-a").alias("model"), F.concat(F.lit("v"), (F.col("k") + 1).cast("string")).alias("dataset_tag"), "created_at"
    )
