"""Run logs: what a run was, how it came out, and a line for each item, put together and written by Spark.

A log's lines are rows in an order, dealt out by range, so a run of any size is
written by many tasks: its folder holds its log as one file or as several, which
follow each other by name. What a task that is lost has written is not committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import outcomes
from ..sources.store import SECRETS

ORDER = ["run_id", "part", "family", "difficulty", "place"]


def _flat(text: Column) -> Column:
    """On one line, whatever the text holds."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _head(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """The lines before the items: model, run, start, parameters (sorted, without secrets) and the totals, of runs with and without items."""
    none = F.lit(None).cast("map<string,string>")
    params = F.map_filter(F.coalesce(F.col("params") if "params" in runs.columns else none, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.lower(k).isin(*SECRETS))
    shown = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(F.lit("  "), _flat(e["key"]), F.lit(" = "), _flat(F.coalesce(e["value"], F.lit("")))))
    said = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(_flat(c.cast("string")), F.lit("-")))
    count = lambda c: F.concat(F.lit(f"  {c} = "), F.coalesce(c, F.lit(0)).cast("string"))
    started = F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    lines = F.concat(
        F.array(F.lit("run log"), said("model", F.col("model")), said("run", F.col("run_id")), said("started", started)), F.when(F.size(shown) > 0, F.concat(F.array(F.lit("parameters:")), shown)).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("summary:"), *[count(c) for c in ("total", *outcomes.OUTCOMES)], F.concat(F.lit("  accuracy = "), F.format_string("%.4f", F.coalesce("accuracy", F.lit(0.0)))), F.lit("items (item, family, difficulty, probe, outcome, reason):")),
    )
    return runs.join(totals, "run_id", "left").select("run_id", F.posexplode(lines).alias("at", "line")).select(
        "run_id", F.lit(0).alias("part"), F.lit("").alias("family"), F.lit(0).alias("difficulty"), F.format_string("%06d", "at").alias("place"), "line"
    )


def log_lines(found: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, part, family, difficulty, place, line`` of every run's log; ``found`` are outcomes (``outcomes.item_outcomes``). The order is that of ORDER.

    Items stand by family, difficulty and id, those unknown first. Runs that are not
    in ``runs`` have their items' lines alone.
    """
    cell = lambda c, width: F.rpad(_flat(F.coalesce(F.col(c).cast("string"), F.lit("-"))), F.greatest(F.lit(width), F.length(_flat(F.coalesce(F.col(c).cast("string"), F.lit("-"))))), F.lit(" "))
    line = F.concat_ws(" ", F.lit(" "), cell("item_id", 24), cell("family", 16), cell("difficulty", 2), cell("probe", 10), cell("outcome", 7), _flat(F.col("reason")))
    items = found.select(
        "run_id", F.lit(1).alias("part"), F.coalesce("family", F.lit("")).alias("family"), F.coalesce("difficulty", F.lit(0)).alias("difficulty"), F.col("item_id").cast("string").alias("place"), line.alias("line"),
    )
    return _head(runs, outcomes.totals(found)).unionByName(items)


def write_logs(lines: DataFrame, folder: str) -> None:
    """A folder ``run_id=...`` for each run, with its log in files that follow each other by name."""
    in_order = lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    in_order.select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(folder)
