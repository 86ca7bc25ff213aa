"""Datasets of problems: made from specifications, verified from their prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .families import MAKERS
from .spec import FAMILIES, specifications
from .verify import derive

COLUMNS = (
    "item_id", "family", "difficulty", "structure_seed", "surface_seed", "has_distractor", "probe", "grp", "answer_type", "gold", "choices", "prompt", "turns", "subgold",
)


def make(specs: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Items for these specifications: each family's expressions over its own rows, without a shuffle."""
    chosen = [f for f in FAMILIES if families is None or f.name in families]
    made = [MAKERS[f.name](specs.where(F.col("family") == f.name)).withColumn("answer_type", F.lit(f.answer_type)).select(*COLUMNS) for f in chosen]
    return reduce(DataFrame.unionByName, made)


def verified(items: DataFrame, families: list[str] | None = None) -> DataFrame:
    """All items with the answer that their prompt leads to; families without a verifier pass."""
    chosen = [f.name for f in FAMILIES if families is None or f.name in families]
    known = reduce(DataFrame.unionByName, [derive(items, f) for f in chosen])
    others = items.where(~F.coalesce(F.col("family").isin(*chosen), F.lit(False)))
    return known.unionByName(others.withColumns({"derived": F.lit(None).cast("string"), "verified": F.lit(True)}))


def build(spark: SparkSession, families: list[str] | None = None, least: int = 1, most: int = 6, reps: int = 3, distractor: bool = False, surface: int = 0, verify: bool = True) -> DataFrame:
    """A dataset; reading it fails on the first item whose gold does not follow from its prompt."""
    items = make(specifications(spark, families, least, most, reps, distractor, surface), families)
    if not verify:
        return items
    checked = verified(items, families)
    failed = F.concat(F.lit("gold of item "), "item_id", F.lit(" ("), "family", F.lit(") does not follow from its prompt"))
    return checked.withColumn("gold", F.when(F.col("verified"), F.col("gold")).otherwise(F.raise_error(failed).cast("string"))).select(*COLUMNS)
