"""JSON whose keys are not known beforehand, by variant columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a variant's type is told as; objects and arrays whatever they hold.
KINDS = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "text"), ("BOOLEAN", "boolean"), ("VOID", "null"))


def kind_of(value: Column) -> Column:
    """object, array, text, boolean, null or number."""
    schema = F.schema_of_variant(value)
    told = F.when(value.isNull(), F.lit(None).cast("string"))
    for start, kind in KINDS:
        told = told.when(F.startswith(schema, F.lit(start)), kind)
    return told.otherwise("number")


def variant_of(text: Column) -> Column:
    """The text as a variant; null where it is no JSON or has a key twice."""
    return F.try_parse_json(text)


def keys_of(rows: DataFrame, column: str) -> DataFrame:
    """What a column of JSON texts holds: ``(key, kind, n)`` for every key of its objects and kind of value, most of all in one aggregate.

    Texts that are no objects are counted with a null key: ``malformed`` (no JSON),
    their kind (an array, a number), or ``missing`` (a null); so are objects without keys.
    """
    text = F.col(column).cast("string")
    read = rows.select(text.isNull().alias("missing"), variant_of(text).alias("v"))
    whole = F.when(F.col("missing"), "missing").when(F.col("v").isNull(), "malformed").otherwise(kind_of(F.col("v")))
    kinds = read.withColumn("whole", whole)
    others = kinds.where("whole <> 'object'").groupBy(F.lit(None).cast("string").alias("key"), F.col("whole").alias("kind")).agg(F.count("*").alias("n"))
    objects = kinds.where("whole = 'object'").lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    return objects.groupBy("key", F.coalesce(kind_of(F.col("value")), F.lit("object")).alias("kind")).agg(F.count("*").alias("n")).unionByName(others)


def value_at(text: Column, path: str, kind: str) -> Column:
    """The value at a path such as ``$.a.b`` as this type; null where there is none or it cannot be one."""
    return F.try_variant_get(variant_of(text), path, kind)
