"""Subsets of the items: by difficulty, and evenly spread over an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.store import materialise

#: Cells that may be broadcast: some megabytes. Where more of them are wanted, rows meet them in a shuffle.
BROADCAST = 100_000
ORDER = ["family", "difficulty", "grp", "probe", "item_id"]


def by_difficulty(items: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Items whose difficulty lies within the bounds, both inclusive and each optional."""
    if least is not None:
        items = items.where(F.col("difficulty") >= least)
    return items if most is None else items.where(F.col("difficulty") <= most)


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their place, from 0, in the total order by these columns.

    The rows are dealt out by range, counted, and numbered within their range,
    so no task sees them all; only one count per range meets in one place.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    offset = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offset), "__range").withColumn(name, F.col("__before") + own).drop("__range", "__before")


def stride(items: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """``limit`` items at even steps of the order; all of them if there are no more, none for a limit of 0.

    The order must tell all rows apart. Row i of the sample stands at the whole
    part of i * n / limit, so a row is taken if such an i leads to its place.
    """
    if limit < 0:
        return items
    if limit == 0:
        return items.limit(0)
    placed = numbered(items, order or ORDER)
    n = placed.count()
    if n <= limit:
        return placed.drop("position")
    step = n / limit
    i = F.ceil(F.col("position") / step)
    lands = lambda k: (k >= 0) & (k < limit) & (F.floor(k * step) == F.col("position"))
    return placed.where(lands(i) | lands(i - 1) | lands(i + 1)).drop("position")


def order_bits(value: Column) -> Column:
    """A long for each double (no nulls or not-a-numbers) that orders as the doubles do: the bits of its size, with its sign."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)  # the logarithm may round
    steps = F.lit(2.0**52)
    normal = let(exponent, lambda e: (e + 1023).cast("long") * F.lit(2**52) + ((size / power(e) - 1.0) * steps).cast("long"))
    tiny = (size * F.lit(2.0**1000) * F.lit(2.0**74)).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 * 2**52)).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of any numbers by ``keys``, with ``n``, and without sorting them.

    Values are counted by the first 16 bits of their order, and the cells found that
    hold the wanted ranks; then what lies in those, by the next 16 bits, until a
    cell has one value: at most four counts, which combine before their shuffle, so
    one key or one value may have most of the rows. Only counts are put in order, at
    most 65,536 of a key. Null values and not-a-numbers do not count; a null key is a key.
    """
    v = F.col("__v")
    held = rows.select(*keys, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    held = materialise(held.withColumn("__bits", order_bits(v)))
    counted = lambda df, within, shift: df.groupBy(*within, F.shiftright("__bits", shift).alias("__cell")).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))

    def placed(cells: DataFrame, within: list[str]) -> DataFrame:
        """Cells with the ranks before them, of those that lie in the same cell of the step before."""
        up = Window.partitionBy(*within).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn("__before", F.coalesce(F.sum("__n").over(up), F.lit(0)))

    cells = materialise(placed(counted(held, keys, 48), keys))
    totals = cells.groupBy(*keys).agg(F.sum("__n").alias("n"))
    # The two ranks that a percentile lies between, and how much each weighs.
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    end = lambda name, rank, weight: F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), weight.alias("weight"))
    both = F.array(*[e for name, q in shares.items() for e in (end(name, F.floor(at(q)), F.floor(at(q)) + 1 - at(q)), end(name, F.floor(at(q)) + 1, at(q) - F.floor(at(q))))])
    wanted = totals.select(*keys, "n", F.explode(both).alias("e")).select(*keys, "n", "e.*").where("weight > 0")

    def found(wanted: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
        """The cell that holds each wanted rank, and the rank within it."""
        other = cells.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], "__cell", "__n", "__before", "__least", "__most")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)], F.lit(True))
        hold = same & (F.col("__before") <= F.col("rank")) & (F.col("rank") < F.col("__before") + F.col("__n"))
        return wanted.join(other, hold).select(*keys, "n", "name", "weight", (F.col("rank") - F.col("__before")).alias("rank"), F.col("__cell").alias("__of"), "__least", "__most")

    now = materialise(found(wanted, cells, keys))
    for shift in (32, 16, 0):
        open_ = now.where("__least < __most")
        some = materialise(open_.select(*keys, "__of").distinct())
        n = some.count()
        if not n:
            break
        of = F.shiftright("__bits", shift + 16)
        narrow = some.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__of")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], of == F.col("__of"))
        inside = held.join(F.broadcast(narrow) if n <= BROADCAST else narrow, same).select(*keys, "__of", "__bits", "__v")
        within = [*keys, "__of"]
        cells = placed(counted(inside, within, shift), within)
        now = materialise(found(open_.drop("__least", "__most"), cells, within).unionByName(now.where("__least = __most")))
    return now.groupBy(*keys, "n").agg(*[F.sum(F.when(F.col("name") == name, F.col("__least") * F.col("weight"))).alias(name) for name in shares])


def ranked_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``percentiles`` by one key."""
    return percentiles(rows, [key], value, shares).select(key, "n", *shares)
