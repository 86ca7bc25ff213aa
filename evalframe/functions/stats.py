"""Statistics as Column expressions: intervals, calibration bins, chance correction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
#: Families whose answers are unbounded integers, so that no constant guess can win.
UNBOUNDED = (
    "arithmetic", "state_tracking", "sequences", "composed", "retroactive_edit", "multi_turn_inject", "dynamic_pivot", "false_lemma", "noise_haystack",
)
#: Golds of ill-posed items.
SENTINELS = ("UNDETERMINED", "NO_SOLUTION")
#: What calibration error and distractor drop are held against to grade them from 0 to 1.
ECE_FULL, DROP_FULL = 0.25, 0.3


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is 0."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def mean_of(flag: Column) -> Column:
    """Mean of a boolean aggregate input; nulls do not count."""
    return F.avg(flag.cast("double"))


def count_if(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Wilson score interval of k successes in n trials as a struct (mean, lo, hi); zeros for n = 0."""
    k, n, zz = k.cast("double"), n.cast("double"), F.lit(z * z)
    p = k / n
    scale = F.lit(1.0) + zz / n
    centre = (p + zz / (n * 2.0)) / scale
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (n * n * 4.0)) / scale
    some = F.struct(p.alias("mean"), F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi"))
    none = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    return F.when(n > 0, some).otherwise(none)


def confidence_bin(confidence: Column) -> Column:
    """Bin 0 to 9 of a stated confidence of 0 to 100; the last bin takes 90 to 100."""
    return F.least(F.lit(9), F.floor(confidence / 10)).cast("int")


def bin_label(b: Column) -> Column:
    return F.concat((b * 10).cast("string"), F.lit("-"), (b * 10 + F.when(b == 9, 10).otherwise(9)).cast("string"))


def above_chance(accuracy: Column, chance: Column) -> Column:
    """Accuracy rescaled so that chance is 0; as it is where chance is 0 or 1."""
    return F.when((chance > 0) & (chance < 1), (accuracy - chance) / (F.lit(1.0) - chance)).otherwise(accuracy)


def is_sentinel(answer: Column) -> Column:
    return answer.isin(*SENTINELS)

