"""What problems there are to make: families, their limits, and the grid of specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_id

DEFAULT_AXIS = "reasoning steps"


@dataclass(frozen=True)
class Family:
    name: str
    answer_type: str = "int"
    cap: int | None = None
    distractor: bool = False
    surface: bool = False
    sequential: bool = False
    axis: str = DEFAULT_AXIS


# The families, the kind of their answers, their highest difficulty and the probes that they support.
FAMILIES = (
    Family("arithmetic", distractor=True, surface=True), Family("state_tracking", distractor=True, surface=True), Family("retroactive_edit", distractor=True, surface=True), Family("multi_turn_inject"),
    Family("ordering", "choice", distractor=True, surface=True), Family("sequences", cap=6, axis="rule tier"), Family("knights_knaves", "set", cap=6, surface=True, axis="islanders (n)"),
    Family("logic_grid", cap=5, surface=True, axis="floors (n)"), Family("composed", cap=5, axis="chain / per-hop difficulty"), Family("redefined_ops", distractor=True, surface=True),
    Family("unsat_csp", "choice", cap=6, surface=True, axis="islanders (n)"), Family("unsat_localize", "justified_choice", cap=4, axis="islanders (n)"), Family("dynamic_pivot", surface=True, sequential=True),
    Family("false_lemma"), Family("noise_haystack"), Family("planning_blocksworld", cap=4, axis="blocks (n)"), Family("theory_of_mind", "choice", axis="belief-nesting depth"), Family("code_output"),
)
#: Repetitions, difficulties, distractors and surface variants of the presets; difficulty bands.
PRESETS = {"quick": (3, 1, 4, False, 0), "standard": (10, 1, 6, True, 0), "thorough": (20, 1, 6, True, 3)}
BANDS = {"all": (None, None), "easy": (1, 2), "medium": (3, 4), "hard": (5, 6)}


def support_matrix(spark: SparkSession) -> DataFrame:
    """A row per family: its answers, cap, probes and what its difficulty counts."""
    rows = [(f.name, f.answer_type, f.cap, f.distractor, f.surface, f.sequential, f.axis) for f in FAMILIES]
    return spark.createDataFrame(rows, "family string, answer_type string, cap int, distractor boolean, surface boolean, sequential boolean, axis string")


def specifications(spark: SparkSession, families: list[str] | None = None, least: int = 1, most: int = 6, reps: int = 3, distractor: bool = False, surface: int = 0) -> DataFrame:
    """One row per item to make: family, difficulty, seeds, probe, group and item_id.

    The repetitions are a distributed range, so a pool of any size is made in
    parallel; families and difficulties are a small dimension beside it. An
    unknown family raises ValueError.
    """
    known = {f.name for f in FAMILIES}
    if unknown := sorted(set(families or ()) - known):
        raise ValueError(f"unknown family: {', '.join(unknown)}")
    dims = F.broadcast(support_matrix(spark).where(F.col("family").isin(families or sorted(known))))  # 18 rows at most
    probe = lambda name, v, on: F.struct(F.lit(name).alias("probe"), F.lit(v).alias("surface_seed"), (F.lit(name) == "distractor").alias("has_distractor"), on.alias("on"))
    probes = F.array(probe("base", 0, F.lit(True)), probe("distractor", 0, F.lit(distractor) & F.col("distractor")), *[probe("surface", v, F.col("surface")) for v in range(1, surface + 1)])
    rep = spark.range(reps).select(F.col("id").cast("int").alias("structure_seed"))
    grid = rep.crossJoin(dims).where(F.lit(least) <= F.least(F.lit(most), F.coalesce("cap", F.lit(most)))).withColumn("difficulty", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.coalesce("cap", F.lit(most))))))
    wide = grid.withColumn("p", F.explode(probes)).where("p.on").select("family", "difficulty", "structure_seed", "p.surface_seed", "p.has_distractor", "p.probe")
    grp = F.concat(F.col("family"), F.lit("-d"), F.col("difficulty").cast("string"), F.lit("-r"), F.col("structure_seed").cast("string"))
    flag = F.when(F.col("has_distractor"), "True").otherwise("False")
    item = short_id(F.col("family"), F.col("difficulty").cast("string"), F.col("structure_seed").cast("string"), F.col("surface_seed").cast("string"), flag, F.col("probe"))
    return wide.withColumns({"grp": grp, "item_id": item})


class Draw:
    """Repeatable draws from a seed column, each told apart by a label."""

    def __init__(self, *seed: str | Column):
        self.seed = seed

    def hash(self, *label: object) -> Column:
        return F.xxhash64(*[F.col(s) if isinstance(s, str) else s for s in self.seed], *[x if isinstance(x, Column) else F.lit(x) for x in label])

    def below(self, n: int | Column, *label: object) -> Column:
        return F.pmod(self.hash(*label), n if isinstance(n, Column) else F.lit(n)).cast("int")

    def between(self, low: int | Column, high: int | Column, *label: object) -> Column:
        low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        return (low + self.below(high - low + 1, *label)).cast("int")

    def pick(self, words: tuple[str, ...] | Column, *label: object) -> Column:
        words = words if isinstance(words, Column) else words_of(words)
        return F.get(words, self.below(F.size(words), *label))

    def shuffled(self, things: Column, *label: object) -> Column:
        keyed = F.transform(things, lambda x, i: F.struct(self.hash(*label, i).alias("h"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])


def words_of(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def count(n: int | Column) -> Column:
    """[0, 1, ..., n - 1]; empty for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
