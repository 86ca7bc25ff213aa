"""Filter interaction audit: every order of five filters, replayed over every document.

The flags of a document are crossed with the 120 orders, a broadcast table of
that size always; the five steps of an order are exploded, held against the step
at which the document fails first, and summed by (part, order, step), which
combines before its shuffle. Nothing else than the flags is kept of a text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LETTERS = "ABCDE"
#: Least words, least percentage of distinct words, most percentage of capitals, and the characters that fail a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Documents that one task crosses with the orders (each makes 600 rows, which are summed at once).
ROWS_PER_TASK = 200_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << LETTERS.index(letter))).otherwise(F.lit(0))


def flags(docs: DataFrame) -> DataFrame:
    """``doc_id, part, flags`` for each row of ``docs``: bit k of ``flags`` is set if the filter LETTERS[k] fails the text.

    Texts are read once; equal ones are found by their SHA-256, of which the
    least id is kept for those that occur more than once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    seen = docs.select("doc_id", part.alias("part"), text.alias("t")).withColumn("words", F.array_remove(F.split("t", BLANKS), ""))
    n = F.size("words")
    own = (
        _bit(n < LEAST_WORDS, "A").bitwiseOR(_bit(100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n, "B"))
        .bitwiseOR(_bit(100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > MOST_CAPITALS * F.length("t"), "C")).bitwiseOR(_bit(F.col("t").rlike(MARKS), "D"))
    )
    narrow = cut(seen.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), own.alias("own")))
    first = cut(narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return narrow.join(first, "digest", "left").select("doc_id", "part", F.col("own").bitwiseOR(_bit(copy, "E")).alias("flags"))


def orders(docs: DataFrame) -> DataFrame:
    """The 120 orders: their number, their name, and the filters' bits from the first step to the last."""
    rows = [(k, "".join(o), *[1 << LETTERS.index(x) for x in o]) for k, o in enumerate(permutations(LETTERS))]
    return docs.sparkSession.createDataFrame(rows, "order_no int, filter_order string, " + ", ".join(f"b{s} int" for s in range(1, 6)))


def replay(flagged: DataFrame) -> DataFrame:
    """Counts by ``part``, order and step from rows of ``part, flags, good, toxic`` (booleans)."""
    every = F.broadcast(orders(flagged))
    fails = lambda bit: F.col("flags").bitwiseAND(F.col(bit)) != 0
    first = F.when(fails("b1"), 1).when(fails("b2"), 2).when(fails("b3"), 3).when(fails("b4"), 4).when(fails("b5"), 5).otherwise(6)
    crossed = flagged.crossJoin(every).select("part", "flags", "good", "toxic", "order_no", first.alias("first"), F.posexplode(F.array(*[f"b{s}" for s in range(1, 6)])).alias("before", "bit"))
    step = crossed.withColumn("step", F.col("before") + 1)
    removed = F.col("step") == F.col("first")
    when = {
        "kept": F.col("step") < F.col("first"), "removed": removed, "redundant": (F.col("step") > F.col("first")) & fails("bit"), "unique_fails": F.col("flags") == F.col("bit"),
        "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic"),
    }
    counted = step.groupBy("part", "order_no", "step").agg(*[F.sum(when[c].cast("long")).alias(c) for c in COUNTS])
    return counted.join(every.select("order_no", "filter_order"), "order_no").drop("order_no")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters act on each other: for each ``part`` (language) and each of the 120 orders, five steps.

    Returns ``part, filter_order, step``, the counts of COUNTS, and ``shapley``:
    what the step's filter removes, summed over all orders of the part. Null
    texts and languages count as empty, and each row of ``docs`` as a document of
    its own. The fifth filter fails a text that equals the text of a smaller id;
    a row without an id is neither smaller than others nor fails for them, and
    rows of one id do not fail for each other. A document counts as good or toxic
    if any label row of its id says so. A table without rows gives none. Columns
    of other names are not looked at.
    """
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = cut(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic")).where("good or toxic"))
    marked = cut(flags(docs)).join(known, "doc_id", "left").select("part", "flags", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    held = cut(marked)
    tasks = max(2 * held.sparkSession.sparkContext.defaultParallelism, held.count() // ROWS_PER_TASK)
    counts = replay(held.repartition(tasks))
    letter = F.expr("substring(filter_order, step, 1)")
    each = cut(counts.withColumn("letter", letter))
    total = each.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return each.join(total, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
