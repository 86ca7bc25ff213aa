"""Turns of conversations as items, and a client that answers them by a rule: what the run loop's query runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import FORMAT
from ..operators.respond import Client, Reply, RetryLater
from ..sources.star import table

#: Lengths that the client is busy for at first, cannot answer, and answers wrongly, as divisors; and what it says.
BUSY, BROKEN, WRONG = 3, 11, 5
SAYS = "It has {n} characters.\nANSWER: {answer}\nCONFIDENCE: {sure}"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for each turn: how long is the text? One of several lines is put line by line, and commits to the length of the first."""
    rows = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    several = F.size(lines) > 1
    return rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), F.lit("length").alias("family"), F.lit(1).alias("difficulty"), F.lit("base").alias("probe"), F.lit("int").alias("answer_type"),
        F.length(F.get(lines, F.size(lines) - 1)).cast("string").alias("gold"), F.when(~several, text).alias("prompt"), F.when(several, lines).alias("turns"), F.when(several, F.length(F.get(lines, 0)).cast("string")).alias("subgold"),
    )


def client() -> Client:
    """Tells the length of the last message without its instructions; some lengths it is busy for once, fails at, or gets wrong by one."""
    busy: set[str] = set()

    def ask(asked: list[dict[str, str]]) -> Reply:
        said = asked[-1]["content"]
        n = len(said) - len(FORMAT) - 2
        if n % BUSY == 0 and said not in busy:
            busy.add(said)
            raise RetryLater("busy", 0.0)
        if n % BROKEN == 0:
            raise ValueError("not to be answered")
        return Reply(SAYS.format(n=n, answer=n + (n % WRONG == 0), sure=n % 101), len(asked), n % 100)

    return ask
