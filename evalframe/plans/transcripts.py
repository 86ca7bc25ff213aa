"""Answer texts of every kind and shape, made from whole driver tables: what grading and telemetry queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import EVENTS, LOGPROBS
from ..sources.star import spread, table

NAMES = ("Ida", "Bruno", "Kofi")
#: Shapes of a response by kind; {a} is the part's number, {b} the supplier's, {c} a confidence, {x} and {y} names.
SHAPES = {
    "int": (
        "Step 1: {b}\nANSWER: {a} apples of {b}\nCONFIDENCE: {c}", "first {b}, then 1,{a}.", "ANSWER: forty\nso -00{a}", "answer = -{a}\nAnswer: {b}", "no number here\nCONFIDENCE: {c}",
    ),
    "choice": ("I say {y}.\nANSWER: {x}", "Not {y}. It must be {x}, surely", "ANSWER: nobody\nperhaps {x} or {y}", "answer: It is {x}, not {y}.\nCONFIDENCE: {c}", "cannot say"),
    "set": ("ANSWER: {x}, {y}", "ANSWER: none", "ANSWER: '{y}' and {x}; {x}.", "{x} or {y}", "CONFIDENCE: {c}"),
    "justified_choice": ("of 1 to 9, {b}\nANSWER: number {a}", "number {a}", "ANSWER: none of them", "ANSWER: {a}\nANSWER: {b}", "ANSWER:\n{a}"),
}
KINDS = tuple(SHAPES)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, text, gold, choices)`` for every line item."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    k, s = F.pmod("l_partkey", F.lit(len(KINDS))).cast("int"), F.pmod("l_suppkey", F.lit(5)).cast("int")
    kind = F.get(F.array(*map(F.lit, KINDS)), k)
    names = F.array(*map(F.lit, NAMES))
    x, y = F.get(names, F.pmod("l_orderkey", F.lit(3)).cast("int")), F.get(names, F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(3)).cast("int"))
    text = F.get(F.get(F.array(*[F.array(*map(F.lit, shapes)) for shapes in SHAPES.values()]), k), s)
    for mark, value in (("a", F.col("l_partkey")), ("b", F.col("l_suppkey")), ("c", F.round(F.col("l_quantity") * 3).cast("int")), ("x", x), ("y", y)):
        text = F.replace(text, F.lit("{" + mark + "}"), value.cast("string"))
    gold = F.when(k == 1, x).when(k == 2, F.concat(y, F.lit(", "), x)).otherwise(F.col("l_partkey").cast("string"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), text.alias("text"), gold.alias("gold"), F.when(k == 1, names).alias("choices"))


def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, content)``: a token for each component of an embedding, with itself and the next two as alternatives."""
    v = F.col("embedding")
    logprob = lambda x: (-F.abs(x) * 4).cast("double")
    alternatives = lambda i: F.transform(F.slice(v, i + 1, F.lit(3)), lambda x: F.struct(F.lit("t").alias("token"), logprob(x).alias("logprob")))
    content = F.transform(v, lambda x, i: F.struct(F.lit("t").alias("token"), logprob(x).alias("logprob"), alternatives(i).alias("top_logprobs")))
    return table(spark, sf_dir, "embeddings").select("vec_id", content.cast(LOGPROBS).alias("content"))


def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, events)``: every text as a message stream, a delta per line; every third one thinks first."""
    def event(at: F.Column, kind: str, block: str | None = None, text: F.Column | None = None, **counts: F.Column) -> F.Column:
        none = F.lit(None)
        return F.struct(
            at.cast("double").alias("at"), F.lit(kind).alias("type"), F.lit(block).cast("string").alias("block"), (none if text is None else text).cast("string").alias("text"),
            *[counts.get(c, none).cast("int").alias(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")],
        )

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    thinks = F.pmod("doc_id", F.lit(3)) == 0
    think = F.when(thinks, F.array(event(F.lit(0.25), "content_block_start", "thinking"), event(F.lit(0.5), "content_block_delta", "thinking", F.lit("hm")))).otherwise(F.array().cast(EVENTS))
    deltas = F.transform(lines, lambda line, i: event(i + 1, "content_block_delta", "text", line))
    end = event(F.size(lines) + 1, "message_delta", output_tokens=F.size(lines), thinking_tokens=F.when(thinks, F.lit(7)))
    events = F.concat(F.array(event(F.lit(0.125), "message_start", input_tokens=F.col("n_chars"))), think, deltas, F.array(end))
    return table(spark, sf_dir, "documents").select("doc_id", events.cast(EVENTS).alias("events"))
