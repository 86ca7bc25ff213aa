"""Putting items to a model: the deterministic stand-in, and any client in partitions; then grading and storing.

A partition is the unit of concurrency: each puts its own items to the model,
and what it returns is graded by column expressions. Nothing passes the driver.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grading
from ..sources.schema import ERROR, METADATA, RESPONSES
from ..sources.store import Store, todo
from . import messages

MODES = ("perfect", "random", "noisy")
LONGEST_WAIT, LONGEST_BACKOFF = 60.0, 8.0
# How the stand-in's chance to be right falls, by how much a wrong integer is off, and the confidences it states.
CHANCE, BY_DIFFICULTY, BY_DISTRACTOR, LEAST_CHANCE, COIN = 0.95, 0.11, 0.18, 0.05, 0.5
OFF_BY = (-3, -2, -1, 1, 2, 3)
SURE, UNSURE = (55, 95), (30, 80)


def mock_reply(key: str, mode: str, difficulty: int, distracted: bool, kind: str, target: str, choices: list[str]) -> str:
    """A reply drawn from the key alone: right with a chance that falls with difficulty, and a confidence."""
    draw = random.Random(int(hashlib.sha1(key.encode()).hexdigest(), 16) % 2**32)
    chance = COIN if mode == "random" else max(LEAST_CHANCE, CHANCE - BY_DIFFICULTY * difficulty - BY_DISTRACTOR * distracted)
    right = mode == "perfect" or draw.random() < chance
    if right:
        answer = target
    elif kind in grading.NUMERIC:
        answer = str(int(target) + draw.choice(OFF_BY))
    else:
        answer = draw.choice([c for c in choices if c != target] or [target])
    return f"A stand-in's reply.\nANSWER: {answer}\nCONFIDENCE: {draw.randint(*(SURE if right else UNSURE))}"


def mock_text(mode: str) -> Callable[..., Column]:
    """The stand-in as a function of columns (key, difficulty, distracted, kind, target, choices); a null target gives null. A set answer without choices has none to go wrong by."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")

    @F.pandas_udf("string")
    def reply(key: pd.Series, difficulty: pd.Series, distracted: pd.Series, kind: pd.Series, target: pd.Series, choices: pd.Series) -> pd.Series:
        rows = zip(key, difficulty, distracted, kind, target, choices, strict=True)
        return pd.Series([None if t is None else mock_reply(k, mode, int(d), bool(x), a, t, [] if c is None else list(c)) for k, d, x, a, t, c in rows], dtype="object")

    return reply


def _samples(items: DataFrame, n: int) -> DataFrame:
    return items.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def run_mock(items: DataFrame, run_id: str, mode: str = "noisy", n: int = 1) -> DataFrame:
    """Graded responses of the stand-in. An item with a committed first answer is put in two turns, each with a draw of its own."""
    reply = mock_text(mode)
    choices = F.coalesce("choices", F.array().cast("array<string>"))
    draw = lambda key, target: reply(key, F.col("difficulty"), F.col("has_distractor"), F.col("answer_type"), target, choices)
    single = F.concat_ws("|", "item_id", F.col("sample_idx").cast("string"))
    turn = lambda k: F.concat_ws("|", "item_id", (F.col("sample_idx") * 100 + k).cast("string"))
    asked = _samples(items, n).withColumn("committed", F.coalesce("subgold", F.lit("")) != "")
    said = asked.withColumns({"raw": draw(F.when(F.col("committed"), turn(2)).otherwise(single), F.col("gold")), "intermediate": F.when(F.col("committed"), draw(turn(1), F.col("subgold")))})
    return graded(said.withColumns({"latency_ms": F.lit(0), "prompt_tokens": F.lit(None).cast("int"), "completion_tokens": F.lit(None).cast("int")}), run_id)


def graded(said: DataFrame, run_id: str) -> DataFrame:
    """Response rows from items with ``sample_idx, raw, intermediate, latency_ms, prompt_tokens, completion_tokens``; failed calls are stored ungraded."""
    failed = F.col("raw") == ERROR
    of = lambda text, gold: grading.grade(F.col(text), F.col("answer_type"), F.col(gold), F.col("choices"))
    g = said.withColumns({"g": of("raw", "gold"), "i": F.when(F.col("intermediate").isNotNull() & (F.coalesce("subgold", F.lit("")) != ""), of("intermediate", "subgold"))})
    metadata = F.struct(F.col("g.source").alias("parse_source"), F.col("i.correct").alias("intermediate_correct"), F.col("i.parsed").alias("intermediate_parsed")).cast(METADATA)
    ok = lambda c: F.when(~failed, c)
    return g.select(
        F.lit(run_id).alias("run_id"), "item_id", "sample_idx", "raw", ok(F.col("g.parsed")).alias("parsed"), ok(F.col("g.correct")).alias("correct"), ok(F.col("g.confidence")).alias("confidence"),
        F.col("latency_ms").cast("int").alias("latency_ms"), ok(F.col("prompt_tokens")).alias("prompt_tokens"), ok(F.col("completion_tokens")).alias("completion_tokens"), ok(metadata).alias("metadata"),
    )


@dataclass
class Reply:
    """What a client returns for one list of messages."""

    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class RetryLater(Exception):
    """A call that may be tried again, after ``wait`` seconds if the server said so."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


Client = Callable[[list[dict[str, str]]], Reply]


def backoff(error: Exception, attempt: int) -> float:
    """Seconds to wait: what the server asks for, at most a minute, else doubling up to eight."""
    wait = getattr(error, "wait", None)
    return min(float(wait), LONGEST_WAIT) if wait is not None else min(2.0**attempt, LONGEST_BACKOFF)


def _call(client: Client, asked: list[dict[str, str]], retries: int, sleep: Callable[[float], None]) -> Reply:
    for attempt in range(retries + 1):
        try:
            return client(asked)
        except RetryLater as error:
            if attempt == retries:
                raise
            sleep(backoff(error, attempt))
    raise AssertionError("unreachable")


def run_client(items: DataFrame, run_id: str, make_client: Callable[[], Client], n: int = 1, ask_confidence: bool = False, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Graded responses of any client, made once in each partition.

    An item with a committed first answer gets its turns one after another, each
    after the real reply to the one before. A call that fails for good becomes
    one failed response; the others go on.
    """
    how = messages.instructions(F.col("answer_type"), F.col("choices"), ask_confidence)
    asked = _samples(items, n).withColumns({"how": how, "messages": messages.build(F.col("prompt"), F.col("turns"), how), "sequential": F.coalesce("subgold", F.lit("")) != ""})
    columns = ["item_id", "sample_idx", "answer_type", "gold", "choices", "subgold"]
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", raw string, intermediate string, latency_ms int, prompt_tokens int, completion_tokens int"

    def talk(client: Client, row: pd.Series) -> tuple[Reply, str | None]:
        if not row.sequential:
            return _call(client, [dict(m) for m in row.messages], retries, sleep), None
        said, first, reply = [{"role": "system", "content": messages.SYSTEM}], None, Reply("")
        for turn in row.turns:
            said.append({"role": "user", "content": f"{turn}\n\n{row.how}"})
            reply = _call(client, said, retries, sleep)
            first = reply.text if first is None else first
            said = [*said, {"role": "assistant", "content": reply.text}]
        return reply, first

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                began = time.monotonic()
                try:
                    reply, first = talk(client, row)
                except Exception:  # noqa: BLE001  whatever a client raises is that one call's failure
                    reply, first = Reply(ERROR), None
                out.append((reply.text, first, int((time.monotonic() - began) * 1000), reply.prompt_tokens, reply.completion_tokens))
            result = batch[columns].reset_index(drop=True)
            for k, name in enumerate(("raw", "intermediate", "latency_ms", "prompt_tokens", "completion_tokens")):
                values = [x[k] for x in out]
                result[name] = pd.array(values, dtype="object" if k < 2 else "Int32")
            yield result

    said = asked.select(*columns, "turns", "how", "messages", "sequential").mapInPandas(work, schema)
    return graded(said, run_id)


def run(store: Store, run_id: str, respond: Callable[[DataFrame], DataFrame], resume: bool = True) -> None:
    """Put the stored items that this run has not done to a model, and store the graded responses. Errors of an earlier try are made again."""
    items = store.read("items")
    responses = respond(todo(items, store.read("responses"), run_id) if resume else items)
    store.upsert("responses", responses.select(*[f.split(" ")[0] for f in RESPONSES.split(", ")]))
