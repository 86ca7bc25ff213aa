"""Messages that put an item to a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What every prompt says; grading looks for the two marked lines.
SYSTEM = "You solve reasoning problems with care, and answer in the form that is asked for."
FORMAT = "Explain your reasoning. End with one line of this form:\nANSWER: <your final answer>"
OPTIONS = "\nGive exactly one of these as the answer: "
CONFIDENCE = "\nFollow it with one more line:\nCONFIDENCE: <a whole number from 0 to 100, how sure you are>"
READY = "Noted. What comes next?"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def instructions(kind: Column, choices: Column, ask_confidence: bool = False) -> Column:
    """How to answer: the marker line, the choices if there are any, and a confidence if asked for."""
    options = F.when((kind == "choice") & (F.size(F.coalesce(choices, F.array().cast("array<string>"))) > 0), F.concat(F.lit(OPTIONS), F.array_join(choices, ", "), F.lit(".")))
    return F.concat(F.lit(FORMAT), F.coalesce(options, F.lit("")), F.lit(CONFIDENCE if ask_confidence else ""))


def build(prompt: Column, turns: Column, how: Column) -> Column:
    """System and user message; for an item of several turns, each as a user message with a neutral reply between, and the instructions after the last."""
    last = F.size(turns) - 1
    told = F.flatten(F.transform(turns, lambda t, i: F.when(i < last, F.array(message("user", t), message("assistant", F.lit(READY)))).otherwise(F.array(message("user", F.concat_ws("\n\n", t, how))))))
    single = F.array(message("user", F.concat_ws("\n\n", prompt, how)))
    several = F.size(F.coalesce(turns, F.array().cast("array<string>"))) > 0
    return F.concat(F.array(message("system", F.lit(SYSTEM))), F.when(several, told).otherwise(single))


def next_turn(turns: Column, replies: Column, how: Column) -> Column:
    """Messages for the turn after ``replies``: every earlier turn is followed by the reply that it really got, and later turns stay hidden."""
    asked = F.slice(turns, F.lit(1), F.size(replies) + 1)
    told = F.flatten(F.transform(asked, lambda t, i: F.concat(F.array(message("user", F.concat_ws("\n\n", t, how))), F.when(i < F.size(replies), F.array(message("assistant", F.get(replies, i)))).otherwise(F.array().cast("array<struct<role:string,content:string>>")))))
    return F.concat(F.array(message("system", F.lit(SYSTEM))), told)


def by_role(messages: Column) -> Column:
    """Struct (system, chat): the system messages' text joined by blank lines (null without any), and the others in order."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    return F.struct(
        F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda m: m["content"]), "\n\n")).alias("system"), F.filter(messages, lambda m: m["role"] != "system").alias("chat")
    )
