"""Grading as Column expressions: the answer a response gives, where it stood, and whether it is right.

A marker line leads with the answer, so its first integer counts; free prose
ends with it, so there the last one does. Set answers and answers by statement
number come from the marker or, for sets, from the whole text as a list; choices
that the prompt itself is full of are never taken from prose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .text import let

#: Choices that only a marker line may give.
RESTRICTED = ("undetermined", "no_solution", "knight", "knave")
NUMERIC = ("int", "justified_choice")



def parse(text: Column, kind: Column, choices: Column, strict: bool = False) -> Column:
    """Struct (parsed, source): source is marker, fallback or none.

    ``kind`` is int, choice, set, justified_choice or another word for free text.
    With ``strict`` only the marker counts. Null text gives (null, none).
    """
    joined = lambda x: F.array_join(F.array_sort(t.split_names(x)), ",")
    of_marker = lambda m: F.when(m.isNotNull(), F.when(kind.isin(*NUMERIC), t.first_int(m)).when(kind == "choice", t.first_choice(m, choices)).when(kind == "set", joined(m)).otherwise(m))

    def result(from_marker: Column) -> Column:
        if strict:
            return F.struct(from_marker.alias("parsed"), F.when(from_marker.isNotNull(), "marker").otherwise("none").alias("source"))
        prose = t.without_confidence(text)
        open_choice = ~F.exists(choices, lambda c: F.lower(c).isin(*RESTRICTED))
        from_prose = F.when(from_marker.isNull(), F.when(kind == "int", t.last_int(prose)).when(kind == "set", F.nullif(joined(prose), F.lit(""))).when((kind == "choice") & open_choice, t.last_choice(text, choices)))
        both = lambda p: F.struct(F.coalesce(from_marker, p).alias("parsed"), F.when(from_marker.isNotNull(), "marker").when(p.isNotNull(), "fallback").otherwise("none").alias("source"))
        return let(from_prose, both)

    return let(t.answer_marker(text), lambda m: let(of_marker(m), result))


def strictly(got: Column) -> Column:
    """What ``parse`` gives with ``strict``, from what it gives without, or from a grade: the marker's answer or none."""
    marked = got["source"] == "marker"
    return F.struct(F.when(marked, got["parsed"]).alias("parsed"), F.when(marked, "marker").otherwise("none").alias("source"))


def is_right(parsed: Column, gold: Column, kind: Column) -> Column:
    """Whether a stored answer equals the gold: as integers, else as text in lower case. Never null."""
    numbers = t.canonical_int(parsed) == t.canonical_int(gold)
    words = F.lower(parsed) == F.lower(gold)
    return F.coalesce(F.when(kind.isin(*NUMERIC), numbers).otherwise(words), F.lit(False))


def grade(text: Column, kind: Column, gold: Column, choices: Column, strict: bool = False) -> Column:
    """Struct (parsed, correct, confidence, source). Sets are compared as sets."""
    names = lambda x: F.array_sort(F.array_distinct(t.split_names(F.coalesce(x, F.lit("")))))
    correct = lambda parsed: F.when(kind == "set", names(parsed) == names(gold)).otherwise(is_right(parsed, gold, kind))

    def result(got: Column) -> Column:
        return F.struct(got["parsed"].alias("parsed"), correct(got["parsed"]).alias("correct"), t.stated_confidence(text).alias("confidence"), got["source"].alias("source"))

    return let(parse(text, kind, choices, strict), result)


def marker_only(text: Column, kind: Column, choices: Column) -> Column:
    """The answer by the marker alone, as strict accuracy reads it: its last integer, its first choice, else the marker itself."""
    return let(t.answer_marker(text), lambda m: of_marker(m, kind, choices))


def of_marker(marker: Column, kind: Column, choices: Column) -> Column:
    """The same from what the marker holds."""
    return F.when(kind.isin(*NUMERIC), t.last_int(marker)).when(kind == "choice", t.first_choice(marker, choices)).otherwise(marker)


def prose_only(text: Column, kind: Column, choices: Column) -> Column:
    """The answer by the whole text, as grading fragility reads it; a statement number still comes from the marker."""
    prose = t.without_confidence(text)
    return (
        F.when(kind == "int", t.last_int(prose)).when(kind == "justified_choice", t.last_int(t.answer_marker(prose))).when(kind == "choice", t.last_choice(prose, choices)).otherwise(t.answer_marker(prose))
    )
