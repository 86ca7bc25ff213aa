"""Answer extraction as Column expressions: markers, confidences, integers, choices, sets.

Patterns carry ``(?d)`` so that a line ends at a newline only, and ``(?U)`` where
word characters and blanks of other scripts count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a response states its answer and confidence by.
ANSWER = r"(?dimU)^\s*answer\s*[:=]\s*(.+?)\s*$"
CONFIDENCE = r"(?dimU)^\s*confidence\s*[:=]\s*([0-9]{1,3})"
INTEGER = r"-?[0-9]+"
#: A word: what lies between the boundaries that a choice must stand between.
WORD = r"(?U)\w+"
NOTHING = ("none", "no", "nothing", "n/a")
SENTENCE_END = r"(?<=\.)\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, where it would otherwise be repeated in every branch or lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def last_of(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def answer_marker(text: Column) -> Column:
    """Value of the last ``ANSWER:`` line, or null. Blanks after the colon may span lines."""
    return last_of(F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1)))


def stated_confidence(text: Column) -> Column:
    """Value of the last ``CONFIDENCE:`` line, at most 100, or null."""
    value = last_of(F.regexp_extract_all(text, F.lit(CONFIDENCE), F.lit(1))).cast("int")
    return F.when(value > 100, 100).otherwise(value)  # least() would turn null into 100


def without_confidence(text: Column) -> Column:
    return F.regexp_replace(text, CONFIDENCE, "")


def canonical_int(value: Column) -> Column:
    """An integer of any length as text without leading zeros; null where the text is no integer."""
    bare = lambda v: F.regexp_replace(v, r"^(-?)\+?0+(?=[0-9])", "$1")
    other = lambda v: let(bare(v), lambda b: F.when(b == "-0", "0").when(b.rlike(r"^-?[0-9]+$"), b))
    return let(F.trim(value), lambda v: F.when(v.rlike(r"^(?:-?[1-9][0-9]*|0)$"), v).otherwise(other(v)))


def _integers(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(text, F.lit(",")), F.lit(INTEGER), F.lit(0))


def first_int(text: Column) -> Column:
    return canonical_int(F.get(_integers(text), 0))


def last_int(text: Column) -> Column:
    return canonical_int(last_of(_integers(text)))


def _as_word(choice: Column) -> Column:
    """A pattern for the choice as a word of its own."""
    return F.concat(F.lit(r"\b"), F.regexp_replace(F.lower(choice), r"(\W)", r"\\$1"), F.lit(r"\b"))


def words_of(low: Column) -> Column:
    """The words of a text in order: what single-word choices are looked up in."""
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _single(choices: Column) -> Column:
    """Whether every choice is one word; only others need a pattern of their own."""
    return F.forall(choices, lambda c: F.regexp_like(F.lower(c), F.lit(r"(?U)^\w+$")))


def first_choice(text: Column, choices: Column) -> Column:
    """The first of the choices, in their order, that occurs as a word in the text."""
    def among(low: Column) -> Column:
        phrase = lambda c: F.contains(low, F.lower(c)) & F.regexp_like(low, F.concat(F.lit("(?U)"), _as_word(c)))
        single = let(words_of(low), lambda words: F.get(F.filter(choices, lambda c: F.array_contains(words, F.lower(c))), 0))
        return F.when(_single(choices), single).otherwise(F.get(F.filter(choices, phrase), 0))

    return let(F.lower(text), among)


def last_choice(text: Column, choices: Column) -> Column:
    """The choice that begins last in the text; of those that begin together, the earliest in order."""
    def among(low: Column) -> Column:
        def place(c: Column, i: Column) -> Column:
            found = F.contains(low, F.lower(c)) & F.regexp_like(low, F.concat(F.lit("(?U)"), _as_word(c)))
            start = F.length(F.call_function("regexp_extract", low, F.concat(F.lit("(?sU)^(.*)"), _as_word(c)), F.lit(1)))
            return F.when(found, F.struct(start.alias("start"), (-i).alias("order"), c.alias("choice")))

        def last_word(words: Column) -> Column:
            """Words are looked up from the end; a choice's number there is the less the later it stands."""
            at = lambda c, i: F.nullif(F.array_position(words, F.lower(c)), F.lit(0)).alias("at")
            return F.array_min(F.filter(F.transform(choices, lambda c, i: F.struct(at(c, i), i.alias("order"), c.alias("choice"))), lambda x: x["at"].isNotNull()))["choice"]

        return F.when(_single(choices), let(F.reverse(words_of(low)), last_word)).otherwise(F.array_max(F.transform(choices, place))["choice"])

    return let(F.lower(text), among)


def split_names(text: Column) -> Column:
    """Lower-cased names of a list in prose; empty if any of them says that there are none."""
    parts = F.split(text, r"(?U)[,;]|\band\b|\bor\b")
    # Blanks at the ends go, then quotes and stops; the blanks of other scripts are looked for only beside such a character.
    blank = lambda t: F.when(t.rlike(r"^[^!-~]|[^!-~]$"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t)
    clean = F.transform(parts, lambda t: F.lower(F.btrim(blank(t), F.lit("'\"."))))
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), none).otherwise(let(F.filter(clean, lambda t: t != ""), lambda named: F.when(F.arrays_overlap(named, F.array(*map(F.lit, NOTHING))), none).otherwise(named)))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def ordinal(n: Column) -> Column:
    end = F.when((F.pmod(n, F.lit(100)) >= 11) & (F.pmod(n, F.lit(100)) <= 13), "th")
    for digit, suffix in ((1, "st"), (2, "nd"), (3, "rd")):
        end = end.when(F.pmod(n, F.lit(10)) == digit, suffix)
    return F.concat(n.cast("string"), end.otherwise("th"))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def seed32(text: Column) -> Column:
    """SHA-1 of the text modulo 2**32."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 33, 8), 16, 10).cast("long")


def slug(text: Column) -> Column:
    """A name fit for a file: other characters become underscores, none at the ends; ``x`` if nothing is left."""
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.when(bare == "", "x").otherwise(bare)


def provider_of(url: Column) -> Column:
    """A short name for the service behind an endpoint's url."""
    netloc = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(F.regexp_replace(netloc, "^.*@", ""), r"^([^:]*)", 1))
    labels = F.filter(F.split(host, r"\."), lambda x: ~x.isin("api", "www"))
    dropped = F.when((F.size(labels) > 1) & (F.length(last_of(labels)) <= 3), F.slice(labels, F.lit(1), F.size(labels) - 1)).otherwise(labels)
    name = F.replace(F.coalesce(last_of(dropped), host), F.lit("-"), F.lit("_"))
    return F.when((host == "") | (host == "localhost") | host.rlike(r"^[0-9.]+$"), "local").when(name == "", "provider").otherwise(name)


def duration(seconds: Column) -> Column:
    """H:MM:SS from an hour on, else M:SS."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def quoted(value: Column) -> Column:
    """A text in single quotes, or in double quotes if it has a single one and no double one; None for null."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    plain = F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(value.isNull(), "None").otherwise(plain)
