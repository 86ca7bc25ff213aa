"""Independent verification: the answer worked out again from the text of the prompt alone.

Every function takes the prompt and gives the answer as text, or null where the
text does not settle one. Nothing here knows the draws behind an item, or
shares with the generators how an answer is worked out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sentences, split_names
from .families import AXES
from .replan import fewest_told
from .spec import FAMILIES, count

#: Structures are enumerated up to so many people.
MOST_ISLANDERS, MOST_FLOORS = 8, 7


def first(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group)), 0)


def number(text: Column, pattern: str | Column, group: int = 1) -> Column:
    return first(text, pattern, group).cast("long")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def index_of(names: Column, name: Column) -> Column:
    """Place of a name from 0, or -1."""
    return F.coalesce(F.array_position(names, name), F.lit(0)).cast("int") - 1


# --- containers

def _amounts(text: Column, thing: Column, pattern: str, group: int = 1) -> Column:
    """Sum of the numbers of sentences by this pattern, in which {t} stands for the thing."""
    p = F.replace(F.lit(pattern), F.lit("{t}"), thing)
    return total(F.regexp_extract_all(text, p, F.lit(group)))


def _held(text: Column, thing: Column, place: Column, factor: Column, moves: bool = True) -> Column:
    at = lambda pattern: F.replace(F.lit(pattern), F.lit("{p}"), place)
    of = lambda pattern: total(F.regexp_extract_all(text, F.replace(at(pattern), F.lit("{t}"), thing), F.lit(1)))
    held = of(r"There are (\d+) {t} in the {p}\.") * factor + of(r"(\d+) {t} are added to the {p}\.") - of(r"(\d+) {t} are removed from the {p}\.")
    return held + of(r"(\d+) {t} are moved from the \w+ to the {p}\.") - of(r"(\d+) {t} are moved from the {p} to the \w+\.") if moves else held


_ASKED = r"How many (\w+) are in the (\w+) now\?"


def state_tracking(text: Column) -> Column:
    return _held(text, first(text, _ASKED, 1), first(text, _ASKED, 2), F.lit(1)).cast("string")


def retroactive_edit(text: Column) -> Column:
    place = first(text, _ASKED, 2)
    edited = first(text, r"Actually, the (\w+) held \d+ times") == place
    factor = F.when(edited, number(text, r"held (\d+) times as many")).otherwise(F.lit(1))
    return _held(text, first(text, _ASKED, 1), place, factor).cast("string")


def multi_turn_inject(text: Column) -> Column:
    times = F.when(text.rlike(r"the amount in the \w+ doubles\."), 2).when(text.rlike(r"the amount in the \w+ triples\."), 3).when(text.rlike(r"The amount in the \w+ stays as it is\."), 1)
    return (_held(text, first(text, _ASKED, 1), first(text, _ASKED, 2), F.lit(1)) * times).cast("string")


def dynamic_pivot(text: Column) -> Column:
    return F.when(text.rlike("none of the moves between containers ever happened"), _held(text, first(text, _ASKED, 1), first(text, _ASKED, 2), F.lit(1), moves=False).cast("string"))


def false_lemma(text: Column) -> Column:
    thing = first(text, r"How many (\w+) are there in total now\?")
    left = _amounts(text, thing, r"There are (\d+) {t} in") + _amounts(text, thing, r"(\d+) {t} are added") - _amounts(text, thing, r"(\d+) {t} are removed")
    return F.when(thing.isNotNull(), left.cast("string"))


# --- chains

def _replay(parts: Column, who: Column, thing: Column, start: Column | None = None) -> Column:
    """Fold the sentences about this person and thing; a start that the caller knows replaces the stated one."""
    about = F.filter(parts, lambda s: s.startswith(F.concat(who, F.lit(" "))) & F.contains(s, F.concat(F.lit(" "), thing)))

    def step(v: Column, s: Column) -> Column:
        k = number(s, r" (\d+) ")
        return (
            F.when(s.rlike(r" starts with \d+ "), k).when(s.rlike(" starts with A plus "), v).when(s.rlike(r" splits the .* into \d+ equal groups"), F.floor(v / number(s, r"into (\d+) equal")).cast("long"))
            .when(s.rlike(" doubles the number"), v * 2).when(s.rlike(" triples the number"), v * 3).when(s.rlike(r" \w+ \d+ more "), v + k).when(s.rlike(r" \w+ \d+ \w+\."), v - k).otherwise(v)
        )

    return F.aggregate(about, F.lit(0).cast("long") if start is None else start.cast("long"), step)


def arithmetic(text: Column) -> Column:
    thing, who = first(text, r"How many (\w+) does (\w+) have now\?", 1), first(text, r"How many (\w+) does (\w+) have now\?", 2)
    return _replay(sentences(text), who, thing).cast("string")


noise_haystack = arithmetic


def _told_to(words: Column, left: Column, right: Column) -> Column:
    """What an operation's wording makes of two numbers; null for another wording."""
    of_two = (
        F.when(words.startswith("add the two numbers "), left + right).when(words.startswith("multiply the two numbers "), left * right).when(words.startswith("double the sum of the two numbers "), left + right + left + right)
        .when(words.startswith("subtract the right number from the left "), left - right).when(words.startswith("take the left modulo the right ") & (right > 0), F.pmod(left, right))
    )
    more = number(words, r" then add (\d+)$")
    return (of_two + F.coalesce(more, -number(words, r" then subtract (\d+)$"))).cast("long")


def redefined_ops(text: Column) -> Column:
    thing, who = first(text, r"How many (\w+) does (\w+) have now\?", 1), first(text, r"How many (\w+) does (\w+) have now\?", 2)
    base = first(text, r"In this problem, (\w+) means")
    simple, later = first(text, r"means:? (?:for its first 2 uses, )?([^:;.]+)[;.]"), first(text, r"for every later use, ([^.]+)\.")
    twice = first(text, r"In this problem, (\w+) means: apply")
    steps = F.filter(sentences(text), lambda s: s.startswith(F.concat(who, F.lit(" "))) & (s.startswith(F.concat(who, F.lit(" "), base, F.lit(" "))) | F.coalesce(s.startswith(F.concat(who, F.lit(" "), twice, F.lit(" "))), F.lit(False))))

    def run(p: Column, q: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            k, n = number(s, r" (\d+) "), acc["uses"] + 1
            once = _told_to(p, acc["v"], k)
            v = F.when(F.coalesce(first(s, r"^\w+ (\w+) ") == twice, F.lit(False)), _told_to(p, once, k)).when(later.isNotNull() & (n > 2), _told_to(q, acc["v"], k)).otherwise(once)
            return F.struct(v.cast("long").alias("v"), n.alias("uses"))

        begin = F.struct(number(text, r"starts with (\d+) ").alias("v"), F.lit(0).alias("uses"))
        return F.aggregate(steps, begin, step, lambda acc: acc["v"])

    known = F.when(thing.isNotNull() & simple.isNotNull(), F.lit(True))
    return F.when(known, let(simple, lambda p: let(F.coalesce(later, simple), lambda q: run(p, q))).cast("string"))


# --- orders and sequences

def _places(text: Column, axis: Column) -> Column:
    """Names from the most to the least along one axis (its number), or null if the comparisons leave it open."""
    word = lambda k: F.get(F.array(*[F.lit(a[k]) for a in AXES]), axis)
    pattern = lambda w: F.concat(F.lit(r"(\w+) is "), w, F.lit(r" than (\w+)\."))
    pairs = lambda w, a, b: F.transform(F.arrays_zip(F.regexp_extract_all(text, pattern(w), F.lit(a)).alias("hi"), F.regexp_extract_all(text, pattern(w), F.lit(b)).alias("lo")), lambda x: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo")))
    edges = F.concat(pairs(word(0), 1, 2), pairs(word(1), 2, 1))
    names = F.array_distinct(F.concat(F.transform(edges, lambda e: e["hi"]), F.transform(edges, lambda e: e["lo"])))

    def settle(e: Column, who: Column) -> Column:
        """Longest path down to each name; as many rounds as names, after which a cycle still grows."""
        def again(depth: Column, _: Column) -> Column:
            above = lambda name: F.filter(e, lambda x: x["lo"] == name)
            return F.transform(who, lambda name: F.coalesce(F.array_max(F.transform(above(name), lambda x: F.get(depth, index_of(who, x["hi"])) + 1)), F.lit(0)))

        depth = F.aggregate(who, F.transform(who, lambda _: F.lit(0)), again)
        order = lambda d: F.transform(F.array_sort(F.arrays_zip(d.alias("d"), who.alias("who"))), lambda x: x["who"])
        return let(depth, lambda d: F.when(F.array_sort(d) == count(F.size(who)), order(d)))

    return let(edges, lambda e: let(names, lambda who: F.when(F.size(who) > 0, settle(e, who))))


def ordering(text: Column) -> Column:
    asked = F.array_position(F.array(*[F.lit(a[2]) for a in AXES]), first(text, r"Who is the \d+\w\w (\w+)\?")).cast("int") - 1
    return F.get(_places(text, asked), number(text, r"Who is the (\d+)\w\w") .cast("int") - 1)


def next_terms(terms: Column) -> Column:
    """The distinct next numbers by every rule that the terms follow."""
    n = F.size(terms)
    at = lambda i: F.get(terms, i)
    differences = lambda x: F.transform(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda v, i: v - F.get(x, i))
    constant = lambda x, least: (F.size(x) >= least) & (F.size(F.array_distinct(x)) == 1)
    last = lambda x: F.get(x, F.size(x) - 1)
    every = lambda begin, rule: F.forall(count(n), lambda i: (i < begin) | rule(i))

    def rules(d1: Column, d2: Column, d3: Column) -> Column:
        ratio = (at(F.lit(0)) != 0) & (n >= 3) & every(2, lambda i: at(i) * at(F.lit(0)) == at(i - 1) * at(F.lit(1))) & (F.pmod(at(n - 1) * at(F.lit(1)), F.nullif(F.abs(at(F.lit(0))), F.lit(0).cast("long"))) == 0)
        geometric = F.when(ratio, F.floor(at(n - 1) * at(F.lit(1)) / F.nullif(at(F.lit(0)), F.lit(0).cast("long"))))
        return F.array(
            F.when(constant(d1, 2), at(n - 1) + last(d1)), geometric, F.when(constant(d2, 2), at(n - 1) + last(d1) + last(d2)), F.when(constant(d3, 2), at(n - 1) + last(d1) + last(d2) + last(d3)),
            F.when((n >= 4) & every(2, lambda i: at(i) == at(i - 1) + at(i - 2)), at(n - 1) + at(n - 2)),
            F.when((n >= 4) & every(4, lambda i: at(i) - at(i - 2) == at(i - 2) - at(i - 4)), at(n - 2) * 2 - at(n - 4)),
        )

    candidates = let(differences(terms), lambda d1: let(differences(d1), lambda d2: let(differences(d2), lambda d3: rules(d1, d2, d3))))
    return F.array_distinct(F.filter(candidates, lambda x: x.isNotNull()))


def sequences(text: Column) -> Column:
    terms = F.transform(F.split(first(text, r"(-?\d+(?:, -?\d+)+)\s*$"), ", "), lambda x: x.cast("long"))
    return let(next_terms(terms), lambda c: F.when(F.size(c) == 1, F.get(c, 0).cast("string")))


# --- islanders

_SAID = r"(\w+) says that (\w+) (?:is a (knight|knave)|and (\w+) are of (the same kind|different kinds))\."


def statements_of(text: Column, people: Column) -> Column:
    """Statements in order, as (speaker, x, y, want) over the people's places; y is -1 where only x is spoken of."""
    def one(s: Column) -> Column:
        g = lambda k: F.call_function("regexp_extract", s, F.lit(_SAID), F.lit(k))
        return F.struct(index_of(people, g(1)).alias("s"), index_of(people, g(2)).alias("x"), index_of(people, g(4)).alias("y"), ((g(3) == "knight") | (g(5) == "the same kind")).alias("want"))

    return F.transform(found(text, _SAID), one)


def people_of(text: Column) -> Column:
    return F.split(first(text, r"The islanders are ([^.]+)\."), ", ")


def worlds(statements: Column, n: Column) -> Column:
    """Every assignment (bit i: islander i is a knight) in which each speaks truly just if a knight."""
    bit = lambda m, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1
    holds = lambda m, s: bit(m, s["s"]) == (F.when(s["y"] < 0, bit(m, s["x"])).otherwise(bit(m, s["x"]) == bit(m, F.greatest(s["y"], F.lit(0)))) == s["want"])
    return F.filter(count(F.pow(F.lit(2), F.least(n, F.lit(MOST_ISLANDERS))).cast("int")), lambda m: F.forall(statements, lambda s: holds(m, s)))


def _island(text: Column, answer: Callable[[Column, Column, Column], Column]) -> Column:
    """The answer from people, statements and number of people; null where there are too many to go through."""
    return let(people_of(text), lambda people: F.when(F.size(people) <= MOST_ISLANDERS, let(statements_of(text, people), lambda said: answer(people, said, F.size(people)))))


def _is_knight(m: Column, i: Column) -> Column:
    return F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1


def knights_knaves(text: Column) -> Column:
    named = lambda people, m: F.array_join(F.array_sort(F.filter(people, lambda p, i: ~_is_knight(m, i))), ", ")
    return _island(text, lambda people, said, n: let(worlds(said, n), lambda w: F.when(F.size(w) == 1, named(people, F.get(w, 0)))))


def unsat_csp(text: Column) -> Column:
    asked = first(text, r"Is (\w+) a knight or a knave\?")

    def answer(people: Column, said: Column, n: Column) -> Column:
        kinds = lambda w: F.array_distinct(F.transform(w, lambda m: _is_knight(m, index_of(people, asked))))
        told = lambda k: F.when(F.size(k) == 0, "NO_SOLUTION").when(F.size(k) == 2, "UNDETERMINED").when(F.get(k, 0), "knight").otherwise("knave")
        return let(worlds(said, n), lambda w: let(kinds(w), told))

    return _island(text, answer)


def unsat_localize(text: Column) -> Column:
    def answer(people: Column, said: Column, n: Column) -> Column:
        without = lambda k: F.filter(said, lambda s, i: i != k)
        good = F.filter(count(F.size(said)), lambda k: F.size(worlds(without(k), n)) == 1)
        return let(good, lambda g: F.when((F.size(g) == 1) & (F.size(worlds(said, n)) == 0), (F.get(g, 0) + 1).cast("string")))

    return _island(text, answer)


def permutations(n: int) -> Column:
    """All orders of 1 to n."""
    insert = lambda p, k: F.transform(F.sequence(F.lit(0), F.size(p)), lambda j: F.concat(F.slice(p, F.lit(1), j), F.array(k), F.slice(p, j + 1, F.size(p) - j)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.array().cast("array<int>")), lambda acc, k: F.flatten(F.transform(acc, lambda p: insert(p, k))))


def logic_grid(text: Column) -> Column:
    people = F.split(first(text, r"one person lives on each: ([^.]+)\."), ", ")
    clue = lambda pattern, *groups: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name) for g, name in groups])
    on, high = clue(r"(\w+) lives on floor (\d+)\.", (1, "a"), (2, "k")), clue(r"(\w+) lives above floor (\d+)\.", (1, "a"), (2, "k"))
    exact, above, near = clue(r"(\w+) lives exactly (\d+) floors (above|below) (\w+)\.", (1, "a"), (2, "k"), (3, "way"), (4, "b")), clue(r"(\w+) lives somewhere above (\w+)\.", (1, "a"), (2, "b")), clue(r"(\w+) and (\w+) live on adjacent floors\.", (1, "a"), (2, "b"))

    def solve(who: Column, on: Column, high: Column, exact: Column, above: Column, near: Column) -> Column:
        def fits(p: Column) -> Column:
            at = lambda name: F.get(p, index_of(who, name))
            return (
                F.forall(on, lambda c: at(c["a"]) == c["k"].cast("int")) & F.forall(high, lambda c: at(c["a"]) > c["k"].cast("int")) & F.forall(above, lambda c: at(c["a"]) > at(c["b"]))
                & F.forall(exact, lambda c: at(c["a"]) - at(c["b"]) == F.when(c["way"] == "above", c["k"].cast("int")).otherwise(-c["k"].cast("int"))) & F.forall(near, lambda c: F.abs(at(c["a"]) - at(c["b"])) == 1)
            )

        asked = index_of(who, first(text, r"On which floor does (\w+) live\?"))
        cases = F.lit(None).cast("array<array<int>>")
        for n in range(2, MOST_FLOORS + 1):
            cases = F.when(F.size(who) == n, F.filter(permutations(n), fits)).otherwise(cases)
        return let(cases, lambda c: F.when(F.size(c) == 1, F.get(F.get(c, 0), asked).cast("string")))

    return let(people, lambda w: let(on, lambda a: let(high, lambda b: let(exact, lambda c: let(above, lambda d: let(near, lambda e: solve(w, a, b, c, d, e)))))))


def composed(text: Column) -> Column:
    stage = lambda k: first(text, rf"(?s)Stage {k}: (.*?)(?:\nStage|$)")
    knights = _island(stage(1), lambda people, said, n: let(worlds(said, n), lambda w: F.when(F.size(w) == 1, F.bit_count(F.get(w, 0)))))
    thing = first(stage(2), r"Let B be the number of (\w+) that")

    def chain(a: Column) -> Column:
        return _replay(sentences(stage(2)), F.lit("Zoe"), thing, a + number(stage(2), r"starts with A plus (\d+) "))

    place = F.array_position(_places(stage(3), F.lit(0)), first(stage(3), r"Let C be the place of (\w+) from"))
    gate1, gate2 = number(stage(4), r"minus C plus (\d+)\."), number(stage(5), r"G is D plus (\d+);")
    d = lambda b, c: F.when(F.pmod(b, F.lit(2)) == 0, b + c).otherwise(b - c + gate1)
    g = lambda x: F.when(F.pmod(x, F.lit(2)) == 0, x + gate2).otherwise(x * 2)
    return let(knights, lambda a: let(chain(a), lambda b: let(place, lambda c: let(d(b, c), lambda x: g(x).cast("string")))))


# --- blocks, beliefs, programs

def planning_blocksworld(text: Column) -> Column:
    part = lambda name: first(text, rf"{name} configuration: ([^\n]+)\n")
    return fewest_told(part("Initial"), part("Goal")).cast("string")


def theory_of_mind(text: Column) -> Column:
    """The chain of believers takes over a move only if all of them are in the room."""
    chain = F.when(text.rlike(r"Where will \w+ look"), F.array(first(text, r"Where will (\w+) look"))).otherwise(
        F.concat(F.array(first(text, r"Where does (\w+) think ")), F.regexp_extract_all(F.coalesce(first(text, r"Where does \w+ think (.*) will look"), F.lit("")), F.lit(r"(\w+) thinks"), F.lit(1)), F.array(first(text, r"(\w+) will look for")))
    )
    everyone = F.split(first(text, r"^(.+?) are in the room\."), ", ")
    start = first(text, r"The \w+ is in the (\w+)\.")

    def run(believers: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            who = first(s, r"^(\w+) ")
            present = F.when(s.endswith(" leaves the room."), F.array_remove(acc["present"], who)).when(s.endswith(" enters the room."), F.array_union(acc["present"], F.array(who))).otherwise(acc["present"])
            seen = s.rlike(r" moves the \w+ from ") & (F.size(F.array_except(believers, acc["present"])) == 0)
            return F.struct(present.alias("present"), F.when(seen, first(s, r" to the (\w+)\.")).otherwise(acc["at"]).alias("at"))

        return F.aggregate(sentences(text), F.struct(everyone.alias("present"), start.alias("at")), step, lambda acc: acc["at"])

    return let(chain, run)


def code_output(text: Column) -> Column:
    """Closed forms of the five shapes of function; another shape gives null, and no text is run."""
    args = F.transform(F.split(first(text, r"Call: f\(([^)]*)\)"), ", "), lambda x: x.cast("long"))
    a, b, c = (F.get(args, k) for k in range(3))
    loops = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    add = lambda xs: total(xs)
    nested = add(F.transform(loops(a), lambda i: add(F.transform(loops(b), lambda j: i + j))))
    value = (
        F.when(F.contains(text, F.lit("total + i + j")), nested).when(F.contains(text, F.lit("if i % m == 0")), add(F.transform(loops(a), lambda i: F.when(i % c == 0, b).otherwise(i))))
        .when(F.contains(text, F.lit("total + i * k")), add(F.transform(loops(a), lambda i: i * b))).when(F.contains(text, F.lit("v = v * c")), (a + b) * c)
        .when(F.contains(text, F.lit("v = v + b")), a + b).when(F.contains(text, F.lit("v = v - b")), a - b)
    )
    return value.cast("string")


SOLVERS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        arithmetic, state_tracking, retroactive_edit, multi_turn_inject, ordering, sequences, knights_knaves, logic_grid, composed, redefined_ops, unsat_csp, unsat_localize, dynamic_pivot, false_lemma,
        planning_blocksworld, theory_of_mind, code_output,
    )
} | {"noise_haystack": noise_haystack}


def agrees(answer: Column, gold: Column, kind: str) -> Column:
    """Whether a derived answer is the gold; sets regardless of order. Null answers do not agree."""
    names = lambda x: F.array_sort(F.array_distinct(split_names(x)))
    return F.coalesce((names(answer) == names(gold)) if kind == "set" else (answer == gold), F.lit(False))


def derive(items: DataFrame, family: str) -> DataFrame:
    """Items of one family with ``derived`` and ``verified``."""


    kind = next(f.answer_type for f in FAMILIES if f.name == family)
    own = items.where(F.col("family") == family).withColumn("derived", SOLVERS[family](F.col("prompt")))
    return own.withColumn("verified", agrees(F.col("derived"), F.col("gold"), kind))
