"""Generators: a function for each family from specifications to prompt, gold and choices.

All draws are hashes of the specification, so an item comes out the same
wherever and whenever it is made. Structure follows ``structure_seed``; names
and things follow ``surface_seed`` too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordinal
from .planning import least_moves
from .spec import FAMILIES, Draw, count, say, words_of

NAMES = ("Ada", "Bruno", "Chen", "Dalia", "Emil", "Farah", "Goran", "Hana", "Ivo", "Jana", "Karim", "Lotte")
THINGS = ("apples", "marbles", "stamps", "coins", "shells", "pencils", "buttons", "cards")
PLACES = ("basket", "drawer", "chest", "cupboard", "suitcase", "crate")
GAIN, LOSS = ("buys", "finds", "receives", "collects"), ("sells", "loses", "donates", "drops")
#: Adjective, its opposite, and the superlative that a question asks for.
AXES = (("taller", "shorter", "tallest"), ("older", "younger", "oldest"), ("faster", "slower", "fastest"), ("heavier", "lighter", "heaviest"))
SYMBOLS = ("zorps", "blinks", "quams", "drives")
#: Redefined operations: how they are told, with {b} for a number.
PHRASES = (
    "add the two numbers then add {b}", "multiply the two numbers then subtract {b}", "double the sum of the two numbers then add {b}",
    "subtract the right number from the left then add {b}", "take the left modulo the right then add {b}",
)
KINDS = ("knight", "knave", "UNDETERMINED", "NO_SOLUTION")
S, U = Draw("family", "difficulty", "structure_seed"), Draw("family", "structure_seed", "surface_seed")
D = F.col


def operate(phrase: Column, left: Column, right: Column, b: Column) -> Column:
    """What phrase number ``phrase`` makes of two numbers; modulo as with floored division."""
    return F.when(phrase == 0, left + right + b).when(phrase == 1, left * right - b).when(phrase == 2, (left + right) * 2 + b).when(phrase == 3, left - right + b).otherwise(
        left - right * F.floor(left / F.nullif(right, F.lit(0))) + b
    ).cast("long")


def _result(df: DataFrame, prompt: Column, gold: Column, choices: Column | None = None, turns: Column | None = None, subgold: Column | None = None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return df.withColumns({
        "prompt": prompt, "gold": gold.cast("string"), "choices": none("array<string>") if choices is None else choices, "turns": none("array<string>") if turns is None else turns,
        "subgold": none("string") if subgold is None else subgold.cast("string"),
    })


# --- containers that hold things

def _stores(df: DataFrame) -> DataFrame:
    """Three containers with amounts large enough for every removal, ``difficulty`` operations, and the text of both.

    The first operation moves something out of the asked container and the
    second adds to another, so that both kinds matter.
    """
    d = D("difficulty")
    df = df.withColumns({"thing": U.pick(THINGS, "thing"), "places": F.slice(U.shuffled(words_of(PLACES), "places"), 1, 3), "asked": S.below(3, "asked")})
    df = df.withColumn("initial", F.transform(count(3), lambda i: S.between(5, 20, "initial", i) + d * 4))

    def operation(i: Column) -> Column:
        kind = F.when(i == 0, F.lit("move")).when(i == 1, F.lit("add")).otherwise(S.pick(("add", "remove", "move"), "kind", i))
        a = F.when(i == 0, D("asked")).otherwise(S.below(3, "from", i))
        return F.struct(kind.alias("kind"), S.between(1, 4, "k", i).alias("k"), a.alias("a"), F.pmod(a + 1 + S.below(2, "to", i), F.lit(3)).alias("b"))

    df = df.withColumn("ops", F.transform(count(d), operation))
    at = lambda i: F.concat(F.lit("the "), F.get(D("places"), i))
    thing = D("thing")
    told = F.transform("ops", lambda o: F.when(o["kind"] == "add", say(o["k"], " ", thing, " are added to ", at(o["a"]), ".")).when(
        o["kind"] == "remove", say(o["k"], " ", thing, " are removed from ", at(o["a"]), ".")).otherwise(say(o["k"], " ", thing, " are moved from ", at(o["a"]), " to ", at(o["b"]), ".")))
    df = df.withColumns({"told": told, "start": F.transform("initial", lambda n, i: say("There are ", n, " ", thing, " in ", at(i), "."))})
    noise = say(U.between(2, 12, "noise"), " ", U.pick(F.array_remove(words_of(THINGS), thing), "other"), " are added to ", at(U.below(3, "noise at")), ".")
    df = df.withColumn("noise", F.when(D("has_distractor"), F.array(noise)).otherwise(F.array().cast("array<string>")))
    return df.withColumns({"where": at(D("asked")), "question": say("How many ", thing, " are in ", at(D("asked")), " now?")})


def _held(at: Column, factor: Column | int = 1, moves: bool = True) -> Column:
    """What container ``at`` holds in the end."""
    gain = lambda o: F.when((o["kind"] == "add") & (o["a"] == at), o["k"]).when((o["kind"] == "remove") & (o["a"] == at), -o["k"]).when(
        F.lit(moves) & (o["kind"] == "move"), F.when(o["a"] == at, -o["k"]).when(o["b"] == at, o["k"]).otherwise(0)).otherwise(0)
    return F.get("initial", at) * factor + F.aggregate(F.transform("ops", gain), F.lit(0), lambda s, x: s + x)


def _story(*more: Column) -> Column:
    return F.array_join(F.concat(D("start"), D("noise"), D("told"), *[F.array(m) for m in more]), " ")


def state_tracking(df: DataFrame) -> DataFrame:
    df = _stores(df)
    return _result(df, _story(D("question")), _held(D("asked")))


def retroactive_edit(df: DataFrame) -> DataFrame:
    df = _stores(df).withColumn("factor", S.between(2, 5, "factor"))
    edit = say("Actually, ", D("where"), " held ", D("factor"), " times as many ", D("thing"), " as originally stated.")
    return _result(df, _story(edit, D("question")), _held(D("asked"), D("factor")))


def multi_turn_inject(df: DataFrame) -> DataFrame:
    df = _stores(df).withColumn("factor", S.between(1, 3, "factor"))
    change = F.when(D("factor") == 1, say("The amount in ", D("where"), " stays as it is. ")).otherwise(say("Then the amount in ", D("where"), F.when(D("factor") == 2, " doubles. ").otherwise(" triples. ")))
    turns = F.array(_story(), F.concat(change, D("question")))
    return _result(df, F.array_join(turns, "\n"), _held(D("asked")) * D("factor"), turns=turns)


def dynamic_pivot(df: DataFrame) -> DataFrame:
    df = _stores(df)
    turns = F.array(_story(D("question")), F.concat(F.lit("Correction: none of the moves between containers ever happened. "), D("question")))
    return _result(df, F.array_join(turns, "\n"), _held(D("asked"), moves=False), turns=turns, subgold=_held(D("asked")))


def false_lemma(df: DataFrame) -> DataFrame:
    df = _stores(df)
    df = df.withColumn("ops", F.transform("ops", lambda o: F.struct(F.when(o["kind"] == "move", "add").otherwise(o["kind"]).alias("kind"), o["k"].alias("k"), o["a"].alias("a"), o["b"].alias("b"))))
    at = lambda i: F.get(D("places"), i)
    told = F.transform("ops", lambda o: say(o["k"], " ", D("thing"), F.when(o["kind"] == "add", " are added to the ").otherwise(" are removed from the "), at(o["a"]), "."))
    prompt = F.array_join(F.concat(D("start"), told, F.array(say("Note that the total number of ", D("thing"), " is conserved throughout."), say("How many ", D("thing"), " are there in total now?"))), " ")
    return _result(df, prompt, sum((_held(F.lit(i)) for i in range(1, 3)), _held(F.lit(0))))


# --- chains of arithmetic

def _chain(draw: Draw, who: Column, thing: Column, start: Column, steps: Column, label: str) -> Column:
    """Struct (value, told) of ``steps`` changes to what somebody has; divisions come out exactly."""

    def step(acc: Column, i: Column) -> Column:
        v, k = acc["value"], draw.between(2, 9, label, "k", i)
        kind = draw.below(5, label, "kind", i)
        split = (kind == 4) & (v % 2 == 0) & (v > 0)
        value = F.when(split, F.floor(v / 2)).when((kind == 3) & (v < 400), v * 2).when((kind == 2) & (v < 400), v * 3).when((kind == 1) & (v >= k), v - k).otherwise(v + k)
        text = F.when(split, say(who, " splits the ", thing, " into 2 equal groups and keeps one group.")).when((kind == 3) & (v < 400), say(who, " doubles the number of ", thing, ".")).when(
            (kind == 2) & (v < 400), say(who, " triples the number of ", thing, ".")).when((kind == 1) & (v >= k), say(who, " ", draw.pick(LOSS, label, "verb", i), " ", k, " ", thing, ".")).otherwise(
            say(who, " ", draw.pick(GAIN, label, "verb", i), " ", k, " more ", thing, "."))
        return F.struct(value.cast("long").alias("value"), F.concat(acc["told"], F.array(text)).alias("told"))

    first = F.struct(start.cast("long").alias("value"), F.array(say(who, " starts with ", start, " ", thing, ".")).alias("told"))
    return F.aggregate(count(steps), first, step)


def arithmetic(df: DataFrame) -> DataFrame:
    df = df.withColumns({"who": U.pick(NAMES, "who"), "thing": U.pick(THINGS, "thing")})
    df = df.withColumn("c", _chain(S, D("who"), D("thing"), S.between(4, 20, "start"), D("difficulty"), "chain"))
    noise = say(D("who"), " also owns ", U.between(2, 20, "noise"), " ", U.pick(F.array_remove(words_of(THINGS), D("thing")), "other"), ".")
    told = F.concat(F.slice("c.told", 1, 1), F.when(D("has_distractor"), F.array(noise)).otherwise(F.array().cast("array<string>")), F.slice("c.told", 2, 1000))
    return _result(df, F.array_join(F.concat(told, F.array(say("How many ", D("thing"), " does ", D("who"), " have now?"))), " "), D("c.value"))


def noise_haystack(df: DataFrame) -> DataFrame:
    df = df.withColumns({"people": U.shuffled(words_of(NAMES), "people"), "thing": U.pick(THINGS, "thing")}).withColumn("who", F.get("people", 0))
    df = df.withColumn("c", _chain(S, D("who"), D("thing"), S.between(4, 20, "start"), D("difficulty"), "chain"))
    other = lambda i: F.get("people", 1 + F.pmod(i, F.lit(len(NAMES) - 1)))
    decoys = F.transform(count(D("difficulty") + 3), lambda i: F.struct(S.below(F.size("c.told"), "after", i).alias("after"), say(
        other(i), " starts with ", S.between(3, 30, "decoy", i), " ", D("thing"), ". ", other(i), " ", S.pick(GAIN, "decoy verb", i), " ", S.between(2, 9, "decoy k", i), " more ", D("thing"), ".").alias("text")))
    df = df.withColumn("decoys", decoys)
    mixed = F.flatten(F.transform("c.told", lambda s, i: F.concat(F.array(s), F.transform(F.filter("decoys", lambda x: x["after"] == i), lambda x: x["text"]))))
    return _result(df, F.array_join(F.concat(mixed, F.array(say("How many ", D("thing"), " does ", D("who"), " have now?"))), " "), D("c.value"))


def redefined_ops(df: DataFrame) -> DataFrame:
    d = D("difficulty")
    df = df.withColumns({"who": U.pick(NAMES, "who"), "thing": U.pick(THINGS, "thing"), "mode": F.when(d < 3, 0).otherwise(1 + S.below(2, "mode")), "syms": S.shuffled(words_of(SYMBOLS), "symbols"), "start": S.between(3, 15, "start")})
    df = df.withColumns({"p1": S.below(5, "p1"), "b1": S.between(1, 5, "b1"), "b2": S.between(1, 5, "b2")}).withColumn("p2", F.pmod(D("p1") + 1 + S.below(4, "p2"), F.lit(5)))
    phrase = lambda p, b: F.replace(F.get(words_of(PHRASES), p), F.lit("{b}"), b.cast("string"))
    a, b = F.get("syms", 0), F.get("syms", 1)
    simple = say("In this problem, ", a, " means ", phrase(D("p1"), D("b1")), ".")
    positional = say("In this problem, ", a, " means: for its first 2 uses, ", phrase(D("p1"), D("b1")), "; for every later use, ", phrase(D("p2"), D("b2")), ".")
    twice = say(simple, " In this problem, ", b, " means: apply ", a, " to the two numbers, then apply ", a, " to that result and the right number.")
    # The last step of the third mode is always the composed one.
    composed = lambda i: (D("mode") == 2) & ((i == d - 1) | (S.below(2, "sym", i) == 1))
    df = df.withColumn("steps", F.transform(count(d), lambda i: F.struct(composed(i).alias("twice"), S.between(2, 10, "k", i).alias("k"), i.alias("i"))))

    def step(v: Column, s: Column) -> Column:
        k = s["k"].cast("long")
        once = operate(D("p1"), v, k, D("b1"))
        later = operate(D("p2"), v, k, D("b2"))
        return F.when(s["twice"], operate(D("p1"), once, k, D("b1"))).when((D("mode") == 1) & (s["i"] >= 2), later).otherwise(once)

    gold = F.aggregate("steps", D("start").cast("long"), step)
    told = F.transform("steps", lambda s: say(D("who"), " ", F.when(s["twice"], b).otherwise(a), " ", s["k"], " ", D("thing"), "."))
    noise = F.when(D("has_distractor"), F.array(say(D("who"), " keeps ", U.between(2, 20, "noise"), " ", U.pick(F.array_remove(words_of(THINGS), D("thing")), "other"), " in a drawer."))).otherwise(F.array().cast("array<string>"))
    rules = F.when(D("mode") == 0, simple).when(D("mode") == 1, positional).otherwise(twice)
    parts = F.concat(F.array(say(D("who"), " starts with ", D("start"), " ", D("thing"), "."), rules), noise, told, F.array(say("How many ", D("thing"), " does ", D("who"), " have now?")))
    return _result(df, F.array_join(parts, " "), gold)


# --- orders and sequences

def ordering_text(people: Column, n: Column, draw: Draw, axis: Column) -> Column:
    """Comparisons of neighbours and of some others, in any order and either direction; people[0] is first."""
    axes = F.array(*[F.struct(F.lit(a).alias("more"), F.lit(b).alias("less")) for a, b, _ in AXES])
    told = lambda i, j, label: F.when(draw.below(2, label, i) == 0, say(F.get(people, i), " is ", F.get(axes, axis)["more"], " than ", F.get(people, j), ".")).otherwise(
        say(F.get(people, j), " is ", F.get(axes, axis)["less"], " than ", F.get(people, i), "."))
    near = F.transform(count(n - 1), lambda i: told(i, i + 1, "near"))
    far = F.transform(count(n - 2), lambda i: told(i, i + 2, "far"))
    return draw.shuffled(F.concat(near, F.filter(far, lambda x, i: draw.below(2, "use", i) == 0)), "clues")


def ordering(df: DataFrame) -> DataFrame:
    n = D("difficulty") + 2
    df = df.withColumns({"people": F.slice(S.shuffled(words_of(NAMES), "people"), F.lit(1), F.least(n, F.lit(len(NAMES)))), "axis": U.below(len(AXES), "axis")})
    df = df.withColumns({"n": F.size("people"), "rank": 1 + S.between(1, F.size("people") - 2, "rank")})
    clues = ordering_text(D("people"), D("n"), U, D("axis"))
    noise = F.when(D("has_distractor"), ordering_text(F.reverse(F.slice("people", 1, 2)), F.lit(2), U, F.pmod(D("axis") + 1, F.lit(len(AXES))))).otherwise(F.array().cast("array<string>"))
    superlative = F.get(words_of(tuple(x[2] for x in AXES)), D("axis"))
    question = say("Who is the ", ordinal(D("rank")), " ", superlative, "?")
    return _result(df, F.array_join(F.concat(noise, clues, F.array(question)), " "), F.get("people", D("rank") - 1), choices=F.array_sort("people"))


def sequences(df: DataFrame) -> DataFrame:
    """Seven terms and the eighth: arithmetic, geometric, quadratic, additive, two interleaved, cubic."""
    a, b, c, e = (S.between(lo, hi, label) for lo, hi, label in ((1, 12, "a"), (2, 7, "b"), (2, 5, "c"), (1, 3, "e")))
    tier = F.least(D("difficulty"), F.lit(6))
    i = count(8)
    arithmetic_, geometric = F.transform(i, lambda k: a + b * k), F.transform(i, lambda k: (a * F.pow(F.least(c, F.lit(4)), k)).cast("long"))
    quadratic, cubic = F.transform(i, lambda k: a + b * k + c * k * k), F.transform(i, lambda k: a + b * k + c * k * k + e * k * k * k)
    additive = F.aggregate(count(6), F.array(a, a + b), lambda s, _: F.concat(s, F.array(F.get(s, F.size(s) - 1) + F.get(s, F.size(s) - 2))))
    woven = F.transform(i, lambda k: F.when(k % 2 == 0, a + b * F.floor(k / 2)).otherwise(a + 20 + (b + c) * F.floor(k / 2)))
    kinds = [x.cast("array<long>") for x in (arithmetic_, geometric, quadratic, additive, woven, cubic)]
    df = df.withColumn("terms", F.get(F.array(*kinds), tier - 1))
    shown = F.array_join(F.transform(F.slice("terms", 1, 7), lambda x: x.cast("string")), ", ")
    return _result(df, say("What is the next number in this sequence? ", shown), F.get("terms", 7))


# --- knights and knaves

def islanders(df: DataFrame, names: Draw = U) -> DataFrame:
    """``n`` islanders, ``truth`` of each, and statements that leave this solution only.

    Islander i speaks of i + 1, and the last compares itself with the first:
    that alone settles the first whatever the last is, and the rest follow. A
    statement is (speaker, x, y, want): x is a knight (y < 0), or x and y are
    of one kind, if ``want``.
    """
    n = F.least(D("difficulty") + 2, F.lit(8))
    df = df.withColumns({"n": n, "truth": F.transform(count(n), lambda i: S.below(2, "truth", i) == 1), "people": F.slice(names.shuffled(words_of(NAMES), "people"), F.lit(1), n)})
    t = lambda i: F.get("truth", i)
    of = lambda s, x, y, want: F.struct(s.cast("int").alias("s"), x.cast("int").alias("x"), y.cast("int").alias("y"), want.alias("want"))
    chain = F.transform(count(D("n") - 1), lambda i: of(i, i + 1, F.lit(-1), t(i) == t(i + 1)))
    last = D("n") - 1
    return df.withColumn("chain", chain).withColumn("anchor", of(last, F.lit(0), last, t(F.lit(0))))


def told_statements(statements: Column) -> Column:
    who = lambda i: F.get("people", i)
    return F.transform(statements, lambda s: F.when(s["y"] < 0, say(who(s["s"]), " says that ", who(s["x"]), " is a ", F.when(s["want"], "knight").otherwise("knave"), ".")).otherwise(
        say(who(s["s"]), " says that ", who(s["x"]), " and ", who(s["y"]), F.when(s["want"], " are of the same kind.").otherwise(" are of different kinds."))))


def _island(statements: Column, question: Column | str, numbered: bool = False) -> Column:
    told = told_statements(statements)
    lines = F.transform(told, lambda s, i: say(i + 1, ") ", s)) if numbered else told
    intro = say("On an island, knights always tell the truth and knaves always lie. The islanders are ", F.array_join("people", ", "), ". ")
    return F.concat(intro, F.array_join(lines, " "), F.lit(" "), F.lit(question) if isinstance(question, str) else question)


def knights_knaves(df: DataFrame) -> DataFrame:
    df = islanders(df)
    said = S.shuffled(F.concat("chain", F.array("anchor")), "order")
    knaves = F.array_sort(F.transform(F.filter(F.arrays_zip("people", "truth"), lambda x: ~x["truth"]), lambda x: x["people"]))
    return _result(df, _island(said, "List all the knaves, separated by commas, or answer none."), F.array_join(knaves, ", "))


def _opposite(statement: Column) -> Column:
    return statement.withField("want", ~statement["want"])


def unsat_csp(df: DataFrame) -> DataFrame:
    """The anchor alone decides: with it the asked islander is settled, without it nobody is, and a contradicted neighbour leaves no solution."""
    df = islanders(df).withColumns({"asked": S.below(D("n"), "asked"), "mode": S.below(4, "mode"), "at": S.below(D("n") - 1, "at")})
    none = F.array().cast(df.schema["chain"].dataType)
    link = F.get("chain", D("at"))
    back = F.struct(link["x"].alias("s"), link["s"].alias("x"), link["y"].alias("y"), link["want"].alias("want"))
    more = F.when(D("mode") == 1, none).when(D("mode") == 2, F.array(D("anchor"), _opposite(back))).when(D("mode") == 3, F.array(D("anchor"), back)).otherwise(F.array("anchor"))
    said = S.shuffled(F.concat(D("chain"), more), "order")
    gold = F.when(D("mode") == 1, "UNDETERMINED").when(D("mode") == 2, "NO_SOLUTION").otherwise(F.when(F.get("truth", D("asked")), "knight").otherwise("knave"))
    question = say("Is ", F.get("people", D("asked")), " a knight or a knave? If it cannot be determined, answer UNDETERMINED; if the statements contradict each other, answer NO_SOLUTION.")
    return _result(df, _island(said, question), gold, choices=words_of(KINDS))


def unsat_localize(df: DataFrame) -> DataFrame:
    """A link that is told from both ends and contradicted once: only the contradiction can go."""
    df = islanders(df).withColumn("at", S.below(D("n") - 1, "at"))
    link = F.get("chain", D("at"))
    back = F.struct(link["x"].alias("s"), link["s"].alias("x"), link["y"].alias("y"), link["want"].alias("want"))
    wrong = F.when(S.below(2, "end") == 0, _opposite(back)).otherwise(_opposite(link))
    df = df.withColumns({"wrong": wrong, "said": S.shuffled(F.concat("chain", F.array(D("anchor"), back, wrong)), "order")})
    question = "Exactly one numbered statement has to be removed to make the others consistent. Which number is it?"
    return _result(df, _island(D("said"), question, numbered=True), F.array_position("said", D("wrong")))


def logic_grid(df: DataFrame) -> DataFrame:
    """One floor is told, the others follow from exact distances; looser clues repeat some of it."""
    n = F.least(D("difficulty") + 2, F.lit(7))
    df = df.withColumns({"people": F.slice(U.shuffled(words_of(NAMES), "people"), F.lit(1), n), "floors": S.shuffled(F.sequence(F.lit(1), n), "floors"), "n": n})
    who, floor = (lambda i: F.get("people", i)), (lambda i: F.get("floors", i))
    apart = lambda i: floor(i + 1) - floor(i)
    exact = F.transform(count(D("n") - 1), lambda i: say(who(i + 1), " lives exactly ", F.abs(apart(i)), " floors ", F.when(apart(i) > 0, "above ").otherwise("below "), who(i), "."))
    loose = F.transform(count(D("n") - 2), lambda i: F.when(F.abs(floor(i + 2) - floor(i)) == 1, say(who(i), " and ", who(i + 2), " live on adjacent floors.")).when(
        floor(i + 2) > floor(i), say(who(i + 2), " lives somewhere above ", who(i), ".")).otherwise(say(who(i), " lives somewhere above ", who(i + 2), ".")))
    high = F.array(say(who(D("n") - 1), " lives above floor ", floor(D("n") - 1) - 1, "."))
    clues = S.shuffled(F.concat(F.array(say(who(F.lit(0)), " lives on floor ", floor(F.lit(0)), ".")), exact, loose, high), "clues")
    asked = S.between(1, D("n") - 1, "asked")
    intro = say("A building has ", D("n"), " floors and one person lives on each: ", F.array_join("people", ", "), ". ")
    return _result(df, F.concat(intro, F.array_join(clues, " "), say(" On which floor does ", who(asked), " live?")), floor(asked))


def composed(df: DataFrame) -> DataFrame:
    """Five stages, each of which needs the one before: islanders, a chain, an order, and two gates by parity."""
    df = islanders(df)
    df = df.withColumns({"thing": U.pick(THINGS, "thing"), "line": F.slice(S.shuffled(words_of(NAMES), "line"), F.lit(1), D("n")), "rank": S.below(D("n"), "rank"), "add": S.between(2, 9, "add"), "g1": S.between(2, 9, "g1"), "g2": S.between(2, 9, "g2")})
    df = df.withColumn("a", F.size(F.filter("truth", lambda t: t))).withColumn("c", _chain(S, F.lit("Zoe"), D("thing"), D("a") + D("add"), D("difficulty"), "chain"))
    b, c = D("c.value"), D("rank") + 1
    df = df.withColumn("d", F.when(b % 2 == 0, b + c).otherwise(b - c + D("g1")))
    gold = F.when(F.pmod(D("d"), F.lit(2)) == 0, D("d") + D("g2")).otherwise(D("d") * 2)
    first = _island(S.shuffled(F.concat("chain", F.array("anchor")), "order"), "Let A be the number of knights.")
    second = say("Zoe starts with A plus ", D("add"), " ", D("thing"), ". ", F.array_join(F.slice("c.told", 2, 1000), " "), " Let B be the number of ", D("thing"), " that Zoe has in the end.")
    third = F.concat(F.array_join(ordering_text(D("line"), D("n"), S, F.lit(0)), " "), say(" Let C be the place of ", F.get("line", D("rank")), " from the tallest, the tallest being 1."))
    fourth = say("If B is even, D is B plus C; otherwise D is B minus C plus ", D("g1"), ".")
    fifth = say("If D is even, G is D plus ", D("g2"), "; otherwise G is twice D. What is G?")
    stages = [F.concat(F.lit(f"Stage {k}: "), x) for k, x in enumerate((first, second, third, fourth, fifth), 1)]
    return _result(df, F.array_join(F.array(*stages), "\n"), gold)


# --- blocks, beliefs, programs

def _stacks(draw: Draw, n: Column, label: str) -> Column:
    """Blocks A, B, ... in stacks, bottom first: a random order, cut at random places; the stacks in order of their bottoms."""
    blocks = draw.shuffled(F.transform(count(n), lambda i: F.chr(i + 65)), label)
    piled = F.aggregate(blocks, F.array().cast("array<array<string>>"), lambda acc, x: F.when((F.size(acc) == 0) | (draw.below(2, label, "cut", x) == 0), F.concat(acc, F.array(F.array(x)))).otherwise(
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.get(acc, F.size(acc) - 1), F.array(x))))))
    return F.array_sort(piled)


def told_stacks(stacks: Column, draw: Draw, label: str) -> Column:
    lines = F.flatten(F.transform(stacks, lambda s: F.transform(s, lambda x, i: F.when(i == 0, say(x, " is on the table.")).otherwise(say(x, " is on ", F.get(s, i - 1), ".")))))
    return F.array_join(draw.shuffled(lines, label), " ")


def planning_blocksworld(df: DataFrame) -> DataFrame:
    n = D("difficulty") + 2
    df = df.withColumns({"begin": _stacks(S, n, "begin"), "end": _stacks(S, n, "end")})
    tower = F.array(F.flatten("begin"))  # in place of an end that is the beginning
    flat = F.transform(F.flatten("begin"), lambda x: F.array(x))
    df = df.withColumn("end", F.when(D("end") != D("begin"), D("end")).when(F.size("begin") == 1, F.array_sort(flat)).otherwise(tower))
    prompt = F.concat(
        F.lit("Blocks stand on a table. A move takes a block with nothing on it and puts it on the table or on another block with nothing on it.\nInitial configuration: "), told_stacks(D("begin"), S, "tell begin"),
        F.lit("\nGoal configuration: "), told_stacks(D("end"), S, "tell end"), F.lit("\nWhat is the least number of moves from the initial to the goal configuration?"),
    )
    return _result(df, prompt, least_moves(D("begin"), D("end")))


def theory_of_mind(df: DataFrame) -> DataFrame:
    """Everybody sees the first moves; then the one whose belief is asked for leaves, and misses the last."""
    depth = F.least(F.lit(3), F.floor((D("difficulty") + 1) / 2)).cast("int")
    df = df.withColumns({"depth": depth, "thing": U.pick(("key", "ring", "letter", "watch"), "thing"), "places": F.slice(S.shuffled(words_of(PLACES), "places"), 1, 3)})
    df = df.withColumn("agents", F.slice(S.shuffled(words_of(NAMES), "agents"), F.lit(1), D("depth") + 1))
    # Each move goes one or two places on, so it never ends where it began.
    route = F.aggregate(count(D("difficulty")), F.array(F.lit(0)), lambda r, i: F.concat(r, F.array(F.pmod(F.get(r, F.size(r) - 1) + 1 + S.below(2, "hop", i), F.lit(3)))))
    df = df.withColumn("route", route)
    place = lambda i: F.get("places", F.get("route", i))
    moves = lambda who, i: say(who, " moves the ", D("thing"), " from the ", place(i), " to the ", place(i + 1), ".")
    seen = F.transform(count(D("difficulty") - 1), lambda i: moves(F.get("agents", S.below(F.size("agents"), "mover", i)), i))
    first, last = F.get("agents", 0), D("difficulty") - 1
    secret = F.array(say(first, " leaves the room."), moves(F.get("agents", 1 + S.below(F.size("agents") - 1, "secret")), last), say(first, " enters the room."))
    chain = F.slice("agents", F.lit(1), D("depth"))
    inner = F.array_join(F.transform(F.slice(chain, F.lit(2), F.greatest(D("depth") - 2, F.lit(0))), lambda a: say(a, " thinks ")), "")
    question = F.when(D("depth") == 1, say("Where will ", first, " look for the ", D("thing"), "?")).otherwise(say("Where does ", first, " think ", inner, F.get(chain, D("depth") - 1), " will look for the ", D("thing"), "?"))
    intro = F.array(say(F.array_join("agents", ", "), " are in the room."), say("The ", D("thing"), " is in the ", place(F.lit(0)), "."))
    return _result(df, F.array_join(F.concat(intro, seen, secret, F.array(question)), " "), place(last), choices=D("places"))


def code_output(df: DataFrame) -> DataFrame:
    """A small function and a call; what it returns is known in closed form, so no text is ever run."""
    d = D("difficulty")
    a, b, c = S.between(2, 8, "a"), S.between(2, 8, "b"), S.between(2, 3, "c")
    n, k, m = S.between(4, 6 + d, "n"), S.between(2, 5, "k"), S.between(2, 3, "m")
    plus = S.below(2, "op") == 0
    whole = lambda x: F.floor(x).cast("long")
    hits = whole((n + m - 1) / m)  # of i < n that m divides
    variants = (
        (say("def f(a, b):\n    v = a\n    v = v ", F.when(plus, "+").otherwise("-"), " b\n    return v"), say("f(", a, ", ", b, ")"), F.when(plus, a + b).otherwise(a - b)),
        (say("def f(a, b, c):\n    v = a\n    v = v + b\n    v = v * c\n    return v"), say("f(", a, ", ", b, ", ", c, ")"), (a + b) * c),
        (say("def f(n, k):\n    total = 0\n    for i in range(n):\n        total = total + i * k\n    return total"), say("f(", n, ", ", k, ")"), whole(k * n * (n - 1) / 2)),
        (say("def f(n, k, m):\n    total = 0\n    for i in range(n):\n        if i % m == 0:\n            total = total + k\n        else:\n            total = total + i\n    return total"), say("f(", n, ", ", k, ", ", m, ")"),
         hits * k + whole(n * (n - 1) / 2) - whole(m * hits * (hits - 1) / 2)),
        (say("def f(n, m):\n    total = 0\n    for i in range(n):\n        for j in range(m):\n            total = total + i + j\n    return total"), say("f(", n, ", ", m, ")"), whole((m * n * (n - 1) + n * m * (m - 1)) / 2)),
    )
    table = F.array(*[F.struct(source.alias("source"), call.alias("call"), value.cast("long").alias("value")) for source, call, value in variants])
    df = df.withColumn("v", F.get(table, F.least(d, F.lit(5)) - 1))
    return _result(df, say("What value does this Python function return when called as shown?\n\n", D("v.source"), "\n\nCall: ", D("v.call")), D("v.value"))


MAKERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.name: globals()[f.name] for f in FAMILIES}
