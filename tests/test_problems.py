from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalframe.operators import accuracy, paired, respond
from evalframe.operators.tidy import Evaluation
from evalframe.problems import build, planning, replan, spec, verify

NAMES = [f.name for f in spec.FAMILIES]


@pytest.fixture(scope="module")
def pool(spark):
    df = build.make(spec.specifications(spark, None, 1, 6, 3, distractor=True, surface=1)).cache()
    df.count()
    return df


@pytest.mark.parametrize("family", NAMES)
def test_golds_follow_from_prompts_and_wrong_ones_do_not(pool, family):
    kind = next(f.answer_type for f in spec.FAMILIES if f.name == family)
    assert verify.derive(pool, family).where("not verified").count() == 0
    if kind == "choice":
        wrong = F.get(F.filter("choices", lambda c: c != F.col("gold")), 0)
    elif kind == "set":
        wrong = F.concat(F.col("gold"), F.lit(", Somebody"))
    else:
        wrong = (F.col("gold").cast("long") + 1).cast("string")
    checked = verify.derive(pool.withColumn("gold", wrong), family)
    assert checked.count() > 0 and checked.where("verified").count() == 0


def test_a_wrong_gold_stops_the_build(spark, monkeypatch):
    assert build.build(spark, ["arithmetic"], 1, 2, 2).count() == 4
    monkeypatch.setitem(build.MAKERS, "arithmetic", lambda df, make=build.MAKERS["arithmetic"]: make(df).withColumn("gold", F.lit("-1")))
    with pytest.raises(PySparkException, match="does not follow from its prompt"):
        build.build(spark, ["arithmetic"], 1, 2, 2).collect()


def test_specifications(spark):
    df = spec.specifications(spark, None, 1, 6, 12, distractor=True, surface=3)
    assert df.count() == df.select("item_id").distinct().count() == 3492
    assert df.where("probe = 'base'").count() == 1224
    assert spec.specifications(spark, ["logic_grid"], 6, 9, 2).count() == 0
    with pytest.raises(ValueError, match="unknown family"):
        spec.specifications(spark, ["nothing"])


def test_items_come_out_the_same_again(spark, pool):
    again = build.make(spec.specifications(spark, None, 1, 6, 3, distractor=True, surface=1).repartition(7))
    assert again.exceptAll(pool).count() == 0 == pool.exceptAll(again).count()


def test_probes_hold_the_gold(pool):
    for family in ("arithmetic", "state_tracking", "retroactive_edit", "redefined_ops", "ordering", "unsat_csp"):
        own = pool.where(F.col("family") == family)
        assert own.groupBy("grp").agg(F.countDistinct("gold").alias("n")).where("n > 1").count() == 0, family


def test_every_label_of_the_island_occurs(spark):
    df = build.make(spec.specifications(spark, ["unsat_csp"], 1, 4, 12))
    assert {r.gold for r in df.select("gold").distinct().collect()} == {"knight", "knave", "UNDETERMINED", "NO_SOLUTION"}


@pytest.mark.parametrize(("begin", "end", "moves"), [([["A"], ["B"]], [["A", "B"]], 1), ([["A"], ["B"], ["C"]], [["A", "B", "C"]], 2), ([["B", "A"]], [["A", "B"]], 2), ([["A"]], [["A"]], 0), ([["A"]], [["B"]], None)])
def test_shortest_plans(begin, end, moves):
    assert planning.shortest(begin, end) == moves


@pytest.mark.parametrize(("terms", "nexts"), [("3, 6, 12, 24", {48, 21}), ("3, 6, 12, 24, 48, 96", {192}), ("1, 2, 4, 7, 11", {16}), ("1, 5, 2, 9, 77", set())])
def test_ambiguous_sequences(spark, terms, nexts):
    df = spark.createDataFrame([(terms,)], "t string").select(F.transform(F.split("t", ", "), lambda x: x.cast("long")).alias("t"))
    assert set(df.select(verify.next_terms(F.col("t")).alias("n")).first().n) == nexts


@pytest.mark.parametrize(("question", "want"), [("Where will Sally look for the ball?", "basket"), ("Where does Anne think Sally will look for the ball?", "basket"), ("Where will Anne look for the ball?", "box")])
def test_beliefs(spark, question, want):
    story = "Sally, Anne are in the room. The ball is in the basket. Sally leaves the room. Anne moves the ball from the basket to the box. Sally enters the room. "
    assert spark.createDataFrame([(story + question,)], "p string").select(verify.theory_of_mind(F.col("p")).alias("a")).first().a == want


@pytest.mark.parametrize(("code", "call", "want"), [("        total = total + i * k", "f(4, 3)", "18"), ("            total = total + i + j", "f(3, 2)", "9"), ("import os", "f(1)", None)])
def test_programs_are_never_run(spark, code, call, want):
    text = f"def f(n, k):\n{code}\n    return total\n\nCall: {call}"
    assert spark.createDataFrame([(text,)], "p string").select(verify.code_output(F.col("p")).alias("a")).first().a == want


# Published figures of the stand-in model over difficulties 1 to 6, 12 repetitions, three samples, distractors, three surface variants.
ACCURACY = {"arithmetic": 0.5972, "composed": 0.6667, "logic_grid": 0.55, "multi_turn_inject": 0.5694, "ordering": 0.5278, "redefined_ops": 0.6389, "retroactive_edit": 0.5417, "sequences": 0.5833, "state_tracking": 0.6528}
DISTRACTED = {"arithmetic": (0.4444, 20, 9), "ordering": (0.3472, 21, 8), "redefined_ops": (0.3472, 29, 8), "retroactive_edit": (0.3889, 13, 2), "state_tracking": (0.5, 22, 11)}
SURFACE = {"arithmetic": (0.8472, 0.5602), "logic_grid": (0.7833, 0.6056), "ordering": (0.8611, 0.5556), "redefined_ops": (0.7917, 0.5694), "retroactive_edit": (0.9167, 0.5417), "state_tracking": (0.8611, 0.5370)}


def test_the_stand_in_reproduces_published_figures(spark):
    items = build.make(spec.specifications(spark, list(ACCURACY), 1, 6, 12, distractor=True, surface=3), list(ACCURACY)).cache()
    e = Evaluation(items, respond.run_mock(items, "noisy", "noisy", 3))
    got = {r.family: round(r.accuracy, 4) for r in accuracy.by_family(e.frame).collect()}
    assert got == ACCURACY
    pairs = {r.family: (round(r.distractor_accuracy, 4), r.hurt, r.helped) for r in paired.distractibility(e.frame).collect()}
    assert pairs == DISTRACTED
    surface = {r.family: (round(r.answer_flip_rate, 4), round(r.surface_accuracy, 4)) for r in paired.invariance(e.frame, "family").collect()}
    assert {k: v[1] for k, v in surface.items()} == {k: v[1] for k, v in SURFACE.items()}
    assert {k: v[0] for k, v in surface.items() if k != "ordering"} == {k: v[0] for k, v in SURFACE.items() if k != "ordering"}  # the order of choices is our own


def test_two_searches_for_shortest_plans_agree():
    """By stacks and by supports, over all ways to put four blocks."""
    def stackings(blocks):
        if not blocks:
            return [[]]
        first, *others = blocks
        return [[[first], *s] for s in stackings(others)] + [s[:i] + [s[i][:j] + [first] + s[i][j:]] + s[i + 1 :] for s in stackings(others) for i in range(len(s)) for j in range(len(s[i]) + 1)]

    ways = stackings("ABCD")
    supports = lambda stacks: {x: (s[i - 1] if i else "") for s in stacks for i, x in enumerate(s)}
    assert len(ways) == 73
    for begin in ways[::3]:
        for end in ways[::5]:
            assert planning.shortest(begin, end) == replan.fewest(supports(begin), supports(end))
    assert replan.fewest({"A": ""}, {"B": ""}) is None and planning.shortest([["A"]], [["B"]]) is None


def test_more_islanders_than_are_gone_through_settle_nothing(spark):
    names = [f"N{chr(65 + i)}" for i in range(9)]
    text = f"The islanders are {', '.join(names)}. " + " ".join(f"{n} says that {n} is a knight." for n in names) + " Is NA a knight or a knave?"
    df = spark.createDataFrame([(text,)], "p string")
    assert df.select(verify.unsat_csp(F.col("p")).alias("a"), verify.knights_knaves(F.col("p")).alias("b")).first() == (None, None)
