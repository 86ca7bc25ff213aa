"""Metrics on hand-made responses."""

from __future__ import annotations

import numpy as np
import pytest

from evalframe.operators import accuracy, compare, outcomes, paired, runtime, sampling, uncertainty
from evalframe.operators.tidy import Evaluation
from evalframe.sources.schema import ERROR, ITEMS, RESPONSES, TELEMETRY


def item(item_id, family="ordering", difficulty=1, probe="base", grp="g", gold="7", kind="int", choices=None):
    return (item_id, family, difficulty, 0, 0, probe == "distractor", probe, grp, kind, gold, choices, "p", None, None)


def response(item_id, correct, parsed=None, sample=0, raw=None, confidence=None, run="r", latency=0, prompt=None, completion=None, source="marker", intermediate=None):
    raw = raw if raw is not None else ERROR if correct is None else f"ANSWER: {parsed}"
    return (run, item_id, sample, raw, parsed, correct, confidence, latency, prompt, completion, (source, intermediate, None))


@pytest.fixture
def evaluate(spark):
    def make(items, responses, telemetry=None):
        return Evaluation(spark.createDataFrame(items, ITEMS), spark.createDataFrame(responses, RESPONSES), None if telemetry is None else spark.createDataFrame(telemetry, TELEMETRY))

    return make


def test_majority_overrides_the_first_sample(evaluate):
    e = evaluate([item("a")], [response("a", False, "8"), response("a", True, "7", 1), response("a", True, "7", 2)])
    r = uncertainty.pass_at_k(e.frame, e.votes).first()
    assert (r.pass_at_1, r.maj_at_k, r.pass_at_k_oracle, r.k) == (0, 1, 1, 3)


def test_a_tie_of_votes_goes_to_the_earliest(evaluate):
    e = evaluate([item("a")], [response("a", True, "7"), response("a", False, "8", 1), response("a", False, "8", 3), response("a", True, "7", 2)])
    assert e.votes.first().winner == "7"


def test_all_failed(evaluate):
    e = evaluate([item("a"), item("b")], [response("a", None), response("b", None)])
    cover, score = accuracy.coverage(e.frame).first(), accuracy.overall(e.frame).first()
    assert (cover.answered, cover.errored, cover.coverage, score.accuracy, score.n) == (0, 2, 0, 0, 0)
    assert accuracy.strict(e.frame).first().fallback_reliance is None
    assert uncertainty.calibration_error(e.frame).count() == 0
    assert e.profile().first().ece is None


def test_fallback_makes_it_right(evaluate):
    e = evaluate([item("a", gold="13")], [response("a", True, "13", raw="the total comes to 13.")])
    r = accuracy.strict(e.frame).first()
    assert (r.strict_accuracy, r.fallback_reliance) == (0, 1)


@pytest.mark.parametrize(("raw", "want"), [("ANSWER: 5\nActually the answer is 7.", 1), ("ANSWER: 7", 0)])
def test_fragility(evaluate, raw, want):
    e = evaluate([item("a")], [response("a", True, "7", raw=raw)])
    assert accuracy.fragility(e.responses, e.items).first().fragility == want


def test_entropy(evaluate):
    e = evaluate([item("a"), item("b")], [response("a", True, "7"), response("a", False, "8", 1), response("a", False, "9", 2), *[response("b", True, "7", k) for k in range(3)]])
    got = {r.item_id: r.entropy for r in e.votes.collect()}
    assert got["a"] == pytest.approx(1.584962500721156) and got["b"] == 0
    assert uncertainty.disagreement(e.frame, e.votes).first().disagreement_entropy == pytest.approx(1.584962500721156 / 2)


def test_calibration_bins(evaluate):
    e = evaluate([item(x) for x in "abcd"], [response("a", True, "7", confidence=90), response("b", False, "1", confidence=50), response("c", True, "7", confidence=100), response("d", True, "7", confidence=55)])
    bins = {r.bin: (r.n, r.mean_confidence, r.accuracy) for r in uncertainty.calibration_bins(e.frame).collect()}
    assert bins == {"90-100": (2, 0.95, 1.0), "50-59": (2, 0.525, 0.5)}
    assert uncertainty.calibration_error(e.frame).first().ece == pytest.approx(0.5 * 0.05 + 0.5 * 0.025)


def test_chance(evaluate):
    golds = ["a", "a", "b"]
    e = evaluate([item(str(i), gold=g, kind="choice") for i, g in enumerate(golds)] + [item("x", family="arithmetic")], [*[response(str(i), True, g) for i, g in enumerate(golds)], response("x", True, "7")])
    got = {r.family: (r.chance, r.above_chance) for r in accuracy.chance(e.frame).collect()}
    assert got["ordering"] == (pytest.approx(2 / 3), 1) and got["arithmetic"] == (0, 1)


def test_pairs_need_both_answers(evaluate):
    items = [item("a"), item("b", probe="distractor"), item("c", grp="h"), item("d", probe="distractor", grp="h")]
    e = evaluate(items, [response("a", True, "7"), response("b", False, "8"), response("c", True, "7"), response("d", None)])
    r = paired.distractibility(e.frame).first()
    assert (r.n, r.base_accuracy, r.distractor_accuracy, r.hurt, r.helped, r.drop) == (1, 1, 0, 1, 0, 1)


def test_a_missing_variant_answer_is_a_flip(evaluate):
    items = [item("a"), item("b", probe="surface"), item("c", probe="surface"), item("d", grp="h"), item("e", probe="surface", grp="h"), item("f", grp="i"), item("g", probe="surface", grp="i")]
    rows = [response("a", True, "7"), response("b", True, "7"), response("c", None), response("d", True, "7"), response("e", True, "7"), response("f", False, None, raw="?"), response("g", True, "7")]
    r = paired.invariance(evaluate(items, rows).frame).first()
    assert (r.groups, r.answer_flip_rate, r.consistent_rate, r.surface_accuracy) == (2, 0.5, 0.5, 1)


def test_ill_posed(evaluate):
    items = [item("a", gold="UNDETERMINED", kind="choice"), item("b", gold="NO_SOLUTION", kind="choice"), item("c"), item("d")]
    r = accuracy.ill_posed(evaluate(items, [response("a", False, "knight"), response("b", None), response("c", False, "UNDETERMINED"), response("d", True, "7")]).frame).first()
    assert (r.confabulation_rate, r.false_undetermined_rate) == (0.5, 0.5)


def test_backtracking(evaluate):
    items = [item(x, family="dynamic_pivot") for x in "abc"]
    rows = [response("a", True, "7", intermediate=True), response("b", False, "8", intermediate=True), response("c", True, "7", intermediate=False)]
    r = accuracy.backtracking(evaluate(items, rows).frame).first()
    assert (r.n, r.intermediate_accuracy, r.final_accuracy, r.revision_success) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5)


def test_runtime(evaluate, spark):
    rows = [response(x, c, "7" if c else None, latency=lat, prompt=p, completion=k) for x, c, lat, p, k in (("a", True, 100, 10, 20), ("b", True, 200, 30, 40), ("c", False, 300, 50, 60), ("d", None, 0, None, None))]
    e = evaluate([item(x) for x in "abcd"], rows)
    lat, tok = runtime.latency(e.responses).first(), runtime.tokens(e.responses).first()
    assert (lat.n_calls, lat.errored, lat.latency_p50_ms, lat.latency_p95_ms) == (4, 1, 150, 285)
    assert (tok.prompt_tokens_total, tok.completion_tokens_total, tok.completion_tokens_mean, tok.tokens_available) == (90, 120, 40, True)


def telemetry(item_id, tokens, source="native_usage"):
    return ("r", item_id, 0, [], source, None, None, tokens, *[None] * 9, {})


def test_reasoning(evaluate):
    items = [item("a", difficulty=1), item("b", difficulty=1), item("c", difficulty=3), item("d", difficulty=3)]
    rows = [response(x, c, "7", completion=100) for x, c in (("a", True), ("b", True), ("c", True), ("d", False))]
    e = evaluate(items, rows, [telemetry("a", 30), telemetry("b", 30), telemetry("c", 50), telemetry("d", 50)])
    tiers = {r.difficulty: (r.mean_reasoning_tokens, r.accuracy, r.n) for r in runtime.reasoning_by_difficulty(e.reasoning_rows).collect()}
    assert tiers == {1: (30, 1, 2), 3: (50, 0.5, 2)}
    eff, tok = runtime.reasoning_efficiency(e.reasoning_rows, e.telemetry).first(), runtime.reasoning(e.responses, e.telemetry).first()
    assert (eff.correct_per_1k, eff.effort_scaling, tok.reasoning_fraction) == (18.75, 0.6, 0.4)
    none = evaluate(items, rows, [telemetry("a", 0, "unavailable")])
    r = runtime.reasoning(none.responses, none.telemetry).first()
    assert (r.reasoning_available, r.reasoning_tokens_total, r.reasoning_fraction) == (False, 0, None)


def test_outcomes(evaluate):
    items = [item(x) for x in "abcdef"]
    rows = [
        response("a", True, "7"), response("b", True, "7", source="fallback"), response("c", False, "5"), response("d", False, None, source="none", raw="?"), response("e", True, "7"), response("e", True, "7", 1), response("e", False, "8", 2),
        response("f", None), response("f", True, "7", 1), response("z", True, "7"),
    ]
    got = {r.item_id: (r.outcome, r.reason) for r in evaluate(items, rows).outcomes().collect()}
    assert got["a"] == ("solved", "correct") and got["b"][0] == "solved" and "fallback" in got["b"][1]
    assert got["c"] == ("wrong", "wrong answer (got '5', expected '7')") and got["d"][1].startswith("no parseable answer")
    assert got["e"] == ("solved", "correct by majority (2/3 samples agreed)") and got["f"][0] == "errored" and got["z"][0] == "solved"


def test_the_lower_error_has_the_longer_bar(spark):
    columns = "run_id string, overall_accuracy double, strict_accuracy double, coverage double, ece double, answer_flip_rate double, confabulation_rate double, maj_at_k double"
    board = compare.leaderboard(spark.createDataFrame([("a", 0.5, 0.5, 1.0, 0.05, None, None, None), ("b", 0.5, 0.5, 1.0, 0.4, None, None, None)], columns))
    ece = {r.run_id: r.scaled for r in board.where("metric = 'calibration ECE'").collect()}
    assert ece["a"] == 1 and ece["b"] == pytest.approx(0.6 / 0.95)
    assert board.where("metric = 'maj@k'").count() == 0


def test_tags(spark):
    runs = spark.createDataFrame([("a", "v1", "m"), ("b", "v2", "m"), ("c", "v2", "n")], "run_id string, dataset_tag string, model string")
    families = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y")], "run_id string, family string")
    assert [tuple(r) for r in compare.tag_mismatch(runs, families).collect()] == [("a", "b", "v1", "v2", 1)]
    assert {r.run_id: r.label for r in compare.run_labels(runs).collect()} == {"a": "a", "b": "b", "c": "n"}


@pytest.mark.parametrize("limit", [0, 1, 6, 7, 23, 24, 30])
def test_stride(spark, limit):
    rows = [(f"{i:02d}", i // 4 + 1) for i in range(24)]
    df = spark.createDataFrame(rows, "item_id string, difficulty int")
    got = sorted(r.item_id for r in sampling.stride(df, limit, ["item_id"]).collect())
    assert got == ([rows[int(i * 24 / limit)][0] for i in range(limit)] if limit < 24 else [r[0] for r in rows])
    assert sampling.by_difficulty(df, 5, 6).count() == 8


def test_empty_tables(evaluate):
    e = evaluate([], [], [])
    assert e.profile().count() == 0 and e.tidy().count() == 0 and e.outcomes().count() == 0


def test_an_item_with_most_of_the_rows(evaluate):
    rows = [response("a", k % 3 == 0, str(k % 5), k) for k in range(3000)] + [response("b", True, "7")]
    e = evaluate([item("a"), item("b")], rows)
    r = {x.item_id: x for x in e.votes.collect()}["a"]
    assert (r.winner, r.n_votes, r.n_options) == ("0", 3000, 5)


def test_percentiles_where_few_values_have_most_rows(spark):
    rows = [("a", 5.0)] * 900 + [("a", float(x)) for x in range(50)] + [("b", 1.0)] * 3 + [("b", None), ("c", float("nan")), (None, 4.0)]
    got = {r.k: (r.n, r.p10, r.p50, r.p99) for r in sampling.ranked_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    own = [v for k, v in rows if k == "a"]
    assert got == {"a": (950, *map(pytest.approx, np.percentile(own, [10, 50, 99]))), "b": (3, 1.0, 1.0, 1.0), None: (1, 4.0, 4.0, 4.0)}


def test_families_together_and_error_bars(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "run_id string, family string")
    assert {tuple(r) for r in compare.families_together(rows).collect()} == {("x", 2, True), ("y", 1, False)}
    assert not compare.families_together(rows.limit(0)).collect()
    curve = spark.createDataFrame([("a", "x", 1, 0.5, 0.25, 0.75), ("a", "x", 2, 1.0, 1.0 + 1e-12, 1.0)], "run_id string, family string, difficulty int, mean double, lo double, hi double")
    assert [(r.below, r.above) for r in accuracy.error_bars(curve).orderBy("difficulty").collect()] == [(0.25, 0.25), (0.0, 0.0)]


def test_place_of_unknown_items(spark):
    rows = spark.createDataFrame([("a", "i2", "x", 1), ("a", "i1", None, None), ("a", "i3", "x", None), ("b", "i0", "x", 1)], "run_id string, item_id string, family string, difficulty int")
    assert [r.item_id for r in outcomes.with_place(rows).orderBy("position").collect()] == ["i1", "i3", "i2", "i0"]
