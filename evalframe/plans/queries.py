"""The registered queries over the evaluation star and the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, grading
from ..functions import text as t
from ..operators import accuracy, compare, messages, outcomes, paired, respond, runtime, sampling, telemetry, uncertainty
from ..operators.items import by_item, votes
from ..operators.tidy import Evaluation
from ..problems import build, spec, verify
from ..render import logs, report
from ..sources import star, store
from ..streaming import committed, live, states
from . import fixtures, talks, transcripts

PLACES = 9
#: Long runs are stored in about so many steps.
STEPS = 16
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, since sums of floating point depend on their order; integers as longs."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        out.append(((F.round(c, PLACES) + F.lit(0.0)) if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(f.name))
    return df.select(*out)


def _evaluation(spark: SparkSession, sf_dir: str) -> Evaluation:
    return Evaluation(star.items(spark, sf_dir), star.responses(spark, sf_dir), star.telemetry(spark, sf_dir))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_item(star.responses(spark, sf_dir), star.items(spark, sf_dir))


def _on_frame(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(metric(_frame(spark, sf_dir)))


def _on_votes(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(metric(_evaluation(spark, sf_dir).lazy_frame))


def response_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.responses(spark, sf_dir)
    return rounded(r.select("run_id", "item_id", "sample_idx", "raw", "parsed", "correct", "confidence", "latency_ms", F.col("metadata.parse_source").alias("parse_source")))


def _store(spark: SparkSession, buckets: int = store.BUCKETS) -> store.Store:
    return store.Store(spark, f"{store.shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets)


def store_items_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items through a stored table: all of them, then the hardest again with other golds, of which the later count."""
    s, items = _store(spark), star.items(spark, sf_dir)
    s.upsert("items", items)
    s.upsert("items", items.where("difficulty = 6").withColumn("gold", F.concat("gold", F.lit("!"))))
    return rounded(s.read("items").select("item_id", "family", "difficulty", "probe", "has_distractor", "grp", "gold", F.array_join("choices", "|").alias("choices")))


def store_runs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs stored twice: the later row counts, and a secret among its parameters is not stored."""
    s, runs = _store(spark), star.runs(spark, sf_dir)
    s.upsert("runs", runs.withColumn("model", F.lit("before")))
    s.upsert("runs", runs.withColumn("params", F.create_map(F.lit("api_key"), F.lit("x"), F.lit("tag"), F.col("dataset_tag"))))
    return s.runs().select("run_id", "model", F.col("params")["tag"].alias("tag"), F.col("params")["api_key"].alias("api_key"), F.col("created_at").cast("date").alias("created_on"))


def store_telemetry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored telemetry of one response: the first in the order of the keys as stored."""
    s = _store(spark)
    s.upsert("telemetry", star.telemetry(spark, sf_dir))
    key = s.read("telemetry").agg(F.min(F.struct("run_id", "item_id", "sample_idx")).alias("k")).select("k.*").first()
    found = s.telemetry_of(*key) if key and key.run_id is not None else s.read("telemetry")
    return rounded(found.select("run_id", "item_id", "sample_idx", "reasoning_token_source", "prompt_tokens", "completion_tokens", "reasoning_tokens"))


def done_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.done_items(star.responses(spark, sf_dir))


def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.todo(star.items(spark, sf_dir), star.responses(spark, sf_dir), "r0").select("item_id", "family", "difficulty", "probe"))


def run_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations put to a client that answers by a rule, and stored step by step, 250 turns each or a sixteenth of a long run; then once more, which asks only what failed."""
    s = _store(spark)
    s.upsert("items", talks.items(spark, sf_dir))
    ask = lambda items: respond.run_client(items, "steps", talks.client, sleep=lambda seconds: None)
    for _ in range(2):
        committed.run_in_steps(s, "steps", ask, commit_every=250, steps=STEPS)
    r = s.read("responses")
    return rounded(r.select("item_id", "sample_idx", "raw", "parsed", "correct", "confidence", "prompt_tokens", "completion_tokens", F.col("metadata.parse_source").alias("source"), F.col("metadata.intermediate_correct").alias("intermediate_correct"), F.col("metadata.intermediate_parsed").alias("intermediate_parsed")))


def metrics_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses stored in five waves that replace each other's rows, and metrics that were brought up to date after each: nothing is counted over all responses."""
    s = _store(spark, star.buckets(spark, sf_dir))
    s.upsert("items", star.items(spark, sf_dir))
    kept = states.MetricStates(s)
    for k, wave in enumerate(star.waves(spark, sf_dir)):
        kept.upsert(wave, f"wave-{k}")
        if k == 2:
            kept.fold()
    run = kept.coverage().join(kept.overall().withColumnRenamed("n", "n_base"), "run_id").join(kept.strict(), "run_id")
    return rounded(kept.degradation().join(run, "run_id"))


def difficulty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.by_difficulty(star.items(spark, sf_dir), 5, 6).select("item_id", "family", "difficulty"))


def stride_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.stride(star.items(spark, sf_dir), 700).select("item_id", "family", "difficulty", "probe"))


def majority_vote_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes(star.responses(spark, sf_dir)))


def grading_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.fragility(star.responses(spark, sf_dir), star.items(spark, sf_dir)))


def regrade_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored grades against grading the raw texts anew."""
    said = star.responses(spark, sf_dir).where(F.col("correct").isNotNull()).join(star.items(spark, sf_dir).select("item_id", "answer_type", "gold", "choices"), "item_id")
    g = said.withColumn("g", grading.grade(F.col("raw"), F.col("answer_type"), F.col("gold"), F.col("choices")))
    return rounded(g.select("run_id", "item_id", "sample_idx", F.col("g.parsed").alias("parsed"), F.col("g.source").alias("source"), F.col("g.correct").alias("correct"), F.col("g.confidence").alias("confidence")))


def grade_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.answers(spark, sf_dir)
    args = (F.col("text"), F.col("kind"), F.col("gold"), F.col("choices"))
    g = rows.withColumn("g", grading.grade(*args)).withColumn("s", grading.strictly(F.col("g")))
    return rounded(g.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", F.col("g.parsed").alias("parsed"), F.col("g.source").alias("source"), F.col("g.correct").alias("correct"),
        F.col("g.confidence").alias("confidence"), F.col("s.parsed").alias("strict_parsed"), F.col("s.source").alias("strict_source"),
    ))


def reparse_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.answers(spark, sf_dir)
    args = (F.col("text"), F.col("kind"), F.col("choices"))
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", grading.marker_only(*args).alias("marker"), grading.prose_only(*args).alias("prose")))


def grade_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.graded(spark).select("id", "text", "kind", "gold", "choices")
    args = (F.col("text"), F.col("kind"), F.col("gold"), F.col("choices"))
    g = rows.withColumn("g", grading.grade(*args)).withColumn("s", grading.strictly(F.col("g")))
    return rounded(g.select("id", F.col("g.parsed").alias("parsed"), F.col("g.source").alias("source"), F.col("g.correct").alias("correct"), F.col("s.parsed").alias("strict_parsed"), F.col("s.source").alias("strict_source"), F.col("g.confidence").alias("confidence")))


def fragility_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts that only the lenient reading gives that answer for, by kind."""
    rows = transcripts.answers(spark, sf_dir)
    args = (F.col("text"), F.col("kind"), F.col("choices"))
    both = rows.select("kind", grading.parse(*args).alias("g")).withColumn("s", grading.strictly(F.col("g")))
    hit = (F.col("g.source") == "fallback") & ~F.col("g.parsed").eqNullSafe(F.col("s.parsed"))
    return rounded(both.groupBy("kind").agg(F.avg(hit.cast("double")).alias("fragility"), F.count("*").alias("n")))


def runtime_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runtime.latency(star.responses(spark, sf_dir)))


def runtime_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runtime.tokens(star.responses(spark, sf_dir)))


def reasoning_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runtime.reasoning(star.responses(spark, sf_dir), star.telemetry(spark, sf_dir)))


def reasoning_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runtime.reasoning_rows(star.responses(spark, sf_dir), star.telemetry(spark, sf_dir), star.items(spark, sf_dir))
    return rounded(runtime.reasoning_by_difficulty(rows))


def reasoning_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = star.telemetry(spark, sf_dir)
    rows = runtime.reasoning_rows(star.responses(spark, sf_dir), told, star.items(spark, sf_dir))  # gone over once, so not written
    return rounded(runtime.reasoning_efficiency(rows, told))


def event_value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.ranked_percentiles(star.table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}))


def item_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evaluation(spark, sf_dir).outcomes())


def outcomes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.with_place(_evaluation(spark, sf_dir).outcomes()).select("run_id", "item_id", "outcome", "position"))


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every run's log."""
    lines = logs.log_lines(_evaluation(spark, sf_dir).outcomes(), star.runs(spark, sf_dir))
    return rounded(lines.select("run_id", "part", "line"))


def outcomes_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.by_family(_evaluation(spark, sf_dir).outcomes()))


def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.totals(_evaluation(spark, sf_dir).outcomes()))


def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.runs(spark, sf_dir).orderBy("created_at", "run_id")


def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.run_labels(star.runs(spark, sf_dir))


def run_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.run_families(star.responses(spark, sf_dir), star.items(spark, sf_dir))


def families_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.families_together(run_families(spark, sf_dir))


def run_tag_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.tag_mismatch(star.runs(spark, sf_dir), run_families(spark, sf_dir)))


def run_class_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a run over the dataset of a third of them, with the kinds of its seventh lines as families: classes that should not be compared."""
    lines = star.table(spark, sf_dir, "lineitem")
    run = F.col("l_suppkey").alias("run_id")
    runs = lines.groupBy(run).agg(F.concat(F.lit("v"), (F.first("l_suppkey") % 3).cast("string")).alias("dataset_tag"))
    families = lines.where("l_linenumber = 7").groupBy(run, F.concat_ws("-", "l_returnflag", "l_linestatus", F.year("l_shipdate").cast("string")).alias("family")).agg(F.count("*").alias("n"))
    return rounded(compare.class_mismatch(compare.run_classes(runs, families)))


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keys the events' properties have, of which kinds and how often; and the same of what is cut short, which is malformed."""
    events = star.table(spark, sf_dir, "events")
    cut = events.where("event_type = 'error'").select(F.expr("substring(props, 1, length(props) - 1)").alias("props"))
    return rounded(documents.keys_of(events.select("props").unionByName(cut), "props"))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.leaderboard(_evaluation(spark, sf_dir).headline()))


def metrics_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evaluation(spark, sf_dir).tidy())


def results_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with their item's dimensions, orphans kept, by the join of the export itself."""
    r = star.responses(spark, sf_dir).select("run_id", "item_id", "sample_idx", "raw", "parsed", "correct", "confidence")
    return rounded(report.with_dimensions(r, star.items(spark, sf_dir)))


def results_export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what an export says about the run."""
    return results_export_rows(spark, sf_dir).join(star.runs(spark, sf_dir), "run_id", "left")


def token_entropy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transcripts.token_streams(spark, sf_dir).select("vec_id", telemetry.token_entropy(F.col("content")).alias("e")).select("vec_id", "e.*"))


def stream_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = transcripts.event_streams(spark, sf_dir).select("doc_id", telemetry.stream_summary(F.col("events")).alias("s")).select("doc_id", "s.*")
    return rounded(folded.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256"))


def event_rows_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams as rows, each message's dealt over sixteen files and some twice, read as a stream a few files at a time."""
    folder = f"{store.shared_folder(spark)}/events-{uuid.uuid4().hex}"
    rows = transcripts.event_streams(spark, sf_dir).select("doc_id", F.posexplode("events").alias("seq", "e")).select("doc_id", "seq", "e.*")
    twice = rows.unionByName(rows.where("seq = 1 or type = 'message_delta'"))
    twice.repartition(16, F.xxhash64("doc_id", "seq")).write.parquet(folder)
    got = live.folds_so_far(spark, folder, ["doc_id"], files=4)
    return rounded(got.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256"))


def telemetry_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.latest_lines(spark, sf_dir)
    think = F.when(F.col("l_linenumber") % 2 == 1, (F.col("l_partkey") % 60).cast("int"))
    calls = lines.select(
        "run_id", "item_id", "sample_idx", F.array(F.lit("chat")).alias("capabilities"), (F.col("l_partkey") % 500).cast("int").alias("prompt_tokens"), (F.col("l_suppkey") % 90).cast("int").alias("completion_tokens"),
        think.alias("thinking_tokens"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax") + 0.001).alias("ttft"), F.when(F.col("l_suppkey") % 3 == 1, F.col("l_tax") + 0.002).alias("first_reasoning"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")).alias("answer_wall"),
        F.when(F.col("l_linenumber") == 1, F.struct(F.lit(1.5).alias("token_entropy_mean"), F.lit(2.0).alias("token_entropy_max"), F.lit(1).alias("friction_transitions"), F.lit(3).alias("logprob_divergence_spikes"), F.lit(9).alias("n_tokens_scored"))).alias("entropy"),
    )
    built = telemetry.build(calls)
    why = F.array_join(F.array_sort(F.transform(F.map_entries("unobservable_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return rounded(built.withColumn("unobservable", why).drop("unobservable_fields", "capabilities"))


def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an item: odd ones as several turns, a line each; the others as one prompt with choices. A null text leaves the instructions alone."""
    docs = star.table(spark, sf_dir, "documents")
    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    how = messages.instructions(F.when(odd, "int").otherwise("choice"), F.when(~odd, F.array(F.lit("yes"), F.lit("no"))), ask_confidence=True)
    m = docs.select("doc_id", messages.build(F.col("text"), F.when(odd, F.split("text", "\n")), how).alias("m"))
    return rounded(m.select("doc_id", F.size("m").alias("n_messages"), F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("|"), x["content"])), "\n"), 256).alias("messages_sha256")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an item of several turns, a line each, and how to answer it."""
    how = messages.instructions(F.lit("int"), F.lit(None).cast("array<string>"))
    return star.table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("turns"), how.alias("how"))


def _spoken(chat: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.transform(chat, lambda x: F.concat(x["role"], F.lit("|"), x["content"])), "\n"), 256)


def messages_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system text apart from the others."""
    told = _turns(spark, sf_dir).select("doc_id", messages.by_role(messages.build(F.lit(None).cast("string"), F.col("turns"), F.col("how"))).alias("m"))
    return rounded(told.select("doc_id", "m.system", F.size("m.chat").alias("n_chat"), _spoken(F.col("m.chat")).alias("chat_sha256")))


def messages_next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent for the last turn, after real replies to all before: here, as many characters as were asked."""
    replies = F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda x: F.length(x).cast("string"))
    sent = _turns(spark, sf_dir).select("doc_id", messages.next_turn(F.col("turns"), replies, F.col("how")).alias("m"))
    return rounded(sent.select("doc_id", F.size("m").alias("n_messages"), _spoken(F.col("m")).alias("messages_sha256")))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = star.table(spark, sf_dir, "documents").select("doc_id", t.sentences(F.col("text")).alias("s"))
    longest = F.array_max(F.transform("s", lambda x: F.length(x)))
    return rounded(split.select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n_sentences"), longest.alias("longest"), F.sha2(F.array_join("s", "\n--\n"), 256).alias("sentences_sha256")))


def seed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("item|"), F.col("o_orderkey").cast("string"))
    return star.table(spark, sf_dir, "orders").select("o_orderkey", t.seed32(key).alias("seed"), t.short_id(F.lit("item"), F.col("o_orderkey").cast("string")).alias("short_id"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "part").select("p_partkey", t.slug(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug"))


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "part").select("p_partkey", t.ordinal(F.col("p_partkey")).alias("ordinal"), t.duration(F.col("p_partkey") * 7).alias("duration"))


def provider_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "pages").select("page_id", t.provider_of(F.col("url")).alias("provider"))


def provider_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(fixtures.ENDPOINTS, "url string, provider string").select("url", t.provider_of(F.col("url")).alias("provider"))


def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the number in their JSON metadata; malformed ones count as without."""
    k = F.from_json("props", "k long")["k"]
    return rounded(star.table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("value")))


def stream_event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream: number and mean value by hour and type."""
    return rounded(live.rates_so_far(spark, f"{sf_dir}/events.parquet", "ts", ["event_type"], "value"))


def stream_rates_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events dealt over twelve files without regard to time, two a batch: every batch has rows of windows that earlier ones began."""
    folder = f"{store.shared_folder(spark)}/events-{uuid.uuid4().hex}"
    star.table(spark, sf_dir, "events").repartition(12, F.xxhash64("event_id")).write.parquet(folder)
    return rounded(live.rates_so_far(spark, folder, "ts", ["event_type"], "value", files=2))


POOL = 20


def _problems(spark: SparkSession) -> DataFrame:
    return build.make(spec.specifications(spark, None, 1, 6, POOL, distractor=True, surface=2))


def gen_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole pool of problems of every family."""
    return rounded(_problems(spark).select("item_id", "family", "difficulty", "probe", "grp", "answer_type", "gold", "prompt"))


def gen_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells the items of the pool apart: identifiers, seeds, groups and probes."""
    return rounded(_problems(spark).select("item_id", "family", "difficulty", "structure_seed", "surface_seed", "has_distractor", "probe", "grp", "answer_type"))


def gen_spec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spec.specifications(spark, None, 1, 6, POOL, distractor=True, surface=2).groupBy("family", "probe").agg(F.count("*").alias("n"), F.max("difficulty").alias("hardest")))


def gen_support_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spec.support_matrix(spark))


def verify_of(family: str) -> Query:
    """How many golds of one family follow from their prompts: all of them."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        specs = spec.specifications(spark, [family], 1, 6, POOL, distractor=True, surface=2)
        checked = verify.derive(build.make(specs, [family]), family)
        return rounded(checked.groupBy("family", "difficulty").agg(F.count("*").alias("n"), F.count(F.when(F.col("verified"), 1)).alias("verified")))

    return run


def mock_run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's accuracy over the pool, by family and probe."""
    items = _problems(spark)
    r = respond.run_mock(items, "mock", "noisy", 3)
    both = r.join(items.select("item_id", "family", "probe"), "item_id")
    return rounded(both.groupBy("family", "probe").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "degradation_wilson": _on_frame(accuracy.degradation), "overall_accuracy": _on_frame(accuracy.overall), "degradation_error_bars": _on_frame(lambda f: accuracy.error_bars(accuracy.degradation(f))), "accuracy_by_family": _on_frame(accuracy.by_family),
        "accuracy_grouping_sets": _on_frame(accuracy.with_totals), "coverage": _on_frame(accuracy.coverage), "chance_baseline": _on_frame(accuracy.chance),
        "macro_above_chance": _on_frame(accuracy.macro_above_chance), "strict_accuracy": _on_frame(accuracy.strict), "ill_posed_rates": _on_frame(accuracy.ill_posed),
        "backtracking": _on_frame(accuracy.backtracking), "distractibility": _on_frame(paired.distractibility), "surface_groups": _on_frame(paired.surface_groups),
        "surface_invariance_overall": _on_frame(paired.invariance), "surface_invariance_by_family": _on_frame(lambda f: paired.invariance(f, "family")),
        "calibration_bins": _on_frame(uncertainty.calibration_bins), "calibration_ece": _on_frame(uncertainty.calibration_error),
        "pass_at_k": _on_votes(uncertainty.pass_at_k), "disagreement_entropy": _on_votes(uncertainty.disagreement), "behavioral_uncertainty": _on_votes(uncertainty.behaviour),
    }
    for f in (
        response_upsert_latest, done_items, resume_todo, difficulty_filter, stride_limit, majority_vote_items, grading_fragility, regrade_responses, grade_transcripts, reparse_transcripts, grade_fixture,
        fragility_examples, runtime_latency, runtime_tokens, reasoning_tokens, reasoning_by_difficulty, reasoning_efficiency, event_value_percentiles, item_outcomes, outcomes_by_family, outcome_totals, run_list,
        run_labels, run_families, run_tag_mismatch, leaderboard, metrics_tidy, results_export_rows, results_export_all, token_entropy_stats, stream_event_fold, telemetry_builder, build_messages, seed_hash, slugify, ordinals,
        provider_from_url, provider_fixture, json_metadata, stream_event_rates, gen_dataset, gen_spec_counts, gen_support_matrix, mock_run_profile, store_items_latest, store_runs_latest, store_telemetry_lookup,
        stream_rates_many_files, run_log_lines, run_in_steps, metrics_kept, event_rows_fold, run_class_mismatch, json_keys, outcomes_in_order, families_together, messages_by_role, messages_next_turn, sentences, gen_identifiers,
    ):
        out[f.__name__] = f
    return out | {f"verify_{f.name}": verify_of(f.name) for f in spec.FAMILIES}
