"""Command line: generate, run, report, dashboard, compare, list, families, and the registry of models."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import accuracy, compare, paired, respond, sampling
from .operators.tidy import Evaluation
from .problems import build, spec
from .render import report, text
from .sources import registry
from .sources.store import Store
from .streaming import committed


def _session() -> SparkSession:
    return SparkSession.builder.appName("evalframe").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalframe")
    p.add_argument("--store", default="evalframe-store", help="folder of the stored tables")
    p.add_argument("--registry", default=None, help="file of models and endpoints")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="make and verify problems")
    g.add_argument("--preset", choices=sorted(spec.PRESETS), default="quick")
    g.add_argument("--families", nargs="*")
    g.add_argument("--band", choices=list(spec.BANDS), default="all", help="difficulties to make, of those of the preset")
    r = sub.add_parser("run", help="put stored problems to the stand-in model")
    r.add_argument("run_id")
    r.add_argument("--mode", choices=respond.MODES, default="noisy")
    r.add_argument("--samples", type=int, default=1)
    r.add_argument("--min-difficulty", type=int)
    r.add_argument("--max-difficulty", type=int)
    r.add_argument("--band", choices=list(spec.BANDS), default="all", help="difficulties to run; bounds given besides win")
    r.add_argument("--limit", type=int)
    r.add_argument("--commit-every", type=int, default=1000, help="items that are stored together; what is lost at most if the run breaks off")
    for name in ("report", "dashboard", "compare"):
        c = sub.add_parser(name)
        c.add_argument("runs", nargs="*")
        c.add_argument("--out", default="evalframe-report")
    for name in ("add-model", "edit-model", "remove-model"):
        m = sub.add_parser(name, help="change the registry of models")
        m.add_argument("alias")
        if name != "remove-model":
            for option in ("--base-url", "--model", "--api-key", "--api-key-env"):
                m.add_argument(option, required=name == "add-model" and option in ("--base-url", "--model"))
            m.add_argument("--context-window", type=int)
            m.add_argument("--max-tokens", type=int)
    sub.add_parser("models", help="registered models")
    sub.add_parser("providers", help="registered endpoints")
    sub.add_parser("list", help="stored runs")
    sub.add_parser("families", help="families and their probes")
    return p


def _change_registry(a: argparse.Namespace) -> int:
    """Commands that need no Spark; keys are never shown."""
    path = a.registry or os.environ.get(registry.PATH_VARIABLE, "providers.json")
    known = registry.load(path)
    limits = {k: getattr(a, k, None) for k in ("context_window", "max_tokens")}
    if a.command == "models":
        for alias, m in sorted(known.models.items()):
            print(f"{alias:<20}{m['model']:<30}{m['provider']}")
    elif a.command == "providers":
        for name, p in sorted(known.providers.items()):
            print(f"{name:<20}{p['base_url']:<50}{p.get('api_key_env') or ('stored key' if p.get('api_key') else 'no key')}")
    elif a.command != "add-model" and a.alias not in known.models:
        print(f"unknown model: {a.alias}", file=sys.stderr)
        return 1
    else:
        if a.command == "remove-model":
            registry.remove(known, a.alias)
        elif a.command == "edit-model":
            registry.edit(known, a.alias, a.base_url, a.model, a.api_key, a.api_key_env, **limits)
        else:
            registry.register(known, a.alias, a.base_url, a.model, a.api_key, a.api_key_env, **limits)
        registry.save(known, path)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command in ("models", "providers") or a.command.endswith("-model"):
        return _change_registry(a)
    spark = _session()
    store = Store(spark, a.store)
    if a.command == "families":
        for f in spec.FAMILIES:
            print(f"{f.name:<22}{f.answer_type:<18}{f.axis}")
    elif a.command == "list":
        for r in store.runs().collect():
            print(f"{r.run_id} {text.shorten(r.model, 40)} {text.moment(r.created_at)}")
    elif a.command == "generate":
        reps, least, most, distractor, surface = spec.PRESETS[a.preset]
        low, high = spec.BANDS[a.band]
        least, most = max(least, low or least), min(most, high or most)
        store.upsert("items", build.build(spark, a.families or None, least, most, reps, distractor, surface))
        print(store.read("items").count(), "items")
    elif a.command == "run":
        run_id, mode, n = a.run_id, a.mode, a.samples
        low, high = spec.BANDS[a.band]
        low, high = a.min_difficulty or low, a.max_difficulty or high
        store.upsert("runs", spark.createDataFrame([(run_id, f"mock-{mode}", "")], "run_id string, model string, base_url string"))

        def chosen(items):  # noqa: ANN001, ANN202
            within = sampling.by_difficulty(items, low, high)
            return sampling.stride(within, a.limit) if a.limit is not None else within

        committed.run_in_steps(store, run_id, lambda items: respond.run_mock(items, run_id, mode, n), a.commit_every, chosen=chosen, watch=lambda p: print(text.progress(p), file=sys.stderr))
    else:
        keep = F.col("run_id").isin(a.runs) if a.runs else F.lit(True)
        e = Evaluation(store.read("items"), store.read("responses").where(keep), store.read("telemetry").where(keep))
        runs = store.read("runs").where(keep).withColumn("dataset_tag", F.coalesce(F.col("params")["dataset_tag"], F.lit("")))
        for r in compare.tag_mismatch(runs, compare.run_families(e.responses, e.items)).collect():
            print(f"warning: {r.run_1} and {r.run_2} were run on different datasets ({r.tag_1!r}, {r.tag_2!r})", file=sys.stderr)
        if a.command == "report":
            print(*report.build(e, runs, a.out), sep="\n")
            report.export_results(e, store.read("runs").where(keep).select("run_id", "model", "params", "created_at"), a.out)
        elif a.command == "compare":
            labels = {r.run_id: r.label for r in compare.run_labels(runs).collect()}
            print(*text.comparison(report.rows_of(compare.leaderboard(e.headline())), labels), sep="\n")
        else:
            families, curve, drops = (report.rows_of(x(e.frame)) for x in (accuracy.chance, accuracy.degradation, paired.distractibility))
            for run in report.rows_of(e.profile()):
                own = lambda rows, key=run["run_id"]: [x for x in rows if x["run_id"] == key]
                print(*text.dashboard(run, own(families), own(curve), colour=sys.stdout.isatty(), drops=own(drops)), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
