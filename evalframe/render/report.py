"""Report files: what is one row per run or family is rendered on the driver; what is one row per item Spark writes itself."""

from __future__ import annotations

import html
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy, compare, outcomes, paired, uncertainty
from ..operators.tidy import Evaluation
from . import logs, text

CELLS = (
    ("accuracy", "overall_accuracy"), ("strict", "strict_accuracy"), ("fallback", "fallback_reliance"), ("coverage", "coverage"), ("flip rate", "answer_flip_rate"), ("ECE", "ece"), ("pass@1", "pass_at_1"),
    ("maj@k", "maj_at_k"), ("oracle", "pass_at_k_oracle"), ("confabulation", "confabulation_rate"), ("above chance", "above_chance"),
)


def table(headers: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A Markdown table."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


def rows_of(df: DataFrame) -> list[dict]:
    """Rows of an aggregate by run, family or difficulty: a few hundred at most."""
    return [r.asDict(recursive=True) for r in df.collect()]


def write_tables(e: Evaluation, folder: str) -> None:
    """The tidy metrics and every item's outcome as CSV, written by Spark."""
    e.tidy().coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/metrics")
    items = outcomes.in_order(e.outcomes()).select("run_id", "item_id", "family", "difficulty", "probe", "gold", "outcome", "reason")
    items.write.mode("overwrite").option("header", True).csv(f"{folder}/items")


def with_dimensions(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Every response with its item's dimensions; one whose item does not exist stays, with ``(unknown)`` as its family."""
    dims = items.select("item_id", "family", "difficulty", "probe", "gold")
    return responses.join(dims, "item_id", "left").withColumn("family", F.coalesce("family", F.lit("(unknown)")))


def export_results(e: Evaluation, runs: DataFrame, folder: str) -> None:
    """Every response with its item's dimensions and its run, as JSON lines, written by Spark; parameters carry no secrets in the store."""
    joined = with_dimensions(e.responses, e.items).join(runs, "run_id", "left")
    joined.write.mode("overwrite").partitionBy("run_id").json(f"{folder}/results")


def markdown(e: Evaluation, labels: dict[str, str]) -> str:
    """The cross-run report."""
    runs = sorted(rows_of(e.profile()), key=lambda r: r["run_id"])
    name = lambda r: labels.get(r["run_id"], r["run_id"])
    overview = table(["run", *[h for h, _ in CELLS]], [[name(r), *[text.number(r[c]) for _, c in CELLS]] for r in runs])
    rated = rows_of(accuracy.chance(e.frame))
    families = sorted({r["family"] for r in rated})
    of = {(r["run_id"], r["family"]): r for r in rated}
    cell = lambda r, f, key: text.number(of[r["run_id"], f][key]) if (r["run_id"], f) in of else "—"
    by_family = table(["family", *map(name, runs)], [[f, *[cell(r, f, "accuracy") for r in runs]] for f in families])
    chance = table(["family", *map(name, runs)], [[f, *[cell(r, f, "above_chance") for r in runs]] for f in families])
    pairs = sorted(rows_of(paired.distractibility(e.frame)), key=lambda r: (r["run_id"], r["family"]))
    drops = table(["run", "family", "n", "base", "distractor", "drop", "hurt", "helped"], [[name(r), r["family"], r["n"], *[text.number(r[c]) for c in ("base_accuracy", "distractor_accuracy", "drop")], r["hurt"], r["helped"]] for r in pairs])
    return "\n\n".join(["# Evaluation report", overview, "## Accuracy by family", by_family, "## Accuracy above chance", chance, "## Distractors", drops]) + "\n"


def run_markdown(run: dict, totals: dict, families: Sequence[dict], label: str) -> str:
    """The report of one run."""
    head = f"# {label}\n\n{totals['solved']} solved, {totals['wrong']} wrong, {totals['errored']} errored of {totals['total']} items; accuracy {text.number(totals['accuracy'])}."
    rows = [[f["family"], f["solved"], f["wrong"], f["errored"], f["total"], text.number(f["accuracy"])] for f in sorted(families, key=lambda f: f["family"])]
    thinking = text.reasoning(run)
    return "\n\n".join([head, *([f"Reasoning tokens: {thinking}."] if thinking else []), table(["family", "solved", "wrong", "errored", "total", "accuracy"], rows)]) + "\n"


def run_html(run: dict, totals: dict, families: Sequence[dict], label: str) -> str:
    """The same as a page; everything that comes from data is escaped."""
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    rows = "".join("<tr>" + "".join(map(cell, (f["family"], f["solved"], f["wrong"], f["errored"], f["total"], text.number(f["accuracy"])))) + "</tr>" for f in sorted(families, key=lambda f: f["family"]))
    cards = "".join(f"<div class=card><b>{html.escape(h)}</b><span>{text.number(run.get(c))}</span></div>" for h, c in CELLS)
    style = "body{font:15px sans-serif;margin:2em}.card{display:inline-block;border:1px solid #ccc;padding:.6em 1em;margin:.3em}.card span{display:block}td,th{padding:.2em .8em;text-align:left}"
    counts = ", ".join(f"{totals[o]} {o}" for o in outcomes.OUTCOMES)
    head = "".join(f"<th>{h}</th>" for h in ("family", *outcomes.OUTCOMES, "total", "accuracy"))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(label)}</title><style>{style}</style><h1>{html.escape(label)}</h1><p>{counts}</p>{cards}<table><tr>{head}</tr>{rows}</table>\n"


def run_log(run: dict, totals: dict, params: dict[str, str], label: str) -> str:
    shown = ", ".join(f"{k}={v}" for k, v in sorted(params.items()) if k not in ("api_key", "authorization"))
    return "\n".join([f"run {label} ({run['run_id']})", f"parameters: {shown}", *(f"{o}: {totals[o]}" for o in outcomes.OUTCOMES), f"accuracy: {text.number(totals['accuracy'])}"]) + "\n"


def charts(e: Evaluation, labels: dict[str, str], folder: str) -> list[str]:
    """Five charts as PNG files; none if matplotlib is not installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt
    except ImportError:
        return []
    Path(folder).mkdir(parents=True, exist_ok=True)
    name = lambda r: labels.get(r["run_id"], r["run_id"])
    made: list[str] = []

    def save(figure: object, file: str) -> None:
        figure.savefig(f"{folder}/{file}.png", bbox_inches="tight")  # type: ignore[attr-defined]
        plt.close(figure)
        made.append(f"{folder}/{file}.png")

    curve = rows_of(accuracy.error_bars(accuracy.degradation(e.frame)))
    figure, axes = plt.subplots(figsize=(9, 5))
    for key in sorted({(c["run_id"], c["family"]) for c in curve}):
        own = sorted((c for c in curve if (c["run_id"], c["family"]) == key), key=lambda c: c["difficulty"])
        bars = [[c[side] for c in own] for side in ("below", "above")]
        axes.errorbar([c["difficulty"] for c in own], [c["mean"] for c in own], yerr=bars, label=f"{name(own[0])} {key[1]}", capsize=2)
    axes.set(xlabel="difficulty", ylabel="accuracy", ylim=(0, 1))
    axes.legend(fontsize=6)
    save(figure, "degradation")

    def grouped(rows: list[dict], key: str, value: str, file: str) -> None:
        figure, axes = plt.subplots(figsize=(9, 4))
        groups, runs = sorted({r[key] for r in rows}), sorted({r["run_id"] for r in rows})
        for k, run in enumerate(runs):
            own = {r[key]: r[value] or 0 for r in rows if r["run_id"] == run}
            axes.bar([g + k / (len(runs) + 1) for g in range(len(groups))], [own.get(g, 0) for g in groups], 1 / (len(runs) + 1), label=labels.get(run, run))
        axes.set_xticks(range(len(groups)), groups, rotation=45, ha="right")
        axes.set_ylabel(value)
        axes.legend()
        save(figure, file)

    grouped(rows_of(paired.distractibility(e.frame)), "family", "drop", "distractibility")
    grouped(rows_of(accuracy.chance(e.frame)), "family", "above_chance", "above_chance")
    profile = rows_of(e.profile())
    figure, axes = plt.subplots()
    for r in profile:
        if r["ece"] is not None and r["confabulation_rate"] is not None:
            axes.scatter(r["ece"], r["confabulation_rate"], label=name(r))
    axes.set(xlabel="calibration error", ylabel="confabulation rate")
    save(figure, "confabulation_vs_calibration")
    behaviour = rows_of(uncertainty.behaviour(e.frame))
    long = [{"run_id": r["run_id"], "metric": m, "value": r[m]} for r in behaviour for m in ("disagreement_entropy", "selfconsistency_gap", "stated_confidence_ece")]
    grouped(long, "metric", "value", "behavioural_uncertainty")
    return made


def build(e: Evaluation, runs: DataFrame, folder: str) -> list[str]:
    """All report files of these runs below a local folder; the large tables go there by Spark. Returns the small files."""
    labels = {r["run_id"]: r["label"] for r in rows_of(compare.run_labels(runs))}
    Path(folder).mkdir(parents=True, exist_ok=True)
    made = charts(e, labels, folder)
    totals = {r["run_id"]: r for r in rows_of(outcomes.totals(e.outcomes()))}
    families = rows_of(outcomes.by_family(e.outcomes()))
    (Path(folder) / "report.md").write_text(markdown(e, labels))
    made.append(f"{folder}/report.md")
    for run in rows_of(e.profile()):
        own, key, label = [f for f in families if f["run_id"] == run["run_id"]], run["run_id"], labels.get(run["run_id"], run["run_id"])
        for end, content in (("md", run_markdown(run, totals[key], own, label)), ("html", run_html(run, totals[key], own, label)), ("log", run_log(run, totals[key], {}, label))):
            (Path(folder) / f"{key}.{end}").write_text(content)
            made.append(f"{folder}/{key}.{end}")
    write_tables(e, folder)
    logs.write_logs(logs.log_lines(e.outcomes(), runs), f"{folder}/logs")
    return made
