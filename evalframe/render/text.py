"""Profiles as text for a terminal."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from ..functions.stats import DROP_FULL, ECE_FULL
from ..streaming.committed import Progress

BLOCKS, SPARKS = " ▏▎▍▌▋▊▉█", "▁▂▃▄▅▆▇█"
RED, YELLOW, GREEN = 31, 33, 32


def number(x: float | None, places: int = 3) -> str:
    return "—" if x is None else f"{x:.{places}f}"


def meter(share: float | None, width: int = 20, plain: bool = False) -> str:
    """A bar for a share of 0 to 1, in eighths of a cell; in ASCII if ``plain``."""
    full = max(0.0, min(1.0, share or 0.0)) * width
    if plain:
        return ("#" * round(full)).ljust(width, ".")
    whole = int(full)
    part = BLOCKS[int((full - whole) * 8)] if whole < width else ""
    return ("█" * whole + part.strip()).ljust(width)


def sparkline(values: Sequence[float | None], low: float = 0.0, high: float = 1.0, plain: bool = False) -> str:
    marks = "_.-=*#@"[:7] if plain else SPARKS
    span = (high - low) or 1.0
    at = lambda v: min(len(marks) - 1, max(0, int((v - low) / span * len(marks))))
    return "".join(" " if v is None else marks[at(v)] for v in values)


def coloured(text: str, good: float | None, colour: bool) -> str:
    """The text in red, yellow or green by how good it is, from 0 to 1."""
    if not colour or good is None:
        return text
    return f"\x1b[{GREEN if good >= 0.66 else YELLOW if good >= 0.33 else RED}m{text}\x1b[0m"


def glyph(good: float | None, plain: bool = False) -> str:
    """A mark for a goodness of 0 to 1: thirds, from the top."""
    if good is None:
        return " "
    marks = ".o*" if plain else "○◐●"
    return marks[(good >= 0.33) + (good >= 0.66)]


def ece_goodness(ece: float | None) -> float | None:
    return None if ece is None else 1 - min(1.0, ece / ECE_FULL)


def drop_goodness(drop: float | None) -> float | None:
    return None if drop is None else max(0.0, 1 - max(drop, 0.0) / DROP_FULL)


def progress(p: Progress) -> str:
    """One line about a run at work: a meter, items done, samples right and failed, and how long the rest will take."""
    left = p.remaining_seconds
    rest = "unknown" if left is None else f"{int(left) // 60}:{int(left) % 60:02d}"
    return f"{meter(p.done / p.items if p.items else 1.0, plain=True)} {p.done}/{p.items} items, {p.right} right, {p.failed} failed, {rest} left"


def shorten(words: str | None, width: int) -> str:
    """At most ``width`` characters, the last of them an ellipsis if something is left out."""
    words = words or ""
    return words if len(words) <= width else words[: max(0, width - 1)] + "…"


def moment(at: datetime | None) -> str:
    """A time in the local zone."""
    return "—" if at is None else f"{at.astimezone():%Y-%m-%d %H:%M:%S}"


def row(label: str, value: float | None, good: float | None = None, plain: bool = False, colour: bool = False, note: str = "") -> str:
    return f"  {label:<18} {coloured(meter(value, plain=plain), value if good is None else good, colour)} {number(value)}{'  ' + note if note else ''}"


def dashboard(run: dict, families: Sequence[dict], curve: Sequence[dict], plain: bool = False, colour: bool = False, drops: Sequence[dict] = ()) -> list[str]:
    """Lines about one run: its profile row, its families (``family, accuracy, above_chance``), their curves (``family, difficulty, mean``) and what distractors cost them (``family, drop``)."""
    lines = [f"run {run['run_id']}: {run['n_items']} items x {run['samples_per_item']}", "HEADLINE"]
    for label, key, better in (("overall acc", "overall_accuracy", 1), ("strict acc", "strict_accuracy", 1), ("coverage", "coverage", 1), ("calibration ECE", "ece", -1), ("answer-flip", "answer_flip_rate", -1), ("confabulation", "confabulation_rate", -1)):
        value = run.get(key)
        good = ece_goodness(value) if key == "ece" else None if value is None or better > 0 else 1 - value
        lines.append(row(label, value, good, plain, colour))
    if run.get("maj_at_k") is not None:
        lines.append(f"  pass@1 {number(run['pass_at_1'])} -> maj@{run['k']} {number(run['maj_at_k'])} -> oracle {number(run['pass_at_k_oracle'])}  headroom {number(run['frontier_headroom'])}")
    lines.append("FAMILIES")
    for f in sorted(families, key=lambda x: x["family"]):
        points = [c["mean"] for c in sorted((c for c in curve if c["family"] == f["family"]), key=lambda c: c["difficulty"])]
        lines.append(row(f["family"], f["accuracy"], plain=plain, colour=colour, note=sparkline(points, plain=plain)))
    if drops:
        lines.append("DISTRACTORS")
        for d in sorted(drops, key=lambda x: x["family"]):
            good = drop_goodness(d["drop"])
            lines.append(f"  {d['family']:<18} {coloured(glyph(good, plain), good, colour)} drop {number(d['drop'])}")
    if run.get("n_calls") is not None:
        lines += ["RUNTIME", f"  {run['n_calls']} calls, {run['failed_calls']} failed; latency p50 {run['latency_p50_ms']} ms, p95 {run['latency_p95_ms']} ms"]
    if run.get("reasoning_available"):
        lines.append(f"  reasoning: {reasoning(run)}")
    return lines


def reasoning(run: dict) -> str:
    """One line about hidden reasoning; empty if none was reported."""
    if not run.get("reasoning_available"):
        return ""
    parts = [f"{run['reasoning_tokens_total']} total", f"mean {run['reasoning_tokens_mean']}/item"]
    for key, form in (("reasoning_fraction", "{:.0%} of completion"), ("reasoning_tokens_per_correct", "{:.0f}/correct"), ("correct_per_1k", "{:.1f} correct/1k"), ("effort_scaling", "effort {:.2f}×")):
        if run.get(key) is not None:
            parts.append(form.format(run[key]))
    return " · ".join(parts)


def comparison(board: Sequence[dict], labels: dict[str, str], plain: bool = False, colour: bool = False) -> list[str]:
    """Lines of a leaderboard: a metric each, with a meter per run that is longest for the best."""
    runs, metrics = sorted({r["run_id"] for r in board}), list(dict.fromkeys(r["metric"] for r in board))
    lines = [" " * 20 + "  ".join(f"{labels.get(x, x):<20}" for x in runs)]
    for metric in metrics:
        own = {r["run_id"]: r for r in board if r["metric"] == metric}
        up = next(iter(own.values()))["higher_is_better"]
        cells = [f"{coloured(meter(own[x]['scaled'], 13, plain), own[x]['goodness'], colour)} {number(own[x]['value'], 2):<6}" if x in own else f"{'—':<20}" for x in runs]
        lines.append(f"  {metric + ('' if up else ' v' if plain else ' ↓'):<18}" + "  ".join(cells))
    return lines
