"""Run logs: written by tasks in order, whole or not at all."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalframe.render import logs

FOUND = "run_id string, item_id string, family string, difficulty int, probe string, gold string, outcome string, reason string"


def _found(spark, n):
    rows = [("a", f"i{k:04d}", ("x", "y", None)[k % 3], None if k % 3 == 2 else k % 4, "base", "1", ("solved", "wrong", "errored")[k % 3], f"reason\n{k}") for k in range(n)]
    return spark.createDataFrame([*rows, ("b", "only", "x", 1, None, "1", "solved", "correct"), ("lost", "i", "x", 1, "base", "1", "wrong", "no")], FOUND).repartition(5)


def _runs(spark):
    rows = [("a", "m", {"n": "3", "api_key": "sk", "mode": "x\ny"}), ("b", None, None), ("c", "m", {})]
    return spark.createDataFrame(rows, "run_id string, model string, params map<string,string>").withColumn("created_at", F.expr("timestamp'2024-05-06 07:08:09'"))


def _plain(rows, head):
    """By plain Python: family, difficulty, item."""
    own = sorted(rows, key=lambda r: (r.family or "", r.difficulty or 0, r.item_id))
    return head + [f"  {r.item_id:<24} {r.family or '-':<16} {'-' if r.difficulty is None else r.difficulty:<2} {r.probe or '-':<10} {r.outcome:<7} {r.reason}".replace("\n", "\\n") for r in own]


def test_logs_as_rendered_plainly(spark, tmp_path):
    found = _found(spark, 700)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few lines are one task's
    try:
        logs.write_logs(logs.log_lines(found, _runs(spark)), str(tmp_path / "logs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = {p.name[7:]: [line for f in sorted(p.glob("part-*")) for line in f.read_text().splitlines()] for p in (tmp_path / "logs").glob("run_id=*")}
    rows = found.collect()
    last = "items (item, family, difficulty, probe, outcome, reason):"
    head = ["run log", "model: m", "run: a", "started: 2024-05-06 07:08:09", "parameters:", "  mode = x\\ny", "  n = 3", "summary:", "  total = 700", "  solved = 234", "  wrong = 233", "  errored = 233", "  accuracy = 0.5011", last]
    assert read["a"] == _plain([r for r in rows if r.run_id == "a"], head)
    assert read["b"][:4] == ["run log", "model: -", "run: b", "started: 2024-05-06 07:08:09"] and len(read["b"]) == 11 + 1
    assert len(read["c"]) == 11 and read["lost"] == _plain([r for r in rows if r.run_id == "lost"], [])
    assert len(list((tmp_path / "logs" / "run_id=a").glob("part-*"))) > 1  # one run, several tasks


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    lines = logs.log_lines(_found(spark, 300), _runs(spark))
    broken = lines.withColumn("line", F.when(F.col("place") == "i0299", F.raise_error(F.lit("gone"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="gone"):
        logs.write_logs(broken, str(tmp_path / "logs"))
    assert not list(Path(tmp_path).rglob("part-*"))
