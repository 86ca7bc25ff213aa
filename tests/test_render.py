from __future__ import annotations

import os

import pytest

from evalframe import cli
from evalframe.plans.queries import queries
from evalframe.render import report, text
from evalframe.sources import registry as r
from evalframe.sources import star


def test_meters():
    assert text.meter(1, 4) == "████" and text.meter(0, 4) == "    " and text.meter(0.5, 4, plain=True) == "##.." and len(text.meter(0.3, 10)) == 10
    assert text.sparkline([0, 0.5, 1, None]) == "▁▅█ " and len(text.sparkline([0, 1], plain=True)) == 2
    assert text.number(None) == "—" and text.coloured("x", 0.9, True).startswith("\x1b[32m") and text.coloured("x", 0.9, False) == "x"


def test_pages_escape_what_comes_from_data():
    page = report.run_html({"run_id": "r"}, {"solved": 1, "wrong": 0, "errored": 0, "total": 1}, [{"family": "<b>", "solved": 1, "wrong": 0, "errored": 0, "total": 1, "accuracy": 1.0}], "a<script>")
    assert "<script>" not in page and "&lt;b&gt;" in page


def test_registry(tmp_path):
    reg = r.Registry()
    assert r.register(reg, "a", "https://api.one.example.com/v1/", "m1", api_key="k") == "example"
    assert r.register(reg, "b", "https://api.one.example.com/v1", "m2", max_tokens=5) == "example"
    assert r.register(reg, "c", "https://two.example.com", "m3") == "example_2"
    path = str(tmp_path / "p.json")
    r.save(reg, path)
    assert r.load(path) == reg and r.load(str(tmp_path / "none.json")) == r.Registry()
    e = r.resolve(reg, "b", environment={})
    assert (e.model, e.base_url, e.api_key, e.max_tokens) == ("m2", "https://api.one.example.com/v1", "k", 5)
    assert r.resolve(reg, "raw", provider="example_2", api_key="x").model == "raw"
    with pytest.raises(ValueError, match="unknown provider"):
        r.resolve(reg, "a", provider="nobody")
    with pytest.raises(ValueError, match="nothing says"):
        r.resolve(reg, "raw")
    assert r.edit(reg, "c", base_url="http://localhost:1") == "local" and "example_2" not in reg.providers
    r.remove(reg, "a")
    assert "example" in reg.providers
    r.remove(reg, "b")
    assert "example" not in reg.providers
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError, match="not a registry"):
        r.load(str(tmp_path / "bad.json"))
    assert [r.output_tokens(*x) for x in ((7, 8, 9), (None, 8, 9), (None, None, 16384), (None, None, 100), ())] == [7, 8, 8192, 1024, 32768]
    assert r.key_of({"api_key_env": "E", "api_key": "k"}, None, {"E": "v"}) == "v" and r.key_of({"oauth": True}, None, {"OPENAI_API_KEY": "z"}) == ""


def test_export_joins_all_items_and_keeps_orphans(spark):
    items = spark.createDataFrame([(k, "f", k, "base", "g") for k in (1, 7, 14)], "item_id long, family string, difficulty int, probe string, gold string")
    responses = spark.createDataFrame([("r", k, "x") for k in (1, 7, 14, 15)], "run_id string, item_id long, raw string")
    got = {x.item_id: (x.family, x.difficulty, x.probe, x.gold) for x in report.with_dimensions(responses, items).collect()}
    assert got == {k: ("f", k, "base", "g") for k in (1, 7, 14)} | {15: ("(unknown)", None, None, None)}


def test_the_whole_export_knows_all_items(spark):
    tables = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    known = {x.item_id for x in star.items(spark, tables).select("item_id").collect()}
    got = queries()["results_export_all"](spark, tables).select("item_id", "family").collect()
    assert any(x.item_id % 7 == 0 for x in got) and all((x.family == "(unknown)") == (x.item_id not in known) for x in got)


def test_command_line(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s")]
    cli.main([*at, "generate", "--families", "arithmetic", "unsat_csp"])
    cli.main([*at, "run", "one", "--samples", "2", "--max-difficulty", "3"])
    cli.main([*at, "run", "two", "--mode", "perfect", "--limit", "9"])
    cli.main([*at, "list"])
    cli.main([*at, "families"])
    cli.main([*at, "compare"])
    cli.main([*at, "dashboard", "one"])
    cli.main([*at, "report", "--out", str(tmp_path / "r")])
    out = capsys.readouterr().out
    assert "24 items" in out and "two mock-perfect" in out and "overall acc" in out and "pass@1" in out
    assert len(list((tmp_path / "r" / "results").glob("run_id=*/*.json"))) >= 2
    models = ["--registry", str(tmp_path / "models.json")]
    assert cli.main([*models, "add-model", "a", "--base-url", "https://api.one.example.com", "--model", "m", "--api-key", "secret"]) == 0
    assert cli.main([*models, "edit-model", "a", "--max-tokens", "9"]) == 0 and cli.main([*models, "remove-model", "zzz"]) == 1
    cli.main([*models, "models"])
    cli.main([*models, "providers"])
    shown = capsys.readouterr().out
    assert "stored key" in shown and "secret" not in shown and r.load(models[1]).models["a"] == {"provider": "example", "model": "m", "max_tokens": 9}
    assert cli.main([*models, "remove-model", "a"]) == 0 and r.load(models[1]) == r.Registry()
    files = {p.name for p in (tmp_path / "r").iterdir()}
    assert {"report.md", "one.html", "two.log", "metrics", "items"} <= files
    assert "| mock-perfect | 1.000 |" in (tmp_path / "r" / "report.md").read_text()
