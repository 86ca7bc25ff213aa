"""JSON of unknown keys; classes of runs."""

from __future__ import annotations

import pyarrow.parquet as parquet
from pyspark.sql import functions as F

from evalframe.functions import documents
from evalframe.operators import compare


def test_keys_and_kinds(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 1.5, "b": null, "c": {"d": 1}}', '{"a": "1"}', "{}", "[1, 2]", "7", '"t"', "true", "null", '{"a": ', "", None, '{"c": [1], "e": false}', '{"ü b": 2}']
    got = {(r.key, r.kind): r.n for r in documents.keys_of(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()}
    assert got == {
        ("a", "number"): 2, ("a", "text"): 1, ("b", "text"): 1, ("b", "null"): 1, ("c", "object"): 1, ("c", "array"): 1, ("e", "boolean"): 1, ("ü b", "number"): 1,
        (None, "array"): 1, (None, "number"): 1, (None, "text"): 1, (None, "boolean"): 1, (None, "null"): 1, (None, "malformed"): 2, (None, "missing"): 1, (None, "object"): 1,
    }
    none = spark.createDataFrame([], "j string")
    assert documents.keys_of(none, "j").collect() == []


def test_values_by_path(spark):
    df = spark.createDataFrame([('{"a": {"b": 3}}',), ('{"a": {"b": "x"}}',), ("{",), (None,)], "j string")
    assert [r.v for r in df.select(documents.value_at(F.col("j"), "$.a.b", "int").alias("v")).collect()] == [3, None, None, None]


def test_many_runs_make_few_classes(spark):
    n = 10_000
    runs = spark.range(n).select(F.col("id").alias("run_id"), F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("dataset_tag"))
    families = runs.select("run_id", F.explode(F.when(F.col("run_id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("x")))).alias("family"))
    classes = compare.run_classes(runs, families)
    assert classes.count() == n and classes.select("tag", "families").distinct().count() == 8
    pairs = compare.class_mismatch(classes).collect()
    assert len(pairs) == 6 * 4  # pairs of tags by pairs of sets; of runs there would be 37.5 million
    assert sum(r.n_runs_1 * r.n_runs_2 for r in pairs) == 6 * 2500 * 2500 and {r.shared_families for r in pairs} == {1, 2}
    few = compare.tag_mismatch(runs.where("run_id < 6"), families.where("run_id < 6")).collect()
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if i % 4 != j % 4}
    assert {(r.run_1, r.run_2) for r in few} == want and len(few) == len(want)
    assert all(r.tag_1 == f"v{r.run_1 % 4}" and r.tag_2 == f"v{r.run_2 % 4}" and r.shared_families == (1 if r.run_1 % 5 == 0 or r.run_2 % 5 == 0 else 2) for r in few)
    bare = spark.createDataFrame([(1, None), (2, "t"), (3, "u")], "run_id long, dataset_tag string")
    own = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "run_id long, family string")
    assert [(r.run_1, r.run_2, r.tag_1, r.tag_2) for r in compare.tag_mismatch(bare, own).collect()] == [(1, 2, "", "t")]


def test_classes_that_share_many_families_meet_once(spark):
    """Sets over 150 families, so that pairs share families of several words of 64: one row a pair, and nothing is aggregated over pairs."""
    rows = [(f"t{c % 3}", sorted({f"f{(c * 7 + k * k * (1 + c % 5)) % 150:03d}" for k in range(c % 13)})) for c in range(60)]
    classes = spark.createDataFrame([(i, tag, ",".join(f)) for i, (tag, f) in enumerate(rows)], "run_id long, tag string, families string")
    found = compare.class_mismatch(classes)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    kept = {(tag, tuple(f)) for tag, f in rows if f}
    want = {(a, ",".join(f), b, ",".join(g)): len({*f} & {*g}) for a, f in kept for b, g in kept if a < b and {*f} & {*g}}
    got = found.collect()
    assert {(r.tag_1, r.families_1, r.tag_2, r.families_2): r.shared_families for r in got} == want and len(got) == len(want) > 100
    assert max(want.values()) > 2 and sum(r.n_runs_1 for r in got) >= len(got)


def test_pairs_of_classes_are_written_with_each_text_once(spark, tmp_path, monkeypatch):
    """64 families, so that a mask is full; a file's dictionary holds a 32nd of what is usual, and a block of classes fits in it: pairs refer to texts that a file has once, and no class is shuffled for the blocks that it meets."""
    monkeypatch.setattr(compare, "BLOCK_BYTES", compare.__dict__.get("BLOCK_BYTES", 0) // 32, raising=False)
    names = [f"family-{k:02d}-of-many" for k in range(64)]
    rows = [(f"t{c % 3}", [n for k, n in enumerate(names) if (c * 2654435761 + k * (c + 7919) * 40503) % 1009 < 560]) for c in range(479)] + [("t0", names)]
    classes = spark.createDataFrame([(i, tag, ",".join(f)) for i, (tag, f) in enumerate(rows)], "run_id long, tag string, families string")
    found = compare.class_mismatch(classes)
    found.write.option("parquet.dictionary.page.size", 32 << 10).parquet(f"{tmp_path}/pairs")
    want = {(a, ",".join(f), b, ",".join(g)): len({*f} & {*g}) for a, f in rows for b, g in rows if a < b and {*f} & {*g}}
    got = spark.read.parquet(f"{tmp_path}/pairs").collect()
    assert {(r.tag_1, r.families_1, r.tag_2, r.families_2): r.shared_families for r in got} == want and len(got) == len(want) > 50_000
    files = [parquet.read_metadata(p).row_group(0) for p in tmp_path.glob("pairs/*.parquet")]
    spelt = [c.path_in_schema for f in files if f.num_rows for c in (f.column(i) for i in range(f.num_columns)) if c.path_in_schema.startswith("families") and "PLAIN" in c.encodings]
    assert files and not spelt, f"{len(spelt)} columns of {len(files)} files have each text written out"
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    none = compare.class_mismatch(classes.where("run_id < 0"))
    assert none.columns == found.columns and none.count() == 0
