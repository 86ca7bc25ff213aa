from __future__ import annotations

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from evalframe.llm import common, decontam, oracles, queries


def brute_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(text: str, items: list[tuple[str, str]]) -> tuple[set[int], set[str]]:
    w, hit, found = brute_words(text), set(), set()
    for item, t in items:
        v = brute_words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1) if v else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return hit, found


words = s.lists(s.sampled_from(["a", "B", "c1", "é", "dd", "-", "0"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(words, s.lists(words, max_size=4))
def test_hits(text, items):
    pairs = [(str(i), t) for i, t in enumerate(items)]
    scan = decontam.Scan(text.encode(), decontam.automaton_of([(i, t.encode()) for i, t in pairs]))
    hit, found = brute(text, pairs)
    assert scan.n_words == len(brute_words(text)) and scan.items == found
    assert (set() if scan.hit is None else {i for i, x in enumerate(scan.hit) if x}) == hit


def test_offsets_lead_to_the_original():
    text = "Ünter, (The Quick brown fox) jumps! éé over"
    scan = decontam.Scan(text.encode(), decontam.automaton_of([("x", b"the QUICK Brown"), ("y", "éé over".encode())]))
    assert [text[a:b] for a, b in decontam.spans(text.encode(), scan.hit)] == ["The Quick brown", "éé over"]


def test_several_blocks_find_the_same(spark, middle, monkeypatch):
    docs, bench = common.read(spark, middle, "documents"), common.read(spark, middle, "benchmark")
    whole = sorted(decontam.contamination(docs, bench).collect())
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", 2000)
    assert sorted(decontam.contamination(docs, bench).collect()) == whole


def test_spans_and_repeated_rows_with_several_blocks(spark, monkeypatch):
    rows = [(1, "Say: the quick, brown fox jumps."), (1, "Say: the quick, brown fox jumps."), (2, None), (None, "brown fox"), (3, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame([("a", "The quick"), ("b", "brown fox"), ("c", "quick brown fox"), ("d", None)], "item_id string, text string")
    order = lambda df: sorted((r.doc_id or 0, r.hits, r.n_hit, r.n_items, r.items_sha256, [tuple(x) for x in r.spans]) for r in df.collect())
    whole = order(decontam.contamination(docs, bench, keep_spans=True, carry=("hits",)))
    assert [r[2:4] for r in whole] == [(2, 1), (4, 3), (4, 3), (0, 0), (0, 0)] and whole[1][5] == [(5, 25)]
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", 60)
    assert len(list(decontam.benchmark_blocks(bench, "item_id", "text", 10, 60))) == 4
    assert order(decontam.contamination(docs, bench, keep_spans=True, carry=("hits",))) == whole


def test_a_full_block_fits_in_a_task():
    """Peak memory of a process that builds and uses the automaton of a full block of distinct windows."""
    code = """
import random, resource
from evalframe.llm import decontam
rng = random.Random(1)
letters = "abcdefghijklmnopqrstuvwxyz"
items, used = [], 0
while used < decontam.AUTOMATON_BYTES:
    text = " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(200)).encode()
    items.append((str(len(items)), text))
    used += len(text) * decontam.WINDOW
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
automaton = decontam.automaton_of(items)
assert decontam.Scan(items[3][1], automaton).items == {"3"}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert grown < 400


def test_whole_table_against_sql(spark, middle):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{middle}/{t}.parquet'")
    found = con.execute(oracles.OP10)
    names = [c[0] for c in found.description]
    want = sorted(tuple(dict(zip(names, r, strict=True)).items()) for r in found.fetchall())
    got = sorted(tuple((c, r[c]) for c in names) for r in queries.op10_decontamination(spark, middle).collect())
    assert got == want and any(dict(r)["contaminated"] for r in got)
    assert {dict(r)["items_sha256"] for r in got if not dict(r)["contaminated"]} == {hashlib.sha256(b"").hexdigest()}
