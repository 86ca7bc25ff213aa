"""The prefix trie and the filter audit against SQL, plain versions and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import audit, common, oracles, queries, trie
from tests.test_oracles import rows


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_filter_audit"])
def test_query_equals_its_sql(spark, middle, name):
    con = duckdb.connect()
    for p in Path(middle).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(oracles.oracle_sql()[name])
    columns, expected = [c[0] for c in want.description], want.fetchall()
    got = queries.queries()[name](spark, middle)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, expected)


def plain_trie(conversations):
    """By walking every conversation; rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    said = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = tuple(said.get(base, [])[:h]) + tuple(said[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()), key=str)


TRIE = "conv_id long, turn long, role string, text string"


def found(spark, conversations, tasks=3):
    df = spark.createDataFrame(conversations, TRIE).withColumns({c: F.lit("clash") for c in ("depth", "k1", "k2", "at", "said", "chars", "p1", "end", "base", "__part", "node")}).repartition(tasks)
    got = trie.prefixes(df)
    return sorted((tuple(r) for r in got.drop("node").collect()), key=str)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    given = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "", None, "ünï ☃", "yes"])) for c in [*range(0, 260), -150, -100, -3, 10**15] for t in range(rng.randint(0, 7))]
    given += [(7, None, "user", "a"), (7, None, "user", "a"), (7, None, None, "b"), (7, 1, "user", "z"), (None, 1, "user", "nobody's"), (300, 2**40, "a:", "b"), (301, 0, "a", ":b"), (302, 0, "", "2:ab")]
    assert found(spark, given) == plain_trie(given)


def test_trie_with_a_conversation_that_has_most_turns_and_copies_of_one(spark, monkeypatch):
    long = [(4, t, "user", f"turn {t % 7}") for t in range(250)]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1025) for t in range(7)]
    given = [*long, *copies, (1400, 0, "user", "x"), (1400, 1, "user", "y")]
    monkeypatch.setattr(trie, "PIECE", 16)
    assert found(spark, given, 7) == plain_trie(given)


def test_empty_trie(spark):
    assert found(spark, [(None, 1, "user", "x")]) == [] == found(spark, [(1, 1, "user", "x")][:0] or [(None, None, None, None)])
    none = spark.createDataFrame([], TRIE)
    assert trie.prefixes(none).collect() == []


def test_texts_of_nodes(spark):
    df = spark.createDataFrame([(1000, t, "user", f"t{t}") for t in range(8)], TRIE)
    got = {r.depth: (r.role, r.text) for r in trie.with_last_turn(trie.build(trie.rebuilt(df)), df).collect()}
    assert got == {0: (None, None)} | {d: ("user", f"t{d - 1}") for d in range(1, 9)}


def test_rounds_are_logarithmic(spark, monkeypatch):
    cuts = []
    real = trie.cut
    monkeypatch.setattr(trie, "cut", lambda df: cuts.append(1) or real(df))
    depth, values = 300, spark.range(300).select((F.col("id") + 1).alias("depth"), F.col("id").alias("k1"), F.lit(0).cast("long").alias("k2"), (F.col("id") - 1).alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(1).cast("long").alias("v"))
    got = {r.k1: r.more_v for r in trie.rolled_up(values, ["v"]).collect()}
    assert all(got[k] == depth - 1 - k for k in range(depth - 1)) and len(cuts) <= 3 * 9 + 1


AUDIT = "doc_id long, text string, lang string"


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    said = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    out = {}
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in first and i > first[t]}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((lang or "", "".join(order), step), [0] * 6)
                removed = bad[x] and not gone
                for k, yes in enumerate((not bad[x] and not gone, removed, bad[x] and gone, [y for y in bad if bad[y]] == [x], removed and said(i, 1), removed and said(i, 2))):
                    row[k] += yes
                gone = gone or bad[x]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return sorted((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


def test_audit_of_odd_documents(spark):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, "en"), (3, None, None), (4, "", ""), (5, " \t\x0b\n", "de"), (6, "A B C # " * 300, "de"), (7, "same words " * 200, "en"), (8, long + " |", None),
        (9, "ÄÖÜ X Y " + long, "de"), (10, "x" * 400_000, "en"), (11, long.upper(), "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (6, None, 1), (99, 1, 1), (8, 7, None)]
    frame = spark.createDataFrame(docs, AUDIT).withColumns({c: F.lit("clash") for c in ("part", "flags", "good", "toxic", "quality", "digest", "first", "step", "filter_order", "n", "t", "words")}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"lang": F.lit("clash"), "text": F.lit("clash"), "good": F.lit("clash")})
    got = audit.audit(frame, marks)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["string", "string", "int"] + ["bigint"] * 7
    assert audit.audit(frame.limit(0), marks).collect() == []
    assert sum(r.good_lost for r in audit.audit(frame, marks.limit(0)).collect()) == 0


def test_audit_adds_up(spark, small):
    docs = common.read(spark, small, "documents")
    got = queries.op13_filter_audit(spark, small).toPandas()
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 600 * len(sizes)
    for (part, _), own in got.groupby(["part", "filter_order"]):
        own = own.sort_values("step")
        assert (own.kept + own.removed.cumsum() == sizes[part]).all()
