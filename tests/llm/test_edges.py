"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for all ten operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalframe.llm import bpe, decontam, embeddings, pii, quality, queries, secrets, simhash, toxicity, urls, warc

LONG = "one long text about nothing at all with password = 'aB3dE5fG7hJ9kL2mN4' in it " * 8_000
DOCS = [
    (1, "the same words again and again in one text", "en"), (1, "the same words again and again in one text", "en"), (2, "the same words again and again in one text", None), (3, "", "en"), (4, None, "en"), (5, " \n\t ", "de"),
    (None, "a text without an id", "en"), (6, LONG, "en"), (7, "ünïcödé ☃ \u2028 \x00 end", "xx"),
]
EXTRA = ("id", "fp", "score", "held_out", "predicted", "quality", "toxic", "n_words", "component_id", "start", "__id", "__doc", "label", "url", "n", "a", "b", "rep")
N = len(DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 1), (1, 0, 1), (3, 0, 0), (5, None, None), (None, 1, 1), (6, 0, 0), (99, 1, 1), (7, 5, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({"text": F.lit("clash"), "lang": F.lit("clash"), "score": F.lit("clash")})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "The same words, again!"), (2, None), (3, ""), (None, "in one text"), (1, "The same words, again!")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.org/x", "p" * 200), (1, "http://a.org/x", "p" * 200), (2, None, "p" * 200), (None, "x", None), (3, "", ""), (4, "http://b ü.com/\n", "q" * 1_000_000), (5, "http://EXAMPLE.org/ES/?a", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "verdict", "first", "block", "payload_digest", "content", "n")})


@pytest.fixture(scope="module")
def vectors(spark):
    unit = [1.0, 0.0, 0.0]
    rows = [(1, unit, 0), (1, unit, 0), (2, [2.0, 0.0, 0.0], 0), (3, unit, 1), (4, unit, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0), (8, [None, 1.0, 0.0], 0), (None, unit, 0), (9, [1.0, 0.0], 0), (10, [], 0), (11, [float("inf"), 0.0, 0.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("n", "rep", "a", "links", "dim")})


def test_quality_and_toxicity(docs, labels):
    for got in (quality.quality(docs, labels), toxicity.toxicity(docs, labels)):
        rows = got.collect()
        assert len(rows) == N and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    none = labels.limit(0)
    assert len({r.score for r in quality.quality(docs, none).collect()}) == 1 == len({r.score for r in toxicity.toxicity(docs, none).collect()})


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == by[1].component_id == 1 and by[1].kept and not by[2].kept
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16 and by[5].component_id == 3
    assert by[None].component_id is None and by[None].kept is None and by[None].fingerprint != "0" * 16


def test_embeddings(vectors):
    rows = embeddings.near_duplicates(vectors).collect()
    assert len(rows) == 13
    by = {r.vec_id: r for r in rows}
    assert by[2].component_id == 1 and by[2].n_links == 2 and not by[2].kept
    assert sorted(r.n_links for r in rows if r.vec_id == 1) == [2, 2]
    assert all(by[k].n_links == 0 and by[k].kept and by[k].component_id == k for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert (by[None].n_links, by[None].component_id, by[None].kept) == (0, None, None)


def test_pii(docs):
    rows = pii.pseudonymise(docs, b"k", carry=("lang",), keep_spans=True).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows}
    assert by[4].text is None and by[4].n_found == 0 and by[3].text == "" and by[7].text == DOCS[-1][1] and by[None].lang == "en"


def test_bpe(docs):
    rows = bpe.encode_decode(docs, queries.RANKS, queries.public_tokenizers.PATTERN, keep_decoded=True).collect()
    assert len(rows) == N
    want = {k: (t or "").encode() for k, t, _ in DOCS}
    assert all(bytes(r.decoded) == want[r.doc_id] for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}


def test_secrets(docs):
    rows = secrets.scan(docs).collect()
    assert {r.doc_id for r in rows} == {6} and len(rows) == 8_000 and len({r.start for r in rows}) == 8_000
    assert all(LONG[r.start : r.start + len(r.secret)] == r.secret for r in rows[:100])


def test_urls(pages):
    rows = urls.judge(pages).collect()
    assert len(rows) == 7
    by = {r.page_id: r for r in rows}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert (by[2].host, by[2].path, by[2].rule, by[2].verdict) == ("", "", None, "allow") and by[None].host == ""
    assert (by[5].host, by[5].path, by[5].rule) == ("example.org", "/ES/", "org/") and by[4].host == "b ü.com"


def test_warc(pages):
    rows = warc.archive(pages).collect()
    assert len(rows) == 7
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None)]
    assert {r.page_id: r.payload_bytes for r in rows} == {None: 0, 1: 200, 2: 200, 3: 0, 4: 1_000_000, 5: 0}


def test_decontamination(docs, benchmark):
    rows = decontam.contamination(docs, benchmark, keep_spans=True, carry=("lang",)).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].n_hit, by[1].n_items, by[1].contaminated) == (9, 7, 2, True)
    assert [(s.start, s.end) for s in by[1].spans] == [(0, 20), (31, 42)]
    assert by[4].n_words == 0 and not by[3].contaminated and by[None].n_words == 5


def test_empty_tables(spark, docs, labels, benchmark, pages, vectors):
    none = docs.limit(0)
    for got in (
        quality.quality(none, labels), toxicity.toxicity(none, labels.limit(0)), simhash.near_duplicates(none), pii.pseudonymise(none, b"k"), bpe.encode_decode(none, queries.RANKS, queries.public_tokenizers.PATTERN), secrets.scan(none),
        urls.judge(pages.limit(0)), embeddings.near_duplicates(vectors.limit(0)), decontam.contamination(none, benchmark), warc.archive(pages.limit(0)),
    ):
        assert got.count() == 0
    assert decontam.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
