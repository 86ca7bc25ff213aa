"""Each stage of the corpus pipeline against a plain version, on whole small tables."""

from __future__ import annotations

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from evalframe.llm import bpe, common, decontam, pii, queries, simhash, toxicity

from .test_decontam import brute
from .test_simhash import brute_components, brute_wide_fingerprint


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, small):
    docs = common.read(spark, small, "documents")
    labels, bench = common.read(spark, small, "labels"), [(str(r.item_id), r.text) for r in common.read(spark, small, "benchmark").collect()]
    assert [name for name, _ in p.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]
    scored = rows(toxicity.toxicity(docs, labels))
    kept = rows(p.drop_toxic(spark, docs, small))
    assert set(kept) == {i for i, r in scored.items() if not r.rejected} and all(tuple(r.__fields__) == p.COLUMNS for r in kept.values())
    after = spark.createDataFrame(list(kept.values()), docs.schema)

    single = rows(p.drop_near_duplicates(spark, after, small))
    bits = simhash.bits_of(0.8)
    classes = brute_components({i: brute_wide_fingerprint(r.text or "", 5) for i, r in kept.items()}, bits)
    assert set(single) == set(classes.values()) and len(single) < len(kept)
    assert all(single[i] == kept[i] for i in single)
    after = spark.createDataFrame(list(single.values()), docs.schema)

    clean = rows(p.drop_contaminated(spark, after, small))
    assert set(clean) == {i for i, r in single.items() if not brute(r.text or "", bench)[0]}
    after = spark.createDataFrame(list(clean.values()), docs.schema)

    private = rows(p.replace_personal(spark, after, small))
    masker = pii.Masker(pii.TEST_KEY)
    assert set(private) == set(clean)
    assert all(r.text == masker.mask(clean[i].text)[0] and r.n_chars == len(r.text) and r.lang == clean[i].lang for i, r in private.items())
    after = spark.createDataFrame(list(private.values()), docs.schema)

    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    coded = rows(p.encode(spark, after, small))
    assert {i: list(r.ids) for i, r in coded.items()} == {i: coder.encode_ordinary(r.text) for i, r in private.items()}
    whole = rows(p.run(spark, small))
    assert {i: r.ids_sha256 for i, r in whole.items()} == {i: r.ids_sha256 for i, r in coded.items()}


def test_documents_without_id_or_text(spark, small):
    rows_ = [(1, "the same words again and again", "en", "s", 3), (1, "the same words again and again", "en", "s", 3), (2, "the same words again and again", "en", "s", 3), (None, "no id", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.drop_near_duplicates(spark, docs, small)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    for _, stage in p.STAGES[2:]:
        assert stage(spark, docs, small).count() == len(rows_)
    assert decontam.words(b"A-b") == [b"a", b"b"]


def test_one_document_of_each_group_whatever_its_id(spark, small):
    """Different texts of one id are judged apart, copies without an id go, and extra columns and very long texts do no harm."""
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    long = "one very long text of many words " * 100_000
    rows_ = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(2) + " end"), (None, text(3)), (None, text(3)), (None, text(1)), (5, text(4)), (4, text(4)), (6, long), (7, long + "x"), (8, None), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("fp", "node", "row", "group", "id", "band", "size")})
    kept = p.drop_near_duplicates(spark, docs.repartition(3), small)
    assert tuple(kept.columns) == p.COLUMNS
    want = [(None, text(3)), (1, text(1)), (1, text(2)), (4, text(4)), (6, long), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_corpus(spark, small):
    docs = common.read(spark, small, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, small).count() == 0
