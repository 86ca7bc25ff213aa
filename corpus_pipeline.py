"""The corpus pipeline: toxicity, near-duplicates, decontamination, pseudonyms, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import bpe, decontam, pii, simhash, toxicity
from evalframe.llm.common import read, shared_folder
from evalframe.llm.queries import RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects, by the threshold of their language, go."""
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, COLUMNS, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    marked = decontam.contamination(docs, read(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms."""
    new = pii.pseudonymise(docs, pii.TEST_KEY, carry=("lang", "source"))
    return new.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes token ids, with digests of the ids and of the bytes that they decode to."""
    return bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", replace_personal), ("bpe", encode)]

#: Classifier, pseudonyms and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each stage's result is written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
