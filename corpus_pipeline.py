"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and is written as Parquet and read again before the next.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from replisift.llm import ngram_join, packing, quality, secrets, toxicity
from replisift.llm._common import written
from replisift.llm.queries import WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels that aren't held out, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default quality policy."""
    return quality.keep_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles and a similarity of 0.8 or more; texts that share an id are documents of their own."""
    return ngram_join.one_of_each(docs, words=5, percent=80, by_text=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of at most 2048 tokens, with their ids."""
    # Workers that idle keep what they remember, and other stages need the memory: little is remembered here.
    return packing.pack_documents(docs, WORDS, 2048, 1, with_ids=True, words_held=120_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs


#: The classifier and the similarity join aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
