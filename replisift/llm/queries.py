"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html_extract, media, ngram_join, oracle, packing, periodic_runs, quality, secrets, spelling, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as padding-free power-of-two sequences of at most 2048 tokens, by the tokenizer as its file sets it up."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORDS, 2048, 1, with_ids=False, special=True)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, and back."""
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of all documents under the default policy."""
    ledger = quality.apply_policy(quality.quality_ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality.mask("base-1"))) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as 8-bit media, sniffed and read back."""
    return media.text_media(_table(spark, sf_dir, "documents"), with_media=False)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-gram sets are similar by 90 per cent."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of all documents."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors found for every twentieth."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents."""
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents, with planted ones."""
    return spelling.spelling_groups(spelling.typed_words(_table(spark, sf_dir, "documents"), drop_every=31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_byte_bpe, op3_secret_scans, op4_quality_rules, op5_toxicity, op6_media_columns,
        op7_ngram_join, op8_chat_formatting, op9_html_extraction, op10_token_counts, op11_nearest, op12_periodic_runs, op13_spelling,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_secret_scans": oracle.SECRETS, "op4_quality_rules": oracle.QUALITY, "op7_ngram_join": oracle.NGRAM_JOIN, "op8_chat_formatting": oracle.CHAT, "op9_html_extraction": oracle.HTML, "op12_periodic_runs": oracle.RUNS, "op13_spelling": oracle.SPELLING}
