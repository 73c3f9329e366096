"""The queries of this package's operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import htmltext, langid, lm, media, mixing, neardup, oracles, packing, passages, tokencount, vafile
from quillmill.runtime import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), least_words=50)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


#: Shares of all tokens that the mix aims at.
TARGETS = {"high": 0.6, "low": 0.36, "toxic": 0.04}


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domain_of_labels(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, TARGETS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    predicted = langid.identify(docs.select("doc_id", "text"), langid.learn(docs, where=~held_out))
    return predicted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_media": op3_media,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_mix_sources": op5_mix_sources,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_lm_score": op8_lm_score,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": oracles.NEAR_DUPLICATES,
    "op4_exact_top_k": oracles.TOP_K,
}
