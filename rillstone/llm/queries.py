"""The registered queries of the pipeline operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, language_id, line_dedup, minhash, packing, quality, token_files, topk_search, url_rules
from .common import table


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op1_query(spark, table(spark, sf_dir, "documents"), _file("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest_table(table(spark, sf_dir, "documents"), _file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"), _file("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, stats=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op5_query(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


HOST_RULES = (
    url_rules.HostRule("com", "/", "allow"),
    url_rules.HostRule("example.com", "/en/", "block"),
    url_rules.HostRule("www.example.com", "/en/", "allow"),
    url_rules.HostRule("net", "/es/", "block"),
    url_rules.HostRule("net", "/fr/", "block"),
)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), HOST_RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_inner_products(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_url_rules": op7_url_rules,
    "op8_quality": op8_quality,
    "op9_minhash": op9_minhash,
    "op10_topk_search": op10_topk_search,
}

SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL,
    "op6_embedding_dedup": embedding_dedup.SQL,
    "op7_url_rules": url_rules.judge_sql(HOST_RULES),
    "op9_minhash": minhash.SQL,
    "op10_topk_search": topk_search.SQL,
}
