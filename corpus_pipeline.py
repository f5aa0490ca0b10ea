"""A training corpus from `documents`: language, quality, line dedup, near-duplicates,
packing. Each stage is a function of (spark, docs, sf_dir); `run` writes each stage's
result to the shared folder and reads it for the next.

Defined results of all stages but the last: rows keep their columns, further ones with
any name too; rows that repeat doc_id and text pass together up to `near`, which keeps
one; an empty table stays empty; very long texts are read whole. Each stage's docstring
says what becomes of nulls and empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import language_id, line_dedup, minhash, packing, quality
from rillstone.llm.common import release, settle, table
from rillstone.session import ship

OWNER = "pipeline"


def _start(spark: SparkSession) -> None:
    """Ship the package and delete what the stage before left in the shared folder."""
    ship(spark)
    release(spark, OWNER)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found surely; the model learns from their lang. Null
    texts and texts without a letter go; a null doc_id or lang stays, but is not learned
    from; of equal languages the first counts."""
    _start(spark)
    return language_id.keep_sure(docs, language_id.learn(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more); null texts and
    texts without a word go; null doc_ids are judged like others."""
    _start(spark)
    return quality.keep_accepted(docs, quality.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks and passages of lines; null texts and texts with
    nothing left go. The first place (by doc_id, nulls first) keeps its lines."""
    _start(spark)
    return line_dedup.dedup_lines(docs, OWNER, passages=True).where("text <> ''")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, Jaccard 0.8. The least
    doc_id stays; null doc_ids, null texts and texts without a word stay, too."""
    _start(spark)
    return minhash.near_duplicates(docs, size=5, percent=80, owner=OWNER, keep_columns=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; a null or empty text is its
    end id alone. The worker's cache is small beside those of the stages before."""
    _start(spark)
    import public_tokenizers

    return packing.packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"), owner=OWNER, cache=60_000)


STAGES = [("language", language), ("quality", good), ("lines", lines), ("near", near), ("packing", packed)]

#: A learned language model and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}", f"stage-{i}")
            if i:
                release(spark, f"stage-{i - 1}")
    return docs
