"""Sparse examples and token lines made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import lines_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature(key: Column, value: Column | float = 1.0) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.struct(key.cast("bigint").alias("key"), v.cast("float").alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is an event a purchase? One-hot user, in order of event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.array(feature(F.col("user_id"))).alias("features"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a labelled document good? Features: toxic or not (keys 0, 1), and one of 14
    residues of doc_id with value 0.5 (keys 2 to 15), in order of doc_id."""
    d = table(spark, sf_dir, "labels")
    return d.select(F.col("doc_id").alias("seq"), F.col("quality").alias("label"), F.array(feature(F.col("toxic")), feature(F.col("doc_id") % 14 + 2, 0.5)).alias("features"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents").where("text is not null"), "doc_id")


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return lines_of(c.withColumn("doc", F.col("conv_id") * 1000 + F.col("turn")), "doc")


def token_key(token: Column) -> Column:
    """32 bits of a token's MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")
