"""Top-k, reservoirs and metrics as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import meet


def top_by_magnitude(df: DataFrame, k: int, weight: str = "weight", *ties: str) -> DataFrame:
    """The k rows of largest |weight|, then by `ties`; each task keeps k rows."""
    return df.orderBy(F.abs(F.col(weight)).desc(), *ties).limit(k)


def top_by_count(df: DataFrame, k: int, count: str = "cnt", *ties: str) -> DataFrame:
    return df.orderBy(F.col(count).desc(), *ties).limit(k)


def top_per_group(df: DataFrame, group: str, k: int, weight: str = "weight", *ties: str) -> DataFrame:
    """The k rows of largest |weight| of each group (limited before the shuffle)."""
    order = Window.partitionBy(group).orderBy(F.abs(F.col(weight)).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weighted_reservoir(df: DataFrame, k: int, uniform: Column, weight: str = "weight", power: float = 1.0, *ties: str) -> DataFrame:
    """k rows with the least |weight|^power * ln(u), u in (0, 1] a column such as a
    hash of the key, so that a repeated task draws the same sample."""
    r = F.pow(F.abs(F.col(weight)), F.lit(power)) * F.ln(uniform)
    return df.withColumn("r", r).orderBy("r", *ties).limit(k)


def uniform_reservoir(df: DataFrame, k: int, uniform: Column, *ties: str) -> DataFrame:
    """k rows drawn without replacement: the least by a hash."""
    return df.withColumn("r", uniform).orderBy("r", *ties).limit(k)


def confusion(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, precision, recall, f1; without positives precision and recall are 1,
    and f1 is null where both are 0. Labels other than 0 and 1 never agree."""
    p, y = F.col(predicted), F.col(label)
    counts = scored.agg(F.count_if(p & (y == 1)).alias("tp"), F.count_if(p & (y != 1)).alias("fp"), F.count_if(~p & (y == 1)).alias("fn"))
    ratio = lambda den: F.when(F.col("tp") + F.col(den) == 0, F.lit(1.0)).otherwise(F.try_divide("tp", F.col("tp") + F.col(den)))
    both = counts.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))
    return both.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def progressive(predictions: DataFrame, *group: str) -> DataFrame:
    """err_count, count, err_rate of predictions (label, predicted) made before learning."""
    wrong = F.count_if(F.col("predicted").cast("int") != F.col("label"))
    return predictions.groupBy(*group).agg(wrong.alias("err_count"), F.count("*").alias("count"), F.try_divide(wrong, F.count("*")).alias("err_rate"))


def scores(examples: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """seq, label, z, predicted: sparse products with a weight table (key, weight), keys
    without a weight counting 0. Ties (z = 0) are positive."""
    flat = examples.select("seq", "label", F.explode_outer("features").alias("f")).select("seq", "label", F.col("f.key").alias("key"), F.col("f.value").cast("double").alias("value"))
    hit = meet(flat, weights.select("key", "weight"), "key", "seq", how="left")
    z = F.coalesce(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("value")), F.lit(0.0)) + bias
    return hit.groupBy("seq", "label").agg(z.alias("z")).withColumn("predicted", F.col("z") >= 0)
