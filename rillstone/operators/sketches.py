"""Count-Min, Count-Sketch and paired Count-Min as aggregations.

A sketch is a long table (row, bucket, ...) of at most depth * 2^log2_width rows. All
are linear, so partial sums combine before the one shuffle and sketches of parts of
the data merge by adding cells. Conservative updates depend on order; `conservative`
runs them as a kernel over the ordered stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import PolynomialHash, TabulationHash, bucket, sign
from .heaps import CountHeap
from .pairs import meet


@dataclass(frozen=True)
class SketchConfig:
    """depth rows of 2^log2_width cells, hashed from a seed."""

    log2_width: int = 10
    depth: int = 1
    seed: int = 0
    tabulation: bool = False
    widest: int = 30

    def __post_init__(self):
        if not 0 <= self.log2_width <= self.widest:
            raise ValueError(f"log2_width must be 0 to {self.widest}")
        if self.depth < 1:
            raise ValueError("depth must be at least 1")
        if self.depth << self.log2_width > 1 << 27:
            raise ValueError("a sketch may have 2^27 cells at most")

    @property
    def hash(self) -> PolynomialHash | TabulationHash:
        return (TabulationHash if self.tabulation else PolynomialHash)(self.depth, self.seed)


def cells(df: DataFrame, key: Column, config: SketchConfig, *carry: str) -> DataFrame:
    """One row for each key and sketch row: row, h, bucket and the carried columns."""
    h = config.hash
    hashes = F.array(*[F.struct(F.lit(i).alias("row"), h.column(key, i).alias("h")) for i in range(config.depth)])
    return df.select(*carry, F.inline(hashes)).withColumn("bucket", bucket(F.col("h"), config.log2_width))


def count_min(df: DataFrame, key: Column, config: SketchConfig) -> DataFrame:
    """row, bucket, cnt."""
    return cells(df, key, config).groupBy("row", "bucket").agg(F.count("*").alias("cnt"))


def count_min_query(sketch: DataFrame, keys: DataFrame, config: SketchConfig, key: str = "key") -> DataFrame:
    """keys with estimate: the least of a key's cells (absent cells are 0)."""
    probe = cells(keys.select(key).distinct(), F.col(key), config, key)
    hit = probe.join(_small(sketch, config), ["row", "bucket"], "left")
    return hit.groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def count_sketch(df: DataFrame, key: Column, delta: Column, config: SketchConfig) -> DataFrame:
    """row, bucket, weight: signed sums of delta."""
    return cells(df.withColumn("__d", delta), key, config, "__d").groupBy("row", "bucket").agg(F.sum(sign(F.col("h")) * F.col("__d")).alias("weight"))


def count_sketch_query(sketch: DataFrame, keys: DataFrame, config: SketchConfig, key: str = "key") -> DataFrame:
    """keys with estimate: the median of a key's signed cells."""
    probe = cells(keys.select(key).distinct(), F.col(key), config, key)
    hit = probe.join(_small(sketch, config), ["row", "bucket"], "left")
    return hit.groupBy(key).agg(F.median(sign(F.col("h")) * F.coalesce("weight", F.lit(0.0))).alias("estimate"))


def paired_count_min(features: DataFrame, config: SketchConfig, key: str = "key", label: str = "label") -> DataFrame:
    """row, bucket, num (label 1), den (others); each class has half the width."""
    half = SketchConfig(config.log2_width - 1, config.depth, config.seed, config.tabulation)
    positive = F.col("__l") == 1
    return cells(features.withColumn("__l", F.col(label)), F.col(key), half, "__l").groupBy("row", "bucket").agg(F.count_if(positive).alias("num"), F.count_if(~F.coalesce(positive, F.lit(False))).alias("den"))


def paired_ratios(sketch: DataFrame, keys: DataFrame, classes: DataFrame, config: SketchConfig, smooth: float = 1.0, key: str = "key") -> DataFrame:
    """keys with ratio, the smoothed ratio of least counts over that of the classes
    (`classes` has one row: pos, neg), and its logarithm `weight`."""
    half = SketchConfig(config.log2_width - 1, config.depth, config.seed, config.tabulation)
    probe = cells(keys.select(key).distinct(), F.col(key), half, key)
    hit = probe.join(_small(sketch, half), ["row", "bucket"], "left")
    least = hit.groupBy(key).agg(F.min(F.coalesce("num", F.lit(0))).alias("num"), F.min(F.coalesce("den", F.lit(0))).alias("den"))
    prior = F.broadcast(classes.select(((F.col("pos") + smooth) / (F.col("neg") + smooth)).alias("prior")))
    ratio = (F.col("num") + smooth) / (F.col("den") + smooth) / F.col("prior")
    return least.join(prior).select(key, ratio.alias("ratio"), F.ln(ratio).alias("weight"))


def _small(sketch: DataFrame, config: SketchConfig) -> DataFrame:
    """A sketch's size is known; it is broadcast up to 2^18 cells (about 6 MB)."""
    return F.broadcast(sketch) if config.depth << config.log2_width <= 1 << 18 else sketch


def conservative(stream: DataFrame, config: SketchConfig, group: str = "model_id", seq: str = "seq", key: str = "key") -> DataFrame:
    """Count-Min with conservative updates: only cells below least + 1 are raised. Rows
    of a group are taken by seq, then key; groups run in parallel, each in one task (a sketch needs
    its stream in order). group, row, bucket, cnt."""
    hashes, width = config.hash, (1 << config.log2_width) - 1

    def run(batches):
        table, now = None, None
        rows = np.arange(config.depth)

        def out():
            r, b = np.nonzero(table)
            return pd.DataFrame({group: now, "row": r.astype(np.int32), "bucket": b.astype(np.int32), "cnt": table[r, b]})

        for pdf in batches:
            for g, own in pdf.groupby(group, sort=False):
                if g != now:
                    if table is not None:
                        yield out()
                    table, now = np.zeros((config.depth, width + 1), np.int64), g
                keys, inverse = np.unique(own[key].to_numpy(), return_inverse=True)
                at = hashes.numpy(keys) & width
                for i in inverse.tolist():
                    c = at[:, i]
                    v = table[rows, c]
                    table[rows, c] = np.maximum(v, v.min() + 1)
        if table is not None:
            yield out()

    kind = dict(stream.dtypes)[group]
    ordered = stream.select(group, seq, key).repartition(group).sortWithinPartitions(group, seq, key)
    return ordered.mapInPandas(run, f"{group} {kind}, row int, bucket int, cnt bigint")


def space_saving(rows: DataFrame, key: str, k: int) -> DataFrame:
    """key, least, most: for each key of the summaries of the table's partitions, bounds
    of its count. A partition's summary holds k counters: a key that is not held takes
    the place, and adds to the count, of the least. Summaries merge by adding bounds; a
    key that a summary doesn't hold has at most the summary's least count there."""

    def run(batches):
        heap, over = CountHeap(k), {}
        for pdf in batches:
            counts = pdf["key"].dropna().value_counts(sort=False).sort_index()
            for name, n in zip(counts.index.tolist(), counts.tolist(), strict=True):
                if name in heap:
                    heap.change(name, heap.count(name) + n, 0.0)
                elif not heap.full:
                    heap.insert(name, n, 0.0)
                else:
                    least, _ = heap.first()
                    gone, _ = heap.pop()
                    over.pop(gone, None)
                    heap.insert(name, least + n, 0.0)
                    over[name] = least
        names = list(heap)
        floor = heap.first()[0] if heap.full else 0
        most = [heap.count(x) for x in names]
        yield pd.DataFrame({"key": pd.Series([*names, None], dtype=object), "least": [m - over.get(x, 0) for x, m in zip(names, most, strict=True)] + [0], "more": [m - floor for m in most] + [floor]})

    kind = dict(rows.dtypes)[key]
    found = rows.select(F.col(key).alias("key")).mapInPandas(run, f"key {kind}, least bigint, more bigint")
    # `more` of the null key: the floors of all summaries
    sums = found.groupBy("key").agg(F.sum("least").alias("least"), F.sum("more").alias("more"))
    floor = F.broadcast(sums.where("key is null").agg(F.coalesce(F.sum("more"), F.lit(0)).alias("floor")))
    return sums.where("key is not null").join(floor).select("key", "least", (F.col("more") + F.col("floor")).alias("most"))


def heavy_hitters(rows: DataFrame, key: str, share: float) -> DataFrame:
    """key, cnt of the keys that have more than `share` of the rows (nulls don't count),
    exactly: Space-Saving finds the candidates, at most 1 / share for each partition, and
    a second pass counts only these."""
    total = rows.where(F.col(key).isNotNull()).count()
    likely = space_saving(rows, key, int(np.ceil(1 / share))).where(F.col("most") > share * total).select("key")
    own = rows.select(F.col(key).alias("key")).join(F.broadcast(likely) if likely.count() <= 100_000 else likely, "key")
    return own.groupBy("key").agg(F.count("*").alias("cnt")).where(F.col("cnt") > share * total)


def active_set_scores(examples: DataFrame, active: DataFrame, sketch: DataFrame, config: SketchConfig, bias: float = 0.0) -> DataFrame:
    """seq, label, z, predicted by an active set kept as tables: exact weights (key,
    weight) where there is one, else the estimate of a Count-Sketch. Keys are looked up
    once each; the exact ones never reach the sketch."""
    flat = examples.select("seq", "label", F.explode_outer("features").alias("f")).select("seq", "label", F.col("f.key").alias("key"), F.col("f.value").cast("double").alias("value"))
    keys = flat.select("key").where("key is not null").distinct()
    tail = count_sketch_query(sketch, keys.join(active, "key", "left_anti"), config).select("key", F.col("estimate").alias("weight"))
    weights = keys.join(active, "key", "left_semi").join(active, "key").select("key", "weight").union(tail)
    hit = meet(flat, weights, "key", "seq", how="left")
    z = F.coalesce(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("value")), F.lit(0.0)) + bias
    return hit.groupBy("seq", "label").agg(z.alias("z")).withColumn("predicted", F.col("z") >= 0)
