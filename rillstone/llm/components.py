"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations for the minima (combined before the shuffle, so a node
with very many neighbours is no burden) and two joins; rounds are written to the
shared folder, so a lost executor costs one round at most. Before the first round
every partition contracts its own edges with a union-find, which shortens long chains;
if at most `ONE_TASK` edges are left after that, one task finishes.

Defined results: loops and repeated edges count for nothing; an edge with a null end is
dropped; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .worker import kernel


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the roots with the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = flat[: len(a)], flat[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != root[root]).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contract(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > 500_000:
            u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
            if len(u) > 250_000:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])
                held, size = [], 0
            else:
                held, size = [(u, v)], len(u)
    if held:
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


def _whole(batches):
    held = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


#: Up to so many edges (16 bytes each) are contracted in one task instead of rounds.
ONE_TASK = 200_000


def components(edges: DataFrame, owner: str = "", rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node each one reaches.

    Nodes that are smallest themselves do not appear. Raises if `rounds` are too few.
    """
    e = settle(edges.where("a <> b").select("a", "b").mapInArrow(kernel(_contract), "a long, b long"), "cc", owner)
    if e.count() <= ONE_TASK:
        e = settle(e.coalesce(1).mapInArrow(kernel(_whole), "a long, b long"), "cc", owner)
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(rounds):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        if mark["n"] == 0 or (mark == before and mark["n"] == mark["d"]):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = down.join(low, down["a"] == low["u"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        e = settle(small, "cc", owner)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
