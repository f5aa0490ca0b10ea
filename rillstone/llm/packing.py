"""Sequence packing by cutting-stock column generation.

A document longer than `length` ids is cut into full pieces and a remainder; no other
document is cut. Pieces fall into size classes (`piece_classes`). Over the histogram
of classes a linear program chooses patterns (how many pieces of each class
share a sequence): a revised simplex holds the basis, and a knapsack dynamic program
over the sequence's capacity prices new patterns by the duals. Pattern counts are
rounded down; what they leave is packed best-fit by decreasing class. The pieces of
a class are ranked (by range of rows, then doc_id and start) and ranks map to places
in the patterns, so each piece finds its sequence by arithmetic.

The driver holds the histogram of the classes (under 200 counts) and the patterns; no
ids or documents.

Defined results: a null text is an empty one and an empty document is its end id
alone; repeated rows are packed each; null doc_ids are packed like others; an empty
table gives no pieces; very long texts are encoded whole and cut into full pieces; the
strings of special tokens in a text get those tokens' ids; further columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import drop_coders, library_coder, text_slices, vocabulary_size, with_end
from .common import settle
from .worker import kernel


#: Chunks that a worker keeps with their ids, about 150 bytes each.
CACHE = 800_000


def piece_classes(length: int = 4096, unit: int = 8) -> np.ndarray:
    """Class sizes in units: every unit up to a 16th of the length, every second up to
    a quarter, every fourth beyond; so a piece is rounded up by about 1 % of its size."""
    top = length // unit
    return np.array([*range(1, top // 16), *range(top // 16, top // 4, 2), *range(top // 4, top + 1, 4)])


def best_pattern(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits, by dynamic programming."""
    fits = np.searchsorted(weight, np.arange(capacity + 1), "right")
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(weight[0]), capacity + 1):
        gain = value[: fits[c]] + best[c - weight[: fits[c]]]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], last[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if last[c] >= 0:
            pattern[last[c]] += 1
            c -= int(weight[last[c]])
        else:
            c -= 1
    return float(best[capacity]), pattern


def patterns(demand: np.ndarray, weight: np.ndarray, capacity: int, rounds: int = 1500, close: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows over classes) and whole counts that use up `demand` exactly:
    rounded columns of the linear program, then best-fit for the rest.

    Ends when no column can lower the number of sequences by more than the share
    `close`, or after `rounds` steps; an early end costs padding, never pieces.
    """
    used = np.flatnonzero(demand > 0)
    if not len(used):
        return np.zeros((0, len(weight)), np.int64), np.zeros(0, np.int64)
    need, w = demand[used].astype(float), weight[used]
    basis = np.diag(capacity // w).astype(float)  # column j: pattern j
    inverse = np.diag(1.0 / (capacity // w))
    amount = inverse @ need
    for step in range(rounds):
        dual = inverse.sum(0)
        gain, column = best_pattern(dual, w, capacity)
        if gain <= 1 + close:  # the dual bound: total / gain
            break
        entering = column.astype(float)
        direction = inverse @ entering
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-11, amount / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = max(0.0, ratio[out])
        amount -= theta * direction
        amount[out] = theta
        basis[:, out] = entering
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            amount = inverse @ need
    count = np.floor(np.maximum(amount, 0) + 1e-9).astype(np.int64)
    made = basis.T.round().astype(np.int64)
    left = demand[used] - count @ made
    for j in np.argsort(-made.sum(1)):  # rounding errors may cover more than is there
        while count[j] and (left[made[j] > 0] < 0).any():
            count[j] -= 1
            left = left + made[j]
    rest: list[np.ndarray] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by room
    for i in range(len(used) - 1, -1, -1):
        for _ in range(int(left[i])):
            at = next((r for r in range(int(w[i]), capacity + 1) if room[r]), capacity)
            if room[at]:
                b = room[at].pop()
            else:
                b = len(rest)
                rest.append(np.zeros(len(used), np.int64))
            rest[b][i] += 1
            room[at - int(w[i])].append(b)
    rows = np.concatenate([made[count > 0], np.array(rest, np.int64).reshape(-1, len(used))])
    whole = np.zeros((len(rows), len(weight)), np.int64)
    whole[:, used] = rows
    return whole, np.concatenate([count[count > 0], np.ones(len(rest), np.int64)])


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, owner: str = "", cache: int = CACHE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (binary, little-
    endian, 2 or 4 bytes an id in `width`), part; written to the shared folder."""
    width = 2 if vocabulary_size(tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4

    def cut(batches):
        coder = library_coder(tokenizer, "words", cache=cache)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), min(1_000_000, 4 * cache)):
                ids, sizes = with_end(*coder.encode(texts), end_id)
                pieces = -(-sizes // length)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, sizes[doc] - start)
                raw = memoryview(ids.astype(f"<u{width}").tobytes())
                ends = (np.cumsum(size) * width).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + lo)), pa.array(start), pa.array(size), pa.array(sizes[doc]), pa.array([raw[e - n * width : e] for e, n in zip(ends, size.tolist(), strict=True)], pa.binary()), pa.array(np.full(len(doc), width, np.int32))], ["doc_id", "start", "length", "doc_tokens", "ids", "width"])

    pieces = docs.select("doc_id", "text").mapInArrow(kernel(cut, "coders", drop_coders), "doc_id long, start long, length long, doc_tokens long, ids binary, width int")
    return settle(pieces.withColumn("part", F.spark_partition_id()), "pieces", owner)


def assign(pieces: DataFrame, length: int = 4096, unit: int = 8) -> DataFrame:
    """part, doc_id, start, length, row (of its part) and sequence_id, offset of every
    piece; reads no ids. The shuffle moves about 50 bytes a piece."""
    if length % (16 * unit):
        raise ValueError("16 units must divide length")
    weight, capacity = piece_classes(length, unit), length // unit
    kinds = np.searchsorted(weight, np.arange(capacity + 1)).tolist()
    light = pieces.select("part", "doc_id", "start", "length", "doc_tokens", F.get(F.lit(kinds), F.ceil(F.col("length") / unit).cast("int")).alias("kind"))
    histogram = light.groupBy("part", "kind").agg(F.count("*").alias("n"))
    demand = np.zeros(len(weight), np.int64)
    for r in histogram.groupBy("kind").agg(F.sum("n").alias("n")).collect():
        demand[r["kind"]] = r["n"]
    rows, count = patterns(demand, weight, capacity)
    first = np.cumsum(count) - count  # a pattern's first sequence
    inside = np.cumsum(rows, 1) - rows  # a class's first place in the pattern
    by_kind = {}
    for kind in np.flatnonzero(demand).tolist():
        p = np.flatnonzero(rows[:, kind])
        ends = np.cumsum(rows[p, kind] * count[p])
        by_kind[kind] = (ends, ends - rows[p, kind] * count[p], rows[p, kind], first[p], inside[p, kind])
    # a piece's rank in its class: pieces of earlier parts, then place in its own part
    earlier = histogram.withColumn("before", F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "kind", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = light.withColumn("own", F.row_number().over(Window.partitionBy("part", "kind").orderBy("doc_id", "start", "doc_tokens")) - 1).join(earlier, ["part", "kind"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(batches):
        for batch in batches:
            kind, rank = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind).tolist():
                own = np.flatnonzero(kind == k)
                ends, starts, each, base, at = by_kind[k]
                p = np.searchsorted(ends, rank[own], "right")
                seq[own] = base[p] + (rank[own] - starts[p]) // each[p]
                slot[own] = at[p] + (rank[own] - starts[p]) % each[p]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "start", "length", "doc_tokens", "own")), pa.array(seq), pa.array(slot)], ["part", "doc_id", "start", "length", "doc_tokens", "own", "sequence_id", "slot"])

    placed = ranked.select("part", "doc_id", "start", "length", "doc_tokens", "own", "kind", "rank").mapInArrow(kernel(place), "part int, doc_id long, start long, length long, doc_tokens long, own int, sequence_id long, slot long")
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def digest(pieces: DataFrame) -> DataFrame:
    """Adds ids_crc32 over the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            crc = [crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "start", "length", "doc_tokens")), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "length", "doc_tokens", "ids_crc32"])

    return pieces.select("part", "doc_id", "start", "length", "doc_tokens", "ids", "width").mapInArrow(kernel(run), "part int, doc_id long, start long, length long, doc_tokens long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, unit: int = 8, owner: str = "") -> DataFrame:
    """Packed pieces with their ids: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids, width. `packed_digests` returns checksums instead of ids."""
    pieces = cut_documents(docs, tokenizer, end_id, length, owner)
    return _join(pieces.select("part", "doc_id", "start", "length", "doc_tokens", "ids", "width"), assign(pieces, length, unit), "ids", "width")


def packed_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, unit: int = 8, owner: str = "", cache: int = CACHE) -> DataFrame:
    pieces = cut_documents(docs, tokenizer, end_id, length, owner, cache)
    return _join(digest(pieces), assign(pieces, length, unit), "ids_crc32")


def _join(content: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """Content to places. Rows that agree in part, doc_id, start and sizes (repeated
    rows, or rows that share a doc_id) are paired off by number on both sides; null
    doc_ids pair with each other."""
    key = ["part", "doc_id", "start", "length", "doc_tokens"]
    number = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    a = content.withColumn("twin", number(columns)).alias("a")
    b = places.withColumn("twin", number(["sequence_id", "slot"])).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc_id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "twin"]]
    return a.join(b, on).select("a.doc_id", "a.start", "a.length", *[f"a.{c}" for c in columns], "a.doc_tokens", "b.sequence_id", "b.offset")
