"""Token files with Elias-Fano document boundaries.

A file set is a table of segments. A segment holds the ids of consecutive documents
as one binary array of little-endian unsigned integers (2 bytes when the vocabulary
allows it, else 4) and the documents' end offsets in Elias-Fano code: for n offsets
below u, each offset's low floor(log2(u/n)) bits lie packed in `ef_low`, its high
bits in unary in `ef_high`; `ef_select` samples the place of every 256th one bit, so
any boundary is found with a scan of a few bytes. That is about 2 + log2(u/n) bits a
document instead of 64.

Defined results: a null text is an empty one; an empty text has only the end id;
repeated rows and repeated or null doc_ids are kept, in order of doc_id then text;
an empty table gives an empty file set; very long texts are encoded whole; the strings
of special tokens in a text get those tokens' ids, as the library has it; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import local_files
from .chunks import drop_coders, library_coder, text_slices, vocabulary_size, with_end
from .common import keep_until_exit, scratch, shuffle_parts
from .worker import kernel

SAMPLE = 256


@dataclass
class EliasFano:
    """A non-decreasing sequence of n numbers below or at u."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def build(cls, values: np.ndarray, u: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(u // max(n, 1)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(u >> bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The place of the i-th one bit, from the nearest sample onwards."""
        place = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        word = self.high[byte] >> (place % 8) << (place % 8)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def get(self, i: int) -> int:
        """The i-th number without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, low = i * self.low_bits, 0
        if self.low_bits:
            raw = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little")
            low = raw >> at % 8 & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = ones - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (high << self.low_bits) + low


SEGMENTS = "part int, base long, n_ids long, width int, doc_ids array<bigint>, ids binary, ef_bits int, ef_low binary, ef_high binary, ef_select binary"


def _segment(part: int, base: int, width: int, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> dict:
    ef = EliasFano.build(np.cumsum(sizes), len(ids))
    return {"part": part, "base": base, "n_ids": len(ids), "width": width, "doc_ids": doc_ids, "ids": ids.astype(f"<u{width}").tobytes(), "ef_bits": ef.low_bits, "ef_low": ef.low, "ef_high": ef.high, "ef_select": ef.samples}


_ARROW = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("ef_bits", pa.int32()), ("ef_low", pa.binary()), ("ef_high", pa.binary()), ("ef_select", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 20, parts: int | None = None) -> None:
    """Encode `docs` (doc_id, text) and write them in ascending order of doc_id.

    One range shuffle of the texts puts them in order; each task then streams its
    range through the encoder, so memory holds one segment. `parts` is the number of
    ranges (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    width = 2 if vocabulary_size(tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts or shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(batches):
        coder = library_coder(tokenizer, "blanks")
        part, base, held, doc_ids, sizes, ids = 0, 0, 0, [], [], []
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            if own:
                part = batch.column("part")[0].as_py()
            for lo, hi, texts in text_slices(batch.column("text"), 1_000_000):
                x, n = with_end(*coder.encode(texts), end_id)
                ids.append(x)
                sizes.append(n)
                doc_ids += own[lo:hi]
                held += len(x)
                if held >= segment_ids:
                    yield pa.RecordBatch.from_pylist([_segment(part, base, width, doc_ids, np.concatenate(ids), np.concatenate(sizes))], _ARROW)
                    base, held, doc_ids, sizes, ids = base + held, 0, [], [], []
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_segment(part, base, width, doc_ids, np.concatenate(ids), np.concatenate(sizes))], _ARROW)

    ordered.mapInArrow(kernel(encode, "coders", drop_coders), SEGMENTS).write.options(**local_files(spark)).parquet(path)


def _decode(before: dict[int, int], digest_only: bool):
    """Documents of segments, each found by its boundaries in the Elias-Fano code."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ef = EliasFano(len(r["doc_ids"]), r["ef_bits"], r["ef_low"], r["ef_high"], r["ef_select"])
                ends = np.fromiter((ef.get(i) for i in range(ef.n)), np.int64, ef.n)
                starts = np.concatenate(([0], ends[:-1]))
                wide = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                raw = memoryview(wide.tobytes())
                out = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + (before[r["part"]] + r["base"])), pa.array(ends - starts), pa.array([crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if not digest_only:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate((starts, ends[-1:])), pa.int32()), pa.array(wide.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return decode


def read_token_files(spark, path: str, digest_only: bool = False) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32 and, unless
    `digest_only`, ids as array<bigint>.

    `start` counts the ids of all earlier documents. Only the totals of the ranges
    are gathered, one number for each range that the writer made.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        before[row["part"]] = at
        at += row["n"]

    return files.mapInArrow(kernel(_decode(before, digest_only)), "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<bigint>"))


def op1_query(spark, docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    keep_until_exit(spark, path)
    return read_token_files(spark, path, digest_only=True)
