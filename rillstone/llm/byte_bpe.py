"""Byte-level BPE by ranks, encoding and decoding, on padded numpy matrices.

Distinct pieces (matches of the split pattern) that the cache does not know are laid
out as rows of matrices, one matrix for each length bucket. In each round every row
merges its leftmost pair of minimum rank; pair ranks come from an open-addressing
hash table and are kept in a second matrix, so that a round looks up only the two
pairs that a merge made. Rows without a pair leave the matrix (compaction). A piece
beyond `LONGEST` bytes is a matrix by itself: its rows are strips of the piece, each with
its least rank, so that a round costs a strip and not the whole piece; strips without ids
leave the chain.

Defined results: a null text is an empty one; an empty text has no ids and decodes to
no bytes; repeated rows are kept, as are null doc_ids; an empty table gives none; very
long texts are encoded whole; further columns are ignored; bytes that form no known token cannot occur, since
all 256 single bytes must have a rank (checked).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkCoder, split_blanks, text_slices
from .worker import kernel

LONGEST = 256
NONE = np.uint32(0xFFFFFFFF)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of the token that a pair of ids forms: linear probing in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.uint32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, NONE)
        left, at = np.arange(len(key)), ((key * _MULT) >> self.shift).astype(np.int64)
        while len(left):
            free = self.keys[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            here = left[free]
            _, first = np.unique(at[here], return_index=True)
            here = here[first]
            self.keys[at[here]], self.values[at[here]] = key[here], value[here]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where no token is formed or a side is NONE."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = ((key * _MULT) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        left = np.flatnonzero((found != key) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class ByteBpe:
    """Encodes and decodes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.pattern, self.pairs = ranks, regex.compile(pattern), PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        top = max(ranks.values()) + 1
        sizes = np.zeros(top, np.int64)
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        sizes[[r for _, r in by_id]] = [len(t) for t, _ in by_id]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)
        self.coder = ChunkCoder(self.encode_chunks, split_blanks)

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.uint32)
            elif len(p) > LONGEST:
                out[i] = self._strips(p)
            elif p:
                buckets.setdefault(-(-len(p) // 4) * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = np.empty(0, np.uint32)
        for width, rows in buckets.items():
            most = max(64, 400_000 // width)
            for lo in range(0, len(rows), most):
                own = rows[lo : lo + most]
                for i, ids in zip(own, self._matrix([pieces[i] for i in own], width), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _matrix(self, pieces: Sequence[bytes], width: int) -> list[np.ndarray]:
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < n[:, None], self.byte_ids[raw], NONE)
        rank = np.full(ids.shape, NONE)
        rank[:, :-1] = self.pairs.get(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(len(ids), -1)
        row, out = np.arange(len(ids)), [None] * len(ids)
        while len(row):
            at = rank.argmin(1)
            every = np.arange(len(row))
            low = rank[every, at]
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[row[i]] = ids[i, : n[i]].copy()
                keep = ~done
                row, n = row[keep], n[keep]
                if not len(row):
                    break
                width = int(n.max())
                ids, rank, at, low, every = ids[keep, :width], rank[keep, :width], at[keep], low[keep], np.arange(len(row))
            # the pair's second id goes; what stands behind it moves up
            move = np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > at[:, None])
            move[:, -1] = np.minimum(move[:, -1], ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, move, 1), np.take_along_axis(rank, move, 1)
            n -= 1
            ids[every, at] = low
            ids[every, n], rank[every, n] = NONE, NONE
            behind = np.minimum(at + 1, ids.shape[1] - 1)
            rank[every, at] = np.where(at + 1 < n, self.pairs.get(low, ids[every, behind]), NONE)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], low[left])
        return out  # type: ignore[return-value]

    def _strips(self, piece: bytes) -> np.ndarray:
        """The rounds of one long piece: the leftmost pair of least rank of all strips. A
        strip's last id pairs with the first one of the next strip that has any."""
        n, width = len(piece), LONGEST
        rows = -(-n // width)
        ids = np.full((rows, width), NONE)
        ids.reshape(-1)[:n] = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = np.full(rows * width, NONE)
        flat = ids.reshape(-1)
        rank[: n - 1] = self.pairs.get(flat[: n - 1], flat[1:n])
        rank = rank.reshape(rows, width)
        least, size = rank.min(1), np.minimum(width, n - np.arange(rows) * width).tolist()
        after, before = [*range(1, rows + 1)], [*range(-1, rows - 1)]
        known: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.get(np.array([a], np.uint32), np.array([b], np.uint32))[0])
            return known[a, b]

        def leave(r: int, i: int) -> None:
            size[r] -= 1
            last = size[r]
            ids[r, i:last], rank[r, i:last] = ids[r, i + 1 : last + 1], rank[r, i + 1 : last + 1]
            ids[r, last] = rank[r, last] = NONE

        while True:
            r = int(least.argmin())
            low = int(least[r])
            if low == NONE:
                return ids[ids != NONE]
            i, q = int(rank[r].argmin()), after[r]
            if i + 1 < size[r]:
                leave(r, i + 1)
            else:
                leave(q, 0)
                if size[q]:
                    least[q] = rank[q].min()
                else:
                    least[q], after[r] = NONE, after[q]
                    if after[q] < rows:
                        before[after[q]] = r
                    q = after[r]
            ids[r, i] = low
            behind = ids[r, i + 1] if i + 1 < size[r] else ids[q, 0] if q < rows else NONE
            rank[r, i] = pair(low, int(behind)) if behind != NONE else NONE
            if i:
                rank[r, i - 1] = pair(int(ids[r, i - 1]), low)
            elif (p := before[r]) >= 0:
                rank[p, size[p] - 1] = pair(int(ids[p, size[p] - 1]), low)
                least[p] = rank[p].min()
            least[r] = rank[r].min()

    def encode_chunks(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings, each cut by the pattern, one behind the other, and the number
        of each; equal pieces are encoded once."""
        cut = [self.pattern.findall(c) for c in chunks]
        pieces = list(dict.fromkeys(p for own in cut for p in own))
        ids = dict(zip(pieces, self.encode_pieces([p.encode("utf-8", "replace") for p in pieces]), strict=True))
        flat = [ids[p] for own in cut for p in own]
        sizes = np.array([sum(len(ids[p]) for p in own) for own in cut], np.int64)
        return np.concatenate(flat) if flat else np.empty(0, np.uint32), sizes

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.coder.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def drop_loaded() -> None:
    _loaded.clear()


def loaded(ranks_path: str, pattern: str) -> ByteBpe:
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = ByteBpe(read_ranks(ranks_path), pattern)
    return _loaded[ranks_path, pattern]


def encode_table(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every text; no shuffle."""

    def encode(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, hi, texts in text_slices(batch.column("text")):
                ids, sizes = bpe.encode(texts)
                raw, ends = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist()
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.array([raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(kernel(encode, "byte_bpe", drop_loaded), "doc_id long, ids binary")


def decode_table(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds `decoded` (binary) to a table with doc_id and ids."""

    def decode(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            for i, x in enumerate(raw):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([x], pa.binary()), pa.array([bpe.decode(np.frombuffer(x, "<u4"))], pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(kernel(decode, "byte_bpe", drop_loaded), "doc_id long, ids binary, decoded binary")


def digest_table(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass and returns sizes and SHA-256 digests, so that
    neither ids nor decoded bytes leave the worker."""

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, hi, texts in text_slices(batch.column("text")):
                ids, sizes = bpe.encode(texts)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.concatenate(([0], np.cumsum(sizes))).tolist()
                spans = list(zip(ends, ends[1:], strict=False))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.array(sizes), pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()), pa.array([hashlib.sha256(bpe.decode(np.frombuffer(raw[4 * a : 4 * b], "<u4"))).hexdigest() for a, b in spans], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(kernel(run, "byte_bpe", drop_loaded), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
