"""Hash families as column expressions, as SQL text and as numpy functions.

All three forms give the same numbers, so sketches that Catalyst aggregates, kernels
that learn in numpy and oracle SQL agree to the bit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

M31 = (1 << 31) - 1
M32 = (1 << 32) - 1


def mt19937(seed: int, n: int) -> list[int]:
    """The first n outputs of the 32-bit Mersenne twister."""
    raw = np.random.RandomState(seed % (1 << 32))._bit_generator.random_raw(n)
    return [int(x) for x in np.atleast_1d(raw)]


class PolynomialHash:
    """h(x) = fold(a x + b) into 31 bits; pairs (a, b) are consecutive twister outputs."""

    def __init__(self, copies: int, seed: int):
        raw = mt19937(seed, 2 * copies)
        self.pairs = list(zip(raw[::2], raw[1::2], strict=True))

    def column(self, x: Column, copy: int = 0) -> Column:
        """Without overflow: of a x + b only bits 0 to 61 matter."""
        a, b = (F.lit(v).cast("bigint") for v in self.pairs[copy])
        high = a * F.shiftright(x, 16)
        low = F.shiftleft(high.bitwiseAND(F.lit((1 << 46) - 1)), 16) + a * x.bitwiseAND(F.lit(65535)) + b
        return (F.shiftright(low, 31) + low).bitwiseAND(F.lit(M31))

    def sql(self, x: str, copy: int = 0) -> str:
        a, b = self.pairs[copy]
        v = f"({a}::HUGEINT * ({x})::HUGEINT + {b})"
        return f"((({v} >> 31) + {v}) & {M31})::BIGINT"

    def numpy(self, x: np.ndarray) -> np.ndarray:
        """One row for each copy."""
        out = []
        for a, b in self.pairs:
            v = x.astype(np.uint64) * np.uint64(a) + np.uint64(b)
            out.append((((v >> np.uint64(31)) + v) & np.uint64(M31)).astype(np.int64))
        return np.array(out).reshape(len(self.pairs), len(x))


class TabulationHash:
    """XOR of four table entries, one for each byte; tables lie chunk by byte by copy."""

    def __init__(self, copies: int, seed: int):
        self.copies = copies
        self.table = np.array(mt19937(seed, 4 * 256 * copies), np.int64).reshape(4, 256, copies)

    def column(self, x: Column, copy: int = 0) -> Column:
        out = None
        for i in range(4):
            entry = F.get(F.lit(self.table[i, :, copy].tolist()), F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)).cast("int"))
            out = entry if out is None else out.bitwiseXOR(entry)
        return out

    def sql(self, x: str, copy: int = 0) -> str:
        return "xor(" * 3 + ", ".join([f"[{','.join(map(str, self.table[0, :, copy]))}][(({x}) & 255) + 1]", *[f"[{','.join(map(str, self.table[i, :, copy]))}][((({x}) >> {8 * i}) & 255) + 1])" for i in (1, 2, 3)]])

    def numpy(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        out = np.zeros((self.copies, len(x)), np.int64)
        for i in range(4):
            out ^= self.table[i, x >> 8 * i & 255].T
        return out


def sign(h: Column) -> Column:
    """+1 where the top one of 32 bits is set, else -1."""
    return F.when(F.shiftright(h, 31).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)


def bucket(h: Column, log2_width: int) -> Column:
    return h.bitwiseAND(F.lit((1 << log2_width) - 1)).cast("int")


# Fixed values of the published MurmurHash3 (32-bit form).
MURMUR_BLOCK = (0xCC9E2D51, 15, 0x1B873593)
MURMUR_STEP = (13, 5, 0xE6546B64)
MURMUR_END = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))


def murmur32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 for 32-bit machines, by its published description."""

    def rotate(v: int, r: int) -> int:
        return (v << r | v >> 32 - r) & M32

    def scramble(block: bytes) -> int:
        first, turn, second = MURMUR_BLOCK
        return rotate(int.from_bytes(block, "little") * first & M32, turn) * second & M32

    turn, factor, addend = MURMUR_STEP
    h, n = seed & M32, len(data)
    whole = n - n % 4
    for at in range(0, whole, 4):
        h = rotate(h ^ scramble(data[at : at + 4]), turn) * factor + addend & M32
    if whole < n:
        h ^= scramble(data[whole:])
    h ^= n
    for shift, mult in MURMUR_END:
        h = (h ^ h >> shift) * mult & M32
    return h


def murmur32_many(texts: Sequence[str], seed: int = 0) -> np.ndarray:
    """The same of many strings at once: a block of each of them a step."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    width = int(size.max(initial=0)) // 4 + 1
    out = np.empty(len(raw), np.int64)
    if len(raw) > 1 and width * 4 > 64 and len(raw) * width > 1 << 20:  # long strings in parts of their own
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, 2 + len(raw) * width // (1 << 21)):
            if len(part):
                out[part] = murmur32_many([texts[i] for i in part.tolist()], seed)
        return out
    first, turn, second = MURMUR_BLOCK
    block = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in raw), "<u4").reshape(len(raw), width).astype(np.uint64)
    mask = np.uint64(M32)

    def rotate(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint64(r) | v >> np.uint64(32 - r)) & mask

    block = rotate(block * np.uint64(first) & mask, turn) * np.uint64(second) & mask
    h = np.full(len(raw), seed & M32, np.uint64)
    turn, factor, addend = MURMUR_STEP
    for i in range(width):
        h = np.where(i < size // 4, rotate(h ^ block[:, i], turn) * np.uint64(factor) + np.uint64(addend) & mask, h)
    h ^= block[np.arange(len(raw)), size // 4]  # the rest; a rest of no bytes is 0
    h ^= size.astype(np.uint64)
    for shift, mult in MURMUR_END:
        h = (h ^ h >> np.uint64(shift)) * np.uint64(mult) & mask
    return h.astype(np.int64)


def murmur32_udf(seed: int = 0):
    """Arrow UDF string -> bigint over whole batches."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        known = s.dropna().unique()
        return s.map(dict(zip(known, murmur32_many(list(known), seed).tolist(), strict=True))).astype("Int64")

    return run


def murmur32_sql(text: str, seed: int = 0) -> str:
    """The same as SQL of an ASCII string."""
    first, turn, second = MURMUR_BLOCK
    step, factor, addend = MURMUR_STEP

    def rotate(v: str, r: int) -> str:
        return f"((({v} << {r}) | ({v} >> {32 - r})) & {M32})"

    def scramble(v: str) -> str:
        return f"({rotate(f'(({v} * {first}) & {M32})', turn)} * {second} & {M32})"

    def byte(at: str) -> str:
        return f"CASE WHEN {at} <= length({text}) THEN ord(substr({text}, CAST({at} AS BIGINT), 1)) ELSE 0 END::HUGEINT"

    whole = f"(length({text}) // 4)"
    word = lambda i: f"({' + '.join(f'({byte(f'(4 * {i} + {j + 1})')}) * {1 << 8 * j}' for j in range(4))})"
    mixed = f"list_reduce(list_prepend({seed & M32}::HUGEINT, list_transform(range({whole}), lambda i: {scramble(word('i'))})), lambda h, k: ({rotate('xor(h, k)', step)} * {factor} + {addend}) & {M32})"
    h = f"xor(xor({mixed}, {scramble(word(whole))}), length({text})::HUGEINT)"
    for shift, mult in MURMUR_END:
        h = f"list_transform([{h}], lambda v: (xor(v, v >> {shift}) * {mult}) & {M32})[1]"
    return f"({h})::BIGINT"


def pair_key(h1: Column, h2: Column) -> Column:
    """The 32-bit key of a pair of hashes."""
    return F.pmod(101 * h1 + h2, F.lit(1 << 32))


def pair_keys(a: Sequence[str], b: Sequence[str], seed: int) -> np.ndarray:
    words = list(dict.fromkeys([*a, *b]))
    known = dict(zip(words, murmur32_many(words, seed).tolist(), strict=True))
    return np.array([(101 * known[x] + known[y]) & M32 for x, y in zip(a, b, strict=True)], np.int64)
