"""Word-cached tokenization: texts are cut where every tokenizer of a family cuts,
each distinct chunk is encoded once per cache generation, and ids are gathered with
numpy. The result equals that of encoding the whole text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides blank and newline, as str.isspace() has it.
_OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Python counts these as white space, the tokenizers' patterns don't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def split_blanks(text: str) -> list[str] | None:
    """Chunks of the byte-level family: a blank belongs to the word behind it.

    Every chunk border is a border between matches of the split pattern, because a
    blank or newline between two other characters always starts a match, and runs
    of white space are cut as the pattern cuts them. None: encode the text whole.
    """
    for c in _SEPARATORS:
        if c in text:
            return None
    plain = "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text and "\0" not in text
    if plain and text and text[0] not in " \n" and text[-1] not in " \n" and not any(c in text for c in _OTHER_SPACE):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return _SPACED.findall(text)


def split_words(text: str) -> list[str] | None:
    """Chunks of tokenizers that drop white space. None: encode the text whole."""
    for c in _SEPARATORS:
        if c in text:
            return None
    return text.split()


class Lexicon(dict):
    """Numbers of chunks, by first sight. `new` lists what has come since the last
    `settle`, which keeps of it what there is room for and forgets the rest."""

    def __init__(self, cap: int, longest: int = 256):
        super().__init__()
        self.cap, self.longest, self.n = cap, longest, 0
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self.n
        self.n += 1
        self.new.append(chunk)
        self[chunk] = code
        return code

    def settle(self) -> list[int]:
        """Which of `new` stay; they are numbered anew, in order."""
        new, first = self.new, self.n - len(self.new)
        room = max(self.cap - first, 0)
        keep = [i for i, chunk in enumerate(new) if len(chunk) <= self.longest][:room]
        if len(keep) < len(new):
            for chunk in new:
                del self[chunk]
            self.update((new[i], first + j) for j, i in enumerate(keep))
        self.n, self.new = first + len(keep), []
        return keep


class ChunkCoder:
    """Encodes texts by distinct chunks.

    `encode` gives the ids of chunks, one behind the other, and the number of each.
    The first `cap` chunks are kept; later ones are encoded once for each call and
    forgotten. Where over a third of a call's chunks are not kept, the texts have
    changed and the cache starts anew. So memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], split: Callable[[str], list[str] | None], cap: int = 500_000):
        self.encode_many, self.split, self.cap = encode, split, cap
        self.reset()

    def reset(self) -> None:
        self.codes = Lexicon(self.cap)
        self.used = 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)

    def _forget(self) -> None:
        """Keep of this call's new chunks what there is room for."""
        first, base = self.codes.n - len(self.codes.new), self.base
        keep = self.codes.settle()
        rows = np.array(keep, np.int64) + first
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(keep) else 0
        self.flat[base : base + total] = self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)]
        self.starts[first : first + len(keep)], self.sizes[first : first + len(keep)] = base + ends - sizes, sizes
        self.used = base + total

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.empty(max(n, 2 * len(a)), a.dtype)
        b[: len(a)] = a
        return b

    def _learn(self) -> None:
        new = self.codes.new
        first = self.codes.n - len(new)
        for lo in range(0, len(new), 20_000):
            ids, sizes = self.encode_many(new[lo : lo + 20_000])
            at, total = first + lo, len(ids)
            self.flat = self._room(self.flat, self.used + total)
            self.starts = self._room(self.starts, at + len(sizes))
            self.sizes = self._room(self.sizes, at + len(sizes))
            self.flat[self.used : self.used + total] = ids
            self.sizes[at : at + len(sizes)] = sizes
            self.starts[at : at + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.used += total

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the number of ids of each."""
        chunks: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.split(text) if text else []
            if own is None:
                own = [text]
            chunks += own
            counts[i] = len(own)
        kept = self.codes.n
        codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
        self.base = self.used
        if self.codes.new:
            self._learn()
        sizes = self.sizes[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        if self.codes.new:
            stale = kept >= self.cap and 3 * np.count_nonzero(codes >= kept) > len(codes)
            self.reset() if stale else self._forget()
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])


def text_slices(column: pa.Array, most: int = 500_000):
    """Ranges of rows of about `most` bytes, at least one row each, with their texts; so
    only a slice of an Arrow batch lives as Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo = hi


#: What the libraries' patterns keep apart from a word before and behind it, and words
#: (with a blank before them or none) that are followed by it, by kind.
_APART = {"blanks": "\n", "words": " \x01 "}
_WORDS = {"blanks": re.compile(r"(?: ?\S+\n)+"), "words": re.compile(r"(?:[^\s\x01]+ \x01 )+")}


class _Library:
    """Encodes chunks with a file of the tokenizers library, words many at a time."""

    def __init__(self, path: str, kind: str, special_as_text: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.apart, self.words = _APART[kind], _WORDS[kind]
        found = self.tok.encode(self.apart, add_special_tokens=False).ids
        self.border = found[0] if len(found) == 1 else None
        self.special = [] if special_as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        split = {"blanks": split_blanks, "words": split_words}[kind]
        # a text with the string of a special token is encoded whole
        self.split = lambda text: None if any(s in text for s in self.special) else split(text)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded a hundred at a time with a border behind each, whose id
        tells them apart; where that fails, each chunk by itself."""
        if self.border is None:
            return self._each(chunks)
        slabs = [chunks[lo : lo + 100] for lo in range(0, len(chunks), 100)]
        joined = [self.apart.join(x) + self.apart for x in slabs]
        fit = [bool(self.words.fullmatch(x)) for x in joined]
        found = iter(self.tok.encode_batch_fast([x for x, ok in zip(joined, fit, strict=True) if ok], add_special_tokens=False))
        out = []
        for slab, ok in zip(slabs, fit, strict=True):
            if ok:
                ids = np.array(next(found).ids, np.uint32)
                ends = np.flatnonzero(ids == self.border)
                if len(ends) == len(slab):
                    out.append((np.delete(ids, ends), np.diff(ends, prepend=-1) - 1))
                    continue
            out.append(self._each(slab))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])


#: Chunks that a worker keeps with their ids, about 150 bytes each.
CACHE = 1_000_000
_coders: dict[tuple[str, str, bool, int], ChunkCoder] = {}


def drop_coders() -> None:
    _coders.clear()


def library_coder(path: str, kind: str, special_as_text: bool = False, cache: int = CACHE) -> ChunkCoder:
    """The process's coder over a file of the tokenizers library; kind: blanks or words.

    Strings of special tokens in a text get their ids, as the library does it, unless
    `special_as_text`. `cache` bounds memory, ids don't depend on it. Kernels that use it name it as their caches (`worker.kernel`).
    """
    key = path, kind, special_as_text, cache
    if key not in _coders:
        own = _Library(path, kind, special_as_text)
        _coders[key] = ChunkCoder(own.encode, own.split, cache)
    return _coders[key]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one more id behind each."""
    return np.insert(ids, np.cumsum(sizes), end) if len(sizes) else ids, sizes + 1
