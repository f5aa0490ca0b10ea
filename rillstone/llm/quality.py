"""Quality classifier from weak labels.

Six heuristic labellers vote good, bad or nothing on every document. Expectation-
maximisation (each labeller votes independently given the hidden class; not to vote says
nothing) estimates the share of good documents and each labeller's rates; it runs on the
counts of vote patterns over all documents, at most 3^6 rows. The posterior of a
document's pattern is its soft label. On a sample of about `sample` documents with these
labels a linear scorer over hashed features (shapes of words, repetition of words,
marks) is trained by logistic loss. The scorer alone then judges every whole text; a
text with a score below 0.5 is rejected.

Defined results: a null text, or one without a word, has score 0 and is rejected; a
score of just 0.5 accepts; repeated rows are judged each; an empty table gives no rows
and an empty scorer; null doc_ids are judged like others; very long texts are read
whole, in slices of an Arrow batch; further columns are ignored (`keep_accepted`: kept).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import text_slices
from .wordhash import mix, span_hashes, words
from .worker import kernel

LABELLERS = ("marks", "capitals", "repeats", "word_length", "short_words", "variety")
BITS = 14

# classes of bytes in a word's shape: lower, upper, digit, common and other marks
_SHAPE = np.full(256, ord("#"), np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
for _c in b".,;:'\"-()":
    _SHAPE[_c] = ord(".")


class Facts:
    """Counts for each text that the labellers and the scorer's features rest on."""

    def __init__(self, texts: list[str | None]):
        _, self.start, self.end, self.hash, self.n = words(texts)
        self.raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "replace") for t in texts), np.uint8)
        self.first = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        self.shape = _SHAPE[self.raw]
        self.same = np.zeros(len(self.hash), bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.owner[1:] == self.owner[:-1])

    def inside(self, mask: np.ndarray) -> np.ndarray:
        """For each text the number of its words' bytes under the mask."""
        total = np.concatenate(([0], np.cumsum(mask)))
        return self.per_text(total[self.end] - total[self.start])

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, minlength=len(self.n))


def votes(f: Facts) -> np.ndarray:
    """+1 good, -1 bad, 0 nothing; one column for each labeller."""
    n = np.maximum(f.n, 1)
    size = np.maximum(f.inside(np.ones(len(f.raw), bool)), 1)
    letters = np.maximum(f.inside((f.shape == ord("a")) | (f.shape == ord("A"))), 1)
    length = f.end - f.start
    window = np.zeros(len(f.hash))  # words that occurred among the three before
    for back in (1, 2, 3):
        window[back:] = np.maximum(window[back:], (f.hash[back:] == f.hash[:-back]) & (f.owner[back:] == f.owner[:-back]))
    marks = f.inside(f.shape == ord("#")) / size
    capitals = f.inside(f.shape == ord("A")) / letters
    repeats = f.per_text(f.same.astype(float)) / n
    mean = f.per_text(length.astype(float)) / n
    short = f.per_text((length <= 4).astype(float)) / n
    near = f.per_text(window) / n

    def vote(x: np.ndarray, good: float, bad: float) -> np.ndarray:
        low = np.where(x < good, 1, np.where(x > bad, -1, 0)) if good <= bad else np.where(x > good, 1, np.where(x < bad, -1, 0))
        return np.where(f.n > 0, low, -1)

    out = [vote(marks, 0.01, 0.03), vote(capitals, 0.15, 0.3), vote(repeats, 0.03, 0.1), np.where((mean >= 3) & (mean <= 9), 1, -1), vote(short, 0.25, 0.12), vote(near, 0.1, 0.25)]
    out[3] = np.where(f.n >= 5, out[3], 0)
    out[4] = np.where(f.n >= 10, out[4], 0)
    return np.stack(out, 1).astype(np.int8)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """By EM: the posterior probability of good for each vote pattern, the share of
    good documents, and each labeller's rates among those it votes on (class good or
    bad; vote -1, 0, +1, where 0 has rate 1).

    Starts from the votes for bad, of which two outweigh all others: a labeller looks
    for one kind of fault and finds none in texts with another. Rates are smoothed by
    one pseudo-document for each vote.
    """
    n = patterns.shape[1]
    good = np.choose(np.minimum((patterns == -1).sum(1), 2), [0.9, 0.5, 0.1])
    share, rates = 0.5, np.ones((2, n, 3))
    for _ in range(rounds):
        share = float((counts @ good + 1) / (counts.sum() + 2))
        for c, weight in enumerate((good, 1 - good)):
            seen = np.array([[counts @ (weight * (patterns[:, j] == v)) + 1 for v in (-1, 1)] for j in range(n)])
            rates[c][:, [0, 2]] = seen / seen.sum(1, keepdims=True)
        new = posterior_of(patterns, share, rates)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, share, rates


def posterior_of(votes: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """Probability of good."""
    log = np.log(rates)[:, np.arange(votes.shape[1]), votes.astype(np.int64) + 1].sum(2)
    return 1 / (1 + np.exp(np.clip(log[1] + np.log1p(-share) - log[0] - np.log(share), -700, 700)))


def features(f: Facts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the texts: text, bucket, value (share of the text's words and
    ten more, so that a few words weigh little).

    A word has its shape (runs of a byte class count once) and, if it repeats the one
    before it, a repetition feature with that shape; its length class is one more.
    """
    start = np.zeros(len(f.raw) + 1, bool)
    start[f.start] = True
    change = np.ones(len(f.raw), bool)
    change[1:] = f.shape[1:] != f.shape[:-1]
    keep = change | start[:-1]
    place = np.concatenate(([0], np.cumsum(keep)))
    shape = span_hashes(f.shape[keep], place[f.start], place[f.end])
    length = np.minimum(f.end - f.start, 30).astype(np.uint64)
    all_h = np.concatenate((shape, mix(length + np.uint64(1 << 40)), mix(shape[f.same] + np.uint64(7))))
    owner = np.concatenate((f.owner, f.owner, f.owner[f.same]))
    code = owner * (1 << BITS) + (all_h >> np.uint64(64 - BITS)).astype(np.int64)
    uniq, count = np.unique(code, return_counts=True)
    text = uniq >> BITS
    return text, uniq & ((1 << BITS) - 1), count / (f.n + 10)[text]


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 400, rate: float = 2.0, l2: float = 1e-5) -> np.ndarray:
    """Weights by full-batch gradient steps with momentum; both classes weigh the same.
    There is no intercept, so a text with little evidence stays near the middle."""
    weight = np.zeros(1 << BITS)
    if not len(x):
        return weight
    rows = np.repeat(np.arange(len(x)), [len(b) for b, _ in x])
    bucket, value = np.concatenate([b for b, _ in x]), np.sqrt(np.concatenate([v for _, v in x]))
    balance = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    speed = np.zeros_like(weight)
    for _ in range(rounds):
        z = np.bincount(rows, weight[bucket] * value, minlength=len(x))
        g = balance * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        step = np.bincount(bucket, g[rows] * value, minlength=1 << BITS)
        speed = 0.9 * speed - rate * (step + l2 * weight)
        weight += speed
    return weight


@dataclass
class Scorer:
    weight: np.ndarray
    share: float
    rates: np.ndarray


def scores(texts: list[str | None], scorer: Scorer) -> np.ndarray:
    f, weight = Facts(texts), scorer.weight
    text, bucket, value = features(f)
    z = np.bincount(text, weight[bucket] * np.sqrt(value), minlength=len(texts))
    return np.where(f.n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def fit(docs: DataFrame, sample: int = 6000) -> Scorer:
    """The linear scorer, with the labellers' rates. All documents count for the
    labellers; the scorer is trained on about `sample` of them, drawn by a hash of
    doc_id and text. Features of at most 2 * sample reach the driver, those of the least
    hashes (more are drawn only where many rows are equal)."""

    def count(batches):
        total: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), 500_000):
                kinds, n = np.unique(votes(Facts(texts)), axis=0, return_counts=True)
                for k, c in zip(map(tuple, kinds.tolist()), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in total], pa.list_(pa.int32())), pa.array(list(total.values()), pa.int64())], ["votes", "n"])

    found = docs.select("text").mapInArrow(kernel(count), "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: r["votes"])
    kinds = np.array([r["votes"] for r in found], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([r["n"] for r in found], float)
    good, share, rates = fit_labellers(kinds, counts)
    posterior = {tuple(k): p for k, p in zip(kinds.tolist(), good.tolist(), strict=True)}
    part = min(1.0, sample / max(counts.sum(), 1))

    def learn(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), 500_000):
                f = Facts(texts)
                y = np.array([posterior[tuple(v)] for v in votes(f).tolist()])
                text, bucket, value = features(f)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                some = np.flatnonzero(f.n).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(lo, hi - lo).take(pa.array(some, pa.int64())), pa.array([bucket[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in some], pa.binary()), pa.array([value[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()), pa.array(y[some])], ["h", "b", "v", "y"])

    drawn = docs.select("text", F.xxhash64("doc_id", "text", F.lit(8)).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = drawn.select("h", "text").mapInArrow(kernel(learn), "h long, b binary, v binary, y double").orderBy("h", "b", "v").limit(2 * sample).collect()
    weight = train([(np.frombuffer(r["b"], np.int32), np.frombuffer(r["v"])) for r in rows], np.array([r["y"] for r in rows]))
    return Scorer(weight, share, rates)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, accepted of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), 500_000):
                s = scores(texts, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s), pa.array(s >= 0.5)], ["doc_id", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(kernel(run), "doc_id long, score double, accepted boolean")


def keep_accepted(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The accepted rows of docs, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column("text"), 500_000):
                yield batch.slice(lo, hi - lo).filter(pa.array(scores(texts, shared.value) >= 0.5))

    return docs.mapInArrow(kernel(run), docs.schema)
