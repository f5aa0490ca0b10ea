"""Streaming PMI by skip-grams with negative sampling in bounded memory.

Each pair of a forward window is a positive example of its own indicator feature, and
`negatives` pairs with one side drawn from a unigram reservoir are negative ones; the
active-set classifier over these features holds the k pairs of largest weight, which
tend to their PMI (less the logarithm of `negatives`).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import pair_keys
from ..session import kernel, map_rows
from .heaps import TokenReservoir
from .learners import ActiveSet, Spec


class StreamingPmi:
    """State: active set, sketch, reservoir, the open window and the draws."""

    def __init__(self, k: int = 1024, log2_width: int = 12, depth: int = 1, negatives: int = 5, window: int = 5, reservoir: int = 4000, seed: int = 0, rate: float = 0.1, l2: float = 1e-7):
        if window < 0 or negatives < 0 or reservoir < 1:
            raise ValueError("need window >= 0, negatives >= 0, reservoir >= 1")
        self.negatives, self.window, self.seed = negatives, window, seed
        self.model = ActiveSet(Spec("active_set", k=k, log2_width=log2_width, depth=depth, seed=seed, rate=rate, l2=l2))
        self.draws = np.random.Generator(np.random.Philox(seed))
        self.drawn: list[float] = []
        self.tokens = TokenReservoir(reservoir, self.uniform)
        self.seen = 0
        self.held: list[str] = []

    def uniform(self) -> float:
        """The next number in [0, 1), drawn many at a time."""
        if not self.drawn:
            self.drawn = self.draws.random(4096)[::-1].tolist()
        return self.drawn.pop()

    def update(self, token: str) -> list[tuple[str, str, bool]]:
        """Examples that a token completes; empty tokens are dropped."""
        if not token:
            return []
        self.seen += 1
        self.tokens.update(token)
        self.held = [*self.held[-self.window :], token] if self.window else [token]
        if len(self.held) < self.window + 1:
            return []
        return [e for b in self.held[1:] for e in self._with_negatives(self.held[0], b)]

    def flush(self) -> list[tuple[str, str, bool]]:
        """End of a sentence: the pairs that are left; nothing crosses it."""
        held = self.held[1:] if len(self.held) == self.window + 1 else self.held
        self.held = []
        return [e for i, a in enumerate(held) for b in held[i + 1 :] for e in self._with_negatives(a, b)]

    def _with_negatives(self, a: str, b: str) -> Iterable[tuple[str, str, bool]]:
        yield a, b, True
        for _ in range(self.negatives):
            if self.uniform() < 0.5:
                yield a, self.tokens.sample(), False
            else:
                yield self.tokens.sample(), b, False

    def learn(self, sentences: Iterable[list[str]]) -> None:
        examples = []
        for words in sentences:
            for w in words:
                examples += self.update(w)
            examples += self.flush()
            if len(examples) > 20_000:
                self._learn(examples)
                examples = []
        self._learn(examples)

    def _learn(self, examples: list[tuple[str, str, bool]]) -> None:
        if not examples:
            return
        model = self.model
        pairs = list(dict.fromkeys((a, b) for a, b, _ in examples))
        at = {p: i for i, p in enumerate(pairs)}
        model.bind(pairs, pair_keys([a for a, _ in pairs], [b for _, b in pairs], self.seed))
        labels = [int(real) for *_, real in examples]
        place = np.array([at[a, b] for a, b, _ in examples], np.int64)
        model.learn_bound(labels, np.arange(len(examples) + 1), place, np.ones(len(examples)))

    def top(self, positive: bool = True) -> list[tuple[str, str, float]]:
        keys, w = self.model.weights()
        rows = sorted(((a, b, float(x)) for (a, b), x in zip(keys, w, strict=True)), key=lambda r: (-abs(r[2]), r[0], r[1]))
        return [r for r in rows if r[2] >= 0] if positive else rows


#: Between the words of a line on their way to the kernel; no word between white space holds it.
BETWEEN = "\n"
#: Batches of examples of a model that learns beside the thread that makes them.
BATCHES = 4


def fit_pmi(lines: DataFrame, shards: int = 1, **params) -> DataFrame:
    """shard, a, b, weight, num_tokens of lines (doc, line, tokens) in order of (doc,
    line). With several shards each learns from a part of the documents in parallel.

    `StreamingPmi` says what is learned; the examples go one by one through the same rules
    in the executors' JVM (PmiKernel.java), where one takes tens of nanoseconds. One model alone
    learns in a second thread of its task, at most `BATCHES` batches behind the words; shards
    keep to a thread each. Tokens must not hold newlines.
    """
    m = StreamingPmi(**params)
    spec, key = m.model.spec, m.draws.bit_generator.state["state"]["key"]
    numbers = [spec.k, spec.log2_width, spec.depth, m.negatives, m.window, m.tokens.capacity, m.seed % (1 << 32), float(spec.rate), float(spec.l2), *key.tolist(), BATCHES if shards == 1 else 1]
    run = kernel(lines.sparkSession, "PmiKernel", " ".join(map(repr, numbers)), " ".join(map(str, m.model.hash.table.ravel().tolist())))
    part = F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(shards)).cast("int")
    text = F.array_join("tokens", BETWEEN).alias("text")
    ordered = lines.select(part.alias("shard"), "doc", "line", text).repartitionById(shards, "shard").sortWithinPartitions("shard", "doc", "line")
    return map_rows(ordered.select("shard", "text"), run, "shard int, a string, b string, weight double, num_tokens bigint")
