"""One-pass linear classifiers with a memory budget, as kernels over ordered batches.

A kernel takes examples as flat arrays (labels, offsets, keys, values), learns in
order, and returns the predictions made before each example was learned. Weights are
kept without the L2 factor: with c = rate * l2 the factor after step t is
(1 - c) / (1 + c t), and the step on unscaled weights is the constant rate / (1 - c),
so neither products underflow nor orders change. Repeated keys in an example count as
one with the sum of their values.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Hashable, Sequence
from dataclasses import asdict, dataclass, fields
from typing import Protocol

import numpy as np

from ..functions.hashes import PolynomialHash, TabulationHash
from .heaps import CountHeap, MagnitudeHeap, WeightedReservoir


@dataclass(frozen=True)
class Spec:
    """A method with its parameters; defaults are those of the command line."""

    method: str = "active_set"
    k: int = 512
    log2_width: int = 10
    depth: int = 1
    seed: int = 0
    rate: float = 0.1
    l2: float = 1e-6
    power: float = 1.0
    smooth: float = 1.0
    conservative: bool = False
    median: bool = False
    no_bias: bool = False
    exact_hash: bool = False  # bucket = key (tests of collision-free sketches)

    def __post_init__(self):
        if self.k < 1 or self.depth < 1 or not 0 <= self.log2_width <= 30 or self.depth << self.log2_width > 1 << 27:
            raise ValueError("need k >= 1, depth >= 1, log2_width 0 to 30 and 2^27 cells at most")
        if not 0 <= self.rate * self.l2 < 1 or self.rate <= 0:
            raise ValueError("need rate > 0 and 0 <= rate * l2 < 1")


class Estimator(Protocol):
    """What every learner offers."""

    def learn(self, labels: np.ndarray, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray: ...
    def weights(self) -> tuple[np.ndarray, np.ndarray]: ...
    def predict(self, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray: ...
    def update(self, label: int, features: dict[int, float]) -> bool: ...
    def predict_one(self, features: dict[int, float]) -> bool: ...
    def get(self, key: int) -> float: ...


def merged(offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Examples in which each key stands once, at its first place, with summed values."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(keys):
        low, span = int(keys.min()), int(keys.max()) - int(keys.min()) + 1
        if span < (1 << 62) // len(offsets):  # one number for each row and key
            code = np.sort(row * span + (keys - low))
            if not (code[1:] == code[:-1]).any():
                return offsets, keys, values
    order = np.lexsort((keys, row))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    if not same.any():
        return offsets, keys, values
    starts = np.flatnonzero(~same)
    total = np.add.reduceat(values[order], starts)
    first = np.minimum.reduceat(order, starts)
    back = np.argsort(first)
    kept = first[back]
    return np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=len(offsets) - 1)))), keys[kept], total[back]


def _gradient(x: float) -> float:
    """-sigmoid(-x), without overflow."""
    return -1 / (1 + math.exp(x)) if x < 700 else 0.0


class Learner:
    """Step count, bias, decay and the loop; subclasses keep the weights."""

    skips_empty = False

    def __init__(self, spec: Spec):
        self.spec = spec
        self.t, self.bias = 0, 0.0
        self.c = spec.rate * spec.l2
        self.step = spec.rate / (1 - self.c)
        rng = np.random.Generator(np.random.Philox(spec.seed % (1 << 64)))
        self._draws = rng
        self.setup()

    def setup(self) -> None: ...

    @property
    def scale(self) -> float:
        return (1 - self.c) / (1 + self.c * (self.t - 1))

    def uniform(self) -> float:
        """A number in (0, 1]."""
        return 1.0 - self._draws.random()

    # a subclass binds a batch's distinct keys, then serves single examples
    def bind(self, distinct: Sequence[Hashable] | np.ndarray) -> None: ...

    def margin(self, at: np.ndarray, v: np.ndarray) -> float:
        raise NotImplementedError

    def change(self, at: np.ndarray, v: np.ndarray, u: float) -> None:
        """Learn: weights fall by u * v."""
        raise NotImplementedError

    def learn(self, labels: np.ndarray, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        offsets, keys, values = merged(offsets, keys, np.asarray(values, float))
        distinct, at = np.unique(keys, return_inverse=True)
        self.bind(distinct)
        return self.learn_bound(labels, offsets, at, values)

    def learn_bound(self, labels: np.ndarray, offsets: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """`learn` for keys that are bound; `at` numbers them."""
        out = np.empty(len(labels), bool)
        ends = offsets.tolist()
        for i, label in enumerate(np.asarray(labels).tolist()):
            lo, hi = ends[i], ends[i + 1]
            if lo == hi and self.skips_empty:
                out[i] = self.bias >= 0
                continue
            a, v = at[lo:hi], values[lo:hi]
            z = self.scale * self.margin(a, v) + self.bias if hi > lo else self.bias
            y = 1 if label == 1 else -1
            g = _gradient(y * z)
            if hi > lo:
                self.change(a, v, self.step * y * g)
            else:
                self.touch()
            if not self.spec.no_bias:
                self.bias -= self.spec.rate / (1 + self.c * self.t) * y * g
            self.t += 1
            out[i] = z >= 0
        return out

    def touch(self) -> None: ...

    def predict(self, offsets: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        offsets, keys, values = merged(offsets, keys, np.asarray(values, float))
        distinct, at = np.unique(keys, return_inverse=True)
        self.bind(distinct)
        z = [self.scale * self.margin(at[a:b], values[a:b]) + self.bias if b > a else self.bias for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.array(z) >= 0

    def update(self, label: int, features: dict[int, float]) -> bool:
        """Learn one example; returns what was predicted before."""
        keys = np.array(list(features), np.int64)
        return bool(self.learn(np.array([label]), np.array([0, len(keys)]), keys, np.array(list(features.values()), float))[0])

    def predict_one(self, features: dict[int, float]) -> bool:
        keys = np.array(list(features), np.int64)
        return bool(self.predict(np.array([0, len(keys)]), keys, np.array(list(features.values()), float))[0])

    def get(self, key: int) -> float:
        """The current weight of a key, or its estimate; 0 for a key that was never seen."""
        self.bind(np.array([key], np.int64))
        return self.scale * self.margin(np.zeros(1, np.int64), np.ones(1))

    def stored(self) -> tuple[list[Hashable], list[float]]:
        """Keys and unscaled weights that a report shows."""
        raise NotImplementedError

    def weights(self) -> tuple[list[Hashable], np.ndarray]:
        keys, w = self.stored()
        return keys, np.asarray(w, float) * self.scale

    def top(self) -> list[tuple[Hashable, float]]:
        keys, w = self.weights()
        return sorted(zip(keys, w.tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))[: self.spec.k]

    def dump(self) -> bytes:
        return pickle.dumps(self)


class Logistic(Learner):
    """All weights, one for each key seen."""

    def setup(self) -> None:
        self.row: dict[Hashable, int] = {}
        self.w = np.zeros(1024)

    def bind(self, distinct) -> None:
        row = self.row
        for k in distinct.tolist():
            if k not in row:
                row[k] = len(row)
        if len(row) > len(self.w):
            self.w = np.concatenate((self.w, np.zeros(max(len(row), len(self.w)))))
        self.at = np.array([row[k] for k in distinct.tolist()], np.int64)

    def margin(self, at, v) -> float:
        return float(self.w[self.at[at]] @ v)

    def change(self, at, v, u) -> None:
        self.w[self.at[at]] -= u * v

    def stored(self):
        return list(self.row), self.w[: len(self.row)]


class _Stored(Learner):
    """Weights that live in a bounded store alone; all others are 0."""

    def bind(self, distinct) -> None:
        self.keys = distinct.tolist()

    def margin(self, at, v) -> float:
        get, keys = self.store.get, self.keys
        return sum(get(keys[i]) * x for i, x in zip(at.tolist(), v.tolist(), strict=True))

    def stored(self):
        items = self.store.items()
        return [k for k, _ in items], [w for _, w in items]


class Truncated(_Stored):
    """The k largest weights; what falls out is forgotten."""

    def setup(self) -> None:
        self.store = MagnitudeHeap(self.spec.k)

    def change(self, at, v, u) -> None:
        store, keys = self.store, self.keys
        for i, x in zip(at.tolist(), v.tolist(), strict=True):
            store.insert_or_change(keys[i], store.get(keys[i]) - u * x)


class ProbabilisticTruncated(Truncated):
    """As `Truncated`, but what stays is drawn by a weighted reservoir."""

    def setup(self) -> None:
        self.store = WeightedReservoir(self.spec.k, self.uniform, self.spec.power)


class SpaceSaving(_Stored):
    """The features of a Space-Saving summary; one replacement for each example."""

    def setup(self) -> None:
        self.store = CountHeap(self.spec.k)

    def change(self, at, v, u) -> None:
        store, keys = self.store, [self.keys[i] for i in at.tolist()]
        unseen = []
        for k in keys:
            if k in store:
                store.increment(k)
            elif not store.full:
                store.insert(k, 1, 0.0)
            else:
                unseen.append(k)
        if unseen:
            pick = unseen[min(int(self._draws.random() * len(unseen)), len(unseen) - 1)]
            least, _ = store.first()
            store.pop()
            store.insert(pick, least + 1, 0.0)
        for k, x in zip(keys, v.tolist(), strict=True):
            if k in store:
                store.change(k, store.count(k), store.get(k) - u * x)


class _Sketched(Learner):
    """Places of keys in a sketch of depth rows."""

    family = PolynomialHash

    def hashing(self, log2_width: int) -> None:
        self.hash = self.family(self.spec.depth, self.spec.seed)
        self.width = 1 << log2_width

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat cells and signs, depth rows by keys."""
        base = np.arange(self.spec.depth)[:, None] * self.width
        if self.spec.exact_hash:
            return base + (np.asarray(keys, np.int64) & self.width - 1)[None, :], np.ones((self.spec.depth, len(keys)))
        h = self.hash.numpy(np.asarray(keys, np.int64))
        return base + (h & self.width - 1), np.where(h >> 31 & 1, 1.0, -1.0)


class CountMin(_Sketched, _Stored):
    """The most frequent features by a Count-Min sketch."""

    family = PolynomialHash

    def setup(self) -> None:
        self.store = CountHeap(self.spec.k)
        self.hashing(self.spec.log2_width)
        self.counts = np.zeros(self.spec.depth * self.width, np.int64)

    def bind(self, distinct) -> None:
        super().bind(distinct)
        self.cell, _ = self.places(distinct)

    def change(self, at, v, u) -> None:
        store, index, counts = self.store, at.tolist(), self.counts
        for i in index:
            if self.keys[i] in store:
                store.increment(self.keys[i])
            c = self.cell[:, i]
            if self.spec.conservative:
                x = counts[c]
                counts[c] = np.maximum(x, x.min() + 1)
            else:
                counts[c] += 1
        for i, x in zip(index, v.tolist(), strict=True):
            k = self.keys[i]
            n = store.count(k) if k in store else int(counts[self.cell[:, i]].min())
            store.insert_or_change(k, n, store.get(k) - u * x)


class SketchedLogistic(_Sketched):
    """All weights in a Count-Sketch; a heap remembers the k largest. The margin uses
    the mean of a key's cells (or the median); depth 1 is feature hashing."""

    family = TabulationHash
    skips_empty = True

    def setup(self) -> None:
        self.hashing(self.spec.log2_width)
        self.table = np.zeros(self.spec.depth * self.width)
        self.heap = MagnitudeHeap(self.spec.k)

    def bind(self, distinct) -> None:
        self.keys = distinct.tolist()
        self.cell, self.sign = self.places(distinct)

    def _estimates(self, at) -> np.ndarray:
        return self.sign[:, at] * self.table[self.cell[:, at]]

    def margin(self, at, v) -> float:
        own = self._estimates(at)
        self.medians = own[0] if len(own) == 1 else np.median(own, 0)
        return float((self.medians if self.spec.median or len(own) == 1 else own.mean(0)) @ v)

    def change(self, at, v, u) -> None:
        np.add.at(self.table, self.cell[:, at], -u * v * self.sign[:, at])
        for i, w in zip(at.tolist(), (self.medians - u * v).tolist(), strict=True):
            self.heap.insert_or_change(self.keys[i], w)

    def stored(self):
        keys = [k for k, _ in self.heap.items()]
        if not keys:
            return [], []
        cell, sign = self.places(np.array(keys))
        return keys, np.median(sign * self.table[cell], 0)


class ActiveSet(_Sketched):
    """Exact weights for an active set of k features, the others in a Count-Sketch.

    Features outside the set offer their new weights in descending size. A newcomer
    that is turned away leaves its gradient in the sketch; a feature that is pushed
    out leaves what its weight differs from its estimate.
    """

    family = TabulationHash
    skips_empty = True

    def setup(self) -> None:
        k = self.spec.k
        self.hashing(self.spec.log2_width)
        self.table = np.zeros(self.spec.depth * self.width)
        self.n = 0
        self.w = np.zeros(k)
        self.who: list[Hashable] = []
        self.slot: dict[Hashable, int] = {}
        self.own_cell = np.zeros((self.spec.depth, k), np.int64)
        self.own_sign = np.zeros((self.spec.depth, k))
        #: No weight of the set is smaller than this.
        self.bound = 0.0

    def learn_bound(self, labels, offsets, at, values):
        if self.spec.depth == 1 and len(labels) and (np.diff(offsets) == 1).all():
            return self._learn_single(np.asarray(labels).tolist(), at.tolist(), values.tolist())
        return super().learn_bound(labels, offsets, at, values)

    def _learn_single(self, labels: list[int], at: list[int], values: list[float]) -> np.ndarray:
        """The same rules for examples of one feature each and a sketch of depth 1, on
        plain numbers; the least weight of the set is followed, not searched."""
        spec, k = self.spec, self.spec.k
        rate, c, step, t, bias = 0.0 if spec.no_bias else spec.rate, self.c, self.step, self.t, self.bias
        table, w, size = self.table.tolist(), self.w.tolist(), np.abs(self.w)
        loc, cell, sign, keys, index = self.loc.tolist(), self.cell[0].tolist(), self.sign[0].tolist(), self.keys, self.index
        own_cell, own_sign, who, slot, n = self.own_cell[0].tolist(), self.own_sign[0].tolist(), self.who, self.slot, self.n
        known, m, least = False, 0, 0.0  # is m the place of the least weight?
        out, exp = [], math.exp
        for label, i, v in zip(labels, at, values, strict=True):
            s = loc[i]
            x = w[s] if s >= 0 else sign[i] * table[cell[i]]
            y = 1 if label == 1 else -1
            z = (1 - c) / (1 + c * (t - 1)) * (x * v) + bias
            out.append(z >= 0)
            g = -1 / (1 + exp(y * z)) if y * z < 700 else 0.0
            new = x - step * y * g * v
            if s >= 0:
                w[s] = new
                size[s] = a = abs(new)
                if a < least or (a == least and s < m):
                    m, least = s, a
                elif s == m:
                    known = False
            else:
                a = abs(new)
                if n < k:
                    s, n = n, n + 1
                    who.append(None)
                    known = False
                else:
                    if not known:
                        m = int(size.argmin())
                        least, known = float(size[m]), True
                    if a >= least:
                        s = m
                        table[own_cell[m]] = own_sign[m] * w[m]
                        gone = who[m]
                        del slot[gone]
                        if (old := index.get(gone)) is not None:
                            loc[old] = -1
                        known = False
                    else:
                        table[cell[i]] -= step * y * g * v * sign[i]
                if s >= 0:
                    w[s], who[s], size[s], slot[keys[i]] = new, keys[i], a, s
                    own_cell[s], own_sign[s], loc[i] = cell[i], sign[i], s
                    least = 0.0
            bias -= rate / (1 + c * t) * y * g
            t += 1
        self.table, self.w, self.loc = np.array(table), np.array(w), np.array(loc, np.int64)
        self.own_cell, self.own_sign = np.array([own_cell], np.int64), np.array([own_sign])
        self.n, self.t, self.bias, self.bound = n, t, bias, 0.0
        return np.array(out, bool)

    def bind(self, distinct, hashed: np.ndarray | None = None) -> None:
        self.keys = distinct.tolist() if isinstance(distinct, np.ndarray) else list(distinct)
        self.index = {k: i for i, k in enumerate(self.keys)}
        self.cell, self.sign = self.places(distinct if hashed is None else hashed)
        get = self.slot.get
        self.loc = np.fromiter((get(k, -1) for k in self.keys), np.int64, len(self.keys))

    def margin(self, at, v) -> float:
        self.s = s = self.loc[at]
        w = self.w[s]
        self.out = out = (s < 0).nonzero()[0]
        if len(out):
            own = self.sign[:, at[out]] * self.table[self.cell[:, at[out]]]
            w[out] = own[0] if len(own) == 1 else np.median(own, 0)
        self.now = w
        return float(w @ v)

    def change(self, at, v, u) -> None:
        s, out = self.s, self.out
        inside = s >= 0
        if len(out) < len(s):
            self.w[s[inside]] -= u * v[inside]
            self.bound -= abs(u) * float(np.abs(v).max())  # no weight falls by more
        if not len(out):
            return
        uv = u * v[out]
        new = self.now[out] - uv
        size = np.abs(new)
        own = at[out]
        if self.n < self.spec.k:
            order = np.argsort(-size, kind="stable")
            turned = order[:0]
            self.bound = 0.0
        else:  # what is below the least weight of the set stays out whatever happens
            if size.max() >= self.bound:
                self.bound = float(np.abs(self.w).min())
            enters = size >= self.bound
            order = enters.nonzero()[0]
            if len(order):
                turned = (~enters).nonzero()[0]
                if len(order) > 1:
                    order = order[np.argsort(-size[order], kind="stable")]
            else:
                turned = slice(None)
        one = self.spec.depth == 1
        for n, j in enumerate(order.tolist()):
            i = int(at[out[j]])
            if self.n < self.spec.k:
                m = self.n
                self.n += 1
                self.who.append(None)
            else:
                m = int(np.abs(self.w).argmin())
                if abs(self.w[m]) > size[j]:
                    turned = np.concatenate((turned, order[n:]))
                    break
                gone, c, g = self.who[m], self.own_cell[:, m], self.own_sign[:, m]
                if one:
                    self.table[c[0]] = g[0] * self.w[m]
                else:
                    est = float(np.median(g * self.table[c]))
                    np.add.at(self.table, c, g * (self.w[m] - est))
                del self.slot[gone]
                if (old := self.index.get(gone)) is not None:
                    self.loc[old] = -1
            self.w[m], self.who[m], self.slot[self.keys[i]] = new[j], self.keys[i], m
            self.own_cell[:, m], self.own_sign[:, m] = self.cell[:, i], self.sign[:, i]
            self.loc[i] = m
        own = own[turned]
        if len(own):
            where = self.cell[0, own] if one else self.cell[:, own]
            np.subtract.at(self.table, where, uv[turned] * (self.sign[0, own] if one else self.sign[:, own]))

    def stored(self):
        return list(self.who), self.w[: self.n]


class PairedCountMin(_Sketched):
    """Log ratios of class frequencies for the k features of largest ratio; it counts
    and does not predict."""

    def setup(self) -> None:
        self.hashing(self.spec.log2_width - 1)
        self.num = np.zeros(self.spec.depth * self.width, np.int64)
        self.den = np.zeros(self.spec.depth * self.width, np.int64)
        self.classes = [0, 0]
        self.heap = MagnitudeHeap(self.spec.k)

    @property
    def scale(self) -> float:
        return 1.0

    def _log_ratio(self, cell: np.ndarray) -> float:
        s = self.spec.smooth
        prior = (self.classes[1] + s) / (self.classes[0] + s)
        return math.log((self.num[cell].min() + s) / (self.den[cell].min() + s) / prior)

    def learn(self, labels, offsets, keys, values):
        distinct, at = np.unique(keys, return_inverse=True)
        cell, _ = self.places(distinct)
        names = distinct.tolist()
        for i, label in enumerate(np.asarray(labels).tolist()):
            self.classes[label == 1] += 1
            own = self.num if label == 1 else self.den
            for j in at[offsets[i] : offsets[i + 1]].tolist():
                c = cell[:, j]
                if self.spec.conservative:
                    own[c] = np.maximum(own[c], own[c].min() + 1)
                else:
                    own[c] += 1
                self.heap.insert_or_change(names[j], self._log_ratio(c))
        return np.ones(len(labels), bool)

    def predict(self, offsets, keys, values):
        return np.ones(len(offsets) - 1, bool)

    def stored(self):
        keys = [k for k, _ in self.heap.items()]
        if not keys:
            return [], []
        cell, _ = self.places(np.array(keys))
        return keys, [self._log_ratio(cell[:, i]) for i in range(len(keys))]


#: Learners by method name.
METHODS: dict[str, type[Learner]] = {
    "logistic": Logistic,
    "logistic_sketch": SketchedLogistic,
    "active_set": ActiveSet,
    "truncated": Truncated,
    "prob_truncated": ProbabilisticTruncated,
    "countmin": CountMin,
    "spacesaving": SpaceSaving,
    "paired_countmin": PairedCountMin,
}


def build(spec: Spec | dict) -> Learner:
    if isinstance(spec, dict):
        unknown = set(spec) - {f.name for f in fields(Spec)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        spec = Spec(**spec)
    if spec.method not in METHODS:
        raise ValueError(f"unknown method {spec.method!r}; one of {', '.join(METHODS)}")
    return METHODS[spec.method](spec)


def restore(state: bytes) -> Learner:
    return pickle.loads(state)


def describe(spec: Spec) -> dict:
    return asdict(spec)
