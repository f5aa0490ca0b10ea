"""Kernels: equivalences, stores, sketches, hashes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.functions.hashes import PolynomialHash, TabulationHash, mt19937, murmur32
from rillstone.operators.association import StreamingPmi
from rillstone.operators.heaps import CountHeap, MagnitudeHeap, TokenReservoir, WeightedReservoir
from rillstone.operators.learners import METHODS, Spec, build, merged, restore

RATE, L2 = 0.2, 1e-2


def stream(n=300, keys=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = [rng.choice(keys, rng.integers(1, 6), replace=False) for _ in range(n)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    k = np.concatenate(rows)
    values = rng.normal(size=len(k))
    truth = rng.normal(size=keys)
    labels = np.array([int(values[a:b] @ truth[k[a:b]] > 0) for a, b in zip(offsets[:-1], offsets[1:])])
    return labels, offsets, k.astype(np.int64), values


def plain(labels, offsets, keys, values):
    """Textbook steps with a running decay, as an independent form."""
    w, bias, scale, said = {}, 0.0, 1.0, []
    for t, label in enumerate(labels):
        x = list(zip(keys[offsets[t] : offsets[t + 1]].tolist(), values[offsets[t] : offsets[t + 1]].tolist()))
        rate = RATE / (1 + RATE * L2 * t)
        z = scale * sum(w.get(k, 0.0) * v for k, v in x) + bias
        y = 1 if label == 1 else -1
        g = -1 / (1 + math.exp(y * z))
        scale *= 1 - rate * L2
        for k, v in x:
            w[k] = w.get(k, 0.0) - rate * y * g * v / scale
        bias -= rate * y * g
        said.append(z >= 0)
    return {k: v * scale for k, v in w.items()}, bias, said


FULL = [("logistic", {}), ("truncated", {}), ("prob_truncated", {}), ("spacesaving", {}), ("countmin", {}), ("active_set", {}), ("active_set", {"k": 4, "exact_hash": True, "log2_width": 6}), ("logistic_sketch", {"exact_hash": True, "log2_width": 6, "depth": 3}), ("logistic_sketch", {"exact_hash": True, "log2_width": 6, "depth": 2, "median": True})]


@pytest.mark.parametrize("method,params", FULL)
def test_methods_equal_plain_logistic_when_nothing_is_lost(method, params):
    data = stream()
    weights, bias, said = plain(*data)
    m = build(Spec(method, **({"k": 64, "rate": RATE, "l2": L2} | params)))
    cut = data[1][150]
    first = m.learn(data[0][:150], data[1][:151], data[2][:cut], data[3][:cut])
    m = restore(m.dump())
    second = m.learn(data[0][150:], data[1][150:] - cut, data[2][cut:], data[3][cut:])
    assert [*first, *second] == said
    assert m.bias == pytest.approx(bias, abs=1e-12)
    for k, w in m.top():
        assert w == pytest.approx(weights[k], abs=1e-12)


@pytest.mark.parametrize("method", list(METHODS))
def test_budget_and_repeatability(method):
    data = stream(seed=2)
    spec = Spec(method, k=5, log2_width=4, depth=2, seed=9)
    a, b = build(spec), build(spec)
    assert a.learn(*data).tolist() == b.learn(*data).tolist()
    assert a.top() == b.top() and len(a.top()) <= 5
    if hasattr(a, "store"):
        assert len(a.store) <= 5
    assert a.predict(*data[1:]).shape == (300,)


def test_empty_examples_follow_each_method():
    for method, moves in (("logistic", True), ("truncated", True), ("spacesaving", True), ("countmin", True), ("active_set", False), ("logistic_sketch", False)):
        m = build(Spec(method, k=4))
        m.learn(np.array([1]), np.array([0, 0]), np.empty(0, np.int64), np.empty(0))
        assert (m.bias != 0) == moves and m.t == int(moves)


def test_odd_labels_train_negative_and_no_bias():
    m = build(Spec("logistic", no_bias=True))
    m.learn(np.array([2]), np.array([0, 1]), np.array([3]), np.ones(1))
    assert m.bias == 0 and m.top()[0][1] < 0


def test_spec_is_checked():
    for bad in ({"k": 0}, {"depth": 0}, {"log2_width": 31}, {"rate": 0}, {"rate": 1.0, "l2": 1.0}, {"log2_width": 27, "depth": 3}):
        with pytest.raises(ValueError):
            Spec(**bad)
    with pytest.raises(ValueError):
        build({"method": "none"})
    with pytest.raises(ValueError):
        build({"methud": "logistic"})


def test_merged_sums_repeated_keys_in_first_place():
    o, k, v = merged(np.array([0, 4, 4, 6]), np.array([7, 3, 7, 1, 3, 3]), np.array([1.0, 2, 3, 4, 5, 6]))
    assert (o.tolist(), k.tolist(), v.tolist()) == ([0, 3, 3, 4], [7, 3, 1, 3], [4, 2, 4, 11])


def test_magnitude_heap_ties_and_errors():
    h = MagnitudeHeap(2)
    h.insert(1, 0.5)
    h.insert(2, -0.2)
    assert h.insert(3, 0.2) == (2, -0.2)
    assert h.insert(4, 0.1) == (4, 0.1)
    assert h.full and 1 in h and 4 not in h and h.get(9) == 0.0
    with pytest.raises(KeyError):
        h.insert(1, 1.0)
    with pytest.raises(KeyError):
        h.change(77, 1.0)
    h.change(1, 0.01)
    assert h.pop() == (1, 0.01) and len(h) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.floats(-5, 5)), max_size=80), st.integers(1, 5))
def test_magnitude_heap_against_a_list(steps, k):
    h, own = MagnitudeHeap(k), {}
    for key, v in steps:
        h.insert_or_change(key, v)
        if key in own or len(own) < k:
            own[key] = v
        else:
            least = min(abs(x) for x in own.values())
            if least <= abs(v):
                gone = next(x for x in own if x not in h)
                assert abs(own.pop(gone)) == least
                own[key] = v
        assert dict(h.items()) == own


def test_count_heap_and_reservoirs():
    h = CountHeap(2)
    h.insert("a", 1, 0.5)
    h.insert("b", 3, 0.1)
    assert h.count("zz") == 0 and "zz" not in h
    assert h.insert("c", 1, 0.0) == ("a", 0.5)
    h.increment("c")
    h.change("c", h.count("c"), 7.0)
    assert (h.count("c"), h.get("c")) == (2, 7.0)
    u = iter(np.random.default_rng(0).random(10_000).tolist())
    w = WeightedReservoir(3, lambda: 1 - next(u), 2.0)
    for i in range(50):
        w.insert_or_change(i % 20, float(i % 7))
    assert len(w) == 3
    t = TokenReservoir(10, lambda: next(u))
    for i in range(7):
        t.update(str(i))
    assert len(t.slots) == 7
    for i in range(100):
        t.update(str(i))
    assert len(t.slots) == 10 and t.sample() in t.slots


def test_hashes():
    assert mt19937(5489, 1) == [3499211612]
    assert mt19937(-1, 1) == mt19937((1 << 32) - 1, 1)
    p = PolynomialHash(2, 3)
    for x in (0, 1, 1 << 31, (1 << 32) - 1):
        for i, (a, b) in enumerate(p.pairs):
            v = (a * x + b) % (1 << 64)
            assert p.numpy(np.array([x]))[i, 0] == ((v >> 31) + v) % (1 << 64) & 0x7FFFFFFF
    t = TabulationHash(2, 3)
    assert t.numpy(np.array([0x01020304]))[1, 0] == t.table[0, 4, 1] ^ t.table[1, 3, 1] ^ t.table[2, 2, 1] ^ t.table[3, 1, 1]
    # published test values of the algorithm
    assert [murmur32(b, s) for b, s in ((b"", 0), (b"", 1), (b"test", 0x9747B28C), (b"Hello, world!", 0x9747B28C), (b"aaa", 0x9747B28C))] == [0, 0x514E28B7, 0x704B81DC, 0x24884CBA, 0x283E0130]


def test_streaming_pairs_are_all_forward_pairs():
    for window, n in ((0, 4), (1, 1), (2, 4), (2, 2), (5, 3), (3, 9)):
        m = StreamingPmi(window=window, negatives=0)
        words = [f"w{i}" for i in range(n)]
        got = [p for w in words for p in m.update(w)] + m.flush()
        assert sorted((a, b) for a, b, _ in got) == sorted((words[i], words[j]) for i in range(n) for j in range(i + 1, min(i + window, n - 1) + 1))
    assert StreamingPmi().update("") == []


def test_pmi_finds_associated_pairs():
    rng = np.random.default_rng(0)
    common = [f"c{i}" for i in range(20)]
    lines = [[*rng.choice(common, 4).tolist(), *(["new", "york"] if i % 3 == 0 else []), *rng.choice(common, 4).tolist()] for i in range(600)]
    m = StreamingPmi(k=50, log2_width=10, window=2, negatives=3, seed=1)
    m.learn(lines)
    assert m.top()[0][:2] == ("new", "york")
    assert all(w >= 0 for _, _, w in m.top())
