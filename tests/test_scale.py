"""Partitioning, merging and the exact ways beyond approximations."""

from __future__ import annotations

import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.functions.hashes import murmur32, murmur32_many
from rillstone.operators import association, pairs, sketches, train
from rillstone.operators.association import StreamingPmi
from rillstone.operators.learners import METHODS, ActiveSet, Learner, Spec, build, merged
from rillstone.session import kernel, map_rows
from rillstone.sources import libsvm

FEATURES = "seq long, label int, features array<struct<key:bigint,value:float>>"


def test_sharded_mean_counts_only_trained_shards(spark):
    one = spark.createDataFrame([(1, 1, [(7, 1.0)])], FEATURES)
    got = {r.key: r.weight for r in train.fit_sharded(one, Spec("logistic"), 8).collect()}
    alone = build(Spec("logistic"))
    alone.update(1, {7: 1.0})
    assert got == {7: pytest.approx(alone.get(7)), None: pytest.approx(alone.bias)}
    assert train.fit_sharded(one.limit(0), Spec("logistic"), 8).count() == 0


def test_sharded_mean_of_sketched_weights(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), [(rng.randrange(30), 1.0)]) for i in range(400)]
    spec = Spec("active_set", k=4, log2_width=4)
    shards = {}
    for i, label, f in rows:
        h = int(train.SHARD.numpy(np.array([i]))[0, 0]) % 3
        shards.setdefault(h, build(spec)).update(label, dict(f))
    keys = {k for m in shards.values() for k, _ in m.top()}
    want = sorted(((k, sum(m.get(k) for m in shards.values()) / len(shards)) for k in keys), key=lambda x: (-abs(x[1]), x[0]))[:4]
    got = {r.key: r.weight for r in train.fit_sharded(spark.createDataFrame(rows, FEATURES), spec, 3).collect()}
    assert {k: pytest.approx(w) for k, w in want} == {k: w for k, w in got.items() if k is not None}


def test_each_model_has_a_task(spark):
    rows = spark.createDataFrame([(i, i % 2, [(i, 1.0)]) for i in range(8)], FEATURES)
    model = train.fit(rows, [Spec(m, k=4) for m in METHODS])
    assert model.where("kind = 'stat'").select(F.spark_partition_id().alias("p")).distinct().count() == len(METHODS)


def test_states_go_out_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 2, [(i % 5, 1.0)]) for i in range(50)], FEATURES)
    models = train.fit(rows, [Spec("logistic"), Spec("truncated", k=3), Spec("countmin", k=3)], keep_state=True).persist()
    whole = sorted(map(tuple, train.predict(rows, models).collect()))
    largest = models.agg(F.max(F.length("state"))).first()[0]
    monkeypatch.setattr(train, "MOST_STATE", largest)
    assert sorted(map(tuple, train.predict(rows, models).collect())) == whole and len(whole) == 150
    monkeypatch.setattr(train, "MOST_STATE", largest - 1)
    with pytest.raises(ValueError):
        train.predict(rows, models)


@pytest.mark.parametrize("seed", range(4))
def test_single_features_follow_the_general_rules(seed):
    rng = np.random.default_rng(seed)
    spec = Spec("active_set", k=6, log2_width=3, seed=seed, no_bias=seed == 3)
    fast, slow = ActiveSet(spec), ActiveSet(spec)
    for _ in range(4):
        keys, labels, values = rng.integers(0, 50, 400), rng.integers(0, 2, 400), rng.choice([1.0, 0.5, 2.0], 400)
        offsets, k, v = merged(np.arange(401), keys, values)
        distinct, at = np.unique(k, return_inverse=True)
        slow.bind(distinct)
        assert (fast.learn(labels, np.arange(401), keys, values) == Learner.learn_bound(slow, labels, offsets, at, v)).all()
        assert fast.top() == slow.top() and fast.bias == slow.bias and np.array_equal(fast.table, slow.table)


@pytest.mark.parametrize("method", sorted(METHODS))
def test_one_example_at_a_time(method):
    rng = random.Random(5)
    one, many = build(Spec(method, k=5, log2_width=4)), build(Spec(method, k=5, log2_width=4))
    rows = [(rng.randrange(2), {rng.randrange(12): 1.0, 12 + rng.randrange(3): 0.5}) for _ in range(60)]
    said = [one.update(y, f) for y, f in rows]
    keys = np.array([k for _, f in rows for k in f])
    values = np.array([v for _, f in rows for v in f.values()])
    ends = np.concatenate(([0], np.cumsum([len(f) for _, f in rows])))
    assert said == many.learn(np.array([y for y, _ in rows]), ends, keys, values).tolist()
    assert one.top() == many.top()
    if method not in ("paired_countmin", "logistic_sketch"):
        assert all(one.get(k) == pytest.approx(w) for k, w in one.top())
        assert one.predict_one({}) == (one.bias >= 0)


def test_heavy_hitters(spark):
    rng = random.Random(1)
    tokens = [f"t{int(rng.paretovariate(0.8)) % 500}" for _ in range(6000)] + [None] * 10
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").repartition(5)
    true = Counter(t for t in tokens if t)
    bounds = {r.key: (r.least, r.most) for r in sketches.space_saving(rows, "t", 40).collect()}
    assert all(lo <= true[t] <= hi for t, (lo, hi) in bounds.items())
    got = {r.key: r.cnt for r in sketches.heavy_hitters(rows, "t", 0.02).collect()}
    assert got == {t: n for t, n in true.items() if n > 0.02 * 6000} and got
    assert sketches.heavy_hitters(rows.limit(0), "t", 0.02).count() == 0


def test_rows_are_numbered_in_order(spark, tmp_path):
    keys = [random.Random(3).randrange(-50, 10_000) for _ in range(300)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(4)
    got = {r.i: r.n for r in libsvm.numbered(rows, "k", "i", buckets=7).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((k, i) for i, k in enumerate(keys)))}
    assert libsvm.numbered(rows.limit(0), "k").count() == 0
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"1 {f * 100 + i}:1\n" + ("junk\n" if i % 7 == 3 else "") for i in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        lines = libsvm.numbered_lines(libsvm.read_libsvm(spark, str(tmp_path), strict=False))
        assert [r.n for r in lines.orderBy(F.col("features")[0]["key"]).collect()] == list(range(120))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_murmur_of_many():
    texts = ["", "a", "ab", "abc", "abcd", "hello, world", "é中", "x" * 1000, *[str(i) * (i % 9) for i in range(200)]]
    assert murmur32_many(texts, 42).tolist() == [murmur32(t.encode(), 42) for t in texts]
    assert murmur32_many([], 1).tolist() == [] and murmur32(b"Hello, world!", 1234) == 0xFAF6CDB3


def test_meet_deals_a_frequent_key_out(spark):
    rows = spark.createDataFrame([("the", i) for i in range(50)] + [("rare", 1), ("none", 2)], "w string, i int")
    facts = spark.createDataFrame([("the", 3), ("rare", 4)], "w string, n int")
    assert sorted((r.w, r.i, r.n) for r in pairs.meet(rows, facts, "w", "i").collect()) == sorted([("the", i, 3) for i in range(50)] + [("rare", 1, 4)])
    assert pairs.meet(rows, facts, "w", "i", how="left").where("n is null").count() == 1


def test_meet_does_not_broadcast_repeated_facts(spark):
    rows = spark.createDataFrame([("the", i) for i in range(50)], "w string, i int")
    joined = pairs.meet(rows, rows.groupBy("w").count(), "w", "i")
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_margins_are_sums_over_pairs(spark):
    rng = random.Random(4)
    lines = [(i, [rng.choice("abcde") for _ in range(rng.randrange(9))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(lines, "line int, tokens array<string>")
    for window in (0, 1, 3, 20):
        made = [(t[i], b) for _, t in lines for i in range(len(t or [])) for b in t[i + 1 : i + 1 + window]]
        both, first, second = Counter(made), Counter(a for a, _ in made), Counter(b for _, b in made)
        assert {r.token: (r.ca, r.cb) for r in pairs.margins(df, window).collect()} == {t: (first[t], second[t]) for t in "abcde"}
        want = {(a, b): (n, pytest.approx(np.log(n * len(made) / (first[a] * second[b])))) for (a, b), n in both.items() if n >= 4}
        assert {(r.a, r.b): (r.cnt, r.pmi) for r in pairs.pmi(df, window, least=4).collect()} == want


@pytest.mark.parametrize(
    "params",
    [
        {"k": 30, "log2_width": 5, "seed": 1},
        {"k": 30, "log2_width": 6, "depth": 3, "seed": 7, "reservoir": 50, "window": 2},
        {"k": 12, "log2_width": 4, "depth": 2, "seed": 2, "negatives": 1, "window": 20, "l2": 1e-3},
        {"k": 5, "log2_width": 4, "window": 0},
        {"k": 4000, "log2_width": 12, "seed": 3, "l2": 1e-4},
    ],
)
def test_kernel_learns_as_the_python_model(spark, params):
    rng = random.Random(6)
    lines = [(i // 3, i % 3, [f"{'wé'[i % 2]}{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(14))]) for i in range(600)]
    lines += [(200, 0, []), (200, 1, None), (200, 2, ["", "a", "", "日本語"])]
    df = spark.createDataFrame(rng.sample(lines, len(lines)), "doc long, line int, tokens array<string>").repartition(3)
    model = StreamingPmi(**params)
    model.learn(t or [] for *_, t in lines)
    learned = association.fit_pmi(df, **params)
    got = learned.collect()
    assert [(r.a, r.b, pytest.approx(r.weight)) for r in got] == model.top() and {r.num_tokens for r in got} <= {model.seen}
    assert "MapInPandas" not in learned._jdf.queryExecution().executedPlan().toString()


def test_kernel_forgets_the_numbers_of_unused_words(spark):
    rng = random.Random(8)
    lines = [(i, 0, [w for j in range(100) for w in ("new", "york", f"{i}x{j}", f"c{rng.randrange(40)}")]) for i in range(2800)]
    params = {"k": 20, "log2_width": 6, "negatives": 1, "window": 1, "reservoir": 60, "seed": 4}
    model = StreamingPmi(**params)
    model.learn(t for *_, t in lines)
    got = association.fit_pmi(spark.createDataFrame(lines, "doc long, line int, tokens array<string>"), **params).collect()
    assert [(r.a, r.b, pytest.approx(r.weight)) for r in got] == model.top() and got


def test_kernel_keeps_a_model_for_each_shard(spark):
    lines = [(i, 0, ["a", f"b{i % 3}", f"c{i % 5}"]) for i in range(90)]
    df = spark.createDataFrame(lines, "doc long, line int, tokens array<string>")
    got = association.fit_pmi(df, shards=4, k=9, log2_width=5).collect()
    docs = {r.doc: r.s for r in df.select("doc", F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(4)).alias("s")).collect()}
    assert len(set(docs.values())) == 4
    for s in range(4):
        model = StreamingPmi(k=9, log2_width=5)
        model.learn(t for d, _, t in lines if docs[d] == s)
        assert [(r.a, r.b, pytest.approx(r.weight), r.num_tokens) for r in got if r.shard == s] == [(*x, model.seen) for x in model.top()]


def test_one_model_learns_beside_the_words(spark):
    """Shards keep to a thread each; no thread outlives its query."""
    names = lambda: [t.getName() for t in spark._jvm.Thread.getAllStackTraces().keySet()]
    lines = [(i, 0, [f"w{j * j % 97}" for j in range(200)]) for i in range(1500)]
    df = spark.createDataFrame(lines, "doc long, line int, tokens array<string>")
    for shards, most in ((1, 1), (2, 0)):
        run = threading.Thread(target=association.fit_pmi(df, shards=shards).collect)
        run.start()
        seen = 0
        while run.is_alive():
            seen = max(seen, names().count("pmi-learner"))
            time.sleep(0.02)
        assert seen == most
        time.sleep(0.2)
        assert "pmi-learner" not in names()


def test_a_learner_that_fails_fails_the_query(spark):
    rows = spark.createDataFrame([(0, "a\nb\nc\nd")], "shard int, text string")
    run = kernel(spark, "PmiKernel", "4 4 2 1 1 10 0 0.1 0.0 1 2 4", "0 0 0")
    with pytest.raises(Exception, match="ArrayIndexOutOfBounds"):
        map_rows(rows, run, "shard int, a string, b string, weight double, num_tokens bigint").collect()
