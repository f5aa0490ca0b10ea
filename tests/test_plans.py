"""Readers, plans, streaming, command line and the driver's contract."""

from __future__ import annotations

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillstone.functions import scalars
from rillstone.functions.hashes import PolynomialHash, TabulationHash, murmur32, murmur32_udf
from rillstone.operators import pairs, sketches, topk, train
from rillstone.operators.learners import Spec
from rillstone.operators.sketches import SketchConfig
from rillstone.plans import examples
from rillstone.plans.registry import QUERIES, SQL
from rillstone.sources import libsvm, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(rows, frame):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v

    names = sorted(frame.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)
    return a, b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert a == b and a


def test_pmi_stream_reads_documents(spark, tmp_path):
    rows = [(1, "new york is new york\n" * 20), (2, None), (3, "A b  c\n\nd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["pmi_stream"](spark, str(tmp_path)).collect()
    assert {r.num_tokens for r in got} == {104} and ("new", "york") in {(r.a, r.b) for r in got}


@pytest.mark.parametrize("name", ["pmi_stream", "pmi_shards"])
def test_streaming_pmi_needs_no_python_worker(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapPartitions" in plan and not any(x in plan for x in ("Pandas", "Python", "Arrow"))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_libsvm_lines(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("+1 3:0.5 7:1\n-1 0:1 3:2.5\n1 7:1 3:1\n1 3:1 3:2\n1 5\n3.7 2:1\n1\n")
    got = libsvm.read_libsvm(spark, str(path)).orderBy("seq").collect()
    assert [(r.label, [(f.key, f.value) for f in r.features]) for r in got] == [(1, [(3, 0.5), (7, 1)]), (0, [(0, 1), (3, 2.5)]), (1, [(7, 1), (3, 1)]), (1, [(3, 1), (3, 2)]), (1, [(5, 5)]), (3, [(2, 1)]), (1, [])]
    path.write_text("1 1:1\n\nx 1:1\n1 3:1 # c\n")
    with pytest.raises(Exception, match="LIBSVM"):
        libsvm.read_libsvm(spark, str(path)).collect()
    kept = libsvm.read_libsvm(spark, str(path), strict=False).collect()
    assert len(kept) == 2
    assert libsvm.feature_dim(libsvm.read_libsvm(spark, str(path), strict=False)).first()[0] == 4


def test_text_source_and_pairs(spark, tmp_path):
    (tmp_path / "x.txt").write_text("A  b\tC d\n\nÉ e\n")
    lines = text.read_lines(spark, f"{tmp_path}/x.txt {tmp_path}/missing.txt")
    assert sorted(r.tokens for r in lines.collect()) == [[], ["a", "b", "c", "d"], ["É", "e"]]
    got = pairs.skipgrams(lines.where("size(tokens) = 4"), 2).collect()
    assert sorted((r.a, r.b) for r in got) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert pairs.skipgrams(lines, 0).count() == 0
    with pytest.raises(ValueError):
        pairs.skipgrams(lines, -1)
    assert text.read_lines(spark, f"{tmp_path}/none").count() == 0


def test_scalars_and_hash_columns(spark):
    row = spark.range(1).select(scalars.finite(F.lit(float("nan"))).alias("n"), scalars.finite(F.lit(float("inf"))).alias("i"), scalars.finite(F.lit(2.0)).alias("x"), scalars.sigmoid(F.lit(0.0)).alias("s"), scalars.ascii_lower(F.lit("AÉ")).alias("l")).first()
    assert (row.n, row.i, row.x, row.s, row.l) == (None, None, 2.0, 0.5, "aÉ")
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(scalars.checked_key(F.lit(9), 5)).collect()
    keys = [0, 1, 77, 1 << 31, (1 << 32) - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    import numpy as np

    for h in (PolynomialHash(2, 5), TabulationHash(2, 5)):
        got = [r[0] for r in df.select(h.column(F.col("k"), 1)).collect()]
        assert got == h.numpy(np.array(keys))[1].tolist()
    words = spark.createDataFrame([("a",), ("test",), (None,), ("",)], "w string")
    assert [r[0] for r in words.select(murmur32_udf(3)("w")).collect()] == [murmur32(b"a", 3), murmur32(b"test", 3), None, murmur32(b"", 3)]


def test_sketch_bounds(spark):
    rows = spark.range(3000).select(F.pmod(F.col("id") * F.col("id"), F.lit(97)).alias("key"), F.lit("m").alias("model_id"), F.col("id").alias("seq"))
    c = SketchConfig(5, 3, 1)
    true = {r.key: r.n for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()}
    est = {r.key: r.estimate for r in sketches.count_min_query(sketches.count_min(rows, F.col("key"), c), rows, c).collect()}
    cons = sketches.conservative(rows, c).drop("model_id")
    low = {r.key: r.estimate for r in sketches.count_min_query(cons, rows, c).collect()}
    assert all(true[k] <= low[k] <= est[k] for k in true)
    halves = sketches.count_min(rows.where("seq < 1000"), F.col("key"), c).union(sketches.count_min(rows.where("seq >= 1000"), F.col("key"), c)).groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, sketches.count_min(rows, F.col("key"), c).collect()))
    for bad in ((31, 1), (5, 0), (27, 2)):
        with pytest.raises(ValueError):
            SketchConfig(*bad)


def test_known_fit_of_events(spark):
    rows = examples.events(spark, "/root/testdata/sf0.01").orderBy("seq").limit(1000)
    m = train.fit(rows, Spec("logistic", k=512)).collect()
    stat = next(r for r in m if r.kind == "stat")
    assert (int(stat.weight), stat.n) == (213, 1000)
    assert math.isclose(next(r.weight for r in m if r.kind == "bias"), -1.18057762536161, abs_tol=1e-9)


def test_grid_epochs_report_and_metrics(spark):
    rows = examples.judged(spark, SF)
    specs = [Spec("logistic", k=8), Spec("active_set", k=2, log2_width=3), Spec("truncated", k=2)]
    got = train.fit(rows, specs, epochs=2, predictions=True)
    n = rows.count()
    stats = {r.model_id: r.n for r in got.where("kind = 'stat'").collect()}
    assert len(stats) == 3 and set(stats.values()) == {2 * n}
    one = json.loads(train.report(specs[1], got.where("model_id = '0001-active_set'")))
    assert one["params"]["k"] == 2 and len(one["results"]["top_indices"]) == 2
    none = topk.confusion(spark.createDataFrame([], "label int, predicted boolean")).first()
    assert (none.precision, none.recall, none.f1) == (1, 1, 1)


def test_stream_count_min(spark, tmp_path):
    from rillstone.streaming.learn import count_min_stream

    src = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderdate")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    c = SketchConfig(6, 2, 4)
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = count_min_stream(live, "o_custkey", c).writeStream.format("memory").queryName("cm").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sketches.count_min(src, F.col("o_custkey"), c)
    assert sorted(map(tuple, spark.table("cm").collect())) == sorted(map(tuple, want.collect()))


def test_stream_learner_equals_batch(spark, tmp_path):
    from rillstone.streaming.learn import learn_stream

    rows = examples.judged(spark, SF).coalesce(1)
    for i, (lo, hi) in enumerate(((0, 80), (80, 150), (150, 10**9))):
        rows.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        seen = []
        q = learn_stream(live, {"m": Spec("active_set", k=4, log2_width=3)}).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = train.fit(rows, Spec("active_set", k=4, log2_width=3)).collect()
    last = [b for b in seen if b][-1]
    assert len([b for b in seen if b]) == 3
    assert {r.key: round(r.weight, 9) for r in last} == {r.key: round(r.weight, 9) for r in batch if r.kind == "weight"}


def test_command_line(tmp_path, capsys, spark):
    from rillstone.cli import main

    (tmp_path / "t.txt").write_text("\n".join(f"{1 if i % 3 else -1} {i % 5}:1 {7 + i % 3}:2" for i in range(60)))
    main(["classify", "--train", f"{tmp_path}/t.txt", "--test", f"{tmp_path}/t.txt", "--method", "active_set", "--topk", "4"])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["results"]["train_count"] == 60 and len(out["results"]["top_indices"]) == 4 and out["results"]["test_recall"] > 0.9
    (tmp_path / "c.txt").write_text("new york is new york\n" * 30 + "a b c d e\n" * 5)
    main(["pmi", "--data", f"{tmp_path}/c.txt", "--topk", "10", "--log2-width", "6"])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["results"]["num_tokens"] == 175 and len(out["results"]["tokens"]) == len(out["results"]["weights"])
