"""Command line: `classify` trains a classifier on LIBSVM files, `pmi` finds associated
word pairs in text files. Results are one JSON document on standard output."""

from __future__ import annotations

import argparse
import json
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.hashes import PolynomialHash
from .operators import association, topk, train
from .operators.learners import METHODS, Spec
from .session import ship
from .sources import libsvm, text

log = logging.getLogger("rillstone")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillstone")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("classify")
    c.add_argument("--train", required=True)
    c.add_argument("--test")
    c.add_argument("--method", default="active_set", choices=sorted(METHODS))
    c.add_argument("--log2-width", type=int, default=10)
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--seed", type=int, default=None, help="default: the clock")
    c.add_argument("--epochs", type=int, default=1)
    c.add_argument("--iters", type=int, default=0, help="steps in total; epochs are then ignored")
    c.add_argument("--sample", action="store_true", help="draw examples with replacement")
    c.add_argument("--topk", type=int, default=512, help="0: as many as features")
    c.add_argument("--lr-init", type=float, default=0.1)
    c.add_argument("--l2-reg", type=float, default=1e-6)
    c.add_argument("--count-smooth", type=float, default=1.0)
    c.add_argument("--pow", type=float, default=1.0)
    for flag in ("median-update", "consv-update", "no-bias", "permissive"):
        c.add_argument(f"--{flag}", action="store_true")
    m = sub.add_parser("pmi")
    m.add_argument("--data", nargs="+", required=True)
    m.add_argument("--topk", type=int, default=1024)
    m.add_argument("--log2-width", type=int, default=12)
    m.add_argument("--depth", type=int, default=1)
    m.add_argument("--neg-samples", type=int, default=5)
    m.add_argument("--window-size", type=int, default=5)
    m.add_argument("--reservoir-size", type=int, default=4000)
    m.add_argument("--lr-init", type=float, default=0.1)
    m.add_argument("--l2-reg", type=float, default=1e-7)
    m.add_argument("--seed", type=int, default=None)
    return p


def classify(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = libsvm.read_libsvm(spark, a.train, strict=not a.permissive)
    dim, n = rows.select(F.max(F.array_max(F.transform("features", lambda f: f["key"]))), F.count("*")).first()
    dim = (dim if dim is not None else -1) + 1
    log.info("%d examples, %d features", n, dim)
    seed = int(time.time()) if a.seed is None else a.seed
    spec = Spec(a.method, k=a.topk or max(dim, 1), log2_width=a.log2_width, depth=a.depth, seed=seed, rate=a.lr_init, l2=a.l2_reg, power=a.pow, smooth=a.count_smooth, conservative=a.consv_update, median=a.median_update, no_bias=a.no_bias)
    epochs = a.epochs
    if a.iters or a.sample:
        dense = libsvm.numbered_lines(rows).drop("seq", "place")
        draws = a.iters or a.epochs * n
        index = F.pmod(PolynomialHash(1, seed).column(F.col("i")), F.lit(n)) if a.sample else F.pmod(F.col("i"), F.lit(n))
        rows, epochs = libsvm.sample_with_replacement(dense, draws, index, by="n").withColumnRenamed("draw", "seq"), 1
    began = time.perf_counter()
    model = train.fit(rows, spec, keep_state=True, epochs=epochs).persist()
    model.count()
    extra = {"train_ms": round((time.perf_counter() - began) * 1000), "num_examples": n, "feature_dim": dim}
    began = time.perf_counter()
    said = train.predict(libsvm.read_libsvm(spark, a.test, strict=not a.permissive), model) if a.test else spark.createDataFrame([], "label int, predicted boolean")
    scores = topk.confusion(said).first()
    extra |= {"test_ms": round((time.perf_counter() - began) * 1000), "test_precision": scores["precision"], "test_recall": scores["recall"], "test_f1": scores["f1"]}
    return train.report(spec, model, extra)


def pmi(spark: SparkSession, a: argparse.Namespace) -> str:
    seed = int(time.time()) if a.seed is None else a.seed
    params = {"k": a.topk, "log2_width": a.log2_width, "depth": a.depth, "negatives": a.neg_samples, "window": a.window_size, "reservoir": a.reservoir_size, "seed": seed, "rate": a.lr_init, "l2": a.l2_reg}
    began = time.perf_counter()
    rows = association.fit_pmi(text.read_lines(spark, " ".join(a.data)), **params).collect()
    rows.sort(key=lambda r: (-r["weight"], r["a"], r["b"]))
    return json.dumps({"params": params, "results": {"train_ms": round((time.perf_counter() - began) * 1000), "num_tokens": rows[0]["num_tokens"] if rows else 0, "tokens": [[r["a"], r["b"]] for r in rows], "weights": [r["weight"] for r in rows]}})


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rillstone").getOrCreate()
    ship(spark)
    log.info("%s", vars(a))
    print({"classify": classify, "pmi": pmi}[a.command](spark, a))


if __name__ == "__main__":
    main()


__all__ = ["main", "parser"]
