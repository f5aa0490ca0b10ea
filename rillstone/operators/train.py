"""Training, scoring and reporting of the learners over DataFrames.

One model is learned in order, so it is one task; a grid of specs trains in parallel,
one task for each model. Examples are sorted by (model_id, epoch, seq) in one shuffle
and stream through the kernel in Arrow batches, so memory is the model's state and one
batch. `fit_sharded` trains a model on each shard of the stream at once and averages
them: an approximation for streams that one task cannot hold up with, off by default.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import PolynomialHash
from .learners import Spec, build, describe, merged, restore

MODEL = "model_id string, kind string, seq bigint, key bigint, weight double, n bigint, label int, predicted boolean, state binary"
_SCHEMA = pa.schema([("model_id", pa.string()), ("kind", pa.string()), ("seq", pa.int64()), ("key", pa.int64()), ("weight", pa.float64()), ("n", pa.int64()), ("label", pa.int32()), ("predicted", pa.bool_()), ("state", pa.binary())])


def _batch(model_id: str, kind: str, size: int, **columns) -> pa.RecordBatch:
    out = []
    for f in _SCHEMA:
        if f.name == "model_id":
            out.append(pa.array([model_id] * size, f.type))
        elif f.name == "kind":
            out.append(pa.array([kind] * size, f.type))
        else:
            out.append(pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type))
    return pa.RecordBatch.from_arrays(out, schema=_SCHEMA)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """labels, offsets, keys, values of a batch of examples."""
    features = batch.column("features")
    ends = features.offsets.to_numpy()
    own = features.flatten()
    return batch.column("label").to_numpy(zero_copy_only=False), ends - ends[0], own.field("key").to_numpy(zero_copy_only=False), own.field("value").to_numpy(zero_copy_only=False).astype(float)


def model_name(spec: Spec, at: int) -> str:
    return f"{at:04d}-{spec.method}"


def fit(examples: DataFrame, specs: Spec | Sequence[Spec], predictions: bool = False, keep_state: bool = False, epochs: int = 1) -> DataFrame:
    """Train a model for each spec on examples (seq, label, features[, epoch][, place])
    in order of epoch, then place or seq.

    Rows by kind: `weight` (key, weight), the k largest; `bias` (weight); `stat`
    (n = examples, weight = errors before learning); with `predictions` also `pred`
    (seq, label, predicted); with `keep_state` also `state`.
    """
    specs = [specs] if isinstance(specs, Spec) else list(specs)
    names = {model_name(s, i): s for i, s in enumerate(specs)}
    order = ["epoch"] if "epoch" in examples.columns else []
    by = "place" if "place" in examples.columns else "seq"
    rows = examples.select("seq", "label", "features", *order, *([by] if by != "seq" else []))
    if epochs > 1:
        rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        order = ["epoch"]
    # the models are few and named here: a row is repeated for each, without a join
    rows = rows.withColumn("model_id", F.explode(F.lit(list(names)))) if len(names) > 1 else rows.withColumn("model_id", F.lit(next(iter(names))))
    parts = min(len(names), 4096)
    # names begin with the model's number: one task for each
    ordered = rows.repartitionById(parts, F.pmod(F.substring_index("model_id", "-", 1).cast("int"), F.lit(parts))).sortWithinPartitions("model_id", *order, by)

    def run(batches):
        model, now, errors, seen = None, None, 0, 0

        def out():
            keys, weights = zip(*model.top(), strict=True) if model.top() else ((), ())
            yield _batch(now, "weight", len(keys), key=list(keys), weight=list(weights))
            yield _batch(now, "bias", 1, weight=[model.bias])
            yield _batch(now, "stat", 1, weight=[float(errors)], n=[seen])
            if keep_state:
                yield _batch(now, "state", 1, state=[model.dump()])

        for batch in batches:
            ids = batch.column("model_id").to_pylist()
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)] if ids else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if ids[lo] != now:
                    if model is not None:
                        yield from out()
                    model, now, errors, seen = build(names[ids[lo]]), ids[lo], 0, 0
                own = batch.slice(lo, hi - lo)
                labels, ends, keys, values = flat(own)
                said = model.learn(labels, ends, keys, values)
                errors += int((said.astype(int) != labels).sum())
                seen += len(labels)
                if predictions:
                    yield _batch(now, "pred", hi - lo, seq=own.column("seq").cast(pa.int64()), label=own.column("label").cast(pa.int32()), predicted=said)
        if model is not None:
            yield from out()

    return ordered.select("model_id", "seq", F.col("label").cast("int").alias("label"), F.col("features").cast("array<struct<key:bigint,value:double>>").alias("features")).mapInArrow(run, MODEL)


#: Numbers shards; a fixed hash, so that a repeated run deals examples out alike.
SHARD = PolynomialHash(1, 29)


def fit_sharded(examples: DataFrame, spec: Spec, shards: int) -> DataFrame:
    """key, weight (bias: null key) of the mean of models trained on `shards` parts of
    the stream at once, one task for each; shards without examples don't count. Keys of
    any shard's report are averaged as each model has them (a sketch gives its estimate
    of what the report leaves out), and the k largest stay. Approximate: not what one
    pass in order gives."""
    part = F.pmod(SHARD.column(F.col("seq")), F.lit(shards)).cast("int")
    ordered = examples.select(part.alias("shard"), "seq", F.col("label").cast("int").alias("label"), F.col("features").cast("array<struct<key:bigint,value:double>>").alias("features")).repartitionById(shards, "shard").sortWithinPartitions("shard", "seq")

    def run(batches):
        models = {}
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            for s in dict.fromkeys(ids.tolist()):
                models.setdefault(s, build(spec)).learn(*flat(pa.RecordBatch.from_struct_array(batch.filter(pa.array(ids == s)).to_struct_array())))
        for s, m in models.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([m.dump()], pa.binary()), pa.array([[k for k, _ in m.top()]], pa.list_(pa.int64()))], ["shard", "state", "keys"])

    trained = ordered.mapInArrow(run, "shard int, state binary, keys array<bigint>").persist()
    every = trained.select(F.explode("keys").alias("key")).distinct().agg(F.sort_array(F.collect_list("key")).alias("keys"))

    def ask(batches):
        for batch in batches:
            for state, keys in zip(batch.column("state").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                model = restore(state)
                yield pa.RecordBatch.from_arrays([pa.array([*keys, None], pa.int64()), pa.array([*map(model.get, keys), model.bias], pa.float64())], ["key", "weight"])

    # at most shards * k keys meet each model
    told = trained.select("shard", "state").join(F.broadcast(every.select(F.col("keys").alias("asked")))).mapInArrow(ask, "key bigint, weight double")
    mean = told.groupBy("key").agg(F.avg("weight").alias("weight"))
    best = mean.where("key is not null").orderBy(F.abs("weight").desc(), "key").limit(spec.k)
    return best.union(mean.where("key is null"))


#: Bytes of state that one broadcast may have.
MOST_STATE = 64 << 20


def predict(examples: DataFrame, models: DataFrame) -> DataFrame:
    """model_id, seq, label, predicted by models fitted with keep_state. States go to the
    examples in broadcasts of at most `MOST_STATE` bytes; a larger one by itself is an
    error (score its weights as a table by `topk.scores` instead)."""
    kept = models.where("kind = 'state'").select("model_id", "state")
    sizes = sorted((r["model_id"], r["n"]) for r in kept.select("model_id", F.length("state").alias("n")).collect())
    parts: list[tuple[int, list[str]]] = []
    for name, n in sizes:
        if n > MOST_STATE:
            raise ValueError(f"the state of {name} has {n} bytes; score its weights with topk.scores")
        if not parts or parts[-1][0] + n > MOST_STATE:
            parts.append((0, []))
        parts[-1] = (parts[-1][0] + n, [*parts[-1][1], name])
    rows = examples.select("seq", F.col("label").cast("int").alias("label"), F.col("features").cast("array<struct<key:bigint,value:double>>").alias("features"))

    def scored(names: list[str]) -> DataFrame:
        states = {r["model_id"]: bytes(r["state"]) for r in kept.where(F.col("model_id").isin(names)).collect()}
        shared = examples.sparkSession.sparkContext.broadcast(states)

        def run(batches):
            own = {k: restore(v) for k, v in shared.value.items()}
            for batch in batches:
                labels, ends, keys, values = flat(batch)
                for name, model in own.items():
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(labels)), batch.column("seq"), batch.column("label"), pa.array(model.predict(ends, keys, values))], ["model_id", "seq", "label", "predicted"])

        return rows.mapInArrow(run, "model_id string, seq bigint, label int, predicted boolean")

    out = scored(parts[0][1] if parts else [])
    for _, names in parts[1:]:
        out = out.union(scored(names))
    return out


def report(spec: Spec, model: DataFrame, extra: dict | None = None) -> str:
    """The JSON document {params, results} of one model; it holds at most k weights."""
    rows = model.where("kind in ('weight', 'bias', 'stat')").collect()
    weights = sorted(((r["key"], r["weight"]) for r in rows if r["kind"] == "weight"), key=lambda x: (-abs(x[1]), x[0]))
    stat = next((r for r in rows if r["kind"] == "stat"), None)
    bias = next((r["weight"] for r in rows if r["kind"] == "bias"), 0.0)
    n, errors = (stat["n"], int(stat["weight"])) if stat else (0, 0)
    results = {"train_err_count": errors, "train_count": n, "train_err_rate": errors / n if n else None, "bias": bias} | (extra or {})
    results |= {"top_indices": [k for k, _ in weights], "top_weights": [w for _, w in weights]}
    clean = lambda v: None if isinstance(v, float) and not np.isfinite(v) else v
    return json.dumps({"params": describe(replace(spec)), "results": {k: [clean(x) for x in v] if isinstance(v, list) else clean(v) for k, v in results.items()}})


__all__ = ["MODEL", "fit", "fit_sharded", "flat", "merged", "model_name", "predict", "report"]
