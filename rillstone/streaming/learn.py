"""Learners and sketches over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.hashes import bucket
from ..operators.learners import Spec, build, restore
from ..operators.sketches import SketchConfig, cells


class LearnerProcessor(StatefulProcessor):
    """Keeps one learner for each model_id; a micro-batch is learned in order of seq and
    the state is written once. Emits the batch's errors and the current top weights. A
    model's part of a micro-batch is sorted in one task's memory: bound it by the source's
    rate limit (maxFilesPerTrigger, maxOffsetsPerTrigger)."""

    def __init__(self, specs: dict[str, Spec]):
        self.specs = specs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        model = restore(bytes(self.state.get()[0])) if self.state.exists() else build(self.specs[key[0]])
        sizes = own["keys"].map(len).to_numpy()
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        keys = np.concatenate([np.asarray(k, np.int64) for k in own["keys"]]) if sizes.sum() else np.empty(0, np.int64)
        values = np.concatenate([np.asarray(v, float) for v in own["values"]]) if sizes.sum() else np.empty(0)
        labels = own["label"].to_numpy()
        said = model.learn(labels, offsets, keys, values)
        self.state.update((model.dump(),))
        top = model.top()
        yield pd.DataFrame({"model_id": key[0], "t": model.t, "errors": int((said.astype(int) != labels).sum()), "bias": model.bias, "key": [k for k, _ in top] or [None], "weight": [w for _, w in top] or [None]}).astype({"key": "Int64"})

    def close(self) -> None: ...


def learn_stream(examples: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """Streaming examples (seq, label, features) to the state of each model after each
    micro-batch. Needs the RocksDB state store."""
    rows = examples.withColumn("model_id", F.explode(F.lit(list(specs)))).select("model_id", "seq", F.col("label").cast("int").alias("label"), F.transform("features", lambda f: f["key"]).alias("keys"), F.transform("features", lambda f: f["value"].cast("double")).alias("values"))
    return rows.groupBy("model_id").transformWithStateInPandas(LearnerProcessor(specs), "model_id string, t bigint, errors bigint, bias double, key bigint, weight double", "Update", "None")


def count_min_stream(events: DataFrame, key: str, config: SketchConfig, time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A Count-Min table over a stream; with `time` and `window` one for each window,
    closed when the watermark passes it."""
    own = events.withWatermark(time, late) if time else events
    carry = [time] if time else []
    rows = cells(own, F.col(key), config, *carry)
    by = [F.window(time, window)] if window else []
    return rows.groupBy(*by, "row", "bucket").agg(F.count("*").alias("cnt"))


__all__ = ["LearnerProcessor", "bucket", "count_min_stream", "learn_stream"]
