"""Line dedup by content-defined chunks of lines.

A text is a sequence of lines. A rolling hash over the hashes of `WINDOW` lines ends a
chunk of two lines or more after a line where it is 0 modulo `MODULUS`. So the borders
of a passage depend on its lines, and on the border before it only until two copies
first share one, a few lines on. A line of `long_line` words or more (a parameter;
None: no such lines) is a chunk of its own. A chunk of several lines, or a single long
one, that occurs more than once in the corpus is kept where it occurs first (by doc_id,
then place) and removed elsewhere, after comparison of bytes: chunks meet by a 128-bit
hash, and each group must have equal least and greatest bytes (both are combined before
the shuffle, so a chunk that a third of all texts have moves once for each task). Groups
that differ are left alone. Repeated groups go to the chunks by a broadcast while they
are at most `BROADCAST_GROUPS`, and beyond that by a join in which each group is repeated
for `SALTS` parts of the chunks, so that no hash is in one task.

Chunks leave what lies before the first and behind the last border in a passage. With
`passages` (the pipeline; the registered op4 keeps to its SQL) every passage of lines
with `PASSAGE` words in all that occurs earlier goes, too: from each line onwards, and
up to each line, the shortest run of lines with `PASSAGE` words depends on the passage
alone, and these runs together cover it. Runs meet by a 64-bit hash; those that occur
more than once count as equal by a 256-bit BLAKE2 of their bytes. All but the first (by
doc_id, hash of the text, line) go; of one that overlaps the first in the same text, the
lines behind the first. So each line that goes has an equal one before it that stays.

Defined results: null texts stay null; empty texts stay empty; a text all of whose
chunks are removed becomes empty; repeated rows (same doc_id and text) share the place
of a first occurrence and so keep their chunks, as do null doc_ids among each other
(null is before all); very long texts are cut whole, one at a time; an empty table gives
none; further columns are kept as they are, but that `stats` replaces columns named
lines_kept and lines_removed.
"""

from __future__ import annotations

from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import text_slices
from .common import fresh, settle
from .wordhash import _SPACE, _pow, mix, span_hashes
from .worker import kernel

WINDOW, MODULUS, LONG_LINE, PASSAGE = 2, 4, 50, 50
#: Up to so many texts and chunk numbers to remove (about 40 bytes each) are broadcast.
BROADCAST_MARKS = 1_000_000
#: Up to so many repeated hashes with their first places (about 100 bytes each) are broadcast.
BROADCAST_GROUPS, SALTS = 500_000, 32
#: A run's first line times this, plus its last line.
PLACE = 1 << 32


def chunks(text: str, long_line: int | None = LONG_LINE) -> list[tuple[int, str, bool]]:
    """Number of lines, text and whether repetitions are removed, of each chunk."""
    lines = text.split("\n")
    out: list[tuple[int, str, bool]] = []
    held: list[str] = []
    before = 0
    for line in lines:
        h = int.from_bytes(md5(line.encode("utf-8", "replace")).digest()[:4], "big")
        if long_line and len(line) >= 2 * long_line - 1 and len(line.split(" ")) >= long_line:
            if held:
                out.append((len(held), "\n".join(held), len(held) > 1))
                held = []
            out.append((1, line, True))
        else:
            held.append(line)
            if (h + 31 * before) % MODULUS == 0 and len(held) > 1:
                out.append((len(held), "\n".join(held), True))
                held = []
        before = h
    if held:
        out.append((len(held), "\n".join(held), len(held) > 1))
    return out


def _chunk_rows(long_line: int | None, with_bytes: bool):
    def run(batches):
        for batch in batches:
            docs, names = batch.column("doc_id").to_pylist(), batch.column("name").to_pylist()
            for lo, _, texts in text_slices(batch.column("text")):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for at, text in enumerate(texts, lo):
                    for i, (_, chunk, whole) in enumerate(chunks(text, long_line)):
                        if whole:
                            raw = chunk.encode("utf-8", "replace")
                            for c, v in zip(rows, (docs[at], names[at], i, md5(raw).digest(), raw if with_bytes else None), strict=True):
                                c.append(v)
                if rows[0]:
                    yield _batch(rows)

    return kernel(run)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "name", "i", "hash", "bytes"])


def meet(rows: DataFrame, groups: DataFrame, key: str, n: int, *salt: str) -> DataFrame:
    """Joins rows with at most one of `n` groups each; any share of them may have one key."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key)
    spread = rows.withColumn("__part", F.pmod(F.xxhash64(*salt), F.lit(SALTS)))
    return spread.join(groups.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "__part"]).drop("__part")


def repeated(docs: DataFrame, owner: str = "", long_line: int | None = LONG_LINE) -> DataFrame:
    """doc_id, name (hash of the text), gone (array of chunk numbers to remove)."""
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("name"), "text")
    schema = "doc_id long, name long, i int, hash binary, bytes binary"
    rows = texts.mapInArrow(_chunk_rows(long_line, True), schema)
    place = F.struct("doc_id", "name", "i")
    groups = settle(rows.groupBy("hash").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), F.count("*").alias("n"), F.min(place).alias("first")).where((F.col("n") > 1) & (F.col("lo") == F.col("hi"))).select("hash", "first"), "repeated", owner)
    light = texts.mapInArrow(_chunk_rows(long_line, False), schema).select("doc_id", "name", "i", "hash")
    gone = meet(light, groups, "hash", groups.count(), "doc_id", "name", "i").where(~place.eqNullSafe(F.col("first")))
    return settle(gone.groupBy("doc_id", "name").agg(F.collect_set("i").alias("gone")), "gone", owner)


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs of lines with PASSAGE words that begin or end at a line: the
    text, first and last line, and a hash, of each."""
    parts = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends + 1))[: len(ends)]
    first = np.concatenate(([0], np.searchsorted(ends, np.cumsum([len(p) for p in parts]))))
    owner = np.repeat(np.arange(len(parts)), np.diff(first))
    inside = ~_SPACE[raw]
    inside[1:] &= _SPACE[raw[:-1]]
    before = np.searchsorted(np.flatnonzero(inside), np.append(starts, len(raw)))
    line = np.arange(len(ends))
    to = np.searchsorted(before, before[:-1] + PASSAGE) - 1
    since = np.searchsorted(before, before[1:] - PASSAGE, "right") - 1
    onwards = np.flatnonzero(to < first[owner + 1])
    up_to = np.flatnonzero((since >= first[owner]) & (to[since] != line))
    i, j = np.concatenate((onwards, since[up_to])), np.concatenate((to[onwards], up_to))
    total = np.zeros(len(line) + 1, np.uint64)
    h = span_hashes(raw, starts, ends)
    np.cumsum(mix(h + np.uint64(1)) * _pow[0][: len(line)], out=total[1:])
    return owner[i], i - first[owner[i]], j - first[owner[i]], mix((total[j + 1] - total[i]) * _pow[1][i])


def _run_rows(batches):
    for batch in batches:
        for lo, _, texts in text_slices(batch.column("text"), 200_000):
            own, i, j, h = runs(texts)
            at = pa.array(lo + own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("name").take(at), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "name", "i", "j", "h"])


def _digest_rows(batches):
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column("text"), 500_000):
            part, digest = batch.slice(lo, hi - lo), []
            size = np.diff(part.column("runs").offsets.to_numpy())
            own = part.column("runs").flatten().to_numpy(zero_copy_only=False)
            i, j = (own // PLACE).astype(np.int32), (own % PLACE).astype(np.int32)
            places, at = list(zip(i.tolist(), j.tolist(), strict=True)), 0
            for text, n in zip(texts, size.tolist(), strict=True):
                lines = text.encode("utf-8", "replace").split(b"\n")
                digest += [blake2b(b"\n".join(lines[a : b + 1]), digest_size=32).digest() for a, b in places[at : at + n]]
                at += n
            row = pa.array(np.repeat(np.arange(hi - lo), size))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("name").take(row), pa.array(i), pa.array(j), pa.array(digest, pa.binary())], ["doc_id", "name", "i", "j", "digest"])


def _place(i, j):
    return (F.lit(PLACE) * i + j).alias("place")


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_MARKS else rows


def _same_text(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.name") == F.col(f"{b}.name"))


def repeated_runs(docs: DataFrame, owner: str = "") -> DataFrame:
    """doc_id, name (hash of the text), runs (array of PLACE numbers of lines to remove)."""
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("name"), "text")
    every = settle(texts.mapInArrow(kernel(_run_rows), "doc_id long, name long, i int, j int, h long"), "runs", owner)
    often = settle(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often", owner)
    hits = meet(every, often, "h", often.count(), "doc_id", "name", "i", "j")
    by_text = settle(hits.groupBy("doc_id", "name").agg(F.collect_set(_place(F.col("i"), F.col("j"))).alias("runs")), "hits", owner)
    n = by_text.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    with_text = texts.alias("t").join(_few(by_text, n).alias("r"), _same_text("t", "r")).select("t.*", "r.runs")
    sure = settle(with_text.mapInArrow(kernel(_digest_rows), "doc_id long, name long, i int, j int, digest binary"), "sure", owner)
    groups = settle(sure.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "name", "i", "j")).alias("first")).where("n > 1").select("digest", "first"), "firsts", owner)
    later = meet(sure, groups, "digest", groups.count(), "doc_id", "name", "i", "j").where(~F.struct("doc_id", "name", "i", "j").eqNullSafe(F.col("first")))
    home = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("name") == F.col("first.name"))
    since = F.when(home, F.greatest("i", F.col("first.j") + 1)).otherwise(F.col("i"))
    return settle(later.groupBy("doc_id", "name").agg(F.collect_set(_place(since, F.col("j"))).alias("runs")), "gone-runs", owner)


def dedup_lines(docs: DataFrame, owner: str = "", stats: bool = False, passages: bool = False, long_line: int | None = LONG_LINE) -> DataFrame:
    """The rows of docs with repeated chunks (and `passages`) removed from text, and
    n_chars (where docs have it) set to the new length; `stats` adds lines_kept and
    lines_removed."""
    if stats:
        docs = docs.drop("lines_kept", "lines_removed")
    gone = repeated(docs, owner, long_line).withColumn("runs", F.array().cast("array<long>"))
    if passages:
        both = gone.union(repeated_runs(docs, owner).select("doc_id", "name", F.array().cast("array<int>").alias("gone"), "runs"))
        gone = settle(both.groupBy("doc_id", "name").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.flatten(F.collect_list("runs")).alias("runs")), "marks", owner)
    marks = gone.agg(F.count("*") + F.coalesce(F.sum(F.size("gone") + F.size("runs")), F.lit(0))).first()[0]
    # texts with removals are few; up to this size they need not move the others
    if marks <= BROADCAST_MARKS:
        gone = F.broadcast(gone)
    names = docs.columns
    c_gone, c_runs = fresh("gone", names), fresh("runs", names)
    joined = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.name")), "left").select("d.*", F.col("g.gone").alias(c_gone), F.col("g.runs").alias(c_runs))
    schema = T.StructType([*docs.schema.fields, *([T.StructField("lines_kept", T.LongType()), T.StructField("lines_removed", T.LongType())] if stats else [])])

    def clean(batches):
        for whole in batches:
            for lo, hi, texts in text_slices(whole.column("text")):
                yield cleaned(whole.slice(lo, hi - lo), texts)

    def cleaned(batch, texts):
        marks = batch.column(c_gone).to_pylist()
        new, kept, removed = [], [], []
        for text, out, places in zip(texts, marks, batch.column(c_runs).to_pylist(), strict=True):
            if out is None:
                new.append(text)
                kept.append(text.count("\n") + 1 if text is not None else 0)
                removed.append(0)
                continue
            drop, lines, at = set(out), text.split("\n"), 0
            stay = np.ones(len(lines), bool)
            for i, (n, _, _) in enumerate(chunks(text, long_line)):
                if i in drop:
                    stay[at : at + n] = False
                at += n
            for place in places:
                stay[place // PLACE : place % PLACE + 1] = False
            new.append("\n".join(line for line, own in zip(lines, stay.tolist(), strict=True) if own))
            kept.append(int(stay.sum()))
            removed.append(len(lines) - kept[-1])
        columns = []
        for c in names:
            if c == "text":
                columns.append(pa.array(new, pa.string()))
            elif c == "n_chars":
                columns.append(pa.array([n if out is None else len(t) for n, out, t in zip(batch.column(c).to_pylist(), marks, new, strict=True)], batch.column(c).type))
            else:
                columns.append(batch.column(c))
        if stats:
            columns += [pa.array(kept, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return joined.mapInArrow(kernel(clean), schema)


SQL = f"""
WITH l AS (SELECT doc_id, md5(text) AS name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS UBIGINT) AS h, len(string_split(line, ' ')) >= {LONG_LINE} AS long FROM l),
r AS (SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % {MODULUS} = 0 AS cut FROM h WINDOW w AS (PARTITION BY doc_id, name ORDER BY j)),
e AS (SELECT *, list(struct_pack(long := long, cut := cut)) OVER (PARTITION BY doc_id, name ORDER BY j) AS past FROM r),
f AS (SELECT * EXCLUDE past, list_reduce(list_prepend(struct_pack(n := 0, chunk := 0, closed := true), list_transform(past, lambda p: struct_pack(n := CAST(p.long AS INT), chunk := CAST(p.cut AS INT), closed := false))),
  lambda a, p: struct_pack(n := CASE WHEN a.closed OR p.n = 1 THEN 1 ELSE a.n + 1 END, chunk := CASE WHEN a.closed OR p.n = 1 THEN a.chunk + 1 ELSE a.chunk END,
    closed := p.n = 1 OR (p.chunk = 1 AND (NOT a.closed) AND a.n + 1 > 1))) AS s FROM e),
c AS (SELECT doc_id, name, s.chunk AS i, count(*) AS n, string_agg(line, chr(10) ORDER BY j) AS body, bool_or(long) AS long FROM f GROUP BY ALL),
g AS (SELECT *, (n > 1 OR long) AND row_number() OVER (PARTITION BY body, n > 1 OR long ORDER BY doc_id, i) > 1 AS gone FROM c),
t AS (SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS lines_kept, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS lines_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(t.lines_kept, 0) AS lines_kept, coalesce(t.lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN t USING (doc_id)
"""
