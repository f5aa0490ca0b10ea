"""Near-duplicate documents: MinHash LSH forest, confirmed on full shingle sets.

Documents with equal sets are one class. `trees` signature orders are kept; tree t
starts at minhash t * depth. A row of a tree has the hash of its first `depth`
minhashes (its region) and, as sort key, 16 bits of each of the next four. All rows are
range-partitioned and sorted by (tree, region, next minhashes), so one hot region is
spread over tasks. Within a region a row's candidates are the region's first row and its
`window` predecessors, which are its longest-common-prefix neighbours: in a sparse
region these are all rows of it, in a crowded one those that agree deeper (to eight
minhashes), so depth adapts to the region. Regions that reach over a border between
tasks are joined by the rows at it.

Candidates are thinned by set sizes and looked at in three steps: each document's most
frequent candidate, its next eight, and all the rest, every time without pairs that are
already in one component. A step drops pairs whose one-byte signatures agree too rarely
(below `floor` matches of all minhashes a true link is rarer than 1 in 10^9) and confirms
the others on full sets.

Regions with more rows than the window covers are looked at again. The sorted pass ties
each of their rows to the region's first one; documents tied in any tree are a family.
Where a family still holds several components, its documents outside the largest one
are compared with all others on full sets, in blocks of like set size (a task holds
at most about 2 * BLOCK documents, sizes differ by two steps of 1 / similarity at most,
and it returns a forest of links). So a group that links is not expanded into its
pairs, and no candidate is dropped.

A pair with Jaccard 0.8 shares no region with probability (1 - 0.8^4)^28 < 10^-6.

Defined results: null or blank texts have an empty set, link with nothing and are kept
as their own component; repeated rows are one class; rows that share a doc_id are
judged each by its own text (classes that share their least doc_id get numbers for the
comparison, and rows go by doc_id and a hash of the text); a null doc_id has a null
component, is never a representative and stays; an empty table gives none; very long
texts are read whole; further columns are ignored, or kept with `keep_columns`,
where a row that repeats both doc_id and text stays once.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import text_slices
from .common import settle, shuffle_parts
from .components import components, forest
from .wordhash import mix, shingles, words
from .worker import kernel

TREES, DEPTH = 28, 4
HASHES = TREES * DEPTH
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minhashes (rows: sets that are not empty) of sets that lie one behind another."""
    out = np.empty((len(sizes), HASHES), np.uint32)
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(sizes):  # slices that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 60_000, "right")))
        first = int(ends[lo - 1]) if lo else 0
        low = (sets[first : int(ends[hi - 1])] >> np.uint64(32)).astype(np.uint32)
        starts = ends[lo:hi] - sizes[lo:hi] - first
        for k in range(HASHES):
            v = low * _MULT[k] + _ADD[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            out[lo:hi, k] = np.minimum.reduceat(v, starts)
        lo = hi
    return out


def floor_of(similarity: float) -> int:
    """Matches of HASHES that a pair of this similarity misses once in 10^9 or so."""
    return max(0, int(HASHES * similarity - 6.2 * np.sqrt(HASHES * similarity * (1 - similarity))))


def _sets(column: pa.Array, size: int):
    for lo, hi, texts in text_slices(column, 500_000):
        _, _, _, h, counts = words(texts)
        yield lo, hi, *shingles(h, counts, size)


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, sets, sizes in _sets(batch.column("text"), size):
                some = np.flatnonzero(sizes)
                sig = signatures(sets, sizes[some]) if len(some) else np.empty((0, HASHES), np.uint32)
                raw, ends = memoryview(sets.tobytes()), np.cumsum(sizes) * 8
                names: list[bytes | None] = [None] * (hi - lo)
                forest: list[bytes | None] = [None] * (hi - lo)
                small: list[bytes | None] = [None] * (hi - lo)
                for row, i in enumerate(some.tolist()):
                    names[i] = blake2b(raw[int(ends[i]) - int(sizes[i]) * 8 : int(ends[i])], digest_size=16).digest()
                    forest[i] = sig[row].tobytes()
                    small[i] = (sig[row] & np.uint32(255)).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(names, pa.binary()), pa.array(forest, pa.binary()), pa.array(small, pa.binary())], ["doc_id", "row", "n_shingles", "name", "sig", "small"])

    return run


def _tree_rows(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        for t in range(TREES):
            at = t * DEPTH
            key = np.zeros(len(sig), np.uint64)
            for k in range(DEPTH):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, at + k] + np.uint64(t + 1))
            deeper = np.zeros(len(sig), np.uint64)
            for k in range(4):
                deeper = deeper << np.uint64(16) | sig[:, (at + DEPTH + k) % HASHES] >> np.uint64(16)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(key.view(np.int64)), pa.array(deeper.view(np.int64)), batch.column("rep"), batch.column("n")], ["tree", "region", "deeper", "rep", "n"])


PAIR, TIE, BORDER = 0, 1, 2
_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("region", pa.int64()), ("part", pa.int32()), ("last", pa.bool_())])


def _neighbours(window: int, least: float):
    """From a sorted partition: candidate pairs; ties of rows to the first row of their
    region, where it has more rows than the window covers or may reach over a border;
    and the first and last row."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(none, kind, np.int8)), pa.array(a), pa.array(b), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.bool_())], schema=_FOUND)

    def border(rep, n, tree, region, part, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": BORDER, "a": int(rep), "b": int(n), "tree": int(tree), "region": int(region), "part": part, "last": last}], _FOUND)

    def run(batches):
        carry: list[np.ndarray] | None = None
        head = None  # of the region that the carried rows belong to: rep, n
        before = 0  # rows of that region before the carried ones
        opening = True  # is it the partition's first region?
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, region, rep, n = (batch.column(c).to_numpy() for c in ("tree", "region", "rep", "n"))
            part = batch.column("part")[0].as_py()
            if carry is None:
                yield border(rep[0], n[0], tree[0], region[0], part, False)
                head, held = (rep[0], n[0]), 0
            else:
                tree, region, rep, n = (np.concatenate(x) for x in zip(carry, (tree, region, rep, n), strict=True))
                held = len(carry[0])
            new = np.ones(len(rep), bool)
            new[1:] = (region[1:] != region[:-1]) | (tree[1:] != tree[:-1])
            place = np.arange(len(rep))
            first = np.maximum.accumulate(np.where(new, place, 0))
            head_rep, head_n = np.where(first == 0, head[0], rep[first]), np.where(first == 0, head[1], n[first])
            depth = place - first + np.where(first == 0, before, 0)  # rows of the region before
            a, b, b_n = [], [], []
            for back in range(1, window + 1):
                i = np.arange(max(held, back), len(rep))
                i = i[i - back >= first[i]]
                a.append(i)
                b.append(rep[i - back])
                b_n.append(n[i - back])
            far = place[held:][depth[held:] > window]
            a, b, b_n = np.concatenate([*a, far]), np.concatenate([*b, head_rep[far]]), np.concatenate([*b_n, head_n[far]])
            low, high = np.minimum(n[a], b_n), np.maximum(n[a], b_n)
            ok = (low >= least * high) & (rep[a] != b)
            x, y = rep[a][ok], b[ok]
            if len(x):
                yield rows(PAIR, np.maximum(x, y), np.minimum(x, y))
            # of a region that turns out crowded, all rows from its first one
            turn = place[held:][depth[held:] == window + 1]
            since = np.concatenate([far, *[turn - back for back in range(1, window + 1)]])
            if opening:
                since = np.concatenate((since, place[first == 0]))
            since = np.unique(since[since >= 0])
            if len(since):
                yield rows(TIE, rep[since], head_rep[since])
            last = first[-1]
            keep = max(last, len(rep) - window)
            before = int(depth[keep])
            if last > 0:
                head, opening = (rep[last], n[last]), False
            carry = [tree[keep:], region[keep:], rep[keep:], n[keep:]]
        if carry is not None:
            yield rows(TIE, carry[2], np.full(len(carry[2]), head[0]))
            yield border(carry[2][-1], carry[3][-1], carry[0][-1], carry[1][-1], part, True)

    return run


def _shared(mine: list[np.ndarray], others: list[np.ndarray], percent: int):
    """Links of each set of `mine` with `others`: the postings of its shingles give all
    intersections at once."""
    if not mine or not others:
        return
    size = np.array([len(x) for x in others])
    shingle = np.concatenate(others)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], np.repeat(np.arange(len(others)), size)[order]
    for i, own in enumerate(mine):
        lo, hi = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(others))
        yield i, np.flatnonzero(100 * both >= percent * (len(own) + size - both))


def _across(percent: int):
    """Links between rows of different components, of which one at least is not the
    family's largest; returns a forest that spans them."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        small = table.column("small").to_numpy(zero_copy_only=False)
        rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        alone = left.all()  # a block with itself
        found = []
        for mine, others in ((left & small, np.ones(len(rep), bool) if alone else ~left), (~left & small, left & ~small)):
            mine, others = np.flatnonzero(mine), np.flatnonzero(others)
            for i, j in _shared([sets[i] for i in mine.tolist()], [sets[i] for i in others.tolist()], percent):
                j = others[j][comp[others[j]] != comp[mine[i]]]
                found.append((np.full(len(j), rep[mine[i]]), rep[j]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(a):
            a, b = forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _alike(floor: int):
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
            ok = pa.array((x == y).sum(1) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = []
            for p, q in zip(x, y, strict=True):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


#: Up to so many document ids (8 bytes each) are broadcast to filter the second scan.
BROADCAST_IDS = 1_000_000
#: Documents of a side in a task of a family.
BLOCK = 512


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, window: int = 3, owner: str = "", keep_columns: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; with `keep_columns` the kept rows of
    `docs` with all their columns (one row of each component) instead."""
    spark = docs.sparkSession
    least = percent / 100
    prints = settle(docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(kernel(_fingerprints(size)), "doc_id long, row long, n_shingles long, name binary, sig binary, small binary"), "prints", owner)
    classes = settle(prints.where("name is not null and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("small").alias("small")).withColumn("least", F.col("rep")), "classes", owner)
    n_classes, n_reps = classes.agg(F.count("*"), F.count_distinct("rep")).first()
    if n_classes > n_reps:  # doc_ids with several texts: a number for each class instead
        classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()), "numbered", owner)

    # with few rows a partition the borders are many; a region needs no more tasks
    parts = shuffle_parts(spark)
    rows = classes.select("rep", "n", "sig").mapInArrow(kernel(_tree_rows), "tree int, region long, deeper long, rep long, n long")
    ordered = rows.repartitionByRange(parts, "tree", "region", "deeper", "rep").sortWithinPartitions("tree", "region", "deeper", "rep").withColumn("part", F.spark_partition_id())
    found = settle(ordered.mapInArrow(kernel(_neighbours(window, least)), "kind byte, a long, b long, tree int, region long, part int, last boolean"), "neighbours", owner)
    border = {(r["part"], r["last"]): r for r in found.where(F.col("kind") == BORDER).select("a", "b", "tree", "region", "part", "last").collect()}
    ends = sorted({p for p, _ in border})
    across, tied, heads = [], [], None
    for p, q in zip(ends, ends[1:], strict=False):
        u, v = border[p, True], border[q, False]
        if (u["tree"], u["region"]) != (v["tree"], v["region"]):
            continue
        # a region over several tasks: the chain of border rows, and its first row
        f = border[p, False]
        whole = (f["tree"], f["region"]) == (u["tree"], u["region"])
        heads = heads if whole and heads is not None else (f if whole else u)
        across += [(max(x["a"], v["a"]), min(x["a"], v["a"])) for x in {u["a"]: u, heads["a"]: heads}.values() if x["a"] != v["a"]]
        tied.append((u["a"], v["a"]))
        if (border[q, True]["tree"], border[q, True]["region"]) != (v["tree"], v["region"]):
            heads = None

    def few_edges(rows: list[tuple[int, int]]) -> DataFrame:  # an Arrow table needs no Python worker
        return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate("ab")})).where("a <> b")

    ties = found.where(F.col("kind") == TIE).select("a", "b").where("a <> b").union(few_edges(tied))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").union(few_edges(across))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    turn = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
    ranked = settle(counted.withColumn("turn", F.row_number().over(turn)), "pairs", owner)
    small = classes.select(F.col("rep").alias("id"), "small")

    def alike(pairs: DataFrame) -> DataFrame:
        x, y = small.select(F.col("id").alias("a"), F.col("small").alias("x")), small.select(F.col("id").alias("b"), F.col("small").alias("y"))
        return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(kernel(_alike(floor_of(least))), "a long, b long")

    def full_sets(batches):
        for batch in batches:
            for lo, hi, sets, sizes in _sets(batch.column("text"), size):
                raw, ends = memoryview(sets.tobytes()), (np.cumsum(sizes) * 8).tolist()
                own = [raw[e - int(n) * 8 : e] for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([blake2b(x, digest_size=16).digest() for x in own], pa.binary()), pa.array(own, pa.binary())], ["least", "name", "set"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        few = pairs.count() * 2 <= BROADCAST_IDS
        wanted = classes.select("rep", "least", "name").join(F.broadcast(involved) if few else involved, "rep")
        if few:
            wanted = F.broadcast(wanted)
        mine = docs.select(F.col("doc_id").alias("least"), "text").join(wanted.select("least"), "least", "left_semi").select(F.col("least").alias("doc_id"), "text")
        sets = mine.mapInArrow(kernel(full_sets), "least long, name binary, set binary").where("length(set) > 0")
        return settle(sets.join(wanted, ["least", "name"]).select(F.col("rep").alias("id"), "set"), "sets", owner)

    def linked(pairs: DataFrame, full: DataFrame) -> DataFrame:
        left, right = full.select(F.col("id").alias("a"), F.col("set").alias("x")), full.select(F.col("id").alias("b"), F.col("set").alias("y"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(kernel(_confirmed(percent)), "a long, b long")

    def component_of(c: str) -> DataFrame:
        return comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))

    comp = None
    for lo, hi in ((1, 1), (2, 9), (10, None)):
        step = ranked.where(F.col("turn") >= lo) if hi is None else ranked.where(F.col("turn").between(lo, hi))
        if comp is not None:
            step = step.join(component_of("a"), "a", "left").join(component_of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        step = settle(alike(step), "step", owner)
        if comp is not None and step.isEmpty():
            continue
        # settled: two Python nodes in one stage would need twice the workers
        sure = settle(linked(step, sets_of(step)), "sure", owner)
        comp = components(sure if comp is None else sure.union(comp.select("node", "component")), owner)

    # what the window does not cover: families of crowded regions with several components
    family = components(ties, owner)
    members = family.select(F.col("node").alias("rep"), F.col("component").alias("family")).union(family.select("component", "component").distinct())
    own = settle(members.join(component_of("rep"), "rep", "left").select("rep", "family", F.coalesce("crep", "rep").alias("comp")), "families", owner)
    parts_of = own.groupBy("family", "comp").agg(F.count("*").alias("n"))
    several = parts_of.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("family", F.col("most.comp").alias("largest"))
    step = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    own = settle(own.join(several, "family").join(classes.select("rep", "n"), "rep").select("rep", "family", "comp", (F.col("comp") != F.col("largest")).alias("small"), step.alias("step")), "several", owner)
    if not own.isEmpty():
        blocks = settle(own.groupBy("family", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks", owner)
        above, below = blocks.select("family", (F.col("step") - 1).alias("step"), F.col("blocks").alias("up")), blocks.select("family", (F.col("step") + 1).alias("step"), F.col("blocks").alias("down"))
        blocks = blocks.join(above, ["family", "step"], "left").join(below, ["family", "step"], "left").na.fill(0)
        blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_IDS // 4 else blocks
        both = sets_of(own.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        with_sets = own.join(both, F.col("rep") == F.col("id")).join(blocks, ["family", "step"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

        def turns(n, left: bool, upper: int, i, j):
            """Block pairs of a row, `upper` steps from the lower one, for each x below n."""
            each = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.lit(left).alias("left"), (F.col("step") - (0 if left else upper)).alias("lower"), F.lit(upper).alias("upper"), i(x).cast("int").alias("i"), j(x).cast("int").alias("j")))
            return F.when(n > 0, each).otherwise(F.array().cast("array<struct<left:boolean,lower:int,upper:int,i:int,j:int>>"))

        salt = F.col("salt")
        roles = F.concat(turns(F.col("blocks") - salt, True, 0, lambda x: salt, lambda x: salt + x), turns(salt, False, 0, lambda x: x, lambda x: salt), turns(F.col("up"), True, 1, lambda x: salt, lambda x: x), turns(F.col("down"), False, 1, lambda x: x, lambda x: salt))
        sides = with_sets.select("family", "rep", "comp", "small", "set", F.inline(roles)).repartition("family", "lower", "upper", "i", "j")
        more = settle(sides.groupBy("family", "lower", "upper", "i", "j").applyInArrow(_across(percent), "a long, b long"), "more", owner)
        comp = components(more.union(comp.select("node", "component")), owner)
    rep = classes.select("name", "rep", "least").join(comp, F.col("rep") == F.col("node"), "left").select("name", "least", F.coalesce("component", "rep").alias("of"))
    if n_classes > n_reps:
        rep = settle(rep, "named", owner)
        rep = rep.join(rep.groupBy("of").agg(F.min("least").alias("first")), "of").select("name", F.col("first").alias("of"))
    # a row's class may hold smaller ids of documents that have further texts
    out = prints.select("doc_id", "row", "n_shingles", "name").join(rep.select("name", "of"), "name", "left").select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if not keep_columns:
        return out.drop("row")
    gone = settle(out.where("not kept").select("doc_id", "row").distinct(), "gone", owner)
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS // 2 else gone
    rest = docs.alias("d").join(few.alias("g"), (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.row")), "left_anti")
    twice = settle(prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice", owner)
    n = twice.count()
    if n:  # rows that repeat a doc_id and its text count once, too
        few = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        rest = rest.join(few, "doc_id", "left_anti").union(rest.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return rest


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, hash(g) AS g, n FROM s JOIN n USING (doc_id)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
         FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, y.b FROM reach r JOIN sym y ON r.b = y.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
