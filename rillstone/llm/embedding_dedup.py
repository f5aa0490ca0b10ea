"""Near-duplicate vectors by cosine: cover trees, traversed in pairs.

Only vectors with the same label (and the same length) are compared. Equal vectors
are one class with a size. On the unit sphere cosine >= t is distance <= eps =
sqrt(2 - 2t). Pivots of a bounded sample cut each label into cells, as many as its size
asks for but only while they separate: on the sample a vector may lie in `COPIES` cells
at most on average. A vector is at home in the cell of its nearest pivot and a guest in
each cell whose bisecting plane is at most eps away, so a home vector meets all its
partners in its own cell. Cells beyond `block` vectors are cut further into pairs of
blocks, each dealt out by its own key, which bounds the memory of a task however large a
label or a group of copies is. Two blocks meet once. A task builds a cover tree (nested
levels, halving radii) over the home vectors, and one over the guests, of a block and
traverses node pairs: apart by more than both covering radii and eps they are pruned,
within eps they are linked whole, else split; a tree with itself is traversed in one
half. What leaves a task is a count for each home vector and a spanning forest of its
links, never the pairs.

Defined results: a vector that is null, empty, all zero or holds a null or non-finite
component, or has a null label, links with nothing and is its own component. Repeated
rows link with each other. A null vec_id keeps its row; it counts as a link, but
never names a component unless it is alone (then null). An empty table gives none; very
long vectors are compared whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components, forest
from .vectors import farthest_first, finite_rows
from .worker import kernel

LEAF = 64
SLACK = 1e-9
#: Cells that a vector of the sample may lie in, on average.
COPIES = 3.0


class CoverTree:
    """Nodes over unit vectors: centre, covering radius, children; leaves hold rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.radius: list[float] = []
        self.centre: list[int] = []
        self.kids: list[np.ndarray | None] = []
        if not len(x):
            return
        todo = [(self._node(0, len(x), 0), 2.0)]
        while todo:
            node, r = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF or self.radius[node] <= 1e-7:
                continue
            parts: list[np.ndarray] = []
            while len(parts) < 2:
                r = min(r, self.radius[node]) / 2
                parts = self._net(self.order[lo:hi], r)
            kids, at = [], lo
            self.order[lo:hi] = np.concatenate(parts)
            for p in parts:
                kids.append(self._node(at, at + len(p), at))
                at += len(p)
            self.kids[node] = np.array(kids)
            todo += [(k, r) for k in kids]
        self.radii, self.centres = np.array(self.radius), np.array(self.centre)
        self.los, self.his = np.array(self.lo), np.array(self.hi)

    def _node(self, lo: int, hi: int, first: int) -> int:
        c = int(self.order[first])
        own = self.x[self.order[lo:hi]]
        self.lo.append(lo)
        self.hi.append(hi)
        self.centre.append(c)
        self.radius.append(float(np.sqrt(np.maximum(0, 2 - 2 * (own @ self.x[c]))).max()) if hi - lo > 1 else 0.0)
        self.kids.append(None)
        return len(self.lo) - 1

    def _net(self, rows: np.ndarray, r: float) -> list[np.ndarray]:
        """Parts around greedily chosen rows that are more than r apart; each row goes
        to the first that covers it. Candidates are taken 256 at a time."""
        parts, x = [], self.x[rows]
        while len(rows):
            near = 2 - 2 * (x @ x[:256].T) <= r * r
            covered, take = np.zeros(near.shape[1], bool), []
            for j in range(len(covered)):
                if not covered[j]:
                    take.append(j)
                    covered |= near[: len(covered), j]
            near = near[:, take]
            near[take, np.arange(len(take))] = True
            first = near.argmax(1)
            done = near[np.arange(len(rows)), first]
            order = np.flatnonzero(done)[np.argsort(first[done], kind="stable")]
            parts += np.split(rows[order], np.cumsum(np.bincount(first[done], minlength=len(take)))[:-1])
            rows, x = rows[~done], x[~done]
        return parts

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of nodes one behind the other, and the number of each."""
        n = self.his[nodes] - self.los[nodes]
        return self.order[np.repeat(self.los[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Links:
    """Counts of partners, and each vector's root in the forest of all links. Links
    within a tree of the forest are dropped as they come, so memory is bounded."""

    def __init__(self, n: int):
        self.counts = np.zeros(n, np.int64)
        self.root = np.arange(n)
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.computed = 0

    def keep(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.root[i], self.root[j]
        new = i != j
        if new.any():
            self.ends.append((i[new], j[new]))
            self.held += int(new.sum())
            if self.held > 20_000:
                self.join()

    def join(self) -> None:
        if self.ends:
            u, v = forest(*map(np.concatenate, zip(*self.ends, strict=True)))
            turn = np.arange(len(self.root))
            turn[u] = v
            self.root, self.ends, self.held = turn[self.root], [], 0

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each vector but the roots with its root."""
        self.join()
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return own, self.root[own]


def link(out: Links, a: CoverTree, b: CoverTree, at: np.ndarray, to: np.ndarray, sizes: np.ndarray, threshold: float, both: bool) -> None:
    """Adds the links between the vectors of two trees (one tree twice: each pair once,
    and each vector with itself). `at` and `to` number their vectors as `out` and `sizes`
    do; `both`: vectors of b count their partners, too."""
    if not len(at) or not len(to):
        return
    eps = np.sqrt(max(0.0, 2 - 2 * threshold))
    same = a is b
    total_a, total_b = (np.concatenate(([0], np.cumsum(sizes[own[t.order]]))) for t, own in ((a, at), (b, to)))

    def credit(t: CoverTree, own: np.ndarray, nodes: np.ndarray, hit: np.ndarray, o: CoverTree, others: np.ndarray, total: np.ndarray) -> None:
        """Count for the rows of `nodes` all rows of the `others` that they hit, and tie
        rows of a node that hits any to its centre, as all of them link with what it hits."""
        some = np.flatnonzero(hit.any(1))
        if len(some):
            gain = hit[some] @ (total[o.his[others]] - total[o.los[others]])
            rows, n = t.spread(nodes[some])
            out.counts[own[rows]] += np.repeat(gain, n)
            out.keep(own[rows], np.repeat(own[t.centres[nodes[some]]], n))

    todo = [(0, 0)]
    while todo:
        m, n = todo.pop()
        ka, kb = a.kids[m], b.kids[n]
        one = same and m == n
        if ka is None and kb is None:
            i, j = a.rows(m), b.rows(n)
            out.computed += len(i) * len(j)
            near = a.x[i] @ b.x[j].T >= threshold
            if one:
                near[np.arange(len(i)), np.arange(len(i))] = True
            if near.any():
                gain = near.astype(float)
                out.counts[at[i]] += (gain @ sizes[to[j]]).astype(np.int64)
                if both and not one:
                    out.counts[to[j]] += (sizes[at[i]] @ gain).astype(np.int64)
                near_i, near_j = np.nonzero(near)
                out.keep(at[i[near_i]], to[j[near_j]])
            continue
        if one:
            kb = ka
        elif kb is None or (ka is not None and a.radii[m] >= b.radii[n]):
            kb = np.array([n])
        else:
            ka = np.array([m])
        step = 64 if one else 512
        for lo in range(0, len(ka), step):
            part = ka[lo : lo + step]
            rest = kb[lo:] if one else kb  # of one tree, kids from each one onwards
            out.computed += len(part) * len(rest)
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centres[part]] @ b.x[b.centres[rest]].T)))
            if one:
                d[np.arange(len(part)), np.arange(len(part))] = 0
            reach = a.radii[part][:, None] + b.radii[rest][None, :]
            once = np.arange(len(rest))[None, :] >= np.arange(len(part))[:, None] if one else np.ones(d.shape, bool)
            whole = once & (d + reach <= eps - SLACK)
            if whole.any():
                credit(a, at, part, whole, b, rest, total_b)
                if both:
                    half = whole & (part[:, None] != rest[None, :]) if same else whole
                    credit(b, to, rest, half.T, a, part, total_a)
                p, q = np.nonzero(whole)
                out.keep(at[a.centres[part[p]]], to[b.centres[rest[q]]])
            todo += [(int(part[p]), int(rest[q])) for p, q in zip(*np.nonzero(once & ~whole & (d <= reach + eps + SLACK)), strict=True)]


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = 8192, sample: int = 4096, owner: str = "") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding,
    label). `sample` bounds the rows, and `sample / 8` the pivots, that the driver sees."""

    def clean(batches):
        for batch in batches:
            ok, ends, x = finite_rows(batch.column("embedding"))
            raw = [x[s:e].tobytes() if o and x[s:e].any() else None for o, s, e in zip(ok.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "v"])

    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(kernel(clean), "vec_id long, label string, v binary")
    key = F.when(F.col("label").isNotNull() & F.col("v").isNotNull(), F.sha2(F.concat(F.col("label").cast("binary"), F.lit(b"\x00"), F.col("v")), 256))
    rows = settle(rows.withColumn("k", key), "vectors", owner)
    classes = settle(rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v")), "classes", owner)
    n = classes.count()
    part = min(1.0, sample / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(part * (1 << 30))).select("label", "v", "k").orderBy(F.xxhash64("k"), "k").limit(2 * sample).collect()
    by: dict[tuple[str, int], list[bytes]] = {}
    for r in picked:
        by.setdefault((r["label"], len(r["v"])), []).append(bytes(r["v"]))
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def reached(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors the nearest pivot, and the cells that they lie in."""
        d2 = np.maximum(0, 2 - 2 * (x @ p.T))
        near = d2.argmin(1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.nan_to_num((d2 - d2.min(1)[:, None]) / (2 * gap), nan=0.0) <= eps + SLACK
        inside[np.arange(len(x)), near] = True
        return near, inside

    pivots = {}
    for g, raw in by.items():
        cells = min(-(-int(len(raw) / part) // block), len(raw) // 8)
        x = _unit(raw)
        spread = farthest_first(x, cells) if cells > 1 else x[:1]
        while len(spread) > 1 and reached(x, spread)[1].sum() > COPIES * len(x):
            spread = spread[: len(spread) // 2]
        if len(spread) > 1:
            pivots[g] = spread

    def place(batches):
        for batch in batches:
            labels, raw = batch.column("label").to_pylist(), batch.column("v").to_pylist()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, v) in enumerate(zip(labels, raw, strict=True)):
                groups.setdefault((label, len(v)), []).append(i)
            take, cell, home = [], [], []
            for g, own in groups.items():
                own = np.array(own)
                if g not in pivots:
                    take.append(own)
                    cell.append(np.zeros(len(own), np.int32))
                    home.append(np.ones(len(own), bool))
                    continue
                near, in_reach = reached(_unit([raw[i] for i in own]), pivots[g])
                i, c = np.nonzero(in_reach)
                take.append(own[i])
                cell.append(c.astype(np.int32))
                home.append(c == near[i])
            at = np.concatenate(take) if take else np.empty(0, np.int64)
            idx = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("label").take(idx), batch.column("rep").take(idx), batch.column("size").take(idx), batch.column("v").take(idx), batch.column("k").take(idx), pa.array(np.concatenate(cell) if cell else [], pa.int32()), pa.array(np.concatenate(home) if home else [], pa.bool_())], ["label", "rep", "size", "v", "k", "cell", "home"])

    placed = settle(classes.select("label", "rep", "size", "v", "k").mapInArrow(kernel(place), "label string, rep long, size long, v binary, k string, cell int, home boolean").withColumn("dim", F.length("v")), "placed", owner)
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    salted = placed.join(cells, ["label", "dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int"))
    # a row goes to the pairs (i, j), i <= j, of its block with each block
    every = salted.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"))
    sides = every.select("label", "dim", "cell", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "k", "size", "v", "home").repartition("label", "dim", "cell", "i", "j")

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        home = table.column("home").to_numpy(zero_copy_only=False)
        if not home.any():
            return pa.table({"k": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "l": pa.array([], pa.string())})
        first = table.column("salt").to_numpy() == table.column("i")[0].as_py()
        k, x = np.array(table.column("k").to_pylist(), object), _unit(table.column("v").to_pylist())
        size, out = table.column("size").to_numpy(), Links(len(k))

        def tree(mask: np.ndarray) -> tuple[CoverTree, np.ndarray]:
            own = np.flatnonzero(mask)
            return CoverTree(x[own]), own

        (h1, i1), (g1, j1) = tree(home & first), tree(~home & first)
        if first.all():
            link(out, h1, h1, i1, i1, size, threshold, True)
            link(out, h1, g1, i1, j1, size, threshold, False)
        else:
            (h2, i2), (g2, j2) = tree(home & ~first), tree(~home & ~first)
            link(out, h1, h2, i1, i2, size, threshold, True)
            link(out, h1, g2, i1, j2, size, threshold, False)
            link(out, h2, g1, i2, j1, size, threshold, False)
        u, v = out.edges()
        own = np.flatnonzero(home)
        return pa.table({"k": pa.array([*k[own], *k[u]], pa.string()), "n": pa.array([*out.counts[own].tolist(), *[0] * len(u)], pa.int64()), "l": pa.array([*[None] * len(own), *k[v]], pa.string())})

    found = settle(sides.groupBy("label", "dim", "cell", "i", "j").applyInArrow(pairs, "k string, n long, l string"), "found", owner)
    rep = classes.select("k", "rep")
    # classes whose vec_ids are all null carry no edge
    edges = found.where("l is not null").join(rep.select("k", F.col("rep").alias("a")), "k").join(rep.select(F.col("k").alias("l"), F.col("rep").alias("b")), "l").select("a", "b").where("a is not null and b is not null")
    comp = components(edges, owner)
    counts = found.groupBy("k").agg((F.sum("n") - 1).alias("n_links"))
    per_class = classes.select("k", "rep").join(counts, "k").join(comp, F.col("rep") == F.col("node"), "left").select("k", "n_links", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "k").join(per_class, "k", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
