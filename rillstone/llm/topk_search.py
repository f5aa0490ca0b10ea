"""Exact top-k inner products with M-trees.

Inner product becomes a metric by one more coordinate: a row x is (x, sqrt(M^2-|x|^2))
with M the largest norm, a query q is (q, 0); then distance falls as the product grows.
Pivots of a bounded sample cut the rows into cells, as many as there are blocks of rows
(`cells` at most), and cells into blocks of about `block` rows. First each query is
answered within one block of its nearest cell, which gives a lower bound of its k-th
score. Then it visits the blocks of those cells only whose covering radius does not
exclude a better row. A block is an M-tree: pages of entries with covering radii and
stored distances to the parent; the search takes pages best first and skips an entry
without computing its distance where the stored distances and the triangle inequality
exclude it. A block goes to as many tasks as its queries ask for, one for about each
`query_block` of them, and to none if no query visits it; so a task holds a block of
rows and a block of queries, whatever the size of the table.

Defined results: vectors that are null or hold a null or non-finite component take no
part; vectors of unequal length count as padded with zeros, so an empty one scores 0;
rows with the query's own vec_id are no candidates; ties go to the smaller vec_id, and
repeated rows take a rank each; of a query id with several vectors the first in byte
order asks; an empty table gives none; further columns are ignored. A null vec_id is a
candidate after all others with its
score, never a query. A score that does not fit 64 bits raises OverflowError.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .vectors import farthest_first, finite_rows
from .worker import kernel

PAGE = 128
FAR = np.iinfo(np.int64).max


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of rows and a query that hold whole doubles."""
    if len(x) and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) < 2.0**53:
        return (x @ q).astype(np.int64)
    own = [int(v) for v in q]
    out = [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in x]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise OverflowError("an inner product does not fit 64 bits")
    return np.array(out, np.int64)


class MTree:
    """Pages over rows x in the augmented space; page p holds entries with a routing
    vector, a covering radius and the distance to the page's own routing vector."""

    def __init__(self, x: np.ndarray, norm: float):
        self.x = x
        self.norm2 = norm * norm
        self.last = np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(1)))
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[int] | None]] = []
        self.root = self._build(np.arange(len(x)), None) if len(x) else -1

    def _apart(self, rows: np.ndarray, i: int) -> np.ndarray:
        d = self.x[rows] - self.x[i]
        return np.sqrt((d * d).sum(1) + (self.last[rows] - self.last[i]) ** 2)

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        if len(rows) <= PAGE:
            to = self._apart(rows, parent) if parent is not None else np.zeros(len(rows))
            self.pages.append((rows, np.zeros(len(rows)), to, None))
            return len(self.pages) - 1
        seeds = [int(rows[0])]
        dist = [self._apart(rows, seeds[0])]
        least = dist[0].copy()
        for _ in range(min(PAGE, -(-len(rows) // PAGE)) - 1):
            i = int(least.argmax())
            if least[i] <= 0:
                break
            seeds.append(int(rows[i]))
            dist.append(self._apart(rows, seeds[-1]))
            least = np.minimum(least, dist[-1])
        near = np.argmin(dist, 0)
        if len(seeds) == 1 or np.bincount(near).max() == len(rows):  # all alike: cut evenly
            parts = np.array_split(np.arange(len(rows)), PAGE)
            seeds = [int(rows[p[0]]) for p in parts]
        else:
            parts = [np.flatnonzero(near == s) for s in range(len(seeds))]
        radii = np.array([self._apart(rows[p], s).max() for p, s in zip(parts, seeds, strict=True)])
        entry = np.array(seeds)
        to = self._apart(entry, parent) if parent is not None else np.zeros(len(entry))
        kids = [self._build(rows[p], s) for p, s in zip(parts, seeds, strict=True)]
        self.pages.append((entry, radii, to, kids))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, own: int, ids: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) pairs among scores of at least `floor`."""
        best: list[tuple[int, int]] = []
        if self.root < 0:
            return best
        qq = float(q @ q)
        slack = 1e-9 * (qq + self.norm2 + 1)

        def limit() -> float:
            least = best[0][0] if len(best) == k else floor
            return np.inf if least is None else float(np.sqrt(max(0.0, qq + self.norm2 - 2 * float(least) + slack)))

        todo = [(0.0, self.root, 0.0)]
        while todo:
            bound, page, to_parent = heapq.heappop(todo)
            most = limit()
            if bound > most:
                break
            entry, radii, stored, kids = self.pages[page]
            # stored distances exclude entries before their own distance is computed
            open_ = np.abs(to_parent - stored) - radii <= most * (1 + 1e-9) + 1e-9 if page != self.root else np.ones(len(entry), bool)
            rows = entry[open_]
            if not len(rows):
                continue
            if kids is None:
                rows = rows[ids[rows] != own]
                score = _scores(self.x[rows], q)
                least = best[0][0] if len(best) == k else floor
                if least is not None:
                    rows, score = rows[score >= least], score[score >= least]
                if len(rows) > 4 * k:  # what is below the page's own k-th is not among the best
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[score >= cut], score[score >= cut]
                for s, i in zip(score.tolist(), ids[rows].tolist(), strict=True):
                    item = (s, -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            d = np.sqrt(np.maximum(0.0, qq + self.norm2 - 2 * (self.x[rows] @ q)))
            low = np.maximum(0.0, d - radii[open_])
            places = np.flatnonzero(open_)
            for j in np.flatnonzero(low <= most * (1 + 1e-9) + 1e-9).tolist():
                heapq.heappush(todo, (float(low[j]), kids[int(places[j])], float(d[j])))
        return sorted(best, reverse=True)


def top_inner_products(vectors: DataFrame, k: int = 10, scale: float = 1024.0, every: int = 100, block: int = 4096, query_block: int = 4096, sample: int = 4096, cells: int = 1024, owner: str = "") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query, the rows whose
    vec_id is divisible by `every`. The driver sees a sample of at most twice `sample`,
    or 16 * `cells`, rows and the statistics of at most `cells` cells."""
    spark = vectors.sparkSession

    def whole(batches):
        for batch in batches:
            ok, ends, x = finite_rows(batch.column("embedding"))
            x = np.floor(scale * x)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in keep.tolist()], pa.binary())], ["vec_id", "x"])

    rows = settle(vectors.select("vec_id", "embedding").mapInArrow(kernel(whole), "vec_id long, x binary"), "whole", owner)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.length("x")), F.lit(0))).first()
    width = max(1, width // 8)

    def load(raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(r.ljust(8 * width, b"\0") for r in raw), np.float64).reshape(len(raw), width)

    cells = max(1, min(cells, n // block))
    sample = max(sample, 8 * cells)
    part = min(1.0, sample / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < int(part * (1 << 30))).select("vec_id", "x").orderBy(F.xxhash64("vec_id", "x"), "x").limit(2 * sample).collect()
    pivots = farthest_first(load([bytes(r["x"]) for r in picked]), cells) if picked else np.zeros((1, width))

    def place(batches):
        for batch in batches:
            x = load(batch.column("x").to_pylist())
            d2 = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)
            cell = d2.argmin(1)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(np.sqrt((x * x).sum(1)))], ["vec_id", "x", "cell", "d", "norm"])

    placed = settle(rows.mapInArrow(kernel(place), "vec_id long, x binary, cell int, d double, norm double"), "placed", owner)
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.max("norm").alias("norm")).collect()}
    known = sorted(stats)
    salts = {c: max(1, -(-stats[c]["n"] // block)) for c in known}
    radius, norms = np.array([stats[c]["radius"] for c in known]), np.array([stats[c]["norm"] for c in known])
    norm = float(norms.max()) if len(norms) else 0.0
    centre = pivots[known] if known else pivots[:0]
    salt_of = F.create_map(*[F.lit(v) for c in known for v in (c, salts[c])]) if known else F.create_map(F.lit(0), F.lit(1))
    data = placed.select("vec_id", "x", "cell", F.pmod(F.xxhash64("vec_id", "x"), salt_of[F.col("cell")]).cast("int").alias("salt"))
    asking = data.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("x", "cell", "salt")).alias("s"))
    queries = asking.select(F.col("vec_id").alias("q_id"), F.col("s.x").alias("q"), F.col("s.cell").alias("cell"), F.col("s.salt").alias("salt"))

    def best_in_block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if left.num_rows and right.num_rows:
            x = load(left.column("x").to_pylist())
            names = left.column("vec_id").to_pylist()
            ids = np.array([FAR if v is None else v for v in names], np.int64)
            tree = MTree(x, norm)
            asked = load(right.column("q").to_pylist())
            floors = right.column("floor").to_pylist()
            for q, own, floor in zip(asked, right.column("q_id").to_pylist(), floors, strict=True):
                out += [(own, None if -v == FAR else -v, s) for s, v in tree.search(q, own, ids, k, floor)]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.int64())})

    keys = ["cell", "salt", "qb"]

    def ask(asked: DataFrame, salted: bool) -> DataFrame:
        """Queries of cells (`salted`: of one block each) meet the blocks that they visit."""
        visits = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        turns = {c: max(1, -(-n // (query_block * (salts[c] if salted else 1)))) for c, n in visits.items()} or {0: 1}
        turns_of = F.create_map(*[F.lit(v) for pair in sorted(turns.items()) for v in pair])
        spread = data.where(F.col("cell").isin(sorted(turns))).select("*", F.explode(F.sequence(F.lit(0), turns_of[F.col("cell")] - 1)).alias("qb"))
        if not salted:
            asked = asked.select("*", F.explode(F.sequence(F.lit(0), salt_of[F.col("cell")] - 1)).alias("salt"))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("q_id", F.lit(1)), turns_of[F.col("cell")]).cast("int"))
        return spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best_in_block, "query_id long, vec_id long, score long")

    queries = settle(queries, "queries", owner)
    first = ask(queries.withColumn("floor", F.lit(None).cast("long")), True)
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("q_id"), "floor")

    def route(batches):
        for batch in batches:
            q = load(batch.column("q").to_pylist())
            floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()], np.float64)
            # <q, x> <= <q, centre> + |q| * radius, and <= |q| * largest norm
            length = np.sqrt((q * q).sum(1))
            top = np.minimum(q @ centre.T + length[:, None] * radius, length[:, None] * norms)
            i, c = np.nonzero(top * (1 + 1e-9) + 1e-6 * (1 + np.abs(top)) >= floor[:, None])
            idx = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column("q_id").take(idx), batch.column("q").take(idx), batch.column("floor").take(idx), pa.array(np.array(known, np.int32)[c])], ["q_id", "q", "floor", "cell"])

    routed = settle(queries.select("q_id", "q").join(floors, "q_id", "left").select("q_id", "q", "floor").mapInArrow(kernel(route), "q_id long, q binary, floor long, cell int"), "routed", owner)
    found = ask(routed, False)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v WHERE vec_id % 100 = 0),
c AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (SELECT query_id, vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
