"""Exact top-k inner products by best-first search of M-trees.

A vector x is lifted to (x, sqrt(M - |x|**2)), M the largest squared length, and a query q to
(q, 0); their Euclidean distance is then sqrt(|q|**2 + M - 2 q.x), so the nearest lifted vectors
have the largest inner products. The top of the tree is kept in tables: vectors go to the nearest of
a bounded number of pivots (cells), a cell's to rings by their distance to its pivot, and a ring's
to shards of bounded bytes, each with the range of these distances. A shard is an M-tree of pages,
built and stored once: every entry of a routing page holds a routing vector, its distance to the
page's own routing vector (the parent distance) and the covering radius of the page below; every
entry of a leaf its parent distance. A query's search keeps pages in a heap by the least distance
they can hold and ends when that passes the k-th best found. Before a distance is computed, the
bound |d(q, parent) - d(entry, parent)| - radius, which needs none, is tested. Queries of a block
search together: those that are at one page share a matrix product.

Each query first searches the shard that may hold the nearest vector; its k-th score then decides
which others it has to visit. Blocks of queries meet stored trees, so neither side is ever whole in
one place."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import narrowed, small_batches, stored

#: Entries of a page.
PAGE = 128
#: Most vectors, and bytes of components, of a shard; and of a block of queries.
SHARD, SHARD_BYTES = 16_384, 8 << 20
QUERIES, QUERY_BYTES = 2_048, 4 << 20
#: Vector lengths that get cells, the most frequent ones, and for each the most pivots and their bytes.
LENGTHS, PIVOTS, PIVOT_BYTES = 32, 256, 1 << 20
#: Rings of a cell, at most.
RINGS = 64
#: From here on, float scores are no longer exact and integers decide.
_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


class Page:
    """leaf: numbers of its entries' vectors; else of routing vectors, their radii, pages below."""

    __slots__ = ("rows", "parent", "radius", "below", "x")

    def __init__(self, rows, parent, radius, below):
        self.rows, self.parent, self.radius, self.below, self.x = rows, parent, radius, below, None


def _distances(x: np.ndarray, h: np.ndarray, to: np.ndarray, to_h: float) -> np.ndarray:
    d = x - to
    return np.sqrt(np.einsum("ij,ij->i", d, d) + (h - to_h) ** 2)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """The added component of each row of x."""
    return np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", x, x)))


def slack(dim: int) -> float:
    """A bound of a distance's rounding error, relative to sqrt(|q|**2 + M)."""
    return 1e-9 + 4 * float(np.sqrt((dim + 2) * np.finfo(float).eps))


class MTree:
    """An M-tree over integer vectors lifted to the sphere of squared radius `most`. rows: numbers
    that tell entries with one id apart (default: the ids)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, self.most = ids[order], vectors[order], float(most)
        self.own = self.ids if rows is None else rows[order]
        self.computed = 0
        self._lift()
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else None

    def _lift(self) -> None:
        self.x = self.v.astype(np.float64)
        self.h = lifted(self.x, self.most)

    def packed(self) -> bytes:
        """The tree as bytes, components in as few as they need."""
        low, high = (int(self.v.min()), int(self.v.max())) if self.v.size else (0, 0)
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)

        def plain(page):
            return page and (page.rows.astype(np.int32), page.parent, page.radius, page.below and [plain(b) for b in page.below])

        return pickle.dumps((self.ids, self.own, self.v.astype(kind), self.most, plain(self.root)), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.ids, tree.own, tree.v, tree.most, root = pickle.loads(data)
        tree.computed = 0
        tree._lift()

        def page(p):
            return p and Page(p[0], p[1], p[2], p[3] and [page(b) for b in p[3]])

        tree.root = page(root)
        return tree

    def _split(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Up to PAGE routing vectors, spread through the rows, and the rows nearest to each; a
        group larger than its share of the page below is cut by distance."""
        want = int(min(PAGE, -(-len(rows) // PAGE)))
        picks = rows[np.linspace(0, len(rows) - 1, want).astype(int)]
        best, near = np.full(len(rows), np.inf), np.zeros(len(rows), int)
        for i, p in enumerate(picks):
            d = _distances(self.x[rows], self.h[rows], self.x[p], self.h[p])
            closer = d < best
            best[closer], near[closer] = d[closer], i
        groups = [(int(p), rows[near == i]) for i, p in enumerate(picks)]
        groups = [g for g in groups if len(g[1])]
        if max(len(g[1]) for g in groups) > 0.9 * len(rows):  # many equal vectors: cut by distance
            far = np.argsort(_distances(self.x[rows], self.h[rows], self.x[picks[0]], self.h[picks[0]]), kind="stable")
            groups = [(int(part[0]), part) for part in np.array_split(rows[far], want) if len(part)]
        return groups

    def _build(self, rows: np.ndarray, route: int | None) -> Page:
        to = (self.x[route], self.h[route]) if route is not None else None
        if len(rows) <= PAGE:
            parent = _distances(self.x[rows], self.h[rows], *to) if to else np.zeros(len(rows))
            return Page(rows, parent, np.zeros(len(rows)), None)
        picks, below, radius = [], [], []
        for p, part in self._split(rows):
            picks.append(p)
            radius.append(_distances(self.x[part], self.h[part], self.x[p], self.h[p]).max())
            below.append(self._build(part, p))
        picks = np.array(picks)
        parent = _distances(self.x[picks], self.h[picks], *to) if to else np.zeros(len(picks))
        return Page(picks, parent, np.array(radius), below)

    def search(self, q: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """The k (score, id) of largest inner product with q, ties to the smaller id, without the
        row numbered `own`."""
        return self.search_many(np.asarray(q)[None], k, [own])[0]

    def search_many(self, queries: np.ndarray, k: int, own: list, least: list | None = None) -> list[list[tuple[int, int]]]:
        """search() for each query; least: a score below which results are not wanted, or None.
        Distances prune with a slack above rounding; scores are exact integers."""
        n = len(queries)
        if self.root is None or k < 1 or not n:
            return [[] for _ in range(n)]
        q = queries.astype(np.float64)
        qq = np.einsum("ij,ij->i", q, q) + self.most
        loose = slack(q.shape[1]) * (1 + np.sqrt(qq))
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # heaps: the first is the k-th
        floor = [None] * n if least is None else list(least)
        limit = np.array([np.inf if f is None else np.sqrt(max(0.0, qq[i] - 2.0 * f)) + loose[i] for i, f in enumerate(floor)])
        exact = self.most * qq.max() < _EXACT**2
        heaps: list[list] = [[(0.0, 0, self.root, None)] for _ in range(n)]
        count, live = 0, range(n)
        while live:
            at: dict[int, tuple[Page, list, list]] = {}
            still = []
            for i in live:
                if not heaps[i]:
                    continue
                low, _, page, to_parent = heapq.heappop(heaps[i])
                if low > limit[i]:
                    continue
                still.append(i)
                _, who, far = at.setdefault(id(page), (page, [], []))
                who.append(i)
                far.append(to_parent)
            live = still
            for page, who, far in at.values():
                who = np.array(who)
                if page.x is None:
                    page.x = self.x[page.rows]
                if far[0] is None:
                    maybe = np.ones((len(who), len(page.rows)), bool)
                else:
                    maybe = np.abs(np.array(far)[:, None] - page.parent) - page.radius <= limit[who, None]
                use = np.flatnonzero(maybe.any(0))
                if not len(use):
                    continue
                maybe = maybe[:, use]
                self.computed += int(maybe.sum())
                score = q[who] @ page.x[use].T
                distance = np.sqrt(np.maximum(0.0, qq[who, None] - 2 * score))
                if page.below is None:
                    maybe &= distance <= limit[who, None]
                    for j in np.flatnonzero(maybe.any(1)).tolist():
                        i, some = int(who[j]), np.flatnonzero(maybe[j])
                        rows = page.rows[use[some]]
                        if exact:
                            found = score[j, some].astype(np.int64).tolist()
                            if len(found) > 4 * k:  # ties stay, as ids decide between them
                                least_found = heapq.nlargest(k + 1, found)[-1]
                                keep = [a for a, f in enumerate(found) if f >= least_found]
                                found, rows = [found[a] for a in keep], rows[keep]
                        else:
                            found = [sum(map(int.__mul__, self.v[r].tolist(), queries[i].tolist())) for r in rows.tolist()]
                        heap = best[i]
                        for f, name, row in zip(found, self.ids[rows].tolist(), self.own[rows].tolist()):
                            if row == own[i] or (floor[i] is not None and f < floor[i]):
                                continue
                            if len(heap) < k:
                                heapq.heappush(heap, (f, -name))
                            elif (f, -name) > heap[0]:
                                heapq.heapreplace(heap, (f, -name))
                        if len(heap) == k:
                            kth = float(np.sqrt(max(0.0, qq[i] - 2.0 * heap[0][0])) + loose[i])
                            limit[i] = min(limit[i], kth)
                else:
                    low = np.maximum(distance - page.radius[use] - loose[who, None], 0.0)
                    maybe &= low <= limit[who, None]
                    for j, i in enumerate(who.tolist()):
                        for a in np.flatnonzero(maybe[j]).tolist():
                            count += 1
                            heapq.heappush(heaps[i], (float(low[j, a]), count, page.below[use[a]], float(distance[j, a])))
        return [[(f, -name) for f, name in sorted(heap, reverse=True)] for heap in best]


def integers(vector: F.Column, scale: float = 256.0) -> F.Column:
    """floor(scale * x) of each component as double; null if the vector or a component is null or
    not finite."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")))


def shard_rows(dim: F.Column, shard: int) -> F.Column:
    return F.least(F.lit(shard), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.greatest(dim, F.lit(1))))))


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _runs(batch: pa.RecordBatch, keys: int):
    """(key, start, stop) of the runs of equal first `keys` columns."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
    if not batch.num_rows:
        return
    edge = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(c[a].item() for c in columns), a, b


def _grouped(batches, keys: int):
    """(key, record batches) of rows sorted by their first `keys` columns, one group at a time."""
    last, held = None, []
    for batch in batches:
        for key, a, b in _runs(batch, keys):
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def _pivots(own: DataFrame, sizes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of the most frequent vector lengths: bounded numbers and bytes."""
    many = {r["dim"]: r["parts"] for r in sizes.where("parts > 1 and dim > 0").orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    out = {}
    for dim, parts in many.items():
        n = int(min(PIVOTS, parts, max(1, PIVOT_BYTES // (8 * dim))))
        rows = own.where(F.col("dim") == dim).select("v").orderBy(F.xxhash64("v"), "row").limit(n).collect()
        out[dim] = np.array([r["v"] for r in rows], np.float64)
    return out


def _cells(own: DataFrame, pivots: dict[int, np.ndarray], most: float) -> DataFrame:
    """own with cell, the nearest pivot, and d, the distance to it (0, 0 for lengths without)."""
    held = own.sparkSession.sparkContext.broadcast({d: (p, lifted(p, most)) for d, p in pivots.items()})

    def run(batches):
        for batch in batches:
            cell, d = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            dims, v = batch.column(2).to_numpy(), batch.column(3)
            for dim in np.unique(dims).tolist():
                if dim not in held.value:
                    continue
                at = np.flatnonzero(dims == dim)
                p, ph = held.value[dim]
                for a in range(0, len(at), 4096):
                    some = at[a : a + 4096]
                    x = _matrix(v.take(pa.array(some)), dim).astype(np.float64)
                    h = lifted(x, most)
                    near = np.argmin((p * p).sum(1) + ph * ph - 2 * (x @ p.T + np.outer(h, ph)), axis=1)
                    cell[some] = near
                    diff = x - p[near]
                    d[some] = np.sqrt(np.einsum("ij,ij->i", diff, diff) + (h - ph[near]) ** 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d)], [*batch.schema.names, "cell", "d"])

    return small_batches(own).mapInArrow(run, "row long, vec_id long, dim int, v array<long>, cell int, d double")


def _trees(cells: DataFrame, sizes: DataFrame, most: float, shard: int) -> DataFrame:
    """A row for each shard: (dim, cell, ring, part), the range of its distances to the cell's pivot,
    and its tree (stored)."""
    ring_edges = F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1_000).alias("edges")
    shape = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), ring_edges)
    shape = shape.withColumn("rings", F.least(F.lit(RINGS), F.ceil(F.col("n") / shard_rows(F.col("dim"), shard))).cast("int"))
    # At most LENGTHS * PIVOTS cells with pivots; lengths without have one each.
    rows = cells.join(shape.select("dim", "cell", "rings", "edges"), ["dim", "cell"])
    place = F.size(F.filter("edges", lambda e: e < F.col("d")))
    rows = rows.withColumn("ring", F.floor(place * F.col("rings") / RINGS).cast("int")).drop("edges", "rings")
    rows = stored(rows, "rings")
    parts = rows.groupBy("dim", "cell", "ring").agg(F.ceil(F.count("*") / shard_rows(F.col("dim"), shard)).cast("int").alias("parts"))
    rows = rows.join(parts, ["dim", "cell", "ring"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    keys = ["dim", "cell", "ring", "part"]
    rows = rows.select(*keys, "row", "vec_id", "v", "d")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for (dim, cell, ring, part), held in _grouped(batches, 4):
            row, ids, d = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("row", "vec_id", "d"))
            v = np.concatenate([_matrix(b.column("v"), dim) for b in held])
            tree = MTree(ids, v, most, row).packed()
            columns = [[dim], [cell], [ring], [part], [float(d.min())], [float(d.max())], [tree]]
            kinds = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*keys, "near", "far", "tree"])

    return stored(small_batches(rows).mapInArrow(run, "dim int, cell int, ring int, part int, near double, far double, tree binary"), "trees")


FOUND = "query_row long, query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, queries: DataFrame, trees: DataFrame, k: int, block: int) -> DataFrame:
    """FOUND of the pairs (query_row, dim, cell, ring, part, least), by blocks of queries."""
    keys = ["dim", "cell", "ring", "part"]
    pairs = stored(pairs, "pairs")
    most = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(QUERY_BYTES) / (8 * F.greatest(F.col("dim"), F.lit(1))))))
    counts = pairs.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    asked = pairs.join(counts, keys).join(queries.select("query_row", "query_id", "v"), "query_row")
    asked = asked.groupBy(*keys, F.pmod(F.xxhash64("query_row"), F.col("blocks")).alias("block"))
    asked = asked.agg(F.collect_list(F.struct("query_row", "query_id", "v", "least")).alias("queries"))
    met = asked.join(trees.select(*keys, "tree"), keys).select("dim", "tree", "queries")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tree = MTree.unpacked(batch.column(1)[i].as_py())
                asks = batch.column(2)[i].values
                row, name = (asks.field(c).to_pylist() for c in ("query_row", "query_id"))
                found = tree.search_many(_matrix(asks.field("v"), batch.column(0)[i].as_py()), k, row, asks.field("least").to_pylist())
                out = [(r, n, other, max(-_LONG - 1, min(score, _LONG))) for r, n, f in zip(row, name, found) for score, other in f]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, [c.split()[0] for c in FOUND.split(", ")])

    return stored(small_batches(met).mapInArrow(run, FOUND), "found")


def top_inner_products(df: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows
    of largest integer inner product among all others, ties to the smaller id (all, if fewer).

    Vectors that are null or hold null or non-finite components take no part, nor do rows without
    an id. Rows that repeat an id are all candidates, and each asks for itself. Vectors meet only
    vectors of their own length; empty ones score 0. Scores are exact integers; those beyond a long
    are the nearest long. Other columns play no part; no rows give none."""
    own = narrowed(df, vec_id=id, v=vector).where("vec_id is not null")
    own = own.select(F.col("vec_id").cast("long"), integers(F.col("v"), scale).alias("v")).where("v is not null")
    own = own.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v")
    own = stored(own, "vectors")
    sizes = own.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)")).alias("most"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("n") / shard_rows(F.col("dim"), shard))), "sizes")
    most = sizes.agg(F.max("most")).first()[0] or 0.0
    pivots = _pivots(own, sizes)
    cells = stored(_cells(own, pivots, most), "cells")
    trees = _trees(cells, sizes, most, shard)
    top = trees.drop("tree")
    queries = stored(cells.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "dim", "v"), "queries")
    held = df.sparkSession.sparkContext.broadcast((pivots, {d: (p * p).sum(1) + lifted(p, most) ** 2 for d, p in pivots.items()}))

    def to_cells(batches):
        """Each query with each cell of its length: distance to the pivot, and what bounds it."""
        for batch in batches:
            for (dim,), part in _grouped([batch.select(["dim", "query_row", "v"])], 1):
                part = pa.Table.from_batches(part).combine_chunks()
                row, q = part["query_row"].to_numpy(), _matrix(part["v"].combine_chunks(), dim).astype(np.float64)
                qq = np.einsum("ij,ij->i", q, q)
                if dim in held.value[0]:
                    p, size = held.value[0][dim], held.value[1][dim]
                    d = np.sqrt(np.maximum(0.0, qq[:, None] + size - 2 * q @ p.T))
                else:
                    d = np.zeros((len(q), 1))
                n = d.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(row, n)), pa.array(np.full(len(row) * n, dim, np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(row))), pa.array(d.ravel()), pa.array(np.repeat(qq + most, n))],
                    ["query_row", "dim", "cell", "to_pivot", "size"],
                )

    near = small_batches(queries).mapInArrow(to_cells, "query_row long, dim int, cell int, to_pivot double, size double")
    loose = F.lit(slack(1)) * (1 + F.sqrt("size")) * F.sqrt(F.col("dim") + 2)
    # Lengths without pivots have one cell and no bound.
    bound = F.when(F.col("dim").isin(*pivots) if pivots else F.lit(False), F.greatest(F.col("to_pivot") - F.col("far"), F.col("near") - F.col("to_pivot")) - loose)
    visits = near.join(top, ["dim", "cell"]).withColumn("low", F.greatest(F.lit(0.0), F.coalesce(bound, F.lit(0.0))))
    keys = ["query_row", "dim", "cell", "ring", "part"]
    first = visits.groupBy("query_row", "dim").agg(F.min(F.struct("low", "to_pivot", "cell", "ring", "part")).alias("b"))
    first = stored(first.select("query_row", "dim", "b.cell", "b.ring", "b.part", F.lit(None).cast("long").alias("least")), "first")
    found = _searched(first, queries, trees, k, block)
    kth = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = visits.join(first.select(*keys), keys, "left_anti").join(kth, "query_row", "left")
    limit = F.sqrt(F.greatest(F.lit(0.0), F.col("size") - 2.0 * F.col("least"))) + loose
    rest = rest.where(F.col("least").isNull() | (F.col("low") <= limit)).select(*keys, "least")
    found = found.union(_searched(rest, queries, trees, k, block))
    # A shard gives at most k rows a query, so a query's rows are few.
    best = found.groupBy("query_row", "query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("all"))
    best = best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "b"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def brute_force(ids: list[int], vectors: list[list[int]], queries: list[int], k: int):
    """The same by all inner products, as a pandas frame; for tests."""
    import pandas as pd

    x = np.array(vectors, np.int64)
    out = []
    for q in queries:
        score = x @ x[ids.index(q)]
        near = sorted((-int(s), i) for s, i in zip(score, ids) if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
