"""Exact top-k search by inner product with dual cover trees.

A cover tree of a bounded sample gives centres. Every row goes to the cell of its
nearest centre, queries by a coarser cut of the same tree; large cells are split by
a hash of the id. For a cell of queries with centre q and covering radius r and one
of candidates with p and s, no product is above <q, p> + |q| s + |p| r + r s. A query's kth
best product within the sample is at most its kth best of all, so a pair of cells whose
bound is below the least of these is skipped before any row is shuffled.

In each pair of blocks that is left, a cover tree of the queries and one of the candidates
are walked together: a pair of nodes whose bound is below the worst kth score that the
query node's queries hold so far is pruned. Leaves are compared exactly in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versotext.llm.text import PLACES, sample_rates

#: Below any score.
NONE = -(1 << 63)
#: Cells of one side at most, and bytes of sampled vectors.
MOST_CELLS = 512
SAMPLE_BYTES = 16 << 20


class CoverTree:
    """A cover tree over the rows of ``x``, built from the top and flattened into lists.

    Everything below a node of level l is within 2^l of its point (covering). Its children stand on points
    more than 2^(l - 1) apart, its own point among them (separation, nesting), each row below the
    nearest of them; their levels are below l, and levels at which a node would have one child are left
    out. A node of up to ``leaf`` rows holds them itself, and so does one whose rows are not
    near each other at all, only few (an eighth of ``leaf``, four at least) around a child: there is nothing to prune by.
    """

    def __init__(self, x: np.ndarray, leaf: int = 64):
        self.x = x.astype(np.float64)
        self.point: list[int] = []
        self.level: list[float] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        self.size: list[int] = []
        if len(x):
            self._build(leaf)
        self.centre = self.x[self.point]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def _node(self, point: int, rows: np.ndarray, distance: np.ndarray) -> int:
        self.point.append(point)
        self.radius.append(float(distance.max()))
        self.level.append(float(math.ceil(math.log2(self.radius[-1]))) if self.radius[-1] > 0 else -math.inf)
        self.children.append([])
        self.rows.append(None)
        self.size.append(len(rows))
        return len(self.point) - 1

    def _distance(self, rows: np.ndarray, point: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[point]) ** 2).sum(axis=1))

    def _build(self, leaf: int) -> None:
        rows = np.arange(len(self.x))
        distance = self._distance(rows, 0)
        todo = [(self._node(0, rows, distance), rows, distance)]
        least = max(4, leaf // 8)
        while todo:
            node, rows, distance = todo.pop()
            parts = self._parts(node, rows, distance, least) if len(rows) > leaf and self.radius[node] > 0 else None
            if parts is None:
                self.rows[node] = rows
                continue
            for point, own, d in parts:
                child = self._node(point, own, d)
                self.children[node].append(child)
                todo.append((child, own, d))

    def _parts(self, node: int, rows: np.ndarray, distance: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]] | None:
        """The children's points, farthest first, with their rows and distances; None if the rows lie too far apart."""
        cover = 2.0 ** (self.level[node] - 1)
        nearest, owner, points = distance.copy(), np.zeros(len(rows), dtype=np.int64), [self.point[node]]
        while nearest.max() > cover:
            if len(points) % 8 == 0 and (nearest <= cover).sum() < least * len(points):
                return None
            points.append(int(rows[nearest.argmax()]))
            d = self._distance(rows, points[-1])
            closer = d < nearest
            owner[closer] = len(points) - 1
            nearest = np.minimum(nearest, d)
        return [(p, rows[owner == i], nearest[owner == i]) for i, p in enumerate(points)]

    def below(self) -> list[np.ndarray]:
        """The rows below each node."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.point)
        for node in range(len(self.point) - 1, -1, -1):  # children come after their parents
            out[node] = self.rows[node] if self.rows[node] is not None else np.concatenate([out[c] for c in self.children[node]])
        return out

    def cut(self, most: int) -> np.ndarray:
        """Points of a cut through the tree: the node with most rows is opened first, while there are no more than ``most``."""
        cut = [0] if self.point else []
        while True:
            inner = [n for n in cut if self.children[n] and len(cut) - 1 + len(self.children[n]) <= most]
            if not inner:
                return self.centre[cut]
            node = max(inner, key=lambda n: (self.size[n], -n))
            cut.remove(node)
            cut += self.children[node]


def _most(a: np.ndarray, b: np.ndarray) -> int:
    """What no inner product of the two sets exceeds."""
    largest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    return largest[0] * largest[1] * a.shape[1]


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether float64 gives the products exactly."""
    return _most(a, b) < 1 << 52


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer vectors, exact: as float64 below 2^52, else as int64, cut off at its ends."""
    if _exact(a, b):
        return a.astype(np.float64) @ b.astype(np.float64).T
    if _most(a, b) < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    full = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda v: max(NONE + 1, min(-NONE - 1, v)), otypes=[np.int64])(full) if full.size else full.astype(np.int64)


def _top(place: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query place, id, score) the ``k`` best of each query, and each one's rank."""
    order = np.lexsort((ids, -scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    return order[rank < k], place[rank < k], rank[rank < k]


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int, least: np.ndarray | None = None, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, point id, score) of each query's ``k`` best points, its own id left out; ties to smaller ids.

    ``least`` is a score that each query's kth best of all is known to reach; points below it may be
    left out. ``counts`` gets the numbers of leaf pairs ``compared`` and of all leaf pairs, ``all``.
    """
    nq = len(queries)
    if not nq or not len(points):
        return (np.zeros(0, np.int64),) * 3
    qt, pt = CoverTree(queries, 16), CoverTree(points, 256)
    exact = _exact(queries, points)
    scores = np.full((nq, k), NONE, dtype=np.int64)
    ids = np.full((nq, k), np.iinfo(np.int64).max, dtype=np.int64)
    floor = np.full(nq, -np.inf) if least is None else least.astype(np.float64)
    below = qt.below()
    compared = 0

    def bound(a: int, b: int) -> float:
        """Above every product below the two nodes, rounding of the bound itself included."""
        reach = (qt.norm[a] + qt.radius[a]) * (pt.norm[b] + pt.radius[b])
        return float(qt.centre[a] @ pt.centre[b]) + qt.norm[a] * pt.radius[b] + pt.norm[b] * qt.radius[a] + qt.radius[a] * pt.radius[b] + 0.5 + 1e-9 * reach

    def held(rows: np.ndarray) -> np.ndarray:
        """What a point must reach to count for each query: an equal score may still win by a smaller id."""
        worst = scores[rows, k - 1]
        return np.maximum(np.where(worst == NONE, -np.inf, worst.astype(np.float64)), floor[rows])

    def compare(a: int, b: int) -> None:
        rows = qt.rows[a]
        step = max(64, (1 << 21) // len(rows))
        for begin in range(0, len(pt.rows[b]), step):
            cols = pt.rows[b][begin : begin + step]
            s = qt.x[rows] @ pt.x[cols].T if exact else products(queries[rows], points[cols])
            need = held(rows)
            s = np.where(query_ids[rows][:, None] == point_ids[cols][None], -np.inf if s.dtype.kind == "f" else NONE, s)
            if (need == -np.inf).any() and len(cols) >= k:
                need = np.maximum(need, np.partition(s, -k, axis=1)[:, -k].astype(np.float64))
            at, col = np.nonzero((s >= need[:, None]) & (s > NONE))
            if not len(at):
                continue
            kept = np.unique(at)
            old = scores[rows[kept]] > NONE
            place = np.concatenate((at, np.repeat(kept, k)[old.ravel()]))
            names = np.concatenate((point_ids[cols[col]], ids[rows[kept]][old]))
            values = np.concatenate((s[at, col].astype(np.int64), scores[rows[kept]][old]))
            chosen, place, rank = _top(place, names, values, k)
            scores[rows[place], rank], ids[rows[place], rank] = values[chosen], names[chosen]

    todo = [(bound(0, 0), 0, 0)]
    while todo:
        top, a, b = todo.pop()
        if top < held(below[a]).min():
            continue
        if qt.rows[a] is not None and pt.rows[b] is not None:
            compared += 1
            compare(a, b)
            continue
        left = [a] if qt.rows[a] is not None else qt.children[a]
        right = [b] if pt.rows[b] is not None else pt.children[b]
        # the best bound is taken first
        todo += sorted((bound(x, y), x, y) for x in left for y in right)
    if counts is not None:
        counts["compared"] = counts.get("compared", 0) + compared
        counts["all"] = counts.get("all", 0) + sum(r is not None for r in qt.rows) * sum(r is not None for r in pt.rows)
    full = scores > NONE
    return np.nonzero(full)[0], ids[full], scores[full]


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as long; null for a vector that is null or holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long")))


class Cells:
    """Centres for the vectors of each length, and sampled rows to measure queries by; bounded, whatever the table holds."""

    def __init__(self, sample: list[tuple[int, list[int]]], k: int, cells: int, query_cells: int):
        self.k = k
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({len(v) for _, v in sample}):
            ids, x = np.array([i for i, v in sample if len(v) == d]), np.array([v for _, v in sample if len(v) == d])
            self.rows[d] = (ids, x)
            tree = CoverTree(x, 8)
            self.centres[d] = (tree.cut(min(cells, MOST_CELLS)), tree.cut(min(query_cells, MOST_CELLS)))

    def nearest(self, d: int, side: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and its distance from the centre; cell -1 for lengths that aren't in the sample."""
        if d not in self.centres:
            return np.full(len(x), -1), np.zeros(len(x))
        c = self.centres[d][side]
        cell = ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        return cell, np.sqrt(((x - c[cell]) ** 2).sum(axis=1)) * (1 + 1e-12)

    def least(self, d: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each query's kth best product with the sampled rows other than its own."""
        out = np.full(len(x), -np.inf)
        if d in self.rows and len(self.rows[d][0]) > self.k:
            own, rows = self.rows[d]
            for begin in range(0, len(x), 1024):
                s = products(x[begin : begin + 1024], rows).astype(np.float64)
                s[ids[begin : begin + 1024, None] == own[None]] = -np.inf
                best = np.partition(s, -self.k, axis=1)[:, -self.k]
                out[begin : begin + 1024] = best - 1e-9 * np.abs(best)
        return out

    def pairs(self, d: int, given: dict[int, tuple], asked: dict[int, tuple]) -> list[tuple[int, int]]:
        """(query cell, cell) of the pairs that may hold a result; ``given`` has each cell's radius, ``asked`` each one's radius and least kth score."""
        if d not in self.centres:
            return [(a, b) for a in asked for b in given]
        points, queries = self.centres[d]
        a, b = np.array(sorted(asked)), np.array(sorted(given))
        q, p = queries[a], points[b]
        qn, pn = np.sqrt((q**2).sum(axis=1))[:, None], np.sqrt((p**2).sum(axis=1))[None]
        r, s = np.array([asked[i][0] for i in a])[:, None], np.array([given[i][0] for i in b])[None]
        bound = q @ p.T + qn * s + pn * r + r * s + 0.5 + 1e-9 * (qn + r) * (pn + s)
        keep = bound >= np.array([asked[i][1] for i in a])[:, None]
        return [(int(a[i]), int(b[j])) for i, j in zip(*np.nonzero(keep), strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 32_768, query_block: int = 4096, sample: int = 2048, counts: dict | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` best other rows.

    Scores are inner products of ``floor(256 * x)`` vectors; components and scores beyond 64 bits
    are cut off at the ends of that range. Ties go to the smaller id. A query's own id is never its
    result; every other row is a candidate, repeated ones too. Queries that repeat an id are asked as
    one: an equal vector counts once, of different ones the best products count. Null ids, null vectors, vectors with null or
    non-finite components and vectors of another length than the query take no part. With fewer
    than ``k`` candidates all are returned. Other columns are ignored.

    Centres and first bounds come from ``sample`` rows at most, chosen by a hash; every row is searched. A
    task holds a block of queries and one of candidates and returns ``k`` rows a query, which are merged last.
    ``counts`` gets the number of pairs of cells ``kept`` and of ``all`` of them.
    """
    own = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(F.col(f"`{vector_col}`")).alias("v"), F.col("__query").alias("q"))
    own = own.where("id is not null and v is not null").withColumn("d", F.size("v")).where("d > 0")
    sizes = own.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max("d").alias("d")).collect()[0]
    few = max(1, min(sample, SAMPLE_BYTES // (8 * (sizes["d"] or 1))))
    # cut by a hash first, so that tasks send few rows
    hashed = own.select("id", "v", F.pmod(F.xxhash64(F.lit("sample"), "id", "v"), F.lit(PLACES)).alias("h"))
    chosen = hashed.where(F.col("h") < F.lit(sample_rates({0: sizes["n"]}, few)[0])).orderBy("h").limit(few).collect()
    cells = Cells([(r["id"], r["v"]) for r in chosen], k, -(-sizes["n"] // block), -(-sizes["q"] // query_block))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ids, asked = batch.column("d").to_numpy(), batch.column("id").to_numpy(), batch.column("q").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                v = batch.column("v").take(pa.array(at))
                x = v.flatten().to_numpy().reshape(-1, d).astype(np.float64)
                q = asked[at]
                cell, distance = cells.nearest(d, 0, x)
                yield _placed(ids[at], v, d, cell, distance, np.full(len(at), -np.inf), False)
                if q.any():
                    cell, distance = cells.nearest(d, 1, x[q])
                    chosen = v.filter(pa.array(q))
                    least = cells.least(d, ids[at][q], chosen.flatten().to_numpy().reshape(-1, d))
                    yield _placed(ids[at][q], chosen, d, cell, distance, least, True)

    placed = own.mapInArrow(place, "id long, v array<long>, d int, cell int, distance double, least double, q boolean")
    # a row for each cell: MOST_CELLS of either side for each vector length
    stats = placed.groupBy("d", "q", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("least").alias("least")).collect()
    asked, given = ({d: {r["cell"]: (r["radius"], r["least"], r["n"]) for r in stats if r["q"] == side and r["d"] == d} for d in {r["d"] for r in stats}} for side in (True, False))
    rows = [(d, a, b, -(-asked[d][a][2] // query_block), -(-given[d][b][2] // block)) for d in asked if asked[d] for a, b in cells.pairs(d, given[d], asked[d])]
    if counts is not None:
        counts |= {"kept": len(rows), "all": sum(len(asked[d]) * len(given[d]) for d in asked)}
    # at most MOST_CELLS squared rows of five numbers for each length
    near = F.broadcast(vectors.sparkSession.createDataFrame(rows, "d int, a int, b int, a_parts int, b_parts int"))
    part = F.xxhash64("id", F.lit("block"))
    queries = placed.where("q").drop("q").dropDuplicates(["id", "v"]).withColumnRenamed("cell", "a").join(near, ["d", "a"])
    queries = queries.select("d", "a", "b", F.pmod(part, "a_parts").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1)).alias("j"), "id", "v", "least", F.lit(True).alias("q"))
    points = placed.where("not q").drop("q").withColumnRenamed("cell", "b").join(near, ["d", "b"])
    points = points.select("d", "a", "b", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)).alias("i"), F.pmod(part, "b_parts").cast("int").alias("j"), "id", "v", F.lit(None).cast("double").alias("least"), F.lit(False).alias("q"))

    def run(group: pa.Table) -> pa.Table:
        d, q = group["d"][0].as_py(), group["q"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        ids = group["id"].to_numpy()
        at, found, score = search(x[q], ids[q], x[~q], ids[~q], k, group["least"].to_numpy()[q])
        return pa.table({"query_id": pa.array(ids[q][at] if len(at) else [], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    found = queries.unionByName(points).groupBy("d", "a", "b", "i", "j").applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _placed(ids: np.ndarray, v: pa.Array, d: int, cell: np.ndarray, distance: np.ndarray, least: np.ndarray, q: bool) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids), v, pa.array(np.full(n, d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(least), pa.array(np.full(n, q))], ["id", "v", "d", "cell", "distance", "least", "q"])
