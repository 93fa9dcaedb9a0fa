"""Exact top-k search by inner product: an M-tree of paged metric nodes, searched best first.

The greatest inner product becomes the least Euclidean distance when every
vector x gets one more component sqrt(M^2 - |x|^2), M being the greatest norm,
and the query gets 0. In that space each row goes to the nearest of a sample of
pivots, whose number follows from the counted rows, so that crowded regions have more of them, up to
``most_pivots``. What is crowded still (one vector many times over, an uneven share, rows beyond that bound) is
split by a hash, so that a group stays near ``group_rows``. Each group becomes
a tree: nodes with a routing vector, a covering radius and the distance to the
parent's routing vector; leaf pages whose entries store theirs to the page's.
The trees are written as a table, one row a group.

Queries come in blocks of bounded size, which are broadcast to the tasks that
read the trees. Groups are searched best first too: centres and radii tell the
group that may be nearest to each query, its k-th best there is the query's
floor, and then a task takes its trees by least possible distance and unpacks
only those that can hold a better candidate. A search takes pages by least possible distance; a stored
distance and the triangle inequality rule out a node or an entry before its own
distance is computed. The queries of a block search a tree together: a page is multiplied once
with all queries whose turn it is. Scores are exact integers; bounds have slack for rounding.

Defined cases: vectors that are null, or hold null or non-finite components,
and rows without id take no part; vectors meet only those of their own length;
rows with the query's id are its own, and several vectors of one query id rank
together; repeated rows are candidates each, while
equal queries count once; ties go to the smaller id; fewer candidates than k
give all; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfacts.llm.common import stored

PAGE = 256  # entries of a leaf page, at most
SEEDS = 16  # pivots that every query meets first
FANOUT = 8


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and q, the vectors floor(scale * x); only those that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long"))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good).select("vec_id", q.alias("q"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as integers: 64 bits, or Python's where sums could overflow."""
    flat = np.asarray(lists.flatten())
    out = flat.reshape(len(lists), -1)
    most = int(max(abs(int(flat.max())), abs(int(flat.min())))) if len(flat) else 0
    return out if most * most * max(1, out.shape[1]) < 1 << 62 else out.astype(object)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(float)
    return np.hstack((x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]))


def build(ids: np.ndarray, x: np.ndarray, top: float) -> dict:
    """The tree of one group."""
    points = lifted(x, top)

    def node(rows: np.ndarray, centre: np.ndarray, to_parent: float) -> dict:
        to_centre = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
        made = {"centre": centre, "radius": float(to_centre.max()), "to_parent": to_parent}
        if len(rows) <= PAGE:
            return made | {"rows": rows, "to_centre": to_centre}
        seeds = [int(np.argmax(to_centre))]
        near = np.sqrt(((points[rows] - points[rows[seeds[0]]]) ** 2).sum(axis=1))
        owner = np.zeros(len(rows), int)
        while len(seeds) < FANOUT and near.max() > 0:
            seeds.append(int(np.argmax(near)))
            d = np.sqrt(((points[rows] - points[rows[seeds[-1]]]) ** 2).sum(axis=1))
            owner[d < near] = len(seeds) - 1
            near = np.minimum(near, d)
        if len(seeds) == 1:  # one point many times over
            parts = [(rows[i : i + PAGE], points[rows[0]]) for i in range(0, len(rows), PAGE)]
        else:
            parts = [(rows[owner == s], points[rows[seed]]) for s, seed in enumerate(seeds)]
        children = [node(r, c, float(np.sqrt(((c - centre) ** 2).sum()))) for r, c in parts if len(r)]
        return made | {
            "children": children, "child_centres": np.array([c["centre"] for c in children]),
            "child_to_parent": np.array([c["to_parent"] for c in children]), "child_radius": np.array([c["radius"] for c in children]),
        }

    return {"ids": ids, "x": x, "root": node(np.arange(len(ids)), points.mean(axis=0), 0.0)}


def search(tree: dict, query_id: int, q: np.ndarray, size2: float, top: float, best: list[tuple[int, int]], k: int, floor: float, count: list[int] | None = None) -> None:
    """Put the tree's better candidates into ``best``, a heap of (score, -id). floor: a score that the k-th best has at least."""
    search_all(tree, [query_id], q[None, :], [size2], top, [best], k, [floor], count)


def search_all(tree: dict, query_ids: list[int], qs: np.ndarray, sizes: list[float], top: float, best: list[list[tuple[int, int]]], k: int, floors: list[float], count: list[int] | None = None) -> None:
    """``search`` for many queries: in each round every query takes its next page by least possible distance, and a page is multiplied once with all that take it."""
    asked, sizes, floors = np.array(query_ids), np.array(sizes, float), np.array(floors, float)
    points = np.hstack((qs.astype(float), np.zeros((len(qs), 1))))
    slack = 1e-9 * (sizes + top) + 1e-6

    def reach(n: np.ndarray) -> np.ndarray:
        """No candidate farther than this can count."""
        return np.sqrt(np.maximum(sizes[n] + top - 2.0 * least[n], 0.0) + slack[n])  # endless without a floor

    least, limit, pages = floors.copy(), np.zeros(len(qs)), []
    # what a score must be at least, as exact as scores are: floors are doubles, and only such scores are whole doubles
    bar = floors.copy() if qs.dtype == float else np.full(len(qs), -np.inf, object) if qs.dtype == object else np.full(len(qs), np.iinfo(np.int64).min)

    def learn(n: np.ndarray) -> None:
        for m in n.tolist():
            if len(best[m]) == k:
                least[m] = max(floors[m], best[m][0][0])
                bar[m] = least[m] if qs.dtype == float else best[m][0][0] if qs.dtype == object else min(best[m][0][0], np.iinfo(np.int64).max)
        limit[n] = reach(n)

    learn(np.arange(len(qs)))

    def descend(node: dict, n: np.ndarray, d: np.ndarray, low: np.ndarray) -> None:
        """The pages under a node, each with the queries that it may have something for, their distances to its routing vector, and the least to its entries."""
        if "rows" in node:
            pages.append((node, n, d, low))
            return
        for child, centre, to_parent, radius in zip(node["children"], node["child_centres"], node["child_to_parent"], node["child_radius"], strict=True):
            able = np.flatnonzero(np.abs(d - to_parent) - radius <= limit[n] + 1e-9)
            to = np.sqrt(((points[n[able]] - centre) ** 2).sum(axis=1))
            lows = np.maximum(low[able], to - radius)
            near = lows <= limit[n[able]]
            if near.any():
                descend(child, n[able][near], to[near], lows[near])

    root = tree["root"]
    to_root = np.sqrt(((points - root["centre"]) ** 2).sum(axis=1))
    lows = np.maximum(0.0, to_root - root["radius"])
    n = np.flatnonzero(lows <= limit)
    descend(root, n, to_root[n], lows[n])
    if not pages:
        return
    low, away = np.full((len(qs), len(pages)), np.inf), np.zeros((len(qs), len(pages)))
    for i, (_, n, d, lows) in enumerate(pages):
        low[n, i], away[n, i] = lows, d
    order = np.argsort(low, axis=1, kind="stable")
    alive = np.arange(len(qs))
    for turn in range(len(pages)):
        lows = low[alive, order[alive, turn]]
        alive = alive[(lows <= limit[alive]) & (lows < np.inf)]  # later pages are no nearer
        taken = order[alive, turn]
        for i in np.unique(taken).tolist():
            n, node = alive[taken == i], pages[i][0]
            d = away[n, i]
            rows = node["rows"][(node["to_centre"] >= (d - limit[n]).min() - 1e-9) & (node["to_centre"] <= (d + limit[n]).max() + 1e-9)]
            ids = tree["ids"][rows]
            if count is not None:
                count[0] += len(rows) * len(n)
            scores = tree["x"][rows] @ qs[n].T
            good, of = np.nonzero((scores >= bar[n]) & (ids[:, None] != asked[n]))  # most of a page ends here
            for s, row_id, m in zip(scores[good, of].tolist(), ids[good].tolist(), n[of].tolist(), strict=True):
                heap, found = best[m], (int(s), -row_id)
                if len(heap) < k:
                    heapq.heappush(heap, found)
                elif found > heap[0]:
                    heapq.heapreplace(heap, found)
            learn(np.unique(n[of]))


def index(vectors: DataFrame, pivots: int = 16, group_rows: int = 8192, most_pivots: int = 4096) -> tuple[DataFrame, dict[int, tuple[float, list]]]:
    """The table of trees (dim, grp, centre, radius, tree), and by vector length the greatest squared norm with a few pivots.

    Pivots are the rows with the smallest hashes: for each length two for every ``group_rows`` rows, at least ``pivots``;
    beyond ``most_pivots`` for all lengths the lengths share that number. Only they, one norm and one count a length and one
    count a pivot come to the driver and are broadcast.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "q", F.size("q").alias("dim"))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    tops = rows.groupBy("dim").agg(F.max(norm).alias("top"), F.count(F.lit(1)).alias("n")).collect()
    wanted = {r["dim"]: max(pivots, -(-2 * r["n"] // group_rows)) for r in tops}
    share = min(1.0, most_pivots / max(1, sum(wanted.values())))
    chosen: dict[int, tuple[float, list]] = {}
    for r in tops:
        most = max(1, int(wanted[r["dim"]] * share))
        few = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(most).collect()
        chosen[r["dim"]] = (r["top"] * (1 + 1e-12), [(x["vec_id"], list(x["q"])) for x in few])
    known = {dim: (top, few[:SEEDS]) for dim, (top, few) in chosen.items()}
    different = {dim: (top, sorted({tuple(q) for _, q in few})) for dim, (top, few) in chosen.items()}
    shared = spark.sparkContext.broadcast({dim: (top, np.array(few, float).reshape(len(few), dim)) for dim, (top, few) in different.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            nearest = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                top, sample = shared.value[int(dim)]
                at = np.flatnonzero(dims == dim)
                centres = lifted(sample, top)
                for i in range(0, len(at), 1024):
                    part = batch.column(1).take(pa.array(at[i : i + 1024]))
                    x = lifted(matrix(part), top)
                    nearest[at[i : i + 1024]] = np.argmin((centres**2).sum(axis=1) - 2.0 * (x @ centres.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], ["vec_id", "q", "dim", "pivot"])

    assigned = rows.mapInArrow(assign, "vec_id long, q array<long>, dim int, pivot int")
    sizes = assigned.groupBy("dim", "pivot").count().select("dim", "pivot", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    salted = assigned.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.col("parts")))  # sizes: a row a pivot

    def grow(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        dim = t["dim"][0].as_py()
        x = matrix(t["q"].combine_chunks() if isinstance(t["q"], pa.ChunkedArray) else t["q"])
        tree = build(np.asarray(t["vec_id"]).astype(np.int64), x, shared.value[dim][0])
        group, root = (t["pivot"][0].as_py() << 32) + t["part"][0].as_py(), tree["root"]
        columns = [[dim], [group], [root["centre"].tolist()], [root["radius"]], [pickle.dumps(tree)]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary()), strict=True)], names=["dim", "grp", "centre", "radius", "tree"])

    trees = salted.groupBy("dim", "pivot", "part").applyInArrow(grow, "dim int, grp long, centre array<double>, radius double, tree binary")
    return stored(trees, "mtree"), known


def top_k(df: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query."""
    spark = df.sparkSession
    vectors = quantised(df, id_col, vector_col, scale)
    trees, known = index(vectors)
    queries = vectors.where(is_query).distinct()
    blocks = max(1, -(-queries.count() // block))
    found = None

    def seeds(asked: list, vecs: list[np.ndarray], known: dict) -> list[float]:
        """A score that the k-th best of each query reaches at least: the k-th best among the pivots, which are candidates too."""
        out = []
        for (query_id, _), q in zip(asked, vecs, strict=True):
            scores = sorted((int(np.dot(np.array(v, object), q.astype(object))) for i, v in known.get(len(q), (0.0, []))[1] if i != query_id), reverse=True)
            out.append(float(scores[k - 1]) if len(scores) >= k else -np.inf)
        return out

    def routed(batch: pa.RecordBatch, vecs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each tree its row, the queries of its length, and the least distance they can have to its entries."""
        points = {dim: (np.array([n for n, q in enumerate(vecs) if len(q) == dim]), np.array([[*q, 0.0] for q in vecs if len(q) == dim], float)) for dim in {len(q) for q in vecs}}
        for row, (dim, centre, radius) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
            if dim in points:
                at, x = points[dim]
                yield row, at, np.maximum(0.0, np.sqrt(((x - np.asarray(centre.values)) ** 2).sum(axis=1)) - radius)

    for b in range(blocks):
        mine = [(r["vec_id"], list(r["q"])) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "q").collect()]
        shared = spark.sparkContext.broadcast((mine, known))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vecs = [np.array(q, np.int64) for _, q in shared.value[0]]
            low, group = np.full(len(vecs), np.inf), np.zeros(len(vecs), np.int64)
            for batch in batches:
                for row, at, lows in routed(batch, vecs):
                    better = at[lows < low[at]]
                    low[at] = np.minimum(low[at], lows)
                    group[better] = batch.column(1)[row].as_py()
            n = np.flatnonzero(low < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(low[n]), pa.array(group[n])], ["n", "low", "grp"])

        # which group may be nearest to each query: a row a query
        route = trees.select("dim", "grp", "centre", "radius").mapInArrow(nearest, "n long, low double, grp long")
        first = {r["n"]: r["grp"] for r in route.groupBy("n").agg(F.min(F.struct("low", "grp"))["grp"].alias("grp")).collect()}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, only: dict[int, int] | None = None, floors: dict[int, float] | None = None) -> Iterator[pa.RecordBatch]:
            """The best candidates of each query: those of its group in ``only``, or all, of which none under its floor counts."""
            asked, known = shared.value
            vecs = [np.array(q, np.int64) for _, q in asked]
            sizes = [float(sum(int(x) * int(x) for x in q)) for _, q in asked]
            largest = [max((abs(int(x)) for x in q), default=0) for _, q in asked]
            best: list[list[tuple[int, int]]] = [[] for _ in asked]
            least = [max(x, (floors or {}).get(n, -np.inf)) for n, x in enumerate(seeds(asked, vecs, known))]
            for batch in batches:
                dims, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(float(lows.min()), row, at, lows) for row, at, lows in routed(batch, vecs)]
                for _, row, at, lows in sorted(found, key=lambda f: f[:2]):  # near groups first
                    top = known[dims[row]][0]
                    able = []
                    for n, low in zip(at.tolist(), lows.tolist(), strict=True):
                        bound = max(least[n], best[n][0][0]) if len(best[n]) == k else least[n]
                        far = np.sqrt(max(sizes[n] + top - 2.0 * bound, 0.0) + 1e-9 * (sizes[n] + top) + 1e-6) if bound > -np.inf else np.inf
                        if low <= far + 1e-9 and (only is None or only.get(n) == groups[row]):
                            able.append(n)
                    if not able:
                        continue
                    tree = pickle.loads(batch.column(4)[row].as_py())
                    for some in ([n for n in able if largest[n] < 1 << 28], [n for n in able if largest[n] >= 1 << 28]):
                        if not some:
                            continue
                        x = tree["x"]
                        if x.dtype != object and int(abs(x).max(initial=0)) * max(largest[n] for n in some) * max(1, dims[row]) < 1 << 53:
                            kind = float  # every product and sum is a whole number that a double holds, and doubles are multiplied faster
                        else:
                            kind = object if x.dtype == object or largest[some[0]] >= 1 << 28 else np.int64
                        ready = tree | {"x": x.astype(float) if kind is float else x}
                        search_all(ready, [asked[n][0] for n in some], np.array([vecs[n] for n in some]).astype(kind), [sizes[n] for n in some], top, [best[n] for n in some], k, [least[n] for n in some])
            out = [(n, asked[n][0], -i, s) for n, heap in enumerate(best) for s, i in heap]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["n", "query_id", "vec_id", "score"])

        schema = "n long, query_id long, vec_id long, score long"
        # first the one nearest group of each query, for a floor: at most k rows a query
        early = trees.where(F.col("grp").isin(sorted(set(first.values())))).mapInArrow(partial(run, only=first), schema)
        floors = {r["n"]: float(r["s"]) for r in early.groupBy("n").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") == k).collect()}
        part = trees.mapInArrow(partial(run, floors=floors), schema).drop("n")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
