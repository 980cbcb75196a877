"""Approximate nearest neighbours: one vantage-point tree for each shard, searched with relaxed pruning.

Nearness is the largest inner product. With M the largest norm of all vectors, x becomes (x, sqrt(M^2 - |x|^2)) and a
query (q, 0): Euclidean distances between these order exactly as inner products do, and the triangle inequality holds.
Equal vectors are one point that keeps its smallest ids, as many as any answer can show, so a vector with any number of
copies costs one place in one shard. A small vantage-point tree over a bounded sample of points (`TOP_SAMPLE`) deals all
points: its leaves are regions of space, and a leaf of many points is several shards. Each shard has a tree of its own, built
once and stored as one row. A query first searches the shards of its own leaf; then, with the distance of its k-th best so
far, it descends the top tree again and asks the shards of the other leaves that can hold something nearer. A subtree, of the
top tree or of a shard's, is skipped where the triangle inequality, its slack multiplied by `factor`, says that it holds
nothing nearer: factor 1 never skips a neighbour (exact search); a larger one skips more.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of different lengths never meet; a null id takes no part; the row of a query is no
candidate of its own, equal vectors of other rows are; rows that repeat an id and a vector count once, and an id with
several vectors is several rows, none a candidate for another of the same id; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.scratch import materialise

#: Measured recall on the driver's vectors stands in the README.
FACTOR = 4.0
SHARD_ROWS, LEAF, BLOCK = 16_384, 128, 512
#: Points that the top tree is built from, at most; one of its leaves has SPREAD of them or more.
TOP_SAMPLE, SPREAD = 8192, 16
#: In place of an id.
NONE = np.iinfo(np.int64).max


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part; the rows of one id and vector are one."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    # -0.0 equals 0.0
    rows = rows.where(F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    return rows.distinct()


def _build(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A balanced tree over augmented points: an order of the points, and nodes (start, end, point, radius, left, right).
    A leaf has point -1. Each node's vantage point is the first of its range; inside come the nearer half."""
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = at
        if end - start <= leaf:
            nodes.append([start, end, -1, 0.0, -1, -1])
            continue
        pick = start + rng.integers(end - start)
        order[[start, pick]] = order[[pick, start]]
        rest = order[start + 1 : end]
        d = np.sqrt(np.maximum(((x[rest] - x[order[start]]) ** 2).sum(1), 0))
        half = len(rest) // 2
        by = np.argsort(d, kind="stable")
        order[start + 1 : end] = rest[by]
        nodes.append([start, end, start, (d[by[half - 1]] + d[by[half]]) / 2, -1, -1])
        todo += [(start + 1, start + 1 + half, at, 0), (start + 1 + half, end, at, 1)]
    return order, np.array(nodes, np.float64).reshape(-1, 6)


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    """Points with the coordinate that gives all of them one norm."""
    return np.column_stack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0))])


def _slack(norm2: float) -> float:
    """What rounding can add to a distance."""
    return 1e-7 * (1 + np.sqrt(norm2))


class _Top:
    """The top tree of one length of vectors: where points and queries belong."""

    def __init__(self, sample: np.ndarray, norm2: float, leaf: int) -> None:
        x = _lift(sample, norm2)
        order, nodes = _build(x, np.random.default_rng(1), leaf)
        self.norm2, self.nodes = norm2, nodes
        self.points = {at: x[order[int(n[2])]] for at, n in enumerate(nodes) if n[2] >= 0}

    def visit(self, x: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that rows of x, with a coordinate more, must ask to find all within their reach."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, who = todo.pop()
            _, _, point, radius, left, right = self.nodes[at]
            if point < 0:
                rows.append(who)
                leaves.append(np.full(len(who), at))
                continue
            d = np.sqrt(((x[who] - self.points[at]) ** 2).sum(1))
            far = reach[who] + (_slack(self.norm2) if factor else 0)
            inside = (d <= radius) | ((d - radius) * factor <= far) if factor else d <= radius
            outside = (d > radius) | ((radius - d) * factor <= far) if factor else d > radius
            todo += [(int(side), who[some]) for side, some in ((left, inside), (right, outside)) if some.any()]
        return np.concatenate(rows), np.concatenate(leaves)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The one leaf of each row of x, with a coordinate more."""
        row, leaf = self.visit(x, np.zeros(len(x)), 0)
        out = np.zeros(len(x), np.int64)
        out[row] = leaf
        return out


class _Search:
    """The k nearest points of one tree for a block of queries, all queries of a node at once: by exact product, then by
    smallest id. first, second: the smallest ids of each point (NONE: there is no second), of which a query's own doesn't count.
    floor: products below which nothing is wanted."""

    def __init__(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, norm2: float, nodes: np.ndarray, k: int, factor: float) -> None:
        self.x, self.first, self.second, self.nodes, self.factor, self.k = x, first, second, nodes, factor, k
        self.norm2 = norm2

    def run(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.q, self.q2, self.own, self.floor = q, (q**2).sum(1), own, floor
        self.tolerance = 1e-12 * np.sqrt(self.q2 * self.norm2)
        self.best = np.full((len(q), self.k), -np.inf)
        self.point = np.full((len(q), self.k), -1)
        self.name = np.full((len(q), self.k), NONE)
        if len(self.nodes):
            self.visit(0, np.arange(len(q)))
        return self.best, self.point

    def least(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[who, -1], self.floor[who])

    def offer(self, who: np.ndarray, start: int, end: int) -> np.ndarray:
        products = self.q[who] @ self.x[start:end].T
        good = products >= (self.least(who) - self.tolerance[who])[:, None]
        some = good.any(1)
        if some.any():
            rows = who[some]
            name = np.where(self.first[start:end] == self.own[rows][:, None], self.second[start:end], self.first[start:end])
            good = good[some] & (name != NONE)
            exact = np.full(good.shape, -np.inf)
            i, j = np.nonzero(good)
            exact[i, j] = (self.q[rows[i]] * self.x[start + j]).sum(1)
            both = np.concatenate([self.best[rows], exact], 1)
            points = np.concatenate([self.point[rows], np.where(good, np.arange(start, end), -1)], 1)
            ids = np.concatenate([self.name[rows], np.where(good, name, NONE)], 1)
            top = np.lexsort((ids, -both), axis=1)[:, : self.k]
            self.best[rows], self.point[rows], self.name[rows] = (np.take_along_axis(x, top, 1) for x in (both, points, ids))
        return products

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The distance of each query's k-th best; infinite as long as there are fewer."""
        return np.sqrt(np.maximum(self.q2[who] + self.norm2 - 2 * self.least(who), 0))

    def visit(self, at: int, who: np.ndarray) -> None:
        start, end, point, radius, left, right = self.nodes[at]
        start, end, left, right = int(start), int(end), int(left), int(right)
        if point < 0:
            self.offer(who, start, end)
            return
        d = np.sqrt(np.maximum(self.q2[who] + self.norm2 - 2 * self.offer(who, start, start + 1)[:, 0], 0))
        near = d <= radius
        for side, first in ((left, near), (right, ~near)):
            if first.any():
                self.visit(side, who[first])
        for side, first, gap in ((right, near, radius - d), (left, ~near, d - radius)):
            late = first & (gap * self.factor <= self.reach(who) + _slack(self.norm2))
            if late.any():
                self.visit(side, who[late])


def _stack(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in rows])


_TREE = "dim int, leaf int, sub int, points binary, nodes binary, ids array<array<long>>"
_HIT = "query_id long, mark long, vec_id long, score double"


def index(points: DataFrame, norm2: float) -> DataFrame:
    """One tree for each (dim, leaf, sub) of points(dim, leaf, sub, v, ids)."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _stack(rows["v"])
        order, nodes = _build(_lift(x, norm2), np.random.default_rng(0))
        ids = [np.asarray(i, np.int64) for i in rows["ids"]]
        return pd.DataFrame({"dim": [key[0]], "leaf": [key[1]], "sub": [key[2]], "points": [x[order].tobytes()], "nodes": [nodes.tobytes()], "ids": [[ids[i] for i in order]]})

    return points.groupBy("dim", "leaf", "sub").applyInPandas(build, _TREE)


def _searcher(norm2: float, k: int, factor: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, points, nodes, ids, names, marks, floors, queries in batch.itertuples(index=False):
                x = np.frombuffer(points).reshape(-1, dim)
                q = _stack(pd.Series(list(queries)))
                first = np.array([i[0] for i in ids], np.int64)
                second = np.array([i[1] if len(i) > 1 else NONE for i in ids], np.int64)
                search_ = _Search(x, first, second, norm2, np.frombuffer(nodes).reshape(-1, 6), min(k, len(x)), factor)
                best, found = search_.run(q, np.asarray(names, np.int64), np.asarray(floors, np.float64))
                row, place = np.nonzero(found >= 0)
                point = found[row, place]
                sizes = np.array([len(ids[p]) for p in point], np.int64)
                out = pd.DataFrame({
                    "query_id": np.repeat(np.asarray(names, np.int64)[row], sizes),
                    "mark": np.repeat(np.asarray(marks, np.int64)[row], sizes),
                    "vec_id": np.concatenate([np.asarray(ids[p], np.int64) for p in point]) if len(point) else np.zeros(0, np.int64),
                    "score": np.repeat(best[row, place], sizes),
                })
                out = out[out["vec_id"] != out["query_id"]].sort_values(["query_id", "mark", "score", "vec_id"], ascending=[True, True, False, True])
                yield out.groupby(["query_id", "mark"], sort=False).head(k)

    return search


def _dealer(tops: dict[int, _Top]):
    """v -> its leaf in the top tree of its length; 0 where there is none."""

    @F.pandas_udf("int")
    def leaf(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        dims = vectors.map(len).to_numpy()
        for dim in np.unique(dims):
            if dim in tops:
                at = np.flatnonzero(dims == dim)
                out[at] = tops[dim].home(_lift(_stack(vectors.iloc[at]), tops[dim].norm2))
        return pd.Series(out)

    return leaf


def _others(tops: dict[int, _Top], factor: float):
    """(v, home leaf, least product wanted) -> the other leaves to ask."""

    @F.pandas_udf("array<int>")
    def leaves(vectors: pd.Series, home: pd.Series, floor: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(vectors))]
        dims = vectors.map(len).to_numpy()
        for dim in np.unique(dims):
            if dim in tops:
                at = np.flatnonzero(dims == dim)
                q = _stack(vectors.iloc[at])
                reach = np.sqrt(np.maximum((q**2).sum(1) + tops[dim].norm2 - 2 * floor.to_numpy()[at], 0))
                row, leaf = tops[dim].visit(np.column_stack([q, np.zeros(len(q))]), reach, factor)
                for r, x in zip(at[row].tolist(), leaf.tolist(), strict=True):
                    if x != home.iloc[r]:
                        out[r].append(x)
        return pd.Series(out)

    return leaves


def _tops(points: DataFrame, norm2: float, count: int, shard_rows: int) -> dict[int, _Top]:
    """Top trees of the lengths of vectors in a sample of points, with leaves of about shard_rows points or more."""
    if count <= shard_rows:
        return {}
    sample = points.select("v").orderBy(F.xxhash64("v"), F.size("v")).limit(TOP_SAMPLE).toPandas()["v"]
    dims = sample.map(len)
    leaf = max(SPREAD, -(-len(sample) * shard_rows // count))
    return {int(dim): _Top(_stack(sample[dims == dim]), norm2, leaf) for dim in dims.unique()}


def _asked(rows: DataFrame, trees: DataFrame, norm2: float, k: int, factor: float) -> DataFrame:
    """Hits of rows(dim, leaf, vec_id, mark, v, floor) in all trees of their leaf, by blocks of queries."""
    number = rows.count()
    blocks = max(1, -(-number // BLOCK))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int"))
    # blocks of a leaf: as many as its share of the queries fills
    per = rows.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_per"))
    per = materialise(per, "vp-blocks")
    rows = rows.join(per, ["dim", "leaf"]).withColumn("_block", F.pmod("_block", "_per"))
    packed = rows.groupBy("dim", "leaf", "_block").agg(F.collect_list(F.struct("vec_id", "mark", "floor", "v")).alias("q"))
    work = packed.join(trees.hint("merge"), ["dim", "leaf"])
    work = work.select("dim", "points", "nodes", "ids", *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("vec_id", "mark", "floor", "v")])
    return materialise(work.mapInPandas(_searcher(norm2, k, factor), _HIT), "vp-hits")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of vectors(vec_id, embedding) found for every row of queries
    (same columns; drawn from vectors), the same id excepted."""
    rows = usable(vectors)
    norm2 = rows.agg(F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).first()[0] * (1 + 1e-12)
    kept = Window.partitionBy("v").orderBy("vec_id")  # a limit on row_number runs before the shuffle, too
    copies = rows.withColumn("_nth", F.row_number().over(kept)).where(F.col("_nth") <= k + 1)
    points = materialise(copies.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vp-points")
    count = points.count()
    tops = _tops(points, norm2, count, shard_rows)
    dealt = points.select(F.size("v").alias("dim"), (_dealer(tops)("v") if tops else F.lit(0)).alias("leaf"), "v", "ids")
    # leaves of several shards: fewer than there are shards
    large = {(r["dim"], r["leaf"]): -(-r["count"] // shard_rows) for r in dealt.groupBy("dim", "leaf").count().where(F.col("count") > shard_rows).collect()}
    per = F.create_map(*[F.lit(x) for (dim, leaf), n in large.items() for x in (f"{dim}/{leaf}", n)]) if large else F.lit(None).cast("map<string,int>")
    subs = F.coalesce(F.try_element_at(per, F.concat_ws("/", "dim", "leaf")), F.lit(1))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("v", F.lit(1)), subs).cast("int"))
    trees = materialise(index(dealt, norm2), "vp-trees")

    asked = usable(queries).select(F.size("v").alias("dim"), (_dealer(tops)("v") if tops else F.lit(0)).alias("leaf"), "vec_id", F.xxhash64("v").alias("mark"), "v")
    asked = materialise(asked, "vp-queries")
    hits = _asked(asked.withColumn("floor", F.lit(float("-inf"))), trees, norm2, k, factor)
    if tops:
        order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
        last = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k).select(F.col("query_id").alias("vec_id"), "mark", F.col("score").alias("floor"))
        again = asked.join(last, ["vec_id", "mark"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        again = again.withColumn("leaf", F.explode(_others(tops, factor)("v", "leaf", "floor")))
        hits = hits.unionByName(_asked(materialise(again, "vp-again"), trees, norm2, k, factor))
    best = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
