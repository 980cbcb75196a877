"""Connected components of a table of edges, by rounds of joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.scratch import discard, give_back, materialise

MAX_ROUNDS = 100
#: Edges that one step of a task contracts at once, and edges (about 40 bytes each) of a graph that one task may hold.
STEP, SMALL = 1 << 17, 1 << 20


def roots(count: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least number of the component of each of the numbers below count, which edges between a and b join; label: what this
    gave for other edges, which hold as well."""
    label = np.arange(count) if label is None else label.copy()
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _contract(step: int | None):
    """Stars in place of the edges of a step (None: of all of a task's): each node but the least of a component, and that one."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        number = sum(batch.num_rows for batch in held)
        nodes = pa.concat_arrays([batch.column(k) for k in (0, 1) for batch in held])
        # texts take most of the memory: none is kept longer than it is read
        held.clear()
        coded = nodes.dictionary_encode()
        del nodes
        names, place = coded.dictionary, coded.indices.to_numpy()
        del coded
        if not step:
            give_back()
        order = pc.sort_indices(names)
        names = names.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        place = rank[place]
        label = roots(len(names), place[:number], place[number:])
        far = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(far)), names.take(pa.array(label[far]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            del batch
            if step and rows >= step:
                yield stars(held)
                rows = 0
        if rows:
            yield stars(held)

    return run


def _to_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges(a, b), a > b. Every node of a neighbourhood meets the least node of it; a node with any
    number of neighbours is aggregated before the shuffle. The least nodes are a written table, so that the join with them
    is one that Spark splits where a node has many neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    found = materialise(out.where("a <> b").distinct(), "components")
    discard(least)
    return found


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges(a, b) is only once an a and never a b as well."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("far")), F.struct(F.col("b").alias("node"), F.lit(0).alias("far")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("far").alias("far"), F.min("far").alias("near"))
    return seen.where("far > 1 OR (far = 1 AND near = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of it) of every node of edges(a, b); nodes are strings or numbers. Tasks contract
    their own edges first, and what is left of up to SMALL edges is contracted by one more task; larger graphs go on by
    rounds, each of them a written table, and the table before it is deleted."""
    edges = edges.where("a <> b").select("a", "b")
    edges = materialise(edges.mapInArrow(_contract(STEP), edges.schema), "components")
    number = edges.count()
    if number <= SMALL:
        one = materialise(edges.coalesce(1).mapInArrow(_contract(None), edges.schema), "components")
        discard(edges)
        edges = one
    else:
        for _ in range(MAX_ROUNDS):
            if _stars(edges):
                break
            large = _to_least(edges, True)
            small = _to_least(large, False)
            discard(edges, large)
            edges = small
        else:
            raise RuntimeError(f"components haven't settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
