"""Exact top-k similarity join in blocks.

Queries and keys of a pair are dealt to blocks of bounded size; every query block meets every key block of its pair as one
matrix product. No row pair is ever a row. Blocks are dealt to a few parts of each side, and a task takes one part of each: it holds
some blocks of queries, reads the blocks of keys one by one, and keeps the best k of each query so far. A window ranks what is left: k rows
for each query and part of keys, of which there are only as many as keep all cores busy. What is written to disk is each block once, whatever the number
of blocks: tasks read a part as often as the other side has parts. Blocks of both sides are large and packed in 32 bits where the features are.

Blocks smaller than `MIN_BLOCK` are taken together to that size, so that copies stay few whatever was asked for. A cell's scores are made in
strips of `STRIP` numbers. The largest score of every run of keys bounds the k-th best from below, so only the few scores that
reach the bound are rounded and sorted. Cells reach Python one or two in a batch, and no cell is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block, and the fewest.
QUERY_BLOCK, KEY_BLOCK, MIN_BLOCK = 16384, 16384, 4096
#: Scores that a task holds at once, and the most keys of a run.
STRIP, RUN = 1 << 22, 64
#: Query blocks of a part, and tasks that a core gets at least (where there are blocks for so many).
HELD, TASKS = 4, 3
#: Pairs whose numbers of blocks are literals; those of more are a table that rows are joined with.
FEW_PAIRS = 64
#: Bytes of one batch that goes to Python: a cell has several millions, and a partition many cells.
BATCH_BYTES = "4m"
METRICS = ("cosine", "neg_sq_l2", "dot")
_EPS = 1e-8
#: Digits to which scores are compared, so that ties don't hang on the order of additions.
DIGITS = 9


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + _EPS) if metric == "cosine" else x


def _scores(q: np.ndarray, x: np.ndarray, metric: str, out: np.ndarray) -> np.ndarray:
    """Of prepared vectors, in place."""
    np.matmul(q, x.T, out=out)
    if metric == "neg_sq_l2":
        out *= 2
        out -= (q**2).sum(1)[:, None] + (x**2).sum(1)[None]
    return out


def _strip_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded scores of the k best of each row, in order; ties to the smaller column."""
    n, width = scores.shape
    run = max(1, min(RUN, width // (2 * k)))
    most = np.maximum.reduceat(scores, np.arange(0, width, run), axis=1) if run > 1 else scores
    if np.isnan(most).any():
        column = np.argsort(-np.round(scores, DIGITS), axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(n), column.shape[1])
        return row, column.ravel(), np.round(scores[row, column.ravel()], DIGITS) + 0.0
    if most.shape[1] > k:
        bound = np.partition(most, most.shape[1] - k, axis=1)[:, -k]
        # rounding may bring together what differs by so much
        row, column = np.divmod(np.flatnonzero(scores >= (bound - 2 * 10.0**-DIGITS)[:, None]), width)
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    found = np.round(scores[row, column], DIGITS) + 0.0
    return _first(row, column, found, n, k)


def _first(row: np.ndarray, column: np.ndarray, found: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each of n rows, in order; ties to the smaller column."""
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    first = np.searchsorted(row, np.arange(n))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], column[kept], found[kept]


def _matrix(cell: pa.Scalar) -> np.ndarray:
    rows = cell.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _best(k: int, metric: str):
    """Cells(pair_id, _q, q_ids, q_feats, k_ids, k_feats) of a part of queries and one of keys -> the k best keys of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                q_ids, k_ids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 4))
                by_id = np.argsort(k_ids, kind="stable")
                k_ids, q, x = k_ids[by_id], _prepared(_matrix(batch.column(3)[i]), metric), _prepared(_matrix(batch.column(5)[i])[by_id], metric)
                height = max(1, STRIP // len(x))
                held = np.empty((min(height, len(q)), len(x)))
                strips = [best[block][1:]] if block in best else []
                for at in range(0, len(q), height):
                    part = q[at : at + height]
                    row, column, found = _strip_best(_scores(part, x, metric, held[: len(part)]), k)
                    strips.append((at + row, k_ids[column], found))
                # the batch's memory goes with the batch
                best[block] = q_ids.copy(), *_first(*(np.concatenate(c) for c in zip(*strips, strict=True)), len(q), k)
        for (pair, _), (q_ids, row, key, found) in best.items():
            out = {"pair_id": pa.array([pair] * len(row), pa.string()), "query_id": q_ids[row], "key_id": key, "score": found}
            yield pa.RecordBatch.from_pydict(out)

    return run


def top_k(queries: DataFrame, keys: DataFrame, k: int, metric: str = "cosine", query_block: int = QUERY_BLOCK, key_block: int = KEY_BLOCK) -> DataFrame:
    """pair_id, query_id, key_id, score, rank (from 1): the k keys most similar to each query of the same pair, ties to the
    smaller key. queries(pair_id, query_id, feat), keys(pair_id, key_id, feat): long ids, vectors of one length."""
    if metric not in METRICS:
        raise ValueError(f"{metric!r} is none of {METRICS}")
    query_block, key_block = max(query_block, MIN_BLOCK), max(key_block, MIN_BLOCK)
    blocks = lambda df, size: df.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    counts = blocks(queries, query_block).withColumnRenamed("blocks", "_nq").join(blocks(keys, key_block).withColumnRenamed("blocks", "_nk"), "pair_id")
    known = counts.limit(FEW_PAIRS + 1).collect()
    few = 0 < len(known) <= FEW_PAIRS
    total = {c: sum(r[c] for r in known) for c in ("_nq", "_nk")} if few else counts.agg(F.sum("_nq").alias("_nq"), F.sum("_nk").alias("_nk")).first().asDict()
    number = {c: max(1, total[c] or 0) for c in total}
    wanted = TASKS * queries.sparkSession.sparkContext.defaultParallelism
    q_parts = -(-number["_nq"] // HELD)
    k_parts = min(number["_nk"], -(-wanted // q_parts))
    q_parts = max(q_parts, min(number["_nq"], -(-wanted // k_parts)))
    queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # for the job that the caller runs later
    kind = "array<float>" if {dict(df.dtypes)["feat"] for df in (queries, keys)} == {"array<float>"} else "array<double>"
    vector = F.col("feat").cast(kind).alias("feat")

    def packed(rows: DataFrame, name: str, own: str, parts: int) -> DataFrame:
        if few:
            rows = rows.withColumn(f"_n{own}", F.create_map(*[F.lit(x) for r in known for x in (r["pair_id"], r[f"_n{own}"])])[F.col("pair_id")]).where(f"_n{own} IS NOT NULL")
        else:
            rows = rows.join(counts, "pair_id")
        rows = rows.select("pair_id", F.pmod(F.xxhash64(name), f"_n{own}").cast("int").alias(f"_{own}"), F.col(name).cast("long"), vector)
        held = rows.groupBy("pair_id", f"_{own}").agg(F.collect_list(F.struct(name, "feat")).alias("x"))
        held = held.select("pair_id", f"_{own}", F.col(f"x.{name}").alias(f"{own}_ids"), F.col("x.feat").alias(f"{own}_feats"))
        # blocks of a pair go to different parts
        part = F.pmod(F.pmod(F.xxhash64(F.lit(own), "pair_id"), F.lit(parts)) + F.col(f"_{own}"), F.lit(parts)).cast("int")
        return held.withColumn("_part", part).repartitionById(parts, "_part").drop("_part")

    # each part of keys meets each part of queries in one task, which holds the latter
    met = packed(keys, "key_id", "k", k_parts).join(packed(queries, "query_id", "q", q_parts).hint("shuffle_replicate_nl"), "pair_id")
    met = met.select("pair_id", "_q", "q_ids", "q_feats", "k_ids", "k_feats")
    kept = met.mapInArrow(_best(k, metric), "pair_id string, query_id long, key_id long, score double")
    order = Window.partitionBy("pair_id", "query_id").orderBy(F.col("score").desc(), "key_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
