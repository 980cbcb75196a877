"""Extraction in one pass: micro-batches of whole slices are encoded, their tokens picked, projected and sent on within one task.

Slices are packed, one row each, by one shuffle. Then a stage over Arrow batches runs the model on a few slices at a time, takes any of its
outputs (taps) and projects each tap's tokens before the next slices are read: raw tokens never leave the task, so what is shuffled
or written later has the projected width. Fitting is the same pass with partial moments in place of tokens: a task sends one row for each
tap and modality code. Slices that a plan doesn't name are never encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import models
from voxlake.operators.projection import PCA, WPLS, added, of_tasks

#: Slices that a model gets at once.
MICRO = 16
KEYS = ("vid", "dim", "slice_idx")
_PACKED = "vid string, dim string, slice_idx int, mod_code int, bg double, rows int, cols int, data binary"
_TOKENS = "vid string, dim string, slice_idx int, mod_code int, tap string, tok_y int, tok_x int, feat array<double>"


def packed_slices(slices: DataFrame, backgrounds: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """One row for each slice of slices(vid, dim, slice_idx, row, col, value[, mod_code]), with the background(vid, bg) of its entity. A
    slice that lacks pixels, or has some twice, is an error; null values are the background. partial: slices have the size of their
    entity's largest along the axis, and pixels that aren't there are the background."""
    rows = slices.select(*KEYS, "row", "col", F.col("value").cast("double").alias("value"), (F.col("mod_code") if "mod_code" in slices.columns else F.lit(None)).cast("int").alias("mod_code"))
    rows = rows.join(backgrounds.select("vid", F.col("bg").cast("double").alias("bg")), "vid", "left") if backgrounds is not None else rows.withColumn("bg", F.lit(0.0))
    if partial:
        rows = rows.join(rows.groupBy("vid", "dim").agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols")), ["vid", "dim"])

    def run(part: pa.Table) -> pa.Table:
        row, col = (part.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        n, m = (part.column(c)[0].as_py() for c in ("_rows", "_cols")) if partial else (int(row.max()) + 1, int(col.max()) + 1)
        if len(np.unique(row * m + col)) != len(row) or (len(row) != n * m and not partial):
            raise ValueError(f"slice {part.column('slice_idx')[0]} of {part.column('vid')[0]} isn't whole")
        bg = part.column("bg")[0].as_py() or 0.0
        out = np.full(n * m, float(bg))
        out[row * m + col] = part.column("value").fill_null(bg).to_numpy()
        first = part.select([*KEYS, "mod_code"]).slice(0, 1)
        more = {"bg": pa.array([bg]), "rows": pa.array([n], pa.int32()), "cols": pa.array([m], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())}
        for name, column in more.items():
            first = first.append_column(name, column)
        return first

    return rows.groupBy(*KEYS).applyInArrow(run, _PACKED)


def projected(projector: PCA | WPLS | None, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What the projector's own expression gives, for a batch of vectors: None leaves them, an unknown code gets zeros."""
    if projector is None:
        return x
    x = np.where(np.isfinite(x), x, 0.0)
    if isinstance(projector, PCA):
        x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-8) if projector.unit else x
        return (x - np.asarray(projector.mean)) @ np.asarray(projector.components).T
    out = np.zeros((len(x), len(projector.singular)))
    for code, weight, mean in ((projector.fix_code, projector.fix_weight, projector.fix_mean), (projector.mov_code, projector.mov_weight, projector.mov_mean)):
        own = codes == code
        out[own] = (x[own] - np.asarray(mean if mean else 0.0)) @ np.asarray(weight)
    return out


def _micro(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    """Slices of one size and background, a few at a time."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held and (len(held) >= size or any(row[c] != held[0][c] for c in ("rows", "cols", "bg"))):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _picked(outputs: Mapping[str, np.ndarray], tap: str, rows: Sequence[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tap's tokens of a micro-batch: which slice, (tok_y, tok_x), vectors. All of them, or those that the rows want."""
    if tap not in outputs or outputs[tap].ndim != 4:
        raise ValueError(f"no tokens {tap!r}; there are {[k for k, v in outputs.items() if v.ndim == 4]}")
    grid = outputs[tap]
    _, gh, gw, c = grid.shape
    whole = np.stack(np.meshgrid(np.arange(gh), np.arange(gw), indexing="ij"), -1).reshape(-1, 2)
    wanted = [whole if r.get("wanted") is None else np.array([(w["tok_y"], w["tok_x"]) for w in r["wanted"]], np.int64).reshape(-1, 2) for r in rows]
    owner, at = np.repeat(np.arange(len(rows)), [len(w) for w in wanted]), np.concatenate(wanted)
    if len(at) and ((at < 0).any() or (at >= (gh, gw)).any()):
        raise ValueError(f"a plan names tokens beyond the grid {(gh, gw)}")
    return owner, at, grid[owner, at[:, 0], at[:, 1]].reshape(len(at), c)


def _planned(slices: DataFrame, plan: DataFrame | None) -> DataFrame:
    if plan is None:
        return slices
    wanted = plan.select("vid", "slice_idx", F.struct("tok_y", "tok_x").alias("t")).distinct().groupBy("vid", "slice_idx").agg(F.collect_list("t").alias("wanted"))
    return slices.join(wanted, ["vid", "slice_idx"])


def _runner(slices: DataFrame, model, weights: models.Weights, micro: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[list[dict], dict]]]:
    held = models.shared(slices.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], dict]]:
        for rows in _micro(batches, micro):
            size = rows[0]["rows"], rows[0]["cols"]
            yield rows, model(held.value, np.stack([np.frombuffer(r["data"], np.float64).reshape(size) for r in rows]), rows[0]["bg"])

    return run


def stream(slices: DataFrame, model, weights: models.Weights, taps: Mapping[str, PCA | WPLS | None], plan: DataFrame | None = None, micro: int = MICRO) -> DataFrame:
    """vid, dim, slice_idx, mod_code, tap, tok_y, tok_x, feat of packed slices: every tap's tokens (those of plan(vid, slice_idx, tok_y,
    tok_x), if there is one), projected by the tap's own projector where they are made. model(weights, batch, background) gives named
    outputs. An empty table, and a plan that names nothing, give no rows."""
    encode = _runner(slices, model, weights, micro)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, outputs in encode(batches):
            for tap, projector in taps.items():
                owner, at, x = _picked(outputs, tap, rows)
                codes = np.array([-1 if r["mod_code"] is None else r["mod_code"] for r in rows])[owner]
                y = projected(projector, x, codes)
                ends = pa.array(np.arange(0, y.size + 1, y.shape[1]).astype(np.int32)) if len(y) else pa.array([0], pa.int32())
                of = lambda name, kind, owner=owner, rows=rows: pa.array([r[name] for r in rows], kind).take(pa.array(owner))
                columns = [of("vid", pa.string()), of("dim", pa.string()), of("slice_idx", pa.int32()), of("mod_code", pa.int32()), pa.array([tap] * len(at), pa.string())]
                columns += [pa.array(at[:, k].astype(np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["vid", "dim", "slice_idx", "mod_code", "tap", "tok_y", "tok_x", "feat"])

    return _planned(slices, plan).mapInArrow(run, _TOKENS)


def tap_moments(slices: DataFrame, model, weights: models.Weights, taps: Sequence[str], plan: DataFrame | None = None, unit: bool = False, micro: int = MICRO) -> DataFrame:
    """group (the tap) and moments of its tokens, as `projection.moments` has them: raw tokens stay in the tasks. unit: of vectors brought to
    length 1."""
    encode = _runner(slices, model, weights, micro)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, outputs in encode(batches):
            for tap in taps:
                _, _, x = _picked(outputs, tap, rows)
                x = np.where(np.isfinite(x), x, 0.0)
                x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-8) if unit else x
                sums[tap] = sums.get(tap, 0) + of_tasks(np.ones(len(x)), x, x)
        if sums:
            yield pa.RecordBatch.from_pydict({"group": pa.array([*sums], pa.string()), "moments": pa.array([m.tolist() for m in sums.values()], pa.list_(pa.float64()))})

    return added(_planned(slices, plan).mapInArrow(run, "group string, moments array<double>"))


def fitted(slices: DataFrame, model, weights: models.Weights, channels: Mapping[str, int], plan: DataFrame | None = None, unit: bool = False) -> dict[str, PCA]:
    """Principal components of each tap's tokens, all taps from one pass: channels gives how many of each."""
    found = {r["group"]: r["moments"] for r in tap_moments(slices, model, weights, [*channels], plan, unit).collect()}
    missing = [t for t in channels if t not in found]
    if missing:
        raise ValueError(f"no tokens to fit components of {missing} to")
    return {tap: PCA.of_moments(found[tap], nc, unit) for tap, nc in channels.items()}


def fit_taps(slices: DataFrame, model, weights: models.Weights, projectors: Mapping[str, object], plan: DataFrame | None = None) -> dict[str, object]:
    """A fitted projector for each tap. One with `fit_batch(slices, tap)` fits itself to the whole batch, or returns None; those left, with
    `channels`, are fitted to tokens, all by one pass; None leaves a tap's tokens as they are."""
    out: dict[str, object] = {}
    for tap, projector in projectors.items():
        out[tap] = projector.fit_batch(slices, tap) if hasattr(projector, "fit_batch") else None
    left = {tap: p.channels for tap, p in projectors.items() if p is not None and out[tap] is None}
    return out | (fitted(slices, model, weights, left, plan) if left else {})
