"""Linear projections of feature vectors: moments are summed where the rows are, a small matrix is solved on the driver.

Every task adds up its own rows' moments as arrays and emits one row for each group it has seen; these partial sums are
added by component in the JVM. The driver gets matrices of the vector length squared, whatever the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators import wide
from voxlake.operators.grids import XYZ

#: The longest vectors whose matrix the driver solves; longer ones are fitted by products with blocks (`wide`).
MAX_CHANNELS = 4096


def _array(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def of_tasks(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The flat array [W, Wx, Wy, Wxx, Wyy, Wxy] of weighted moments of rows."""
    wx, wy = x * w[:, None], y * w[:, None]
    return np.concatenate([[w.sum()], wx.sum(0), wy.sum(0), (wx * x).sum(0), (wy * y).sum(0), (wx.T @ y).ravel()])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, w, x, y) -> group and the flat array [W, Wx, Wy, Wxx, Wyy, Wxy] of weighted moments."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        names, codes = groups.dictionary.to_pylist(), groups.indices.to_numpy(zero_copy_only=False)
        w, x, y = batch.column(1).to_numpy(zero_copy_only=False), _array(batch.column(2)), _array(batch.column(3))
        for code, name in enumerate(names):
            at = codes == code
            part = of_tasks(w[at], x[at], y[at])
            sums[name] = sums[name] + part if name in sums else part
    if sums:
        yield pa.RecordBatch.from_pydict({"group": pa.array([*sums], pa.string()), "moments": pa.array([m.tolist() for m in sums.values()], pa.list_(pa.float64()))})


def moments(rows: DataFrame) -> DataFrame:
    """group and moments of rows(group, w, x, y), x and y array<double> of one length each."""
    parts = rows.select(F.col("group").cast("string"), F.col("w").cast("double"), "x", "y").mapInArrow(_partial, "group string, moments array<double>")
    return added(parts)


def added(parts: DataFrame) -> DataFrame:
    """group and moments of parts(group, moments), added by component."""
    long = parts.select("group", F.posexplode("moments").alias("i", "v")).groupBy("group", "i").agg(F.sum("v").alias("v"))
    return long.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("moments"))


def _split(flat: Sequence[float], c: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = np.asarray(flat)
    at = np.cumsum([1, c, c, c, c])
    return m[0], m[1 : at[1]], m[at[1] : at[2]], m[at[2] : at[3]], m[at[3] : at[4]], m[at[4] :].reshape(c, c)


def covariances(rows: DataFrame, channels: int, weight: Column | None = None) -> DataFrame:
    """i, j (from i on), cov: the population covariance of components of feat, from moments that tasks add up first."""
    w = weight if weight is not None else F.lit(1.0)
    feat = F.slice("feat", 1, channels)
    m = moments(rows.select(F.lit("all").alias("group"), w.alias("w"), feat.alias("x"), feat.alias("y")))
    at = lambda k: F.element_at("moments", k)
    mean = lambda k: at(k + 2) / at(F.lit(1))
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (at(i * channels + j + 2 + 4 * channels) / at(F.lit(1)) - mean(i) * mean(j)).alias("cov"))
    last = F.lit(channels - 1)
    cells = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: cell(i, j))))
    return m.select(F.explode(cells).alias("c")).select("c.*")


def _signed(components: np.ndarray) -> np.ndarray:
    """Each row's component of largest size is positive."""
    at = np.abs(components).argmax(1)
    return components * np.where(components[np.arange(len(components)), at] < 0, -1.0, 1.0)[:, None]


@dataclass
class PCA:
    """Exact principal components; explained shares are of the kept components only."""

    mean: list[float]
    components: list[list[float]]
    explained: list[float]
    unit: bool = False

    @classmethod
    def fit(cls, rows: DataFrame, nc: int, unit: bool = False) -> PCA:
        """rows(feat). unit: vectors are brought to length 1 first. Vectors of more than MAX_CHANNELS go by `wide.principal`."""
        feat = V.finite(F.col("feat"))
        x = V.unit(feat) if unit else feat
        first = rows.select(F.size("feat")).first()  # all are of one length
        channels = first[0] if first else 0
        if channels > MAX_CHANNELS:
            mean, values, vectors = wide.principal(rows.select(x.alias("x")), channels, nc)
            return cls(mean.tolist(), _signed(vectors.T).tolist(), (values / (values.sum() + 1e-8)).tolist(), unit)
        found = moments(rows.select(F.lit("all").alias("group"), F.lit(1.0).alias("w"), x.alias("x"), x.alias("y"))).collect()
        if not found:
            raise ValueError("no rows to fit components to")
        return cls.of_moments(found[0]["moments"], nc, unit)

    @classmethod
    def of_moments(cls, flat: Sequence[float], nc: int, unit: bool = False) -> PCA:
        """From the flat moments of one group, x and y the same vectors."""
        c = int(round((-4 + (16 + 4 * (len(flat) - 1)) ** 0.5) / 2))
        if c > MAX_CHANNELS:
            raise ValueError(f"{c} channels; at most {MAX_CHANNELS}")
        n, s, _, _, _, p = _split(flat, c)
        mean = s / n
        values, vectors = np.linalg.eigh(p / n - np.outer(mean, mean))
        q = min(nc, c, int(n))
        order = np.argsort(-values, kind="stable")[:q]
        kept = np.maximum(values[order], 0)
        return cls(mean.tolist(), _signed(vectors[:, order].T).tolist(), (kept / (kept.sum() + 1e-8)).tolist(), unit)

    def transform(self, feat: Column) -> Column:
        x = V.finite(feat)
        x = V.unit(x) if self.unit else x
        return project(V.subtract(x, literal(self.mean)), self.components)

    def to_json(self) -> str:
        return json.dumps({"kind": "pca", "mean": self.mean, "components": self.components, "explained": self.explained, "unit": self.unit})


def literal(values: Sequence[float]) -> Column:
    """A constant vector; read from one string, so that the plan stays short."""
    return F.from_json(F.lit(json.dumps([*values])), "array<double>")


def project(x: Column, components: Sequence[Sequence[float]]) -> Column:
    """The dot product with each component, in the JVM."""
    rows = F.from_json(F.lit(json.dumps([[*r] for r in components])), "array<array<double>>")
    return V.let(x, lambda v: F.transform(rows, lambda r: V.dot(v, r)))


def ladder(spec: str | Sequence[float], levels: int, normalise: bool = True) -> list[float]:
    """Weights of levels: linear (1 to 2), uniform, exp (powers of 1.4), or a list."""
    if isinstance(spec, str):
        kinds = {"linear": [1.0 + k / max(levels - 1, 1) for k in range(levels)], "uniform": [1.0] * levels, "exp": [1.4**k for k in range(levels)]}
        if spec not in kinds:
            raise ValueError(f"{spec!r} is none of {[*kinds]}")
        out = kinds[spec]
    else:
        out = [*map(float, spec)]
        if len(out) != levels:
            raise ValueError(f"{len(out)} weights for {levels} levels")
    total = sum(out)
    return [a / total for a in out] if normalise and abs(total) > 1e-12 else out


def ladder_of(spec: str, levels: Column, normalise: bool = True) -> Column:
    """An array with the weight of each level, for as many levels as a column says (1 at least)."""
    if spec not in ("linear", "uniform", "exp"):
        raise ValueError(f"{spec!r} is none of linear, uniform, exp")
    each = F.transform(F.sequence(F.lit(0), levels.cast("int") - 1), lambda k: k.cast("double"))
    weights = {
        "linear": lambda k: 1.0 + k / F.greatest(levels - 1, F.lit(1)),
        "uniform": lambda k: F.lit(1.0),
        "exp": lambda k: F.pow(F.lit(1.4), k),
    }
    raw = F.transform(each, weights[spec])
    return V.let(raw, lambda v: F.transform(v, lambda x: x / V.total(v))) if normalise else raw


def gradient_weight(fixed: DataFrame, mode: str = "edge") -> DataFrame:
    """fixed(pair_id, d, h, w, feat) with vw, its gradient magnitude over the pair's largest ("mix": half of it, plus a half)."""
    from voxlake.operators.neighbourhood import gradient_magnitude

    size = gradient_magnitude(fixed, ["pair_id"])
    most = size.groupBy("pair_id").agg(F.max("grad").alias("_m"))
    g = F.col("grad") / F.greatest(F.col("_m"), F.lit(1e-8))
    return size.join(most, "pair_id").withColumn("vw", 0.5 + 0.5 * g if mode == "mix" else g).drop("grad", "_m")


def residual_weight(both: DataFrame, clip: float = 3.0) -> DataFrame:
    """both(pair_id, d, h, w, x, y) with vw: the mean absolute difference over its mean, cut at clip, over its largest."""
    res = V.total(F.zip_with("x", "y", lambda a, b: F.abs(a - b))) / F.size("x")
    rows = both.withColumn("_r", res)
    means = rows.groupBy("pair_id").agg(F.greatest(F.avg("_r"), F.lit(1e-8)).alias("_m"))
    rows = rows.join(means, "pair_id").withColumn("_r", F.least(F.col("_r") / F.col("_m"), F.lit(float(clip)))).drop("_m")
    most = rows.groupBy("pair_id").agg(F.greatest(F.max("_r"), F.lit(1e-8)).alias("_m"))
    return rows.join(most, "pair_id").withColumn("vw", F.col("_r") / F.col("_m")).drop("_r", "_m")


def weighted_means(rows: DataFrame, keys: Sequence[str], value: str, weight: str = "w") -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("mean"))


def centred(rows: DataFrame, keys: Sequence[str], value: str, weight: str = "w") -> DataFrame:
    """rows with value less its weighted mean within keys."""
    return rows.join(weighted_means(rows, keys, value, weight), [*keys]).withColumn(value, F.col(value) - F.col("mean")).drop("mean")


@dataclass
class WPLS:
    """Correspondence-weighted partial least squares: two projections, of fixed and of moving features."""

    fix_weight: list[list[float]]
    mov_weight: list[list[float]]
    singular: list[float]
    fix_mean: list[float] | None
    mov_mean: list[float] | None
    fix_code: int = 0
    mov_code: int = 1

    @classmethod
    def fit(cls, levels: DataFrame, means: tuple[list[float], list[float]] | None, channels: int, nc: int, alpha: Sequence[float], ridge: float = 1e-3, codes: tuple[int, int] = (0, 1)) -> WPLS:
        """levels(pair_id, level, d, h, w, x, y, vw, msk, valid): warped moving features x, fixed features y, voxel weights,
        the fixed mask (which always restricts) and whether the level's own mask holds the voxel (x counts as 0 where not).
        Weights are brought to mean 1 over all voxels of a pair after masking; the variance of x is that of the last level."""
        mean_w = levels.where("level = 0").groupBy("pair_id").agg(F.greatest(F.avg(F.when(F.col("msk"), F.col("vw")).otherwise(0.0)), F.lit(1e-8)).alias("_mw"))
        rows = levels.where("msk").join(mean_w, "pair_id")
        fx, my = (literal(m) for m in means) if means else (None, None)
        y = V.subtract(F.col("y"), fx) if means else F.col("y")
        x = V.subtract(F.col("x"), my) if means else F.col("x")
        x = F.when(F.col("valid"), x).otherwise(V.scale(x, 0.0))
        group = F.concat_ws("|", F.col("level").cast("string"), "pair_id")
        own = rows.select(group.alias("group"), (F.col("vw") / F.col("_mw")).alias("w"), x.alias("x"), y.alias("y"))
        if channels > MAX_CHANNELS:
            s, right, left = wide.least_squares(own, channels, nc, alpha, ridge)
            sign = np.where(left[np.abs(left).argmax(0), np.arange(left.shape[1])] < 0, -1.0, 1.0)
            return cls((right * sign).tolist(), (left * sign).tolist(), s.tolist(), *(means or (None, None)), *codes)
        found = moments(own)
        cxy, xv, yv, total = _accumulated(found, channels, alpha)
        denominator = total + 1e-8
        sx, sy = 1 / np.sqrt(xv / denominator + ridge), 1 / np.sqrt(yv / denominator + ridge)
        u, s, vh = np.linalg.svd(sx[:, None] * cxy * sy[None], full_matrices=False)
        at = np.abs(u[:, :nc]).argmax(0)
        sign = np.where(u[at, np.arange(len(at))] < 0, -1.0, 1.0)
        return cls((vh.T[:, :nc] * sign).tolist(), (u[:, :nc] * sign).tolist(), s[:nc].tolist(), *(means or (None, None)), *codes)

    def transform(self, rows: DataFrame, code: str = "mod_code", feat: str = "feat") -> DataFrame:
        """rows with projected feat, by modality code; rows of an unknown code get zeros."""
        sides = []
        for weight, mean in ((self.fix_weight, self.fix_mean), (self.mov_weight, self.mov_mean)):
            x = V.finite(F.col(feat))
            sides.append(project(V.subtract(x, literal(mean)) if mean else x, np.asarray(weight).T.tolist()))
        zeros = literal([0.0] * len(self.singular))
        chosen = F.when(F.col(code) == self.fix_code, sides[0]).when(F.col(code) == self.mov_code, sides[1]).otherwise(zeros)
        return rows.withColumn(feat, chosen)

    def to_json(self) -> str:
        return json.dumps({"kind": "wpls", **self.__dict__})


def _accumulated(found: DataFrame, c: int, alpha: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Centred sums over pairs, added up in the cluster; one row of c * c + 2 c + 1 numbers comes back."""
    last = len(alpha) - 1

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(c * c + 2 * c + 1)
        for batch in batches:
            for name, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                level = int(name.split("|", 1)[0])
                w, sx, sy, xx, yy, xy = _split(flat.values.to_numpy(zero_copy_only=False), c)
                d = max(w, 1e-8)
                out[: c * c] += alpha[level] * (xy - np.outer(sx, sy) / d).ravel()
                if level == last:
                    out[c * c : -1] += np.concatenate([xx - sx**2 / d, yy - sy**2 / d])
                    out[-1] += w
        yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tolist()], pa.list_(pa.float64()))})

    parts = found.mapInArrow(centre, "sums array<double>")
    summed = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(c * c + 2 * c + 1)
    for row in summed.toLocalIterator():
        flat[row["i"]] = row["v"]
    return flat[: c * c].reshape(c, c), flat[c * c : c * c + c], flat[c * c + c : -1], float(flat[-1])


def masked_mean(rows: DataFrame, channels: int, value: str = "feat", mask: str = "msk") -> list[float]:
    """The mean vector of masked rows: one row of `channels` numbers comes to the driver."""
    row = rows.where(mask).agg(*[F.avg(F.element_at(value, k + 1)) for k in range(channels)]).first()
    return [float(v or 0.0) for v in row]


def load(text: str) -> PCA | WPLS:
    state = json.loads(text)
    kinds = {"pca": PCA, "wpls": WPLS}
    return kinds[state.pop("kind")](**state)


def save(model: PCA | WPLS, spark: SparkSession, path: str) -> None:
    """One row of JSON as Parquet; nothing is pickled."""
    spark.createDataFrame([(model.to_json(),)], "state string").coalesce(1).write.parquet(path)


def read(spark: SparkSession, path: str) -> PCA | WPLS:
    return load(spark.read.parquet(path).first()["state"])


__all__ = ["PCA", "WPLS", "XYZ", "centred", "covariances", "gradient_weight", "ladder", "ladder_of", "load", "masked_mean", "moments", "project", "read", "residual_weight", "save", "weighted_means"]
