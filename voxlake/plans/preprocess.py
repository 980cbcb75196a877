"""Preprocessing pipelines: stages in a row, each a fit (an aggregate) and an application (a join and an expression)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators import intensity
from voxlake.operators.selection import percentiles
from voxlake.scratch import written


@dataclass(frozen=True)
class Percentile:
    """Clip to percentiles of the volume and lay on [0, 1]."""

    low: float = 0.0
    high: float = 97.0
    use_mask: bool = False
    modalities: tuple[str, ...] | None = None

    def apply(self, voxels: DataFrame) -> DataFrame:
        bounds = intensity.percentile_bounds(voxels.where(intensity.applies(self.modalities)), self.low, self.high, self.use_mask)
        return intensity.clip_to(voxels, bounds)

    def brought(self, value: Column, state: Column) -> Column:
        """value by a state's low and high."""
        span = state["high"] - state["low"]
        return F.when(span > 1e-8, (F.greatest(F.least(value, state["high"]), state["low"]) - state["low"]) / span).otherwise(0.0)


@dataclass(frozen=True)
class Window:
    low: float = -150.0
    high: float = 250.0
    modalities: tuple[str, ...] | None = None

    def apply(self, voxels: DataFrame) -> DataFrame:
        return voxels.withColumn("value", intensity.window(F.col("value"), self.low, self.high))


@dataclass(frozen=True)
class MeanStd:
    """Fixed mean and deviation of each modality."""

    constants: tuple[tuple[str, float, float], ...] = ()
    modalities: tuple[str, ...] | None = None

    def apply(self, voxels: DataFrame) -> DataFrame:
        return voxels.withColumn("value", intensity.fixed_mean_std({m: (a, b) for m, a, b in self.constants}))


@dataclass(frozen=True)
class ZScore:
    low_share: float = 0.0
    high_share: float = 1.0
    modalities: tuple[str, ...] | None = None

    def apply(self, voxels: DataFrame) -> DataFrame:
        stage = intensity.ZScore(self.low_share, self.high_share)
        return stage.apply(voxels, stage.fit(voxels))

    def brought(self, value: Column, state: Column) -> Column:
        """value by a state's n, total and squares."""
        mean = state["total"] / state["n"]
        return (value - mean) / (F.sqrt(F.greatest(state["squares"] / state["n"] - mean * mean, F.lit(0.0))) + intensity.ZScore.eps)


Stage = Percentile | Window | MeanStd | ZScore
_STATE = "stage int, vid string, modality string, state map<string,double>"


def _observed(rows: DataFrame, stages: dict[int, Stage]) -> DataFrame:
    """stage, vid, modality, state of stages of which no two take one modality."""
    number = F.lit(None).cast("int")
    for i, stage in stages.items():
        number = F.when(intensity.applies(stage.modalities), F.lit(i)).otherwise(number)
    rows = rows.withColumn("stage", number).where("stage IS NOT NULL")
    keys, masked = ["stage", "vid", "modality"], F.coalesce(F.col("msk"), F.lit(True))
    ranked = {i: s for i, s in stages.items() if isinstance(s, Percentile)}
    summed = {i: s for i, s in stages.items() if isinstance(s, ZScore)}
    own = lambda chosen, of: F.element_at(F.create_map(*[F.lit(x) for i, s in chosen.items() for x in (i, of(s))]), F.col("stage"))
    out = []
    if summed:
        # of one scan, unless a stage takes a part of its volume's range, which has to be known first
        mine = rows.where(F.col("stage").isin(*summed) & masked)
        if any((s.low_share, s.high_share) != (0.0, 1.0) for s in summed.values()):
            ends = mine.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
            low, high = (intensity.part_of("_a", "_b", own(summed, share)) for share in (lambda s: s.low_share, lambda s: s.high_share))
            mine = mine.join(ends, keys).where(F.col("value").between(low, high))
        sums = mine.groupBy(*keys).agg(F.count("value").cast("double").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
        out.append(sums.select(*keys, F.create_map(*[x for c in ("n", "total", "squares") for x in (F.lit(c), F.col(c))]).alias("state")))
    if ranked:
        mine = rows.where(F.col("stage").isin(*ranked))
        inside = F.when(~own(ranked, lambda s: s.use_mask) | masked, F.col("value"))
        shares = sorted({p for s in ranked.values() for p in (s.low, s.high)})
        names = {k: f"_{k}" for k in keys}
        found = percentiles(mine.select(*keys, inside.alias("value")), [p / 100 for p in shares], keys).withColumnsRenamed(names)
        ends = mine.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"))
        met = ends.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left")
        at = lambda of: F.element_at(F.array(*[F.col(f"p{k}") for k in range(len(shares))]), own(ranked, lambda s: shares.index(of(s)) + 1))
        state = F.create_map(F.lit("low"), F.coalesce(at(lambda s: s.low), "least"), F.lit("high"), F.coalesce(at(lambda s: s.high), "most"))
        out.append(met.select(*keys, state.alias("state")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


STAGES: dict[str, Callable] = {"percentile": Percentile, "window": Window, "mean_std": MeanStd, "zscore": ZScore}


@dataclass
class Pipeline:
    """Stages in order. Every row's `log` names the stages that took it."""

    stages: Sequence[Stage] = field(default_factory=list)

    def __call__(self, voxels: DataFrame) -> DataFrame:
        rows = voxels.withColumn("log", F.array().cast("array<string>"))
        for stage in self.stages:
            takes = intensity.applies(stage.modalities)
            own = stage.apply(rows.where(takes)).withColumn("log", F.array_append("log", F.lit(type(stage).__name__)))
            rows = own if stage.modalities is None else own.unionByName(rows.where(~takes))
        return rows

    def waves(self) -> list[list[int]]:
        """The stages by number, in runs of which no two take one modality: a run's fits all see the same voxels."""
        out: list[list[int]] = []
        for i, stage in enumerate(self.stages):
            own = set(map(str.upper, stage.modalities or ()))
            met = lambda j, stage=stage, own=own: stage.modalities is None or self.stages[j].modalities is None or own & set(map(str.upper, self.stages[j].modalities))
            if not out or any(map(met, out[-1])):
                out.append([])
            out[-1].append(i)
        return out

    def record(self, voxels: DataFrame) -> DataFrame:
        """stage, vid, modality and state (numbers by name) of every stage that fits and every whole volume of
        voxels(vid, modality, value[, msk]) it takes: a table that later batches are appended to. The stages of a wave are fitted
        together, sums in one scan and ranks in one search; a wave sees what the waves before it made of its volumes."""
        rows = voxels if "msk" in voxels.columns else voxels.withColumn("msk", F.lit(None).cast("boolean"))
        rows, out = rows.select("vid", "modality", "value", "msk"), None
        for wave in self.waves():
            fitting = {i: self.stages[i] for i in wave if isinstance(self.stages[i], Percentile | ZScore)}
            states = written(_observed(rows, fitting), "stage-states") if fitting else None
            if states is not None:
                out = states if out is None else out.unionByName(states)
            if wave != self.waves()[-1]:
                rows = self._applied(rows, wave, states, ["vid", "modality"])
        return out if out is not None else voxels.sparkSession.createDataFrame([], _STATE)

    def merged(self, states: DataFrame) -> DataFrame:
        """stage, modality and state of whole modalities, from the states of their volumes, of all batches: the medians of bounds, the sums of
        counts and powers."""
        rows = states.select("stage", "modality", F.explode("state").alias("name", "x"))
        bounds = F.col("name").isin("low", "high")
        found = rows.groupBy("stage", "modality", "name").agg(F.when(F.first(bounds), F.median("x")).otherwise(F.sum("x")).alias("x"))
        return found.groupBy("stage", "modality").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("state"))

    def apply(self, voxels: DataFrame, states: DataFrame) -> DataFrame:
        """voxels with the stages applied by states of `record` (each volume's own) or `merged` (its modality's), and nothing fitted. A volume
        that a stage takes but has no state for is left out, as there is nothing to bring it by."""
        keys = [k for k in ("vid", "modality") if k in states.columns]
        rows = voxels.withColumn("log", F.array().cast("array<string>"))
        for i in range(len(self.stages)):
            rows = self._applied(rows, [i], states, keys)
        return rows

    def _applied(self, rows: DataFrame, wave: Sequence[int], states: DataFrame | None, keys: Sequence[str]) -> DataFrame:
        for i in wave:
            stage = self.stages[i]
            takes = intensity.applies(stage.modalities)
            own = rows.where(takes)
            if isinstance(stage, Percentile | ZScore):
                fit = states.where(F.col("stage") == i).select(*keys, F.col("state").alias("_state"))
                own = own.join(fit, [*keys]).withColumn("value", stage.brought(F.col("value"), F.col("_state"))).drop("_state")
            else:
                own = stage.apply(own)
            if "log" in rows.columns:
                own = own.withColumn("log", F.array_append("log", F.lit(type(stage).__name__)))
            own = own.select(*rows.columns)
            rows = own if stage.modalities is None else own.unionByName(rows.where(~takes))
        return rows

    def to_json(self) -> str:
        names = {v: k for k, v in STAGES.items()}
        return json.dumps([{"stage": names[type(s)], **asdict(s)} for s in self.stages])

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        def freeze(v):
            return tuple(freeze(x) for x in v) if isinstance(v, list) else v

        return cls([STAGES[d.pop("stage")](**{k: freeze(v) for k, v in d.items()}) for d in json.loads(text)])


#: MR by percentiles 0 to 97 of its volume, CT by a fixed window.
PRESETS: dict[str, Pipeline] = {
    "mr_ct": Pipeline([Percentile(0.0, 97.0, False, ("MR",)), Window(-150.0, 250.0, ("CT",))]),
    "t1_t2": Pipeline([Percentile(0.0, 99.5, False, ("T1", "T2"))]),
}


def make(name: str, **options) -> Stage:
    if name not in STAGES:
        raise ValueError(f"no stage {name!r}; there are {sorted(STAGES)}")
    return STAGES[name](**options)


def dataset_bounds(voxels: DataFrame, low: float, high: float) -> DataFrame:
    """Bounds of a whole modality, merged from its volumes' own."""
    own = intensity.percentile_bounds(voxels, low, high, keys=("modality", "vid"))
    return intensity.merged_bounds(own, ["modality"])
