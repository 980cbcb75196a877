"""What a user can add: projectors, samplers, mask generators, affine registrations and feature wrappers, by name.

An extension is a class of plain parameters. Its fit is an aggregate over a DataFrame and its application joins and
expressions, so Spark plans both; its state is the JSON of its kind, parameters and what it fitted.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, is_dataclass
from typing import Protocol, get_args, get_origin, get_type_hints, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import grammar
from voxlake.operators import features, neighbourhood, projection, slice_search
from voxlake.plans.axes import AXES, Axis, ThreeAxes


@runtime_checkable
class Projector(Protocol):
    """fit sees all rows(feat, ...) and returns a projector; transform is an expression over one vector."""

    def fit(self, rows: DataFrame) -> Projector: ...
    def transform(self, feat: Column) -> Column: ...


@runtime_checkable
class Sampler(Protocol):
    """The tokens to fit with, of tokens(vid, slice_idx, tok_y, tok_x[, msk])."""

    def sample(self, tokens: DataFrame) -> DataFrame: ...


@runtime_checkable
class MaskGenerator(Protocol):
    """vid, d, h, w, msk of volumes(vid, d, h, w, value)."""

    def generate(self, volumes: DataFrame) -> DataFrame: ...


@runtime_checkable
class AffineRegistration(Protocol):
    """pair_id, sd, sh, sw, td, th, tw of fixed and moving(pair_id, d, h, w, feat)."""

    def register(self, fixed: DataFrame, moving: DataFrame) -> DataFrame: ...


@runtime_checkable
class Wrapper(Protocol):
    """Changed features of a table(vid, d, h, w, feat)."""

    def wrap(self, rows: DataFrame) -> DataFrame: ...


class Registry:
    """Extensions of one kind by name. A name can stand for `module:class`, which is imported when it is first asked for."""

    def __init__(self, kind: str, protocol: type) -> None:
        self.kind, self.protocol = kind, protocol
        self._known: dict[str, Callable | str] = {}

    def register(self, name: str, make: Callable | str) -> None:
        self._known[name] = make

    def names(self) -> list[str]:
        return sorted(self._known)

    def get(self, spec, **options):
        """An extension from an instance, a name, or a mapping of a name and options; options given here come last."""
        if isinstance(spec, self.protocol) and not isinstance(spec, type):
            return spec
        if isinstance(spec, dict):
            options = {k: v for k, v in spec.items() if k != "name"} | options
            spec = spec["name"]
        if spec not in self._known:
            raise ValueError(f"no {self.kind} {spec!r}; there are {self.names()}")
        make = self._known[spec]
        if isinstance(make, str):
            module, _, attribute = make.partition(":")
            make = self._known[spec] = getattr(importlib.import_module(module), attribute)
        return make(**options)

    def state(self, extension) -> str:
        """JSON of an extension that is a dataclass of plain parameters."""
        name = next((n for n, make in self._known.items() if make is type(extension)), None)
        if name is None or not is_dataclass(extension):
            raise ValueError(f"{type(extension).__name__} is no {self.kind} with a state")
        return json.dumps({"name": name, **asdict(extension)})

    def restored(self, text: str):
        """The extension of a state; JSON has no tuples, so parameters that are declared as such become them again."""
        state = json.loads(text)
        make = self._known.get(state["name"])
        hints = get_type_hints(make) if isinstance(make, type) else {}
        tuples = {k for k, hint in hints.items() if tuple in (hint, get_origin(hint), *map(get_origin, get_args(hint)), *get_args(hint))}
        return self.get({k: tuple(v) if isinstance(v, list) and k in tuples else v for k, v in state.items()})


@dataclass(frozen=True)
class Identity:
    """Leaves vectors as they are, so a plan with it is the plan without."""

    def fit(self, rows: DataFrame) -> Identity:
        return self

    def transform(self, feat: Column) -> Column:
        return feat


@dataclass(frozen=True)
class Principal:
    """Principal components; fitted, it holds the model's JSON."""

    channels: int = 16
    model: str | None = None

    def fit(self, rows: DataFrame) -> Principal:
        return Principal(self.channels, projection.PCA.fit(rows, self.channels).to_json())

    def transform(self, feat: Column) -> Column:
        if self.model is None:
            raise ValueError("a projector is fitted before it transforms")
        return projection.load(self.model).transform(feat)


@dataclass(frozen=True)
class EveryToken:
    masked: bool = False

    def sample(self, tokens: DataFrame) -> DataFrame:
        return features.every_token(tokens, self.masked)


@dataclass(frozen=True)
class UniformTokens:
    per_slice: int | None = None
    total: int | None = None
    seed: int = 0

    def sample(self, tokens: DataFrame) -> DataFrame:
        return features.sampled(tokens.select("vid", "slice_idx", "tok_y", "tok_x"), self.per_slice, self.total, self.seed)


@dataclass(frozen=True)
class SelfSimilarityMask:
    threshold: float = 0.99
    size: int = 3
    connectivity: int = 6
    radius: int = 2
    dilation: int = 2

    def generate(self, volumes: DataFrame) -> DataFrame:
        return neighbourhood.generated_mask(volumes, self.threshold, self.size, self.connectivity, self.radius, self.dilation)

    def signature(self) -> str:
        """A name for what it generates."""
        return f"selfsim-t{self.threshold:g}-s{self.size}-c{self.connectivity}-r{self.radius}-d{self.dilation}"


@dataclass(frozen=True)
class BandSearch:
    order: str = "zxy"
    rounds: int = 1
    joint: bool = False
    n_scales: int = 101

    def register(self, fixed: DataFrame, moving: DataFrame) -> DataFrame:
        return slice_search.refined(slice_search.SliceSearch(n_scales=self.n_scales), fixed, moving, self.order, self.rounds, self.joint)


@dataclass(frozen=True)
class Channels:
    """Chosen channels, of length 1 if wanted, times a factor."""

    chosen: str = ":"
    unit: bool = False
    factor: float = 1.0
    size: int = 64

    def wrap(self, rows: DataFrame) -> DataFrame:
        from voxlake.functions import vectors as V

        feat = grammar.select(F.col("feat"), self.chosen, self.size)
        return rows.withColumn("feat", V.scale(V.unit(feat) if self.unit else feat, self.factor))


projectors = Registry("projector", Projector)
samplers = Registry("sampler", Sampler)
mask_generators = Registry("mask generator", MaskGenerator)
registrations = Registry("affine registration", AffineRegistration)
wrappers = Registry("wrapper", Wrapper)
projectors.register("identity", Identity)
projectors.register("pca", Principal)
samplers.register("all", EveryToken)
samplers.register("uniform", UniformTokens)
mask_generators.register("self_similarity", SelfSimilarityMask)
registrations.register("band_search", BandSearch)
wrappers.register("channels", Channels)


def projected(projector, rows: DataFrame) -> DataFrame:
    """rows with projected features: by the projector's own method for whole tables if it has one, else vector by vector; an
    identity, or none, adds nothing to the plan."""
    if projector is None or isinstance(projector, Identity):
        return rows
    if hasattr(projector, "transform_rows"):
        return projector.transform_rows(rows)
    return rows.withColumn("feat", projector.transform(F.col("feat")))


def three_axes_state(model: ThreeAxes) -> str:
    """The JSON of a three-axis model: its axes' parameters and fitted projections."""
    axes = {a: asdict(model.axes[a]) for a in AXES}
    return json.dumps({"combine": model.combine, "axes": axes, "models": {a: m and m.to_json() for a, m in model.models.items()}})


def three_axes_restored(text: str) -> ThreeAxes:
    state = json.loads(text)
    model = ThreeAxes(combine=state["combine"])
    model.axes = {a: Axis(**state["axes"][a]) for a in AXES}
    model.models = {a: m and projection.load(m) for a, m in state["models"].items()}
    return model
