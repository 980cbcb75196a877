"""Named collections of volumes: files are told apart by their names, in column expressions over the listing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import names
from voxlake.sources import nifti

#: Files whose kinds are broadcast; longer lists are joined by shuffle.
BROADCAST_FILES = 100_000
#: Axis names of each collection for slicing along x, y, z. Fixed values.
AXIS_ORDER = {"abdomen": ("Sagittal", "Coronal", "Axial"), "brain": ("Coronal", "Sagittal", "Axial")}


def classify_abdomen(listing: DataFrame) -> DataFrame:
    """path, kind (vol, seg, msk), sample, modality of `img0002_tcia_MR.nii.gz` and likewise named files; others are left out."""
    form = "(?:^|/)(img|seg|mask)([0-9]{4})_tcia_(MR|CT)\\.nii(?:\\.gz)?$"
    kind = F.regexp_extract("path", form, 1)
    rows = listing.where(F.col("path").rlike(form))
    named = F.when(kind == "img", "vol").when(kind == "seg", "seg").otherwise("msk")
    return rows.withColumns({"kind": named, "sample": F.regexp_extract("path", form, 2).cast("int"), "modality": F.regexp_extract("path", form, 3)})


def classify_brain(listing: DataFrame) -> DataFrame:
    """The same of `HCPT1_12_0000.nii.gz` (volume), `HCPT1_12.nii.gz` (labels), and that name below a folder `rois` (mask)."""
    form = "(?:^|/)HCPT([12])_([0-9]+)(_0000)?\\.nii(?:\\.gz)?$"
    rows = listing.where(F.col("path").rlike(form))
    mask = F.col("path").rlike("/rois/[^/]*$")
    kind = F.when(mask, "msk").when(F.regexp_extract("path", form, 3) != "", "vol").otherwise("seg")
    return rows.withColumns({"kind": kind, "sample": F.regexp_extract("path", form, 2).cast("int"), "modality": F.concat(F.lit("T"), F.regexp_extract("path", form, 1))})


CLASSIFIERS: dict[str, Callable[[DataFrame], DataFrame]] = {"abdomen": classify_abdomen, "brain": classify_brain}


def duplicates(classified: DataFrame) -> DataFrame:
    """Kinds of which an entity has several files."""
    return classified.groupBy("kind", "sample", "modality").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def incomplete(classified: DataFrame) -> DataFrame:
    """Entities with labels or a mask but no volume, or without labels."""
    seen = classified.groupBy("sample", "modality").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("vol", "seg", "msk")])
    return seen.where("NOT vol OR NOT seg")


def dataset(spark: SparkSession, name: str, folder: str, samples: Sequence[int] | None = None, modality: str | None = None) -> DataFrame:
    """vid, sample, modality, d, h, w, value, seg, msk (null: no mask file) of a collection's files. Restrictions are made on
    the listing: files that they leave out are never opened. The list of files, as Spark itself holds it, comes to the driver."""
    if name not in CLASSIFIERS:
        raise ValueError(f"no collection {name!r}; there are {sorted(CLASSIFIERS)}")
    found = CLASSIFIERS[name](nifti.listing(spark, folder))
    if samples is not None:
        found = found.where(F.col("sample").isin(*map(int, samples)))
    if modality is not None:
        found = found.where(F.col("modality") == modality.upper())
    files = found.select("path", "kind", "sample", "modality").collect()
    keys = spark.createDataFrame(files, "path string, kind string, sample int, modality string")
    rows = nifti.voxels(nifti.chosen(spark, [f["path"] for f in files]))
    rows = rows.join(F.broadcast(keys) if len(files) <= BROADCAST_FILES else keys, "path")
    at = ["sample", "modality", "d", "h", "w"]
    wide = rows.groupBy(*at).agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("vol", "seg", "msk")])
    vid = names.make(F.col("sample"), F.col("modality"), F.col("sample").cast("string"))
    return wide.select(vid.alias("vid"), *at, F.col("vol").alias("value"), F.col("seg").cast("short").alias("seg"), (F.col("msk") > 0.5).alias("msk"))


def resolved(spark: SparkSession, spec: DataFrame | str | dict, **overrides) -> DataFrame:
    """A collection from a table (as it is), a registered name, or a mapping of a name and options; overrides come last."""
    if isinstance(spec, DataFrame):
        if overrides:
            raise ValueError(f"a table takes no options: {sorted(overrides)}")
        return spec
    options = {"name": spec} if isinstance(spec, str) else dict(spec)
    options |= overrides
    unknown = set(options) - {"name", "folder", "samples", "modality"}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return dataset(spark, **options)


def of_samples(rows: DataFrame, samples: Sequence[int]) -> DataFrame:
    """The rows of some samples, such as a named subset's."""
    return rows.where(F.col("sample").isin(*map(int, samples)))


def of_modality(voxels: DataFrame, modality: str) -> DataFrame:
    """The voxels of one modality, whatever its letters' case."""
    return voxels.where(F.upper("modality") == modality.upper())


def coerced(voxels: DataFrame) -> DataFrame:
    """The usual types: value float, seg short, msk boolean (floats above 0.5, whole numbers other than 0)."""
    kinds = dict(voxels.dtypes)
    out = voxels.withColumns({"value": F.col("value").cast("float"), "seg": F.col("seg").cast("short")})
    if kinds["msk"] in ("float", "double"):
        return out.withColumn("msk", F.col("msk") > 0.5)
    return out if kinds["msk"] == "boolean" else out.withColumn("msk", F.col("msk") != 0)


def faults(volumes: DataFrame) -> DataFrame:
    """vid and what is wrong: volumes(vid, shape, seg_shape, msk_shape, affine) that break the contract of a batch."""
    rules = {
        "volume isn't 3-D": F.size("shape") != 3,
        "labels of another shape": F.col("seg_shape").isNotNull() & (F.col("seg_shape") != F.col("shape")),
        "mask of another shape": F.col("msk_shape").isNotNull() & (F.col("msk_shape") != F.col("shape")),
        "affine isn't 4 x 4": F.col("affine").isNotNull() & ((F.size("affine") != 4) | F.exists("affine", lambda r: F.size(r) != 4)),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(text)) for text, test in rules.items()]), lambda x: x.isNotNull())
    return volumes.select("vid", F.explode(found).alias("fault"))


def merged(items: DataFrame) -> DataFrame:
    """item, n, item_ptr: how many entities each item has and where they start, of items(item, vid)."""
    from pyspark.sql import Window

    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("item", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("item_ptr"))


def picked(rows: DataFrame, at: int | slice | Sequence[int], size: int, key: str = "sample_pos") -> DataFrame:
    """Rows at an index, slice or list of indexes."""
    index = [*range(size)[at]] if isinstance(at, slice) else [at] if isinstance(at, int) else [*at]
    return rows.where(F.col(key).isin(*[int(k) + size if k < 0 else int(k) for k in index]))
