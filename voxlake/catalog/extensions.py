"""Loading geometry, masks by stage, extensions by name, traces, registrations of two stages, models over slices and volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.catalog.base import INTEN, TOK, VOX, Catalog, entities, inten, r6, tok, vox
from voxlake.operators import encoders, grids, knn, landmarks, models, projection, registration, slices, streaming
from voxlake.operators.numbering import ordered
from voxlake.operators.pairs import fixed_moving
from voxlake.plans import experiments as X
from voxlake.plans import extensions, masks, preprocess
from voxlake.sources import datasets
from voxlake.sources.views import table

C = Catalog()
_SZ = VOX + ", sz AS (SELECT vid, max(d) + 1 AS nd, max(h) + 1 AS nh, max(w) + 1 AS nw FROM vox GROUP BY vid)"
_GRID = _SZ + """, g AS (SELECT * FROM (SELECT vid, nd, nh, nw, unnest(range(0, nd + 3)) AS d FROM sz), (SELECT unnest(range(0, 200)) AS h), (SELECT unnest(range(0, 200)) AS w) WHERE h < nh + 2 AND w < nw + 1)"""


# ---- geometry while loading ------------------------------------------------------------------------------------------


@C.add(_GRID + " SELECT g.vid, CAST(g.d AS INTEGER) AS d, CAST(g.h AS INTEGER) AS h, CAST(g.w AS INTEGER) AS w, round(v.value, 6) + 0.0 AS value FROM g LEFT JOIN vox v ON v.vid = g.vid AND v.d = greatest(least(g.d - 1, nd - 1), 0) AND v.h = greatest(least(g.h - 2, nh - 1), 0) AND v.w = least(g.w, nw - 1)")
def S14_padded_by_border(spark, folder):
    return grids.padded(vox(spark, folder), (1, 2, 0), (2, 0, 1)).withColumn("value", r6("value"))


@C.add(_GRID + " SELECT g.vid, CAST(g.d AS INTEGER) AS d, CAST(g.h AS INTEGER) AS h, CAST(g.w AS INTEGER) AS w, round(coalesce(v.value, -1.5), 6) + 0.0 AS value FROM g LEFT JOIN vox v ON v.vid = g.vid AND v.d = g.d - 1 AND v.h = g.h - 2 AND v.w = g.w")
def S14_padded_by_value(spark, folder):
    return grids.padded(vox(spark, folder), (1, 2, 0), (2, 0, 1), -1.5).withColumn("value", r6("value"))


_ZOOM = _SZ + """, z AS (SELECT vid, nd, nh, nw, greatest(CAST(round_even(nd * 1.7::DOUBLE, 0) AS INTEGER), 1) AS md, greatest(CAST(round_even(nw * 0.5::DOUBLE, 0) AS INTEGER), 1) AS mw FROM sz),
g AS (SELECT * FROM (SELECT vid, nd, nh, nw, md, mw, unnest(range(0, md)) AS d FROM z), (SELECT unnest(range(0, 200)) AS h), (SELECT unnest(range(0, 200)) AS w) WHERE h < nh AND w < mw),
p AS (SELECT vid, nd, nw, d, h, w, CASE WHEN md > 1 THEN d * (nd - 1) / (md - 1)::DOUBLE ELSE 0 END AS x, CASE WHEN mw > 1 THEN w * (nw - 1) / (mw - 1)::DOUBLE ELSE 0 END AS y FROM g)"""


@C.add(_ZOOM + " SELECT p.vid, CAST(p.d AS INTEGER) AS d, CAST(p.h AS INTEGER) AS h, CAST(p.w AS INTEGER) AS w, v.seg FROM p JOIN vox v ON v.vid = p.vid AND v.d = floor(x + 0.5) AND v.h = p.h AND v.w = floor(y + 0.5)")
def S14_zoomed_labels(spark, folder):
    return grids.zoomed(vox(spark, folder), (1.7, 1.0, 0.5), "seg", 0)


@C.add(
    _ZOOM
    + """, t AS (SELECT *, floor(x) AS a, floor(y) AS b FROM p),
k AS (SELECT vid, d, h, w, a + i AS sd, b + j AS sw, (CASE WHEN i = 0 THEN 1 - (x - a) ELSE x - a END) * (CASE WHEN j = 0 THEN 1 - (y - b) ELSE y - b END) AS wt FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT k.vid, CAST(k.d AS INTEGER) AS d, CAST(k.h AS INTEGER) AS h, CAST(k.w AS INTEGER) AS w, round(sum(v.value * wt), 6) + 0.0 AS value FROM k JOIN vox v ON v.vid = k.vid AND v.d = k.sd AND v.h = k.h AND v.w = k.sw WHERE wt > 0 GROUP BY k.vid, k.d, k.h, k.w"""
)
def S14_zoomed_volume(spark, folder):
    return grids.zoomed(vox(spark, folder), (1.7, 1.0, 0.5)).withColumn("value", r6("value"))


def _cubic(source: str, axis: str, size: str, new: str, others: str, out: str) -> str:
    """SQL of a zoom by cubic splines along one axis: coefficients as sums over the mirrored line, far terms of which vanish, then four taps."""
    mirrored = lambda i, n: f"CASE WHEN {n} = 1 THEN 0 WHEN abs({i}) % (2 * {n} - 2) < {n} THEN abs({i}) % (2 * {n} - 2) ELSE 2 * {n} - 2 - abs({i}) % (2 * {n} - 2) END"
    return f"""{out}_n AS (SELECT vid, {others}, {axis} AS i, {size} AS n, {new} AS m, value FROM {source} JOIN z USING (vid)),
{out}_c AS (SELECT a.vid, {", ".join(f"a.{c}" for c in others.split(", "))}, a.i, any_value(a.n) AS n, any_value(a.m) AS m, CASE WHEN any_value(a.n) = 1 THEN any_value(a.value) ELSE sum(sqrt(3::DOUBLE) * (sqrt(3::DOUBLE) - 2) ** abs(k) * b.value) END AS c
  FROM (SELECT *, unnest(range(-36, 37)) AS k FROM {out}_n) a JOIN {out}_n b ON b.vid = a.vid AND {" AND ".join(f"b.{c} = a.{c}" for c in others.split(", "))} AND b.i = {mirrored("a.i + k", "a.n")} GROUP BY ALL),
{out}_p AS (SELECT DISTINCT vid, {others}, n, m, unnest(range(0, m)) AS j FROM {out}_c),
{out}_t AS (SELECT *, CASE WHEN m > 1 THEN j * (n - 1) / (m - 1)::DOUBLE ELSE 0 END AS x FROM {out}_p),
{out}_u AS (SELECT *, x - floor(x) AS t, CAST(floor(x) AS INTEGER) AS f, unnest(range(0, 4)) AS k FROM {out}_t),
{out} AS (SELECT u.vid, {", ".join(f"u.{c}" for c in others.split(", "))}, u.j AS {axis}, sum(c.c * CASE k WHEN 0 THEN (1 - t) ** 3 WHEN 1 THEN 4 - 6 * t ** 2 + 3 * t ** 3 WHEN 2 THEN 4 - 6 * (1 - t) ** 2 + 3 * (1 - t) ** 3 ELSE t ** 3 END / 6) AS value
  FROM {out}_u u JOIN {out}_c c ON c.vid = u.vid AND {" AND ".join(f"c.{x} = u.{x}" for x in others.split(", "))} AND c.i = {mirrored("f + k - 1", "u.n")} GROUP BY ALL)"""


@C.add(
    _SZ
    + ", z AS (SELECT vid, nd, nh, nw, greatest(CAST(round_even(nd * 1.7::DOUBLE, 0) AS INTEGER), 1) AS md, greatest(CAST(round_even(nw * 0.5::DOUBLE, 0) AS INTEGER), 1) AS mw FROM sz), "
    + _cubic("vox", "d", "nd", "md", "h, w", "za")
    + ", "
    + _cubic("za", "w", "nw", "mw", "d, h", "zb")
    + " SELECT vid, CAST(d AS INTEGER) AS d, CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w, round(value, 5) + 0.0 AS value FROM zb"
)
def S14_zoomed_by_splines(spark, folder):
    return grids.zoomed(vox(spark, folder), (1.7, 1.0, 0.5), order=3, partial=True).withColumn("value", F.round("value", 5) + 0.0)


@C.add("SELECT c_custkey AS sample, c_name AS vid FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21)")
def S4_named_subset(spark, folder):
    chosen = masks.subset('{"test": [3, 5, 8, 13, 21], "train": [1, 2]}', "test")
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_name").alias("vid"))
    return datasets.of_samples(rows, chosen)


# ---- masks -----------------------------------------------------------------------------------------------------------


def _generated(spark: SparkSession, folder: str) -> DataFrame:
    return vox(spark, folder).where("(d + h) % 3 <> 0").select("vid", "d", "h", "w", (F.col("w") < 3).alias("msk"))


@C.add(VOX + " SELECT vid, d, h, w, msk AS msk_raw, CASE WHEN (d + h) % 3 <> 0 THEN w < 3 END AS msk_gen, msk AND (w < 3 OR (d + h) % 3 = 0) AS msk FROM vox")
def P43_attached_masks(spark, folder):
    return masks.attached(vox(spark, folder), _generated(spark, folder), "inter").select("vid", "d", "h", "w", "msk_raw", "msk_gen", "msk")


@C.add(VOX + ", st AS (SELECT unnest(['feat', 'affine', 'elastic']) AS stage) SELECT stage, vid, d, h, w, CASE WHEN stage <> 'elastic' AND (d + h) % 3 <> 0 THEN w < 3 END AS msk FROM vox, st")
def F15_routed_masks(spark, folder):
    bare = vox(spark, folder).withColumn("msk", F.lit(None).cast("boolean"))
    found = masks.injected(bare, _generated(spark, folder))
    out = None
    for stage in ("feat", "affine", "elastic"):
        part = masks.stage_rows(found, "affine+feat", stage).select(F.lit(stage).alias("stage"), "vid", "d", "h", "w", "msk")
        out = part if out is None else out.unionByName(part)
    return out


@C.add(VOX + " SELECT vid, CAST(d AS INTEGER) AS slice_idx, list(msk ORDER BY h, w) AS msk FROM vox GROUP BY vid, d")
def P44_flat_masks(spark, folder):
    lines = vox(spark, folder).groupBy("vid", "d", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "msk"))), lambda x: x["msk"]).alias("m"))
    planes = lines.groupBy("vid", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "m"))), lambda x: x["m"]).alias("m"))
    whole = planes.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("msk"))
    return masks.flat(whole)


# ---- batches and traces ----------------------------------------------------------------------------------------------


@C.add("it AS (SELECT c_nationkey AS item, count(*) AS n FROM customer GROUP BY 1), pt AS (SELECT item, n, coalesce(sum(n) OVER (ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM it) SELECT item, CAST(p + k AS BIGINT) AS entity_pos FROM (SELECT item, p, unnest(range(0, n)) AS k FROM pt)")
def P39_split_items(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("item"), F.col("c_name").alias("vid"))
    return masks.items(datasets.merged(c), spark.range(c.count()).withColumnRenamed("id", "entity_pos")).select("item", "entity_pos")


@C.add("SELECT o_orderkey AS id, 'encode(patch:2) > project(channels:24,kind:pca) > warp()' AS summary FROM orders")
def P40_traces(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    rows = masks.traced(masks.traced(o, "encode", patch=2), "project", kind="pca", channels=24)
    other = masks.traced(o, "warp").select("id", F.col("trace").alias("after"))
    return rows.join(other, "id").select("id", masks.summary(masks.chained(F.col("trace"), F.col("after"))).alias("summary"))


@C.add(VOX + " SELECT vid, d, h, w, [value, value, value] AS channels FROM vox")
def P10_gray_to_channels(spark, folder):
    return encoders.repeated(vox(spark, folder).select("vid", "d", "h", "w", "value")).drop("value")


@C.add(TOK + " SELECT vox, feat FROM tok")
def P30_identity_projection(spark, folder):
    t = tok(spark, folder).select("vox", "feat")
    return extensions.projected(extensions.projectors.get("identity").fit(t), t)


@C.add(TOK + ", n AS (SELECT vid, d, h, w, row_number() OVER (PARTITION BY vid, d ORDER BY md5(concat_ws('|', '3', vid, d, h, w)), h, w) AS n FROM tok) SELECT vid, d AS slice_idx, h AS tok_y, w AS tok_x FROM n WHERE n <= 3")
def U3_sampler_by_name(spark, folder):
    tokens = tok(spark, folder).select("vid", F.col("d").alias("slice_idx"), F.col("h").alias("tok_y"), F.col("w").alias("tok_x"))
    again = extensions.samplers.restored(extensions.samplers.state(extensions.samplers.get({"name": "uniform", "per_slice": 3}, seed=3)))
    return again.sample(tokens)


@C.add(TOK + " SELECT vox, list_transform(feat[2:9], lambda x: round(2 * x / (sqrt(list_dot_product(feat[2:9], feat[2:9])) + 1e-8), 6) + 0.0) AS feat FROM tok")
def U6_wrapper_by_name(spark, folder):
    found = extensions.wrappers.get("channels", chosen="[1:9]", unit=True, factor=2.0).wrap(tok(spark, folder))
    return found.select("vox", F.transform("feat", r6).alias("feat"))


@C.add(TOK + """, lm AS (SELECT vid, concat('p', seg) AS p, d AS x, h AS y, w AS z, vox FROM tok), la AS (SELECT vid, p, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY vid, p ORDER BY vox DESC) AS n FROM lm) WHERE n = 1)
SELECT vid, p, x, y, z FROM la""")
def J3_last_duplicates(spark, folder):
    t = tok(spark, folder).select("vid", F.concat(F.lit("p"), F.col("seg").cast("string")).alias("p"), F.col("d").alias("x"), F.col("h").alias("y"), F.col("w").alias("z"), "vox")
    return landmarks.last_of_name(t, "vox")


@C.add(VOX + """, s AS (SELECT vid, h AS slice_idx, d, w, value FROM vox), sz AS (SELECT vid, max(d) + 1 AS nr, max(w) + 1 AS nc, max(slice_idx) + 1 AS n FROM s GROUP BY vid)
SELECT vid, CAST(n AS INTEGER) AS n, CAST(ceil(nr / 4.0) * 4 AS INTEGER) AS rows, CAST(ceil(nc / 4.0) * 4 AS INTEGER) AS cols FROM sz""")
def E10_pad_policy(spark, folder):
    cut = slices.serialize(vox(spark, folder).select("vid", "d", "h", "w", "value"), "y")
    found = encoders.resized_for(cut, "pad_to_patch", 4, slices.background(cut))
    return found.groupBy("vid").agg((F.max("slice_idx") + 1).alias("n"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


@C.add(TOK + " SELECT vox, d, h, w FROM tok")
def T2_unravelled_indexes(spark, folder):
    t = tok(spark, folder).select("vox", (F.col("d") * 25 + F.col("h") * 5 + F.col("w")).alias("flat"))
    d, h, w = knn.unravelled(F.col("flat"), F.lit(5), F.lit(5))
    return t.select("vox", d.alias("d"), h.alias("h"), w.alias("w"))


@C.add("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS pos, s_name AS vid FROM supplier")
def P9_T5_restored_order(spark, folder):
    rows = ordered(table(spark, folder, "supplier"), ["s_suppkey"], "pos").select((F.col("pos") + 1).alias("pos"), (F.col("s_nationkey") % 3).alias("mod_code"), F.lit(1).alias("n_slices"), F.col("s_name").alias("vid"))
    order = slices.by_modality(rows)
    return slices.restored(order.select("place", "vid"), order).select("pos", "vid")


@C.add(
    INTEN
    + """, bd AS (SELECT vid, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM inten WHERE modality = 'MR' GROUP BY vid)
SELECT vid, modality, round(avg(CASE modality WHEN 'MR' THEN (least(greatest(value, low), high) - low) / (high - low) ELSE (least(greatest(value, 0), 50000) - 0) / 50000 END), 6) + 0.0 AS mean FROM inten JOIN bd USING (vid) GROUP BY vid, modality"""
)
def K9_pipeline_state(spark, folder):
    made = preprocess.Pipeline([preprocess.make("percentile", low=5.0, high=95.0, modalities=("MR",)), preprocess.make("window", low=0.0, high=50000.0, modalities=("CT",))])
    rows = preprocess.Pipeline.from_json(made.to_json())(inten(spark, folder))
    return rows.groupBy("vid", "modality").agg(r6(F.avg("value")).alias("mean"))


@C.add("SELECT DISTINCT c_mktsegment AS config, concat('n', c_nationkey) AS name, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey::DOUBLE / 2 END AS lr, CASE WHEN c_nationkey % 2 = 0 THEN 3 ELSE c_nationkey END::BIGINT AS epochs FROM customer")
def S16_parsed_experiments(spark, folder):
    n = F.col("c_nationkey")
    own = F.create_map(F.lit("lr"), F.when(n % 3 == 0, "__none__").otherwise((n / 2).cast("string")))
    own = F.when(n % 2 == 0, own).otherwise(F.map_concat(own, F.create_map(F.lit("epochs"), n.cast("string"))))
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("config"), F.concat(F.lit("n"), n.cast("string")).alias("name"), F.to_json(own).alias("text")).distinct()
    base = rows.select("config", F.lit("__otherwise__").alias("name"), F.lit('{"lr": 0.1, "epochs": 3}').alias("text")).distinct()
    found = X.expanded_rows(rows.unionByName(base))
    return found.select("config", "name", F.col("settings.lr").cast("double").alias("lr"), F.col("settings.epochs").cast("long").alias("epochs"))


# ---- registration ----------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = tok(spark, folder)
    pairs = fixed_moving(entities(spark, folder), "MR", "CT")
    side = lambda name: pairs.join(t.withColumnRenamed("vid", name), name).select("pair_id", "d", "h", "w", "feat", "msk")
    return side("fix_vid"), side("mov_vid")


_BOX3 = "(SELECT v.vid, v.d, v.h, v.w, sum(n.ud) / 27 AS ud FROM {0} v JOIN {0} n ON n.vid = v.vid AND abs(n.d - v.d) <= 1 AND abs(n.h - v.h) <= 1 AND abs(n.w - v.w) <= 1 GROUP BY v.vid, v.d, v.h, v.w)"


@C.add(
    VOX
    + ", f0 AS (SELECT vid, d, h, w, value AS ud FROM vox), a AS "
    + _BOX3.format("f0")
    + ", b AS "
    + _BOX3.format("a")
    + ", f1 AS "
    + _BOX3.format("b")
    + " SELECT vid AS pair_id, 'e5_s0' AS level, d, h, w, round(ud, 6) + 0.0 AS ud FROM f0 UNION ALL SELECT vid, 'e5_s1', d, h, w, round(ud, 6) + 0.0 FROM f1"
)
def R7_smoothing_snapshots(spark, folder):
    zero = F.lit(0.0)
    fields = vox(spark, folder).select(F.col("vid").alias("pair_id"), F.lit("e5").alias("level"), "d", "h", "w", F.col("value").alias("ud"), zero.alias("uh"), zero.alias("uw"))
    return registration.smoothing_levels(fields, (0, 1)).select("pair_id", "level", "d", "h", "w", r6("ud").alias("ud"))


@C.add("SELECT CAST(p AS VARCHAR) AS pair_id, CAST(step AS INTEGER) AS step, level FROM (SELECT DISTINCT o_custkey % 7 AS p FROM orders), (VALUES (0, NULL), (1, 'affine'), (2, 'convex'), (3, 'e20_s1')) t(step, level)")
def R10_ladder_levels(spark, folder):
    pairs = table(spark, folder, "orders").select((F.col("o_custkey") % 7).cast("string").alias("pair_id")).distinct()
    found = pairs.select("pair_id", F.explode(F.array(*[F.lit(x) for x in ("affine", "convex", "e5_s0", "e5_s9", "e20_s0", "e20_s1")])).alias("level"))
    return registration.ladder_levels(found)


@C.add()
def R9_two_stage_registration(spark, folder):
    fixed, moving = _sides(spark, folder)
    stage = registration.TwoStage("trans", registration.Elastic(grid=2, reach=2, inverse_rounds=3, adam_grid=1, iters=(60,), loss="ncc", smooths=(0,)), use_mask="elastic")
    return stage(fixed, moving).select("pair_id", "level", "d", "h", "w", *[r6(c).alias(c) for c in ("ud", "uh", "uw")])


# ---- models over whole slices and volumes -----------------------------------------------------------------------------

#: Sides of 5 are padded to 6, one pixel before; tokens are sums over 2 x 2 pixels with weights cos(k + 2 y + 3 x), and a position table.
_PATCHED = TOK + """, px AS (SELECT vid, d AS slice_idx, (h + 1) // 2 AS tok_y, (w + 1) // 2 AS tok_x, (h + 1) % 2 AS y, (w + 1) % 2 AS x, 100 * feat[1] AS value FROM tok),
ks AS (SELECT unnest(range(0, 4)) AS k),
tk AS (SELECT vid, slice_idx, tok_y, tok_x, k, 0.1::DOUBLE * k + 0.01::DOUBLE * (tok_y + 2 * tok_x) * k + sum(value * cos(k + 2 * y + 3 * x)) AS t FROM px, ks GROUP BY vid, slice_idx, tok_y, tok_x, k)"""


def _patch_model() -> tuple[models.PatchTransformer, dict[str, np.ndarray]]:
    k, y, x = np.meshgrid(np.arange(4), np.arange(2), np.arange(2), indexing="ij")
    ty, tx, c = np.meshgrid(np.arange(3), np.arange(3), np.arange(4), indexing="ij")
    weights = {"patch.weight": np.cos(k + 2 * y + 3 * x)[..., None], "patch.bias": 0.1 * np.arange(4), "position": 0.01 * (ty + 2 * tx) * c}
    return models.PatchTransformer(models.Layout(2, "pad_to_patch", channels=1), 4), weights


def _value_slices(spark, folder):
    return streaming.packed_slices(slices.serialize(vox(spark, folder).select("vid", "d", "h", "w", "value"), "x").drop("is_end"), partial=True)


def _seen_tokens(spark, folder):
    """Tokens of at least one pixel: a slice may lack some."""
    place = [F.expr(f"cast(({c} + 1) div 2 as int)").alias(name) for c, name in (("h", "tok_y"), ("w", "tok_x"))]
    return tok(spark, folder).select("vid", F.col("d").alias("slice_idx"), *place).distinct()


@C.add(
    _PATCHED
    + """ SELECT vid, CAST(slice_idx AS INTEGER) AS slice_idx, CAST(tok_y AS INTEGER) AS tok_y, CAST(tok_x AS INTEGER) AS tok_x,
  [round(sum((t - 0.5::DOUBLE * k) * sin(1 + k)), 6) + 0.0, round(sum((t - 0.5::DOUBLE * k) * sin(5 + k)), 6) + 0.0] AS feat FROM tk GROUP BY vid, slice_idx, tok_y, tok_x"""
)
def E1_E2_streamed_projection(spark, folder):
    model, weights = _patch_model()
    k = np.arange(4)
    onto = projection.PCA((0.5 * k).tolist(), [np.sin(1 + k).tolist(), np.sin(5 + k).tolist()], [0.5, 0.5])
    found = streaming.stream(_value_slices(spark, folder), model, weights, {"patch": onto}, _seen_tokens(spark, folder))
    return found.select("vid", "slice_idx", "tok_y", "tok_x", F.transform("feat", r6).alias("feat"))


@C.add(
    _PATCHED
    + """, pl AS (SELECT * FROM tk WHERE (slice_idx + tok_y + tok_x) % 2 = 0)
SELECT vid, CAST(slice_idx AS INTEGER) AS slice_idx, 'patch' AS tap, CAST(tok_y AS INTEGER) AS tok_y, CAST(tok_x AS INTEGER) AS tok_x, list(round(t, 6) + 0.0 ORDER BY k) AS feat FROM pl GROUP BY ALL
UNION ALL SELECT vid, CAST(slice_idx AS INTEGER), 'tokens', CAST(tok_y AS INTEGER), CAST(tok_x AS INTEGER), [round(sum(t * (1 + k)), 6) + 0.0] FROM pl GROUP BY ALL"""
)
def E3_E6_two_taps_of_a_plan(spark, folder):
    model, weights = _patch_model()
    onto = projection.PCA([0.0] * 4, [[1.0, 2.0, 3.0, 4.0]], [1.0])
    plan = _seen_tokens(spark, folder).where((F.col("slice_idx") + F.col("tok_y") + F.col("tok_x")) % 2 == 0)
    found = streaming.stream(_value_slices(spark, folder), model, weights, {"patch": None, "tokens": onto}, plan)
    return found.select("vid", "slice_idx", "tap", "tok_y", "tok_x", F.transform("feat", r6).alias("feat"))


_CONV = VOX + """, o AS (SELECT a.x AS a, b.x AS b, c.x AS c FROM (SELECT unnest([0, 1, 2]) AS x) a, (SELECT unnest([0, 1, 2]) AS x) b, (SELECT unnest([0, 1, 2]) AS x) c), ch AS (SELECT unnest([0, 1]) AS k),
ne AS (SELECT v.vid, v.d, v.h, v.w, n.d AS nd, n.h AS nh, n.w AS nw, a, b, c, n.value FROM vox v CROSS JOIN o JOIN vox n ON n.vid = v.vid AND n.d = v.d + a - 1 AND n.h = v.h + b - 1 AND n.w = v.w + c - 1),
l0 AS (SELECT vid, d, h, w, k, greatest(0, 0.5::DOUBLE * k + sum(value * cos(k + a + 2 * b + 3 * c))) AS t FROM ne, ch GROUP BY vid, d, h, w, k)"""


@C.add(_CONV + " SELECT ne.vid, ne.d, ne.h, ne.w, [round(0.1 + sum(t * sin(1 + k + a + b + c)), 5) + 0.0] AS feat FROM ne JOIN l0 ON l0.vid = ne.vid AND l0.d = ne.nd AND l0.h = ne.nh AND l0.w = ne.nw GROUP BY ne.vid, ne.d, ne.h, ne.w")
def E11_volume_convolution(spark, folder):
    k, a, b, c = np.meshgrid(np.arange(2), np.arange(3), np.arange(3), np.arange(3), indexing="ij")
    weights = {
        "layers.0.weight": np.cos(k + a + 2 * b + 3 * c)[..., None], "layers.0.bias": 0.5 * np.arange(2),
        "layers.1.weight": np.moveaxis(np.sin(1 + k + a + b + c), 0, -1)[None], "layers.1.bias": np.array([0.1]),
    }
    found = models.convolved(models.VolumeConvolution(2), weights, vox(spark, folder), depth=2)
    return found.withColumn("feat", F.transform("feat", lambda x: F.round(x, 5) + 0.0))
