"""Similarity joins, label transfer and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.catalog.base import ENT, PAIRS, TOK, Catalog, entities, r6, tok
from voxlake.operators import knn, landmarks, pairs, similarity

C = Catalog()
KS = (1, 3, 5)

_NL = PAIRS + """, cnt AS (SELECT vid, count(DISTINCT seg) AS n FROM tok GROUP BY vid),
nl AS (SELECT pair_id, CAST(greatest(a.n, b.n) AS INTEGER) AS n_labels FROM pairs JOIN cnt a ON a.vid = query_vid JOIN cnt b ON b.vid = key_vid)"""
_COS = "list_dot_product(q.feat, k.feat) / ((sqrt(list_dot_product(q.feat, q.feat)) + 1e-8) * (sqrt(list_dot_product(k.feat, k.feat)) + 1e-8))"
_NN = _NL + f""", sim AS (
  SELECT p.pair_id, q.vox AS query_id, k.vox AS key_id, k.seg AS label, round({_COS}, 9) AS score
  FROM pairs p JOIN tok q ON q.vid = p.query_vid AND q.msk JOIN nl USING (pair_id)
  JOIN tok k ON k.vid = p.key_vid AND k.msk AND k.seg BETWEEN 0 AND nl.n_labels - 1),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, query_id ORDER BY score DESC, key_id) AS rank FROM sim) WHERE rank <= 5)"""
_VOTE = _NN + """, ks AS (SELECT unnest([1, 3, 5]) AS k),
votes AS (SELECT pair_id, query_id, k, label, count(*) AS n, min(rank) AS first FROM nn, ks WHERE rank <= k GROUP BY ALL),
pred AS (SELECT pair_id, query_id, k, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, query_id, k ORDER BY n DESC, first) AS o FROM votes) WHERE o = 1),
truth AS (SELECT pair_id, vox AS query_id, seg FROM pairs JOIN tok ON vid = query_vid AND msk)"""
_DICE = _VOTE + """, lab AS (SELECT pair_id, k, unnest(generate_series(0, n_labels - 1)) AS label FROM nl, ks),
both_ AS (SELECT pair_id, k, pred, seg FROM pred JOIN truth USING (pair_id, query_id)),
dice AS (
  SELECT l.pair_id, l.k, CAST(l.label AS INTEGER) AS label,
         2.0 * count(*) FILTER (pred = l.label AND seg = l.label) / (count(*) FILTER (pred = l.label) + count(*) FILTER (seg = l.label) + 1e-8) AS dice
  FROM lab l LEFT JOIN both_ b ON b.pair_id = l.pair_id AND b.k = l.k GROUP BY l.pair_id, l.k, l.label),
rep AS (SELECT pair_id, k, coalesce(avg(dice) FILTER (label >= 1), max(dice) FILTER (label = 0)) AS dice_mean_fg FROM dice GROUP BY pair_id, k)"""


def _quads(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.quads(entities(spark, folder))


def _near(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    p, t = _quads(spark, folder), tok(spark, folder)
    return knn.neighbours(p, t, k, n_labels=knn.label_counts(p, t))


@C.add(PAIRS + " SELECT pair_id, query_vid, key_vid, seg_type FROM pairs")
def J5_quad_pairs(spark, folder):
    return _quads(spark, folder).select("pair_id", "query_vid", "key_vid", "seg_type")


@C.add(ENT + " SELECT concat(q.vid, '|', k.vid) AS pair_id, concat(q.modality, '->', k.modality) AS seg_type FROM ent q JOIN ent k USING (patient)")
def J6_double_pairs(spark, folder):
    return pairs.doubles(entities(spark, folder)).select("pair_id", "seg_type")


@C.add(_NN + " SELECT pair_id, query_id, key_id, score, CAST(rank AS INTEGER) AS rank FROM nn")
def J1_similarity_topk(spark, folder):
    return _near(spark, folder).select("pair_id", "query_id", "key_id", "score", "rank")


@C.add(
    TOK
    + """, sim AS (SELECT q.vox AS query_id, k.vox AS key_id,
  round(-(list_dot_product(q.feat, q.feat) + list_dot_product(k.feat, k.feat) - 2 * list_dot_product(q.feat, k.feat)), 9) AS score
  FROM tok q, tok k)
SELECT query_id, key_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM sim) WHERE rank <= 3"""
)
def T1_l2_topk_blocks(spark, folder):
    t = tok(spark, folder).withColumn("pair_id", F.lit("all"))
    q = t.select("pair_id", F.col("vox").alias("query_id"), "feat")
    found = similarity.top_k(q, t.select("pair_id", F.col("vox").alias("key_id"), "feat"), 3, "neg_sq_l2", query_block=32, key_block=128)
    return found.select("query_id", "key_id", r6("score").alias("score"), "rank")


@C.add(_NN + " SELECT pair_id, query_id, CAST(rank AS INTEGER) AS rank, label FROM nn")
def J20_neighbour_labels(spark, folder):
    return _near(spark, folder).select("pair_id", "query_id", "rank", "label")


@C.add(_NN + " SELECT pair_id, query_id, CAST(rank AS INTEGER) AS rank, label, count(*) OVER (PARTITION BY pair_id, query_id, label ORDER BY rank) AS votes FROM nn")
def W2_running_votes(spark, folder):
    return knn.running_votes(_near(spark, folder))


@C.add(_VOTE + " SELECT pair_id, query_id, k, pred FROM pred")
def A1_knn_vote(spark, folder):
    return knn.vote(_near(spark, folder), KS)


@C.add(_NL + " SELECT pair_id, n_labels FROM nl")
def A3_label_counts(spark, folder):
    return knn.label_counts(_quads(spark, folder), tok(spark, folder))


@C.add(_DICE + " SELECT pair_id, k, label, round(dice, 6) + 0.0 AS dice FROM dice")
def A2_knn_dice(spark, folder):
    return knn.evaluate(_quads(spark, folder), tok(spark, folder), KS).select("pair_id", "k", "label", r6("dice").alias("dice"))


@C.add(
    _DICE
    + """ SELECT seg_type, k, round(avg(dice_mean_fg), 6) + 0.0 AS mean, round(stddev_samp(dice_mean_fg), 6) + 0.0 AS std, round(median(dice_mean_fg), 6) + 0.0 AS median,
  round(min(dice_mean_fg), 6) + 0.0 AS min, round(max(dice_mean_fg), 6) + 0.0 AS max FROM rep JOIN pairs USING (pair_id) GROUP BY seg_type, k"""
)
def A4_knn_summary(spark, folder):
    p = _quads(spark, folder)
    rows = knn.report(knn.evaluate(p, tok(spark, folder), KS)).join(p.select("pair_id", "seg_type"), "pair_id")
    out = knn.summary(rows, ["seg_type", "k"], "dice_mean_fg")
    return out.select("seg_type", "k", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")])


@C.add(_DICE + " SELECT pair_id, k, round(max(dice_mean_fg), 6) + 0.0 AS dice_mean_fg, " + ", ".join(f"round(max(dice) FILTER (label = {x}), 6) + 0.0 AS dice_{x}" for x in range(4)) + " FROM rep JOIN dice USING (pair_id, k) GROUP BY pair_id, k")
def A3_knn_report(spark, folder):
    p = _quads(spark, folder)
    rows = knn.wide(knn.evaluate(p, tok(spark, folder), KS), range(4))
    return rows.select("pair_id", "k", *[r6(c).alias(c) for c in ("dice_mean_fg", "dice_0", "dice_1", "dice_2", "dice_3")])


@C.add(
    _VOTE
    + """ SELECT p.pair_id, CAST(5 AS INTEGER) AS k, t.d, t.h, t.w, CAST(coalesce(pred.pred, 0) AS SMALLINT) AS label
FROM pairs p JOIN tok t ON t.vid = p.query_vid LEFT JOIN pred ON pred.pair_id = p.pair_id AND pred.query_id = t.vox AND pred.k = 5"""
)
def P38_prediction_volumes(spark, folder):
    p, t = _quads(spark, folder), tok(spark, folder)
    return knn.to_volume(knn.vote(_near(spark, folder), (5,)), t, p, ks=(5,))


@C.add(TOK + " SELECT vid, vox FROM tok WHERE msk")
def F1_mask_filter(spark, folder):
    return knn.masked(tok(spark, folder)).select("vid", "vox")


@C.add(_NL + " SELECT pair_id, count(*) AS n FROM pairs JOIN nl USING (pair_id) JOIN tok ON vid = key_vid AND msk AND seg BETWEEN 0 AND n_labels - 1 GROUP BY pair_id")
def F2_key_label_filter(spark, folder):
    p, t = _quads(spark, folder), tok(spark, folder)
    keys = p.select("pair_id", F.col("key_vid").alias("vid")).join(knn.masked(t), "vid").join(knn.label_counts(p, t), "pair_id")
    return keys.where("seg BETWEEN 0 AND n_labels - 1").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))


@C.add(ENT + " SELECT 0 AS group_id, count(DISTINCT vid) AS n_vids, count(DISTINCT patient) AS n_patients, count(DISTINCT modality) AS n_modalities FROM ent WHERE vid <> 's0__mMR__iP0'")
def F19_quad_faults(spark, folder):
    return pairs.quad_faults(entities(spark, folder).where("vid <> 's0__mMR__iP0'"))


@C.add(ENT + " SELECT CAST(patient AS VARCHAR) AS pair_id, min(vid) FILTER (modality = 'MR') AS fix_vid, min(vid) FILTER (modality = 'CT') AS mov_vid FROM ent GROUP BY patient HAVING count(*) FILTER (modality = 'MR') = 1 AND count(*) FILTER (modality = 'CT') = 1")
def J7_fixed_moving_pairs(spark, folder):
    return pairs.fixed_moving(entities(spark, folder), "mr", "ct")


_LM = PAIRS + """, lm AS (SELECT vid, concat('label_', seg) AS p, CAST(round_even(avg(d), 0) AS INTEGER) AS x, CAST(round_even(avg(h), 0) AS INTEGER) AS y,
  CAST(round_even(avg(w), 0) AS INTEGER) AS z FROM tok WHERE seg <> 0 GROUP BY vid, seg)"""
_MATCH = _LM + """, sh AS (
  SELECT p.*, a.p AS landmark, a.x AS qx, a.y AS qy, a.z AS qz, b.x AS kx, b.y AS ky, b.z AS kz FROM pairs p JOIN lm a ON a.vid = p.query_vid JOIN lm b ON b.vid = p.key_vid AND a.p = b.p),
cand AS (
  SELECT s.pair_id, s.seg_type, s.landmark, s.query_vid = s.key_vid AS self, q.vox AS qvox, k.vox AS kvox, kx, ky, kz, k.d, k.h, k.w, """ + f"""round({_COS}, 9) AS cos,
         round(-(list_dot_product(q.feat, q.feat) + list_dot_product(k.feat, k.feat) - 2 * list_dot_product(q.feat, k.feat)), 9) AS l2
  FROM sh s JOIN tok q ON q.vid = s.query_vid AND q.d = qx AND q.h = qy AND q.w = qz JOIN tok k ON k.vid = s.key_vid),
both_ AS (SELECT *, 'cos' AS metric, cos AS score FROM cand UNION ALL SELECT *, 'l2' AS metric, l2 AS score FROM cand),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, landmark, metric ORDER BY score DESC, kvox) AS r0 FROM both_) WHERE r0 <= 4),
raw AS (
  SELECT pair_id, seg_type, landmark, metric, rank, sqrt((d - kx) * (d - kx) + (h - ky) * (h - ky) + (w - kz) * (w - kz)) AS distance_vox
  FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, landmark, metric ORDER BY r0) AS rank FROM top WHERE NOT (self AND qvox = kvox)) WHERE rank <= 3),
pp AS (SELECT pair_id, seg_type, landmark, metric, k, avg(distance_vox) AS mean_topk, stddev_pop(distance_vox) AS std_topk
  FROM raw, (SELECT unnest([1, 3]) AS k) WHERE rank <= k GROUP BY ALL HAVING count(*) = k)"""


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    t = tok(spark, folder)
    return landmarks.match(_quads(spark, folder), t, landmarks.centroids(t), 3)


@C.add(_LM + " SELECT vid, p, x, y, z FROM lm")
def A8_label_centroids(spark, folder):
    return landmarks.centroids(tok(spark, folder))


@C.add(_LM + " SELECT pair_id, a.p AS landmark FROM pairs JOIN lm a ON a.vid = query_vid JOIN lm b ON b.vid = key_vid AND a.p = b.p")
def J3_shared_landmarks(spark, folder):
    return landmarks.shared_names(_quads(spark, folder), landmarks.centroids(tok(spark, folder))).select("pair_id", "landmark")


@C.add(_MATCH + " SELECT pair_id, landmark, metric, CAST(rank AS INTEGER) AS rank, round(distance_vox, 6) + 0.0 AS distance_vox FROM raw")
def J2_landmark_match(spark, folder):
    return _raw(spark, folder).withColumn("distance_vox", r6("distance_vox"))


@C.add(_MATCH + " SELECT pair_id, landmark, metric, CAST(rank AS INTEGER) AS rank, round(distance_vox, 6) + 0.0 AS distance_vox FROM raw")
def J4_self_match_excluded(spark, folder):
    t = tok(spark, folder)
    return landmarks.match(_quads(spark, folder), t, landmarks.centroids(t), 3).withColumn("distance_vox", r6("distance_vox"))


@C.add(_MATCH + " SELECT pair_id, landmark, metric, CAST(k AS INTEGER) AS k, round(mean_topk, 6) + 0.0 AS mean_topk, round(std_topk, 6) + 0.0 AS std_topk FROM pp")
def A5_landmark_per_pair(spark, folder):
    rows = landmarks.per_pair(_raw(spark, folder), (1, 3))
    return rows.select("pair_id", "landmark", "metric", "k", r6("mean_topk").alias("mean_topk"), r6("std_topk").alias("std_topk"))


@C.add(_MATCH + " SELECT pair_id, landmark, metric, CAST(k AS INTEGER) AS k, round(mean_topk, 6) + 0.0 AS mean_topk, round(std_topk, 6) + 0.0 AS std_topk FROM pp")
def W3_landmark_running(spark, folder):
    rows = landmarks.running(_raw(spark, folder), (1, 3))
    return rows.select("pair_id", "landmark", "metric", "k", r6("mean_topk").alias("mean_topk"), r6("std_topk").alias("std_topk"))


@C.add(
    _MATCH
    + """ SELECT seg_type, metric, CAST(k AS INTEGER) AS k, round(avg(mean_topk), 6) + 0.0 AS mean, round(stddev_samp(mean_topk), 6) + 0.0 AS std,
  round(median(mean_topk), 6) + 0.0 AS median, round(min(mean_topk), 6) + 0.0 AS min, round(max(mean_topk), 6) + 0.0 AS max, count(*) AS n FROM pp GROUP BY seg_type, metric, k"""
)
def A6_landmark_summary(spark, folder):
    p = _quads(spark, folder)
    rows = landmarks.per_pair(_raw(spark, folder), (1, 3)).join(p.select("pair_id", "seg_type"), "pair_id")
    out = landmarks.summary(rows)
    return out.select("seg_type", "metric", "k", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")], "n")


@C.add(
    _MATCH
    + """ SELECT f.feat_type, seg_type, metric, CAST(k AS INTEGER) AS k, round(avg(mean_topk), 6) + 0.0 AS mean, count(*) AS n
FROM pp, (SELECT unnest(['all', 'half']) AS feat_type) f WHERE f.feat_type = 'all' OR metric = 'cos' GROUP BY f.feat_type, seg_type, metric, k"""
)
def A7_landmark_summary_by_feature(spark, folder):
    p = _quads(spark, folder)
    rows = landmarks.per_pair(_raw(spark, folder), (1, 3)).join(p.select("pair_id", "seg_type"), "pair_id")
    both = rows.withColumn("feat_type", F.lit("all")).unionByName(rows.where("metric = 'cos'").withColumn("feat_type", F.lit("half")))
    out = landmarks.summary(both, ("feat_type", "seg_type", "metric", "k"))
    return out.select("feat_type", "seg_type", "metric", "k", r6("mean").alias("mean"), "n")


@C.add(
    _LM
    + """, moved AS (SELECT vid, p, CAST(x + 3 AS INTEGER) AS x, y, z FROM lm), sz AS (SELECT vid, max(d) + 1 AS nd, max(h) + 1 AS nh, max(w) + 1 AS nw FROM tok GROUP BY vid)
SELECT m.* FROM moved m JOIN sz USING (vid) WHERE NOT (x >= 0 AND x < nd AND y >= 0 AND y < nh AND z >= 0 AND z < nw)"""
)
def F20_landmarks_outside(spark, folder):
    t = tok(spark, folder)
    moved = landmarks.centroids(t).withColumn("x", (F.col("x") + 3).cast("int"))
    return landmarks.outside(moved, t)
