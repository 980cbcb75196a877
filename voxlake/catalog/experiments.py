"""Sweeps, folds, the best combination, model choice, resumption and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.catalog.base import HPS, TOK, Catalog, entities, hps, r6
from voxlake.functions import grammar, names
from voxlake.operators import knn
from voxlake.plans import experiments as X
from voxlake.scratch import shared_dir
from voxlake.sources import reports
from voxlake.sources.views import table

C = Catalog()


def _values(name: str) -> str:
    return f"(SELECT unnest([{', '.join(map(str, X.SEARCH_SPACE[name]))}]) AS {name})"


_OUTER = [n for n in X.SEARCH_SPACE if n not in X.WITHIN_RUN]
_CAST = {n: "INTEGER" if isinstance(X.SEARCH_SPACE[n][0], int) else "DOUBLE" for n in _OUTER}
_COMBOS = "cb AS (SELECT " + ", ".join(f"CAST({n} AS {_CAST[n]}) AS {n}" for n in _OUTER) + " FROM " + ", ".join(_values(n) for n in _OUTER) + ")"
#: Failed runs are every 29th part; a null takes every value.
_AV = "av AS (SELECT DISTINCT 2 + p_size % 4 AS grid_sp, CASE WHEN p_partkey % 3 > 0 THEN 1 + p_size % 3 END AS grid_sp_adam, 2 + p_partkey % 6 AS disp_hw FROM part WHERE p_partkey % 29 = 0)"
_VALID = _COMBOS + ", " + _AV + """, ok AS (SELECT * FROM cb WHERE NOT EXISTS (SELECT 1 FROM av WHERE (av.grid_sp IS NULL OR av.grid_sp = cb.grid_sp) AND (av.grid_sp_adam IS NULL OR av.grid_sp_adam = cb.grid_sp_adam) AND (av.disp_hw IS NULL OR av.disp_hw = cb.disp_hw)))"""


def _valid(spark, folder):
    failed = table(spark, folder, "part").where("p_partkey % 29 = 0")
    avoid = failed.select((2 + F.col("p_size") % 4).alias("grid_sp"), F.when(F.col("p_partkey") % 3 > 0, 1 + F.col("p_size") % 3).alias("grid_sp_adam"), (2 + F.col("p_partkey") % 6).alias("disp_hw")).distinct()
    return X.without(X.combinations(spark, X.SEARCH_SPACE), avoid)


@C.add(_COMBOS + " SELECT s_suppkey, cb.* FROM supplier, cb")
def X4_parameter_product(spark, folder):
    return X.combinations(table(spark, folder, "supplier").select("s_suppkey"), X.SEARCH_SPACE)


@C.add(_VALID + " SELECT * FROM ok")
def J18_F18_avoid_list(spark, folder):
    return _valid(spark, folder)


_DRAW = "md5(concat_ws('|', '42', " + ", ".join(f"CAST({n} AS VARCHAR)" for n in _OUTER) + "))"


@C.add(_VALID + f" SELECT * FROM ok ORDER BY {_DRAW} LIMIT 400")
def T7_sampled_sweep(spark, folder):
    return X.sample(_valid(spark, folder), 400)


@C.add(
    _VALID
    + f", sp AS (SELECT * FROM ok ORDER BY {_DRAW} LIMIT 400), lg AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS parameter, CAST({n} AS DOUBLE) AS value FROM sp" for n in _OUTER)
    + "), wanted AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS parameter, CAST({n} AS DOUBLE) AS value FROM {_values(n)}" for n in _OUTER)
    + ") SELECT w.parameter, w.value, count(l.value) AS n FROM wanted w LEFT JOIN lg l ON l.parameter = w.parameter AND l.value = w.value GROUP BY w.parameter, w.value"
)
def A33_sweep_distribution(spark, folder):
    return X.distribution(X.sample(_valid(spark, folder), 400), X.SEARCH_SPACE)


@C.add(
    HPS
    + """, m AS (SELECT fold, feat, reg, hps, displacement, round(avg(dice), 12) AS mean_dice FROM hps GROUP BY ALL)
SELECT fold, feat, reg, hps AS best_hps, displacement AS best_disp, round(mean_dice, 6) + 0.0 AS mean_dice FROM (SELECT *, row_number() OVER (PARTITION BY fold, feat, reg ORDER BY mean_dice DESC, concat('hps', hps, '_', displacement)) AS n FROM m) WHERE n = 1"""
)
def A32_best_combination(spark, folder):
    return X.best_combination(hps(spark, folder)).withColumn("mean_dice", r6("mean_dice"))


@C.add(
    HPS
    + """ SELECT feat, reg, round(avg(dice), 6) + 0.0 AS mean, round(stddev_samp(dice), 6) + 0.0 AS std, round(median(dice), 6) + 0.0 AS median, round(min(dice), 6) + 0.0 AS min, round(max(dice), 6) + 0.0 AS max FROM hps GROUP BY feat, reg"""
)
def A4_search_summary(spark, folder):
    out = knn.summary(hps(spark, folder), ["feat", "reg"], "dice")
    return out.select("feat", "reg", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")])


@C.add("SELECT DISTINCT c_name AS vid FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 = 0")
def F16_leakage_check(spark, folder):
    c = table(spark, folder, "customer").withColumn("vid", F.col("c_name"))
    return X.leakage(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 5 = 0"))


#: Every customer's list of eight samples, as JSON.
_PERMS = "pm AS (SELECT c_name AS name, unnest(range(0, 8)) AS p, unnest([c_custkey % 7, c_nationkey, 5, 2, c_custkey, 0, c_custkey % 3, 1]) AS s FROM customer)"


def _sample_lists(spark, folder):
    k = F.col("c_custkey")
    values = F.array(*[x.cast("int") for x in (k % 7, F.col("c_nationkey"), F.lit(5), F.lit(2), k, F.lit(0), k % 3, F.lit(1))])
    return table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.to_json(values).alias("text"))


@C.add(_PERMS + " SELECT name, CAST(f AS INTEGER) AS fold, CAST(s AS INTEGER) AS sample, CASE WHEN p // 2 = f THEN 'test' ELSE 'search' END AS role FROM pm, (SELECT unnest(range(0, 4)) AS f)")
def F17_X3_fold_split(spark, folder):
    return X.list_folds(_sample_lists(spark, folder), 2)


@C.add(_PERMS + " SELECT name, CAST(p AS INTEGER) AS pos, CAST(s AS INTEGER) AS sample, CAST(p // 2 AS INTEGER) AS fold FROM pm")
def S18_fold_permutation(spark, folder):
    return X.permutations(_sample_lists(spark, folder))


#: Models are fitted on ten customers each; the batch is all customers in debt.
_MODELS = "md AS (SELECT concat('fold', c_custkey // 10) AS model, c_mktsegment AS modality, CAST(c_custkey AS VARCHAR) AS real_id, c_acctbal FROM customer), bt AS (SELECT modality, real_id FROM md WHERE c_acctbal < 0)"
#: Models are fitted on the suppliers (by fives) and lines of their flags; the batch is all of those that were returned.
_COVER = "md AS (SELECT DISTINCT concat(l_returnflag, l_linestatus) AS model, CAST(l_suppkey % 5 AS VARCHAR) AS modality, CAST(l_linenumber AS VARCHAR) AS real_id FROM lineitem), bt AS (SELECT DISTINCT modality, real_id FROM md WHERE model[1] = 'R')"


def _models(spark, folder):
    k = F.col("c_custkey")
    c = table(spark, folder, "customer").select(F.concat(F.lit("fold"), F.floor(k / 10).cast("string")).alias("model"), F.col("c_mktsegment").alias("modality"), k.cast("string").alias("real_id"), "c_acctbal")
    return c, c.where("c_acctbal < 0")


@C.add(_MODELS + " SELECT DISTINCT model FROM md WHERE model NOT IN (SELECT model FROM md JOIN bt USING (modality, real_id))")
def S20_held_out_models(spark, folder):
    return X.held_out_models(*_models(spark, folder))


@C.add(_COVER + " SELECT model FROM md JOIN bt USING (modality, real_id) GROUP BY model HAVING count(*) = (SELECT count(*) FROM bt)")
def S20_covering_models(spark, folder):
    items = table(spark, folder, "lineitem")
    rows = items.select(F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_suppkey") % 5).cast("string").alias("modality"), F.col("l_linenumber").cast("string").alias("real_id"))
    return X.covering_models(rows, rows.where("model LIKE 'R%'"))


#: A configuration for each segment, an experiment for each of its customers; the segment's largest key is its rate by default.
_CONFIG = """ex AS (SELECT c_mktsegment AS config, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN concat('{"lr": ', c_nationkey, '}') WHEN 1 THEN '{"lr": "__none__", "epochs": 7}' WHEN 2 THEN '{}' ELSE '{"epochs": 9}' END AS text, c_custkey AS k, c_nationkey AS n,
  max(c_custkey) OVER (PARTITION BY c_mktsegment) AS m FROM customer)"""


@C.add(_CONFIG + " SELECT config, name, CASE k % 4 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN NULL ELSE CAST(m AS VARCHAR) END AS lr, CASE k % 4 WHEN 1 THEN '7' WHEN 3 THEN '9' ELSE '3' END AS epochs FROM ex")
def S16_S17_expanded_experiments(spark, folder):
    k, c = F.col("c_custkey"), table(spark, folder, "customer")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"lr": '), F.col("c_nationkey").cast("string"), F.lit("}"))).when(k % 4 == 1, '{"lr": "__none__", "epochs": 7}').when(k % 4 == 2, "{}").otherwise('{"epochs": 9}')
    own = c.select(F.col("c_mktsegment").alias("config"), F.col("c_name").alias("name"), text.alias("text"))
    base = c.groupBy(F.col("c_mktsegment").alias("config")).agg(F.concat(F.lit('{"epochs": 3, "lr": '), F.max(k).cast("string"), F.lit("}")).alias("text"))
    out = base.select("config", F.lit("__output_dir__").alias("name"), F.lit("{}").alias("text"))
    rows = own.unionByName(base.select("config", F.lit("__otherwise__").alias("name"), "text")).unionByName(out)
    found = X.expanded_rows(rows)
    return found.select("config", "name", F.col("settings.lr").alias("lr"), F.col("settings.epochs").alias("epochs"))


@C.add(
    "fl AS (SELECT DISTINCT c_custkey % 4 AS fold FROM customer), "
    + _VALID
    + " SELECT reg, feat, count(*) AS n FROM fl, ok, (SELECT unnest(['ca', 'gica']) AS reg), (SELECT unnest(['cat', 'sum', 'axi']) AS feat) GROUP BY reg, feat"
)
def X5_task_space(spark, folder):
    tasks = X.tasks(table(spark, folder, "customer").select((F.col("c_custkey") % 4).cast("int").alias("fold")).distinct(), _valid(spark, folder), ("ca", "gica"), ("cat", "sum", "axi"))
    return tasks.groupBy("reg", "feat").agg(F.count_distinct("task").alias("n"))


@C.add("SELECT o_orderkey AS quad, o_orderpriority AS feat FROM orders WHERE o_orderstatus <> 'F'")
def K4_remaining_tasks(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("quad"), F.col("o_orderpriority").alias("feat"), "o_orderstatus")
    return X.remaining(o.select("quad", "feat"), o.where("o_orderstatus = 'F'"), ["quad", "feat"])


@C.add(
    """SELECT coalesce(a.c_name, b.c_name) AS key, a.c_mktsegment AS saved, b.v AS current FROM (SELECT * FROM customer WHERE c_custkey % 11 <> 0) a
FULL JOIN (SELECT c_name, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0) b ON a.c_name = b.c_name WHERE a.c_mktsegment IS DISTINCT FROM b.v"""
)
def K6_config_diff(spark, folder):
    c = table(spark, folder, "customer")
    now = F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    saved = c.where("c_custkey % 11 <> 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return reports.config_diff(saved, c.where("c_custkey % 7 <> 0").select(F.col("c_name").alias("key"), now.alias("value")))


@C.add("SELECT o_orderstatus AS run, count(*) AS stages, round(sum(o_totalprice), 2) + 0.0 AS stages_sum_sec FROM orders GROUP BY 1")
def K12_stage_totals(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("sec"))
    return reports.stage_totals(o).select("run", "stages", (F.round("stages_sum_sec", 2) + 0.0).alias("stages_sum_sec"))


@C.add(HPS + " SELECT fold, count(*) AS n, round(sum(dice), 6) + 0.0 AS total FROM hps GROUP BY fold")
def K2_K11_resumed_run(spark, folder):
    import uuid

    rows = hps(spark, folder)
    run = reports.Run(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", ["fold", "hps"], partition="fold")
    run.guard({"k": 5})
    run.append(rows.where("hps = 1"))
    todo = run.todo(rows.select("fold", "hps").distinct())
    run.append(rows.join(todo, ["fold", "hps"], "left_semi"))
    run.finish()
    return run.rows().groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("dice")).alias("total"))


@C.add(TOK + " SELECT DISTINCT patient AS sample, concat('s', patient, '__mMR__iP', patient) AS fix_vid, concat('s', patient, '__mCT__iP', patient) AS mov_vid FROM tok")
def J19_S7_fix_mov_roles(spark, folder):
    return X.roles(entities(spark, folder).withColumnRenamed("patient", "sample"), "mr", "ct")


@C.add(HPS + ", u AS (SELECT feat, dice, NULL AS extra FROM hps WHERE feat <> 'R' UNION ALL SELECT feat, dice, 1 FROM hps WHERE feat = 'R') SELECT feat, count(*) AS n, count(extra) AS n_extra FROM u GROUP BY feat")
def X1_union_of_reports(spark, folder):
    h = hps(spark, folder)
    both = reports.union(h.where("feat <> 'R'"), h.where("feat = 'R'").withColumn("extra", F.lit(1)))
    return both.groupBy("feat").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


@C.add("SELECT DISTINCT a.l_suppkey AS vid FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def X2_intersected_names(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vid"), "l_returnflag")
    return X.shared(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))


#: Modes of orders as they might be written.
_MODES = ("all", " Elastic + feat", "none", "reg", "affine", "feat+feat", "reg+feat", "elastic")


@C.add(
    "SELECT o_orderkey, ['feat+affine+elastic', 'feat+elastic', 'none', 'affine+elastic', 'affine', 'feat', 'feat+affine+elastic', 'elastic'][1 + o_orderkey % 8] AS mode, ['both', 'elastic', 'none', 'both', 'affine', 'none', 'both', 'elastic'][1 + o_orderkey % 8] AS stages FROM orders"
)
def F13_F14_mask_modes(spark, folder):
    text = F.element_at(F.array(*map(F.lit, _MODES)), (1 + F.col("o_orderkey") % 8).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", grammar.mask_modes(text).alias("mode"))
    return rows.withColumn("stages", grammar.registration_stages(F.col("mode")))


@C.add("SELECT o_orderkey AS id, concat_ws('_', o_orderstatus, o_orderpriority, o_orderkey % 3) AS prefix FROM orders")
def P42_weight_names(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(k.alias("id"), names.joined(F.col("o_orderstatus"), F.col("o_orderpriority"), k % 3).alias("prefix"))
