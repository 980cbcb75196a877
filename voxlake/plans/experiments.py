"""Parameter sweeps, folds, model choice, leakage checks and the choice of the best combination."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The default search space. Fixed values.
SEARCH_SPACE = {
    "lambda_weight": [0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6],
    "grid_sp": [2, 3, 4, 5],
    "disp_hw": [2, 3, 4, 5, 6, 7],
    "grid_sp_adam": [1, 2, 3, 4],
    "iters_adam": [60, 80, 100, 120],
    "iters_smooth": [0, 1, 2, 3],
    "gauss_sigma": [0.7, 1.0, 1.3, 1.6, 1.9, 2.2, 2.5, 2.8],
}
#: Parameters that a registration tries within one run; they aren't part of the outer product.
WITHIN_RUN = ("iters_adam", "iters_smooth")


def combinations(base: SparkSession | DataFrame, space: Mapping[str, Sequence], within: Sequence[str] = WITHIN_RUN) -> DataFrame:
    """One row for each combination of the outer parameters, and each row of base, if that is a table of experiments. Lists are literals of a
    few values; the product is their size's. A base is dealt to tasks first: a small file would be one task, and so would its product."""
    rows = base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if isinstance(base, DataFrame) else base.range(1).select()
    for name, values in space.items():
        if name not in within:
            rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return rows


def matches(pattern: str, candidate: str, names: Sequence[str]) -> Column:
    """A pattern fits where all its parameters that aren't null are equal."""
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"{pattern}.{n}").isNull() | (F.col(f"{pattern}.{n}") == F.col(f"{candidate}.{n}")))
    return out


def without(candidates: DataFrame, avoid: DataFrame) -> DataFrame:
    """Candidates that no pattern of the avoid list fits (a list of failed runs, a few hundred rows at most)."""
    names = [n for n in avoid.columns if n in candidates.columns]
    return candidates.alias("c").join(F.broadcast(avoid.alias("a")), matches("a", "c", names), "left_anti")


def sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of all columns: the sampling operator, repeatable in any engine."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in rows.columns]))
    return rows.withColumn("_draw", draw).orderBy("_draw").limit(n).drop("_draw")


def distribution(rows: DataFrame, space: Mapping[str, Sequence]) -> DataFrame:
    """parameter, value, n: how often each value of the space was drawn, 0 included."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c in space]
    wanted = spark.createDataFrame([(n, float(v)) for n in names for v in space[n]], "parameter string, value double")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    counts = long.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, ["parameter", "value"], "left").select("parameter", "value", F.coalesce("n", F.lit(0)).alias("n"))


def best_combination(rows: DataFrame) -> DataFrame:
    """fold, feat, reg, best_hps, best_disp, mean_dice: the largest mean Dice of each fold; ties go to the first tag in the
    order of strings. Means are compared to 12 digits."""
    tag = F.concat(F.lit("hps"), F.col("hps").cast("string"), F.lit("_"), F.col("displacement"))
    means = rows.withColumn("tag", tag).groupBy("fold", "feat", "reg", "hps", "displacement", "tag").agg(F.round(F.avg("dice"), 12).alias("mean_dice"))
    order = Window.partitionBy("fold", "feat", "reg").orderBy(F.col("mean_dice").desc(), "tag")
    first = means.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("fold", "feat", "reg", F.col("hps").alias("best_hps"), F.col("displacement").alias("best_disp"), "mean_dice")


def leakage(samples: DataFrame, fitted: DataFrame) -> DataFrame:
    """Entities that are in both; none in a sound experiment."""
    return samples.select("vid").join(fitted.select("vid"), "vid", "left_semi").distinct()


def shared(*tables: DataFrame, key: str = "vid") -> DataFrame:
    """The keys that all tables hold, once each; null keys are no keys."""
    rows = None
    for n, table in enumerate(tables):
        part = table.where(F.col(key).isNotNull()).select(key, F.lit(n).alias("_n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.count_distinct("_n").alias("_n")).where(F.col("_n") == len(tables)).select(key)


def assert_no_leakage(samples: DataFrame, fitted: DataFrame, context: str = "") -> None:
    found = [r["vid"] for r in leakage(samples, fitted).orderBy("vid").limit(10).collect()]
    if found:
        raise ValueError(f"entities of the fit are tested{f' in {context}' if context else ''}: {found}")


def _role(per_fold: int) -> Column:
    return F.when(F.col("fold") == F.floor(F.col("pos") / per_fold), "test").otherwise("search")


def folds(order: DataFrame, per_fold: int, keys: Sequence[str] = ()) -> DataFrame:
    """[keys,] fold, sample, role: of order([keys,] pos, sample), each fold tests its own run of per_fold samples and searches with the
    rest. With keys, every key has an order of its own."""
    last = order.groupBy(*keys).agg(F.max("pos").alias("_last"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / per_fold).cast("int"))).alias("fold"))
    rows = order.select(*keys, "pos", "sample")
    return (rows.join(every, [*keys]) if keys else rows.join(every)).select(*keys, "fold", "sample", _role(per_fold).alias("role"))


def _lists(rows: DataFrame, per_fold: int) -> DataFrame:
    values = F.from_json("text", "array<int>")
    wrong = F.raise_error(F.concat(F.col("name"), F.lit(f" has a number of entries that {per_fold} doesn't divide")))
    return rows.select("name", F.when(F.size(values) % per_fold == 0, values).otherwise(wrong).alias("_v"))


def permutations(rows: DataFrame, per_fold: int = 2) -> DataFrame:
    """name, pos, sample, fold of rows(name, text), lists as JSON; a list that per_fold doesn't divide is an error."""
    whole = _lists(rows, per_fold)
    return whole.select("name", F.posexplode("_v").alias("pos", "sample")).withColumn("fold", F.floor(F.col("pos") / per_fold).cast("int"))


def list_folds(rows: DataFrame, per_fold: int = 2) -> DataFrame:
    """name, fold, sample, role of rows(name, text): the `folds` of each list, made row by row, so that nothing is shuffled or sorted."""
    whole = _lists(rows, per_fold).select("name", F.size("_v").alias("_n"), F.posexplode("_v").alias("pos", "sample"))
    every = whole.select("name", "pos", "sample", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / per_fold).cast("int"))).alias("fold"))
    return every.select("name", "fold", "sample", _role(per_fold).alias("role"))


def permutation(spark: SparkSession, text: str, name: str, per_fold: int = 2) -> DataFrame:
    """pos, sample, fold of a named list in a JSON text."""
    every = json.loads(text)
    if name not in every:
        raise ValueError(f"no permutation {name!r}; there are {sorted(every)}")
    values = every[name]
    if len(values) % per_fold:
        raise ValueError(f"{name!r} has {len(values)} entries, which {per_fold} doesn't divide")
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(int(v)) for v in values])).alias("pos", "sample"))
    return rows.withColumn("fold", F.floor(F.col("pos") / per_fold).cast("int"))


def held_out_models(models: DataFrame, batch: DataFrame) -> DataFrame:
    """Models none of whose fitted entities is in the batch, compared by (modality, real_id)."""
    used = models.join(batch.select("modality", "real_id"), ["modality", "real_id"], "left_semi").select("model").distinct()
    return models.select("model").distinct().join(used, "model", "left_anti")


def covering_models(models: DataFrame, batch: DataFrame) -> DataFrame:
    """Models whose fitted entities hold the whole batch: relational division by counting matches."""
    wanted = batch.select("modality", "real_id").distinct()
    hits = models.select("model", "modality", "real_id").distinct().join(wanted, ["modality", "real_id"]).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(wanted.agg(F.count(F.lit(1)).alias("n")), "n", "left_semi").select("model")


def parsed(text: str) -> dict:
    """A configuration in JSON, or in YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise ValueError("the text is no JSON, and no YAML reader is installed") from error
        return yaml.safe_load(text)


def expanded(spark: SparkSession, config: Mapping) -> list[dict]:
    """Experiments of a configuration: shallow defaults in `__otherwise__`, names with double underscores skipped, `__none__`
    for null at any depth."""

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return None if value == "__none__" else value

    base = clean(dict(config.get("__otherwise__") or {}))
    return [{"name": k, **base, **(clean(v) or {})} for k, v in config.items() if not (k.startswith("__") and k.endswith("__"))]


def expanded_rows(rows: DataFrame) -> DataFrame:
    """config, name and settings of every experiment of rows(config, name, text): text is JSON of one level; the row `__otherwise__` of a
    configuration holds the defaults of its others, names with double underscores are no experiments, `__none__` is null."""
    parsed_ = rows.select("config", "name", F.coalesce(F.from_json("text", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("own"))
    base = parsed_.where("name = '__otherwise__'").select("config", F.col("own").alias("base"))
    found = parsed_.where("NOT (startswith(name, '__') AND endswith(name, '__'))").join(base, "config", "left")
    kept = F.map_filter(F.coalesce("base", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key("own", k))
    clean = F.transform_values(F.map_concat(kept, "own"), lambda _, v: F.when(v != "__none__", v))
    return found.select("config", "name", clean.alias("settings"))


def tasks(folds_: DataFrame, combos: DataFrame, methods: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The work list: folds x combinations x methods x features, each with a key."""
    few = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rows = folds_.join(F.broadcast(combos)).select("*", few("reg", methods)).select("*", few("feat", features))
    return rows.withColumn("task", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), [*keys], "left_anti")


def roles(entities: DataFrame, fixed: str, moving: str) -> DataFrame:
    """sample, fix_vid, mov_vid; a sample without exactly one of each is an error."""
    one = lambda m, n: F.min(F.when(F.upper("modality") == m.upper(), F.col("vid"))).alias(n)
    many = lambda m, n: F.count(F.when(F.upper("modality") == m.upper(), 1)).alias(n)
    rows = entities.groupBy("sample").agg(one(fixed, "fix_vid"), one(moving, "mov_vid"), many(fixed, "_f"), many(moving, "_m"))
    wrong = F.raise_error(F.concat(F.lit("a sample needs one entity of each modality: "), F.col("sample").cast("string")))
    return rows.select("sample", F.when((F.col("_f") == 1) & (F.col("_m") == 1), F.col("fix_vid")).otherwise(wrong).alias("fix_vid"), "mov_vid")


def stable_key(value: Column) -> Column:
    return F.sha2(value, 256)
