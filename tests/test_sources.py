"""Names, notations, files, pipelines and runs."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxlake.catalog.base import inten
from voxlake.functions import grammar, names
from voxlake.operators import knn, numbering, projection, slices, warp
from voxlake.plans import experiments, extensions, masks, preprocess
from voxlake.sources import datasets, nifti, reports


def test_volume_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    volumes = {}
    for sample in (2, 4):
        for modality in ("MR", "CT"):
            v = rng.normal(size=(3, 4, 5))
            volumes[sample, modality] = v
            for kind, data in (("img", v), ("seg", v > 0), ("mask", v > 1)):
                (tmp_path / f"{kind}{sample:04d}_tcia_{modality}.nii.gz").write_bytes(nifti.encode(data.astype(float), np.diag([2.0, 1.0, 1.0, 1.0])))
    (tmp_path / "notes.txt").write_text("x")
    rows = datasets.dataset(spark, "abdomen", tmp_path.as_uri())
    assert rows.count() == 4 * 60
    for r in rows.where("vid = 's4__mCT__i4'").collect():
        value = volumes[4, "CT"][r["d"], r["h"], r["w"]]
        assert r["value"] == pytest.approx(value, rel=1e-6) and r["seg"] == int(value > 0) and r["msk"] == (value > 1)
    one = datasets.dataset(spark, "abdomen", tmp_path.as_uri(), samples=[2], modality="mr")
    assert {r["vid"] for r in one.select("vid").distinct().collect()} == {"s2__mMR__i2"}
    head = nifti.headers(nifti.files(spark, tmp_path.as_uri())).first()
    assert (head["nd"], head["nh"], head["nw"]) == (3, 4, 5) and head["affine"][0][0] == 2.0
    with pytest.raises(ValueError, match="no collection"):
        datasets.dataset(spark, "other", tmp_path.as_uri())
    written = nifti.write(spark, rows.select(F.col("vid").alias("name"), "d", "h", "w", "value"), f"{tmp_path}/out").collect()
    assert len(written) == 4 and nifti.decode(bytes(written[0]["content"]))[0].shape == (3, 4, 5)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_excluded_files_are_never_opened(spark, tmp_path, monkeypatch, broadcast):
    """A file that a restriction leaves out may be too large for the source, broken, or unreadable."""
    monkeypatch.setattr(datasets, "BROADCAST_FILES", broadcast)
    v = np.arange(24.0).reshape(2, 3, 4)
    for name in ("img0002_tcia_MR", "seg0002_tcia_MR"):
        (tmp_path / f"{name}.nii.gz").write_bytes(nifti.encode(v))
    (tmp_path / "img0002_tcia_CT.nii.gz").write_bytes(b"no volume" * 10_000)
    (tmp_path / "img0004_tcia_MR.nii").write_bytes(b"")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 20_000)
    try:
        rows = datasets.dataset(spark, "abdomen", tmp_path.as_uri(), [2], "MR").collect()
        assert len(rows) == 24 and all(r["value"] == v[r["d"], r["h"], r["w"]] == r["seg"] for r in rows)
        with pytest.raises(Exception, match="exceeds the max length"):
            datasets.dataset(spark, "abdomen", tmp_path.as_uri(), [2]).collect()
        assert datasets.dataset(spark, "abdomen", tmp_path.as_uri(), [99]).collect() == []
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_file_checks(spark):
    listing = spark.createDataFrame([("img0002_tcia_MR.nii.gz",), ("x/img0002_tcia_MR.nii.gz",), ("mask0004_tcia_CT.nii",)], "path string")
    found = datasets.classify_abdomen(listing)
    assert datasets.duplicates(found).collect() == [("vol", 2, "MR", 2)]
    assert {(r["sample"], r["modality"]) for r in datasets.incomplete(found).collect()} == {(2, "MR"), (4, "CT")}


def test_names(spark):
    good = spark.range(1).select(names.parse(F.lit("s3__mMR__iA_1")).alias("p")).first()["p"]
    assert tuple(good) == (3, "MR", "A_1")
    for wrong in ("s3__mMR", "3__mMR__iA", None):
        with pytest.raises(PySparkException):
            spark.range(1).select(names.parse(F.lit(wrong).cast("string"))).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(names.make(F.lit(1), F.lit("a__b"), F.lit("c"))).collect()


@pytest.mark.parametrize(("spec", "want"), [(None, [0, 1, 2, 3]), (":", [0, 1, 2, 3]), ("1:3", [1, 2]), ("[::2]", [0, 2]), ("3", [3]), ("[3]", [3]), ("0,2", [0, 2]), ("[0, -1]", [0, 3]), (2, [2]), ([1, 0], [1, 0]), (slice(1, None), [1, 2, 3])])
def test_channel_choices(spec, want):
    assert grammar.channels(spec, 4) == want


@pytest.mark.parametrize("spec", ["a", "1:2:3:4", "1:x"])
def test_wrong_channel_choices(spec):
    with pytest.raises(ValueError, match="no channel choice"):
        grammar.channels(spec, 4)
    with pytest.raises(IndexError):
        grammar.channels("4", 4)


def test_mask_modes():
    assert grammar.mask_mode("reg") == "affine+elastic" and grammar.registration_masks("feat") == "none"
    with pytest.raises(ValueError, match="unknown mask mode"):
        grammar.mask_mode("feat+other")


def test_pipeline_state(spark, sf):
    pipeline = preprocess.PRESETS["mr_ct"]
    assert preprocess.Pipeline.from_json(pipeline.to_json()).to_json() == pipeline.to_json()
    assert pipeline(inten(spark, sf)).where("value < 0 OR value > 1").count() == 0
    z = preprocess.Pipeline([preprocess.make("zscore")])(inten(spark, sf).withColumn("msk", F.lit(True)))
    got = z.groupBy("vid").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-6 and abs(r["s"] - 1) < 1e-6 for r in got)
    with pytest.raises(ValueError, match="no stage"):
        preprocess.make("other")


def _volumes(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(6):
        modality = ("MR", "CT", "PT")[k % 3]
        rows += [(f"v{k}", modality, float(x), bool(m)) for x, m in zip(rng.normal(k, 1 + k, 40), rng.random(40) < 0.7, strict=True)]
    return spark.createDataFrame([*rows, ("v6", "MR", 2.0, False), ("v7", "CT", None, None)], "vid string, modality string, value double, msk boolean")


PIPELINES = [
    [preprocess.Percentile(5.0, 90.0, True, ("MR",)), preprocess.Percentile(0.0, 97.0, False, ("CT",)), preprocess.ZScore(modalities=("PT",))],
    [preprocess.Percentile(10.0, 95.0), preprocess.ZScore(0.1, 0.8, ("MR", "ct")), preprocess.Window(0.0, 1.0, ("PT",)), preprocess.ZScore(modalities=("PT",))],
    [preprocess.Window(-5.0, 5.0)],
]


@pytest.mark.parametrize("stages", PIPELINES)
def test_recorded_states(spark, stages):
    """States recorded in one go, applied, give what each stage fitted in turn gives; two batches' states are one batch's."""
    pipeline, voxels = preprocess.Pipeline(stages), _volumes(spark)
    key = lambda rows: sorted((r["vid"], r["modality"], tuple(r["log"]), None if r["value"] is None else round(r["value"], 9)) for r in rows.where("vid < 'v6'").collect())
    states = pipeline.record(voxels).cache()
    assert key(pipeline.apply(voxels, states)) == key(pipeline(voxels))
    halves = [pipeline.record(voxels.where(x)) for x in ("vid < 'v3'", "vid >= 'v3'")]
    both = halves[0].unionByName(halves[1])
    flat = lambda rows: sorted((r["stage"], r["modality"], r["vid"] if "vid" in r else None, sorted((k, None if v is None else round(v, 9)) for k, v in r["state"].items())) for r in rows.collect())
    assert flat(both) == flat(states)
    assert flat(pipeline.merged(both)) == flat(pipeline.merged(states))
    states.unpersist()


def test_merged_states(spark):
    pipeline, voxels = preprocess.Pipeline(PIPELINES[0]), _volumes(spark).where("vid < 'v6'")
    merged = {(r["stage"], r["modality"]): r["state"] for r in pipeline.merged(pipeline.record(voxels)).collect()}
    rows = voxels.collect()
    own = lambda vid, masked: [r["value"] for r in rows if r["vid"] == vid and (r["msk"] or not masked)]
    assert merged[0, "MR"]["high"] == pytest.approx(np.median([np.percentile(own(v, True), 90) for v in ("v0", "v3")]))
    assert merged[1, "CT"]["low"] == pytest.approx(np.median([min(own(v, False)) for v in ("v1", "v4")]))
    both = np.array(own("v2", True) + own("v5", True))
    assert (merged[2, "PT"]["n"], merged[2, "PT"]["total"]) == (len(both), pytest.approx(both.sum()))
    brought = [r["value"] for r in pipeline.apply(voxels.where("vid = 'v2'"), pipeline.merged(pipeline.record(voxels))).collect()]
    assert sorted(brought) == pytest.approx(sorted((x - both.mean()) / (both.std() + 1e-8) for x in own("v2", False)))
    assert preprocess.Pipeline(PIPELINES[1]).waves() == [[0], [1, 2], [3]] and pipeline.waves() == [[0, 1, 2]]


def test_runs_resume(spark, tmp_path):
    run = reports.Run(spark, tmp_path.as_uri(), ["task"])
    tasks = spark.createDataFrame([(k, k * 1.5) for k in range(6)], "task long, value double")
    run.guard({"k": 5, "seed": 1})
    run.append(run.todo(tasks).where("task < 4"))
    assert not run.finished()
    again = reports.Run(spark, tmp_path.as_uri(), ["task"])
    again.guard({"seed": 1, "k": 5})
    assert sorted(r["task"] for r in again.todo(tasks).collect()) == [4, 5]
    with pytest.raises(ValueError, match="k: 5 is now 7"):
        again.guard({"k": 7, "seed": 1})
    again.finish()
    assert again.finished()


@pytest.mark.parametrize("partition", [None, "fold"])
@pytest.mark.parametrize("pruned", [10_000, 0])
def test_runs_stopped_at_any_moment(spark, tmp_path, monkeypatch, partition, pruned):
    """Stopped while rows are written, before the keys, and before the manifest: the rows of a run that never stopped, each once."""
    monkeypatch.setattr(reports, "PRUNED_ATTEMPTS", pruned)
    run = reports.Run(spark, tmp_path.as_uri(), ["fold", "task"], partition)
    tasks = spark.createDataFrame([(k % 2, k, k * 1.5 + copy) for k in range(8) for copy in range(2)], "fold int, task long, value double")
    key = tasks.select("fold", "task").distinct()
    assert run.rows() is None and run.done() is None and run.todo(key).count() == 8
    run.append(tasks.where("task < 2"))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(reports.Run, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            run.append(tasks.where("task BETWEEN 2 AND 3"))
    (tmp_path / "rows" / "attempt=0e1" / "_temporary").mkdir(parents=True)
    tasks.where("task > 4").write.parquet(f"{tmp_path}/rows/attempt=7")
    again = reports.Run(spark, tmp_path.as_uri(), ["fold", "task"], partition)
    assert sorted(r["task"] for r in again.todo(key).collect()) == [2, 3, 4, 5, 6, 7]
    again.append(tasks.where("task BETWEEN 2 AND 5"))
    again.append(tasks.where("task BETWEEN 4 AND 6").withColumn("value", F.lit(-1.0)))  # 4 and 5 for the second time
    again.append(tasks.limit(0), key.where("task = 7"))  # a task without rows
    assert again.todo(key).count() == 0
    again.finish()
    want = sorted((k % 2, k, -1.0 if k == 6 else k * 1.5 + copy) for k in range(7) for copy in range(2))
    assert sorted((r["fold"], r["task"], r["value"]) for r in again.rows().collect()) == want
    assert sorted(again.rows().columns) == ["fold", "task", "value"]
    assert len([*(tmp_path / "rows").iterdir()]) == 4 == len([*(tmp_path / "manifest").glob("*.json")])


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "k int, dice double")
    reports.write_by_type({"organs": rows}, f"{tmp_path}/r.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r_organs.csv").collect() == [("1", "0.5")]
    with pytest.raises(ValueError, match=".csv"):
        reports.write_csv(rows, f"{tmp_path}/r.txt")


def test_leakage(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "vid string") for v in ("ab", "bc"))
    with pytest.raises(ValueError, match="b"):
        experiments.assert_no_leakage(a, b)
    experiments.assert_no_leakage(a.where("vid = 'a'"), b)


def test_votes(spark):
    rows = [("p", 1, 10, 0.9, 1, 2), ("p", 1, 11, 0.8, 2, 1), ("p", 1, 12, 0.7, 3, 1), ("p", 1, 13, 0.6, 4, 2)]
    found = spark.createDataFrame(rows, "pair_id string, query_id long, key_id long, score double, rank int, label int")
    got = {r["k"]: r["pred"] for r in knn.vote(found, (1, 3, 4)).collect()}
    assert got == {1: 2, 3: 1, 4: 2}  # a tie goes to the label of the best rank
    with pytest.raises(TypeError, match="boolean"):
        knn.masked(spark.createDataFrame([(1.0,)], "msk double"))


def test_absent_label_has_dice_0(spark):
    pred = spark.createDataFrame([("p", 1, 1, 0)], "pair_id string, query_id long, k int, pred int")
    truth = spark.createDataFrame([("p", 1, 0)], "pair_id string, query_id long, seg int")
    n = spark.createDataFrame([("p", 2)], "pair_id string, n_labels int")
    assert {r["label"]: round(r["dice"], 6) for r in knn.dice(pred, truth, n).collect()} == {0: 1.0, 1: 0.0}


def test_one_kept_slice_fills_the_depth(spark):
    kept = spark.createDataFrame([("v", 2, [7.0])], "vid string, slice_idx int, feat array<double>")
    depth = spark.createDataFrame([("v", 4)], "vid string, depth int")
    assert [r["feat"] for r in slices.interpolate(kept, depth, ["vid"]).orderBy("slice_idx").collect()] == [[7.0]] * 4


def test_unknown_modality(spark):
    registry = slices.codes_by_name(spark.createDataFrame([("MR",)], "modality string"))
    with pytest.raises(PySparkException):
        slices.with_codes(spark.createDataFrame([("CT",)], "modality string"), registry).collect()


def test_places_without_one_task_for_all(spark):
    """Places and running sums over ties, nulls and many parts equal those of one sorted list."""
    rng = np.random.default_rng(8)
    rows = [(None if k % 50 == 0 else int(rng.integers(0, 40)), int(k), float(rng.integers(1, 9))) for k in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int, x double").repartition(7)
    found = numbering.ordered(frame, ["a", "b"], "place", {"before": F.col("x"), "twice": 2 * F.col("x")}).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ahead = np.cumsum([0.0, *(r[2] for r in want)])
    assert sorted((r["place"], r["a"], r["b"], r["before"], r["twice"]) for r in found) == [(k, r[0], r[1], ahead[k], 2 * ahead[k]) for k, r in enumerate(want)]
    assert numbering.ordered(frame.limit(0), ["a"]).collect() == []
    ties = numbering.ordered(frame.withColumn("a", F.lit(1)), ["a"]).select("place").collect()
    assert sorted(r["place"] for r in ties) == [*range(500)]


def test_affines_and_matrices_of_columns(spark):
    rows = spark.createDataFrame([([1.5, 2.0, 0.5], [1.0, -2.0, 3.0])], "s array<double>, t array<double>")
    made = rows.select(warp.matrices(F.col("s"), F.col("t")).alias("m")).withColumn("a", warp.affines(F.col("m"))).first()
    assert made["m"] == warp.Affine((1.5, 2.0, 0.5), (1.0, -2.0, 3.0)).matrix() and tuple(made["a"]) == ([1.5, 2.0, 0.5], [1.0, -2.0, 3.0])
    turned = spark.createDataFrame([([[1.0, 0.1, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]],)], "m array<array<double>>")
    with pytest.raises(PySparkException, match="only scale and shift"):
        turned.select(warp.affines(F.col("m"))).collect()


def test_folds_of_lists_are_made_row_by_row(spark):
    lists = spark.createDataFrame([("a", "[3, 1, 2, 0]"), ("b", "[7, 8]"), ("c", "[]"), ("d", "[5, 5, 4, 3, 2, 1]")], "name string, text string")
    found = experiments.list_folds(lists)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, experiments.folds(experiments.permutations(lists), 2, ["name"]).collect()))
    assert found.where("role = 'test'").count() == 12 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(PySparkException, match="doesn't divide"):
        experiments.list_folds(lists, 4).collect()


def test_modes_permutations_and_experiments_of_columns(spark):
    texts = ["all", " Elastic + feat", "none", "reg", "feat+reg", "none+affine"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grammar.mask_modes(F.col("t")).alias("m")).withColumn("s", grammar.registration_stages(F.col("m")))
    assert {(r["t"], r["m"], r["s"]) for r in rows.collect()} == {(t, grammar.mask_mode(t), grammar.registration_masks(t)) for t in texts}
    with pytest.raises(PySparkException, match="unknown mask mode"):
        spark.createDataFrame([("feat+other",)], "t string").select(grammar.mask_modes(F.col("t"))).collect()
    lists = spark.createDataFrame([("a", "[3, 1, 2, 0]"), ("b", "[7, 8]"), ("c", "[]")], "name string, text string")
    assert sorted(map(tuple, experiments.permutations(lists).collect())) == [("a", 0, 3, 0), ("a", 1, 1, 0), ("a", 2, 2, 1), ("a", 3, 0, 1), ("b", 0, 7, 0), ("b", 1, 8, 0)]
    with pytest.raises(PySparkException, match="doesn't divide"):
        experiments.permutations(lists, 4).collect()
    folds = experiments.folds(experiments.permutations(lists), 2, ["name"]).where("role = 'test'")
    assert sorted((r["name"], r["fold"], r["sample"]) for r in folds.collect()) == [("a", 0, 1), ("a", 0, 3), ("a", 1, 0), ("a", 1, 2), ("b", 0, 7), ("b", 0, 8)]
    config = {"__output_dir__": "out", "__otherwise__": {"lr": "0.1", "epochs": "3"}, "a": {"lr": "0.5"}, "b": {"lr": "__none__"}, "c": None}
    rows = [("x", k, None if v is None else json.dumps(v) if isinstance(v, dict) else "{}") for k, v in config.items()] + [("y", "d", '{"z": "1"}')]
    found = {(r["config"], r["name"]): r["settings"] for r in experiments.expanded_rows(spark.createDataFrame(rows, "config string, name string, text string")).collect()}
    assert found == {("x", e.pop("name")): e for e in experiments.expanded(spark, config)} | {("y", "d"): {"z": "1"}}


def test_ladders_of_columns(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 5)], "n int")
    for spec in ("linear", "uniform", "exp"):
        for normalise in (True, False):
            found = {r["n"]: r["w"] for r in rows.select("n", projection.ladder_of(spec, F.col("n"), normalise).alias("w")).collect()}
            assert all(np.allclose(found[n], projection.ladder(spec, n, normalise)) for n in found)
    with pytest.raises(ValueError, match="none of"):
        projection.ladder_of("other", F.col("n"))


def test_states_and_traces_come_back(spark):
    @dataclasses.dataclass(frozen=True)
    class Chosen:
        listed: list
        fixed: tuple[int, ...] = ()
        maybe: tuple[str, ...] | None = None

        def sample(self, tokens):
            return tokens

    registry = extensions.Registry("sampler", extensions.Sampler)
    registry.register("chosen", Chosen)
    for one in (Chosen([1, 2], (3,), ("a",)), Chosen([], (), None)):
        assert registry.restored(registry.state(one)) == one
    rows = masks.traced(masks.traced(spark.range(1), "cut", by='{"x"}', at=3), "keep")
    assert rows.select(masks.summary(F.col("trace"))).first()[0] == 'cut(at:3,by:{"x"}) > keep()'


def test_a_product_is_dealt_to_tasks(spark):
    """A table of one partition isn't multiplied within one task."""
    from voxlake.plans import experiments

    found = experiments.combinations(spark.range(40).coalesce(1), {"a": [1, 2], "b": [3, 4, 5]}, ())
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 240 and len({r["part"] for r in rows}) > 1
