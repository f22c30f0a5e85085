"""Nulls, clashing names, ties and empty tables in the library's own operators, and files of results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import conflicts, metrics, running, sampling, splitting
from siftwell.plans import curate, evaluate
from siftwell.sources import images, manifest, results

ROWS = "doc_id long, group_id long, cls string, min_side int, blur double, n int, quota int, fold int, split string"


def test_row_numbers_and_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 0 else int(rng.integers(0, 3)), int(rng.integers(0, 50)), int(rng.integers(1, 9))) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k int, x int, w int")
    got = {r.id: r for r in running.row_numbers(running.running_sums(df, ["k"], [F.col("x"), F.col("id")], {"s": "w"}), ["k"], [F.desc("x"), F.col("id")], "r").collect()}
    for key in (None, 0, 1, 2):
        own = [r for r in rows if r[1] == key]
        total = 0
        for r in sorted(own, key=lambda r: (r[2], r[0])):
            total += r[3]
            assert got[r[0]].s == total
        for n, r in enumerate(sorted(own, key=lambda r: (-r[2], r[0])), 1):
            assert got[r[0]].r == n
    assert running.row_numbers(df.limit(0), ["k"], [F.col("x")], "r").count() == 0


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(1, 1, "a", 9, 1.0), (2, 1, "a", 9, 2.0), (3, 2, "a", 9, 1.0), (4, 2, "b", 9, 1.0), (5, None, "a", 1, 1.0), (6, None, None, 1, 1.0), (7, 3, None, 1, 1.0), (8, 3, None, 2, 1.0), (9, 4, None, 1, 1.0), (10, 4, "b", 1, 1.0)]
    return spark.createDataFrame([(*r, 5, 5, 5, "x") for r in rows], ROWS)


@pytest.mark.parametrize(("policy", "kept"), [("report", {2, 3, 4, 5, 6, 8, 9, 10}), ("keep_rarest", {2, 4, 5, 6, 8, 10}), ("drop_all", {2, 5, 6, 8})])
def test_policies_keep_rows_without_group_or_class(grouped, policy, kept):
    assert {r.doc_id for r in conflicts.survivors(grouped, policy).collect()} == kept
    assert conflicts.survivors(grouped.limit(0), policy).count() == 0


def test_splits_keep_every_row_and_replace_clashing_columns(grouped):
    for out in (splitting.three_way(grouped, label="cls"), splitting.holdout_split(grouped.withColumn("source", F.lit("s")), label="cls")):
        assert sorted(r.doc_id for r in out.collect()) == list(range(1, 11))
        assert {r.split for r in out.collect()} <= set(splitting.SPLITS)
        assert splitting.split_overlap(out.where("group_id IS NOT NULL")).count() == 0
    folds = splitting.k_folds(grouped, 3, label="cls").collect()
    assert len(folds) == 30 and sorted(r.doc_id for r in folds if r.role == "val") == list(range(1, 11))
    fixed = splitting.k_folds_with_test(grouped, 2, label="cls").collect()
    tested = [{r.doc_id for r in fixed if r.role == "test" and r.fold == k} for k in (0, 1)]
    assert tested[0] == tested[1] and len(fixed) == 20
    assert splitting.three_way(grouped.limit(0), label="cls").count() == 0


def test_metrics_of_rows_without_label_prediction_or_confidence(spark):
    rows = [(1, 0, 0, 0.9, "a"), (2, None, 0, 0.8, "a"), (3, 1, None, 0.7, "b"), (4, 1, 1, None, "b"), (5, None, None, None, None)]
    p = spark.createDataFrame(rows, "id int, label int, prediction int, conf double, source string").withColumn("probs", F.when(F.col("id") < 5, F.array(F.lit(0.4), F.lit(0.6))))
    report = {r.name: r for r in metrics.classification_report(p, 2).collect()}
    assert (report["0"].precision, report["0"].recall, report["0"].support) == (0.5, 1.0, 1) and (report["1"].precision, report["1"].recall, report["1"].support) == (1.0, 0.5, 2)
    assert sum(r.n for r in metrics.confusion_matrix(p, 2).collect()) == 2
    assert {r.source: r.accuracy for r in metrics.accuracy_by_source(p, least=1).collect()} == {"a": 0.5, "b": 0.5, None: 0.0}
    assert {r.what: r.n for r in metrics.confidence_summary(p).collect()} == {"all": 5, "correct": 2, "wrong": 3}
    assert [(r.n, r.accuracy) for r in metrics.confidence_sweep(p, (0.75,)).collect()] == [(2, 0.5)]
    assert metrics.roc_points(p, 2).count() > 0
    assert metrics.confusion_matrix(p.limit(0), 2).count() == 4 and metrics.accuracy_by_source(p.limit(0)).count() == 0


def test_small_labels_need_no_rows_in_the_test_set(spark):
    rows = [(i, i, "small" if i < 5 else "large", "one") for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, group_id long, label string, source string")
    n = {(r.split, r.label): r.n for r in splitting.split_sizes(splitting.holdout_split(df)).collect()}
    assert ("test", "small") not in n and n["test", "large"] == 6


def test_sampling_with_clashing_columns_and_null_strata(grouped):
    rows = grouped.withColumn("stratum", F.col("cls"))
    got = sampling.stratified_sample(rows, 4)
    assert got.columns == rows.columns and got.count() == 4
    assert sampling.stratified_sample(rows, 99).count() == 10
    assert sampling.sampled_classes(rows, {"a": 2}).count() == 8
    assert sampling.weighted_draw(rows, 5, F.lit(None)).count() == 0


def test_interpolation_against_numpy(spark):
    rng = np.random.default_rng(1)
    curves = {c: sorted({0.0, 1.0, *rng.random(20).round(3).tolist()}) for c in (0, 1)}
    ys = {c: np.sort(rng.random(len(x))) for c, x in curves.items()}
    points = spark.createDataFrame([(c, x, float(y)) for c in curves for x, y in zip(curves[c], ys[c], strict=True)], "cls int, fpr double, tpr double")
    grid = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 37)], "fpr double")
    got = metrics.interpolated(points, grid).collect()
    assert len(got) == 74
    assert all(r.tpr == pytest.approx(np.interp(r.fpr, curves[r.cls], ys[r.cls])) for r in got)


def test_manifest_with_absent_columns_and_null_class(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿new_path,class,width,extra\na/1.jpg,a,12,x\nb/2.jpg,,wide,y\n")
    rows = {r.new_path: r for r in manifest.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows["a/1.jpg"]["class"] == "a" and rows["a/1.jpg"].width == 12 and rows["a/1.jpg"].phash == "-"
    assert rows["b/2.jpg"]["class"] == "-" and rows["b/2.jpg"].width is None
    named = manifest.numbered(spark.createDataFrame([("x/2.JPG", None), ("x/1.JPG", None)], "path string, cls string"))
    assert {r.path: r.new_path for r in named.collect()} == {"x/1.JPG": "-/000000.jpg", "x/2.JPG": "-/000001.jpg"}


def test_histories_reports_and_metadata(spark, tmp_path):
    history = spark.createDataFrame([(0, 1.0, 0.5)], "epoch int, loss double, accuracy double")
    results.append_history(history, str(tmp_path / "h1"))
    results.append_history(history.withColumn("epoch", F.lit(1)), str(tmp_path / "h1"))
    got = results.read_histories(spark, [str(tmp_path / "h1"), str(tmp_path / "none")]).orderBy("epoch").collect()
    assert [(r.stage, r.epoch, r.loss, r.val_loss) for r in got] == [(1, 0, 1.0, None), (1, 1, 1.0, None)]
    assert results.read_histories(spark, [str(tmp_path / "none")]).count() == 0
    p = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1)], "id int, label int, prediction int")
    assert results.predictions_of(p.select("id", "label"), p.select("id", "prediction")).count() == 3
    for bad in (p.where("id < 3"), p.union(p.limit(1)), p.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError):
            results.predictions_of(p.select("id", "label"), bad.select("id", "prediction"))
    results.write_report(metrics.classification_report(p, 2), metrics.confusion_matrix(p, 2), str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r/report")).collect()]
    assert [x.split()[0] for x in lines] == ["0", "1", "accuracy", "macro", "weighted"]
    assert spark.read.option("header", True).csv(str(tmp_path / "r/confusion")).count() == 4
    results.write_kfold_summary(metrics.kfold_summary(spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, acc double"), ["acc"]), str(tmp_path / "k"))
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).first()["metric"] == "acc"
    results.write_metadata(["a", "b"], results.environment(spark, 42, k=3), str(tmp_path / "meta"))
    assert {r.class_dir: r.label for r in spark.read.json(str(tmp_path / "meta/classes.json")).collect()} == {"a": 0, "b": 1}
    assert {r.name: r.value for r in spark.read.json(str(tmp_path / "meta/run_meta.json")).collect()}["seed"] == "42"


def test_split_command(spark, tmp_path):
    rows = [(f"{'ab'[i % 2]}/{i:03d}.jpg", "ab"[i % 2], f"s{i % 6}", f"{(i * 2654435761) % 2**64:016x}") for i in range(120)]
    spark.createDataFrame(rows, "new_path string, class string, pseudo_source string, phash string").coalesce(1).write.option("header", True).csv(str(tmp_path / "m"))
    evaluate.main(["split", str(tmp_path / "m"), str(tmp_path / "o"), "--classes", "a,b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o/splits")).groupBy("split").count().count() == 3
    evaluate.main(["split", str(tmp_path / "m"), str(tmp_path / "k"), "--classes", "a,b", "--kfold", "3"])
    assert spark.read.option("header", True).csv(str(tmp_path / "k/folds")).count() == 360
    evaluate.main(["split", str(tmp_path / "m"), str(tmp_path / "s"), "--classes", "a,b", "--source-holdout"])
    p = spark.createDataFrame([(i, i % 2, "s", (i // 3) % 2, 0.9, [0.1, 0.9]) for i in range(40)], "id int, label int, source string, prediction int, conf double, probs array<double>")
    p.select("id", "label", "source").write.parquet(str(tmp_path / "t"))
    p.select("id", "prediction", "conf", "probs").write.parquet(str(tmp_path / "p"))
    evaluate.main(["report", str(tmp_path / "t"), str(tmp_path / "p"), str(tmp_path / "e"), "--classes", "a,b"])
    assert spark.read.text(str(tmp_path / "e/report")).count() == 5


def ppm(x):
    return b"P6 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tree"), np.random.default_rng(9)
    for k in range(4):
        x = np.kron(rng.integers(0, 255, (16, 16, 3)), np.ones((16, 16, 1)))
        for name in (f"a/p{k}.ppm", f"b/p{k}.ppm") if k < 2 else (f"b/q{k}.ppm",):
            (root / name).parent.mkdir(exist_ok=True)
            (root / name).write_bytes(ppm(x))
    (root / "a/broken.ppm").write_bytes(b"P6 1")
    return images.scan(spark, str(root), ("ppm",)), str(root)


@pytest.mark.parametrize("policy", conflicts.POLICIES)
def test_report_lists_conflicts_as_they_were(spark, tree, policy):
    profiled = images.profiled(tree[0])
    good = curate.grouped(profiled, min_side=100, blur=0.0)
    kept = curate.resolved(good, policy=policy)
    tables = curate.report(profiled, good, kept, min_side=100, blur=0.0)
    assert tables["conflicts"].count() == 4 and tables["conflicts"].select("group_id").distinct().count() == 2
    n = {r.cls: (r.n_good, r.n_kept) for r in tables["survivors"].collect()}
    assert n == {"a": (2, {"report": 2, "keep_rarest": 2, "drop_all": 0}[policy]), "b": (4, {"report": 4, "keep_rarest": 2, "drop_all": 2}[policy])}
    assert tables["rejects"].groupBy().sum("n_rejected").first()[0] == 0
    assert curate.report(profiled, good, kept, min_side=10**6)["rejects"].groupBy().sum("n_rejected").first()[0] == 6
    assert tables["broken"].count() == 1


def test_integrity_grey_fill_and_listing(spark, tree):
    seen, root = tree
    good, dropped = images.integrity(seen)
    row = dropped.first()
    assert good.count() == 6 and row.n_dropped == 1 and row.first_paths[0].endswith("a/broken.ppm")
    filled = {r.path.split("/")[-1]: r for r in images.grey_filled(seen, 8).collect() if "/a/" in r.path}
    assert filled["broken.ppm"].filled and set(filled["broken.ppm"].pixels) == {128} and len(filled["p0.ppm"].pixels) == 192 and not filled["p0.ppm"].filled
    frame = images.directory_frame(spark, root, ("ppm",)).collect()
    assert [r.path for r in frame] == sorted(r.path for r in frame) and {r.class_dir for r in frame} == {"a", "b"} and {r.phash for r in frame} == {"-"}
    assert images.sampled_files(seen, 3).count() == 3
