"""Splits of a manifest, training of the stand-in classifier and evaluation of predictions, as a command.

    python -m siftwell.plans.evaluate split MANIFEST OUT --classes a,b,c [--root IMAGES] [--kfold K] [--source-holdout] [--balanced] [--no-cap]
    python -m siftwell.plans.evaluate train VECTORS OUT --classes a,b,c
    python -m siftwell.plans.evaluate report TEST PREDICTIONS OUT --classes a,b,c
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import classifier, hamming, metrics, quality, splitting
from siftwell.sources import images, manifest, results
from siftwell.sources.shared import exists, scratch, written

#: Near duplicates of a split: bands over all 64 bits, and the largest bucket that links.
CAP = 700
#: Share of valid hashes below which groups can't be relied on.
LEAST_HASHED = 0.5


def sound_frame(spark: SparkSession, path: str, root: str | None, classes: list[str], *, verify: bool = True, extensions: tuple[str, ...] = images.EXTENSIONS) -> DataFrame:
    """Rows to split: those of the manifest at ``path``, or the images under ``root`` if there is no manifest; of the listed classes, with label.

    With ``root`` paths are repaired by its files, rows without a file are dropped and, with ``verify``, files that can't be decoded; all
    that is dropped is warned about with its count. One row of each path stays. An error if there are no rows, or a listed class has none, before or after
    files are verified; fewer valid hashes than ``LEAST_HASHED`` are warned about.
    """
    if exists(spark, path):
        frame = manifest.training_frame(manifest.read_manifest(spark, path))
        if root:
            files = images.listing(spark, root, extensions)
            n = frame.count()
            frame = written(manifest.path_repair(frame, files, images.root_of(spark, root)).drop("repaired"), "repaired")
            if n > frame.count():
                warnings.warn(f"{n - frame.count()} rows without a file", stacklevel=2)
        frame = manifest.first_rows(frame, "path", ["path", "class_dir"])
    elif root:
        warnings.warn("no manifest: near duplicates and sources are unknown", stacklevel=2)
        frame = images.directory_frame(spark, root, extensions, classes)
    else:
        raise FileNotFoundError(path)
    frame = written(manifest.labelled(frame, classes), "frame")
    check_classes(frame, classes)
    if root and verify:
        tried = images.decodable(spark, root, extensions)
        bad = written(tried.where("NOT ok").join(frame.select("path"), "path", "left_semi"), "bad")
        row = images.dropped(bad).first()
        if row.n_dropped:
            warnings.warn(f"{row.n_dropped} files that can't be decoded, such as {row.first_paths}", stacklevel=2)
            frame = written(frame.join(bad, "path", "left_anti"), "verified")
            check_classes(frame, classes)
    ratio = hamming.hash_coverage(frame).first().ratio
    if ratio < LEAST_HASHED:
        warnings.warn(f"{ratio:.1%} of the hashes are valid: near duplicates may be in several splits", stacklevel=2)
    return frame


def check_classes(frame: DataFrame, classes: list[str]) -> None:
    """An error if a listed class has no row."""
    found = {r.class_dir for r in frame.select("class_dir").distinct().collect()}  # listed classes only
    lacking = [c for c in classes if c not in found]
    if lacking:
        raise ValueError(f"classes without a row: {lacking}")


def labelled_groups(frame: DataFrame, cap: int | None = CAP) -> DataFrame:
    """The rows with dup_group: near duplicates by hash over bands of all 64 bits; no cap if None."""
    groups = hamming.duplicate_groups(frame, cap=cap, whole=True, id_col="path").withColumnRenamed("group_id", "dup_group")
    return written(frame.join(groups, "path"), "labelled")


def splits(frame: DataFrame, classes: list[str], *, source_holdout: bool = False, balanced: bool = False, cap: int | None = CAP, seed: int = 42) -> DataFrame:
    """``split`` of each row; an error if paths or groups are in several splits, or a split lacks one of ``classes``."""
    rows = labelled_groups(frame, cap)
    deal = splitting.balanced_folds if balanced else splitting.group_folds
    if source_holdout:
        out = splitting.holdout_split(rows, group="dup_group", id_col="path", seed=seed, deal=deal)
    else:
        out = splitting.three_way(rows, group="dup_group", seed=seed, deal=deal)
    every = metrics.labels_table(frame.sparkSession, len(classes))
    return splitting.checked(written(out, "split"), every, group="dup_group", id_col="path")


def split(spark: SparkSession, args: argparse.Namespace) -> None:
    frame = sound_frame(spark, args.manifest, args.root, args.classes, verify=not args.skip_verify, extensions=tuple(args.extensions.split(",")))
    quality.imbalance(frame, "class_dir").orderBy("class_dir").show(1000, truncate=False)
    cap = None if args.no_cap else CAP
    out = splits(frame, args.classes, source_holdout=args.source_holdout, balanced=args.balanced, cap=cap, seed=args.seed)
    splitting.split_warnings(out).show(truncate=False)
    manifest.write_splits(out, f"{args.out}/splits")
    if args.kfold > 1:
        deal = splitting.balanced_folds if args.balanced else splitting.group_folds
        folds = splitting.folds_of_split(out, args.kfold, group="dup_group", seed=args.seed + 1, deal=deal)
        folds.write.partitionBy("fold", "role").option("header", True).csv(f"{args.out}/folds")
    given = {k: v for k, v in vars(args).items() if k != "run"}
    results.write_metadata(args.classes, results.environment(spark, args.seed, kfold=args.kfold, source_holdout=args.source_holdout), args.out)
    results.write_run(results.run_record(spark, results.counted(out), given, args.seed), f"{args.out}/run.json")


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parquet with id, features, label, source and fold (null: test); runs, their history and predictions of the test rows."""
    rows = spark.read.parquet(args.vectors)
    folds = rows.agg(F.max("fold").alias("m")).first().m
    plan = classifier.Plan(epochs=args.epochs, freeze=args.freeze, warmup=args.warmup, patience=args.patience)
    # Of two folds, one for validation and one for learning, only the first is a run.
    runs = classifier.trained(rows, len(args.classes), args.kfold or 1, plan)
    if not runs or folds is None or folds < 1:
        raise ValueError("rows of at least two folds are needed")
    results.append_history(classifier.history(spark, runs), f"{args.out}/history")
    scores = classifier.fold_scores(spark, runs)
    if args.kfold > 1:
        results.write_kfold_summary(metrics.kfold_summary(scores, ["val_macro_f1", "test_acc", "test_macro_f1"]), f"{args.out}/kfold_summary")
    test = rows.where("fold IS NULL").select("id", "features", "label", "source")
    for i, run in enumerate(runs):
        classifier.predictions(test, run).drop("features").write.parquet(f"{args.out}/predictions/fold={i}")
    scores.write.parquet(f"{args.out}/scores")


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    k = len(args.classes)
    scored = results.predictions_of(spark.read.parquet(args.test), spark.read.parquet(args.predictions))
    p = written(scored.withColumn("label", F.col("label").cast("int")), "scored")
    results.write_report(metrics.classification_report(p, k), metrics.confusion_matrix(p, k), args.out)
    tables = {"sources": metrics.accuracy_by_source(p), "confidence": metrics.confidence_summary(p), "sweep": metrics.confidence_sweep(p), "classes": metrics.confidence_by_class(p), "auc": metrics.auc(p, k)}
    for name, table in tables.items():
        manifest.write_json(table, f"{args.out}/{name}")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--seed", type=int, default=42)
    sub = ap.add_subparsers(dest="what", required=True)
    names = lambda s: s.split(",")
    one = sub.add_parser("split")
    one.add_argument("manifest", help="CSV; if it is not there, the images under --root")
    one.add_argument("out")
    one.add_argument("--classes", type=names, required=True)
    one.add_argument("--root", help="folder of the images: paths are repaired by it, files looked for and decoded")
    one.add_argument("--skip-verify", action="store_true", help="don't decode the files")
    one.add_argument("--extensions", default=",".join(images.EXTENSIONS))
    one.add_argument("--kfold", type=int, default=0, help="folds over what the test set leaves")
    one.add_argument("--source-holdout", action="store_true")
    one.add_argument("--balanced", action="store_true", help="groups of several classes count with all of them")
    one.add_argument("--no-cap", action="store_true", help=f"buckets of over {CAP} rows link too")
    one.set_defaults(run=split)
    two = sub.add_parser("train")
    two.add_argument("vectors", help="Parquet with id, features, label, source and fold; null folds are the test set")
    two.add_argument("out")
    two.add_argument("--classes", type=names, required=True)
    two.add_argument("--kfold", type=int, default=0)
    two.add_argument("--epochs", type=int, default=24)
    two.add_argument("--freeze", type=int, default=2)
    two.add_argument("--warmup", type=int, default=2)
    two.add_argument("--patience", type=int, default=classifier.PATIENCE)
    two.set_defaults(run=train)
    three = sub.add_parser("report")
    three.add_argument("test", help="Parquet with id, label and source")
    three.add_argument("predictions", help="Parquet with id, prediction, conf and probs")
    three.add_argument("out")
    three.add_argument("--classes", type=names, required=True)
    three.set_defaults(run=report)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    with scratch(spark):
        args.run(spark, args)


if __name__ == "__main__":
    main()
