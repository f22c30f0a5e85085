"""Curation of an image tree: profile, filter, group, resolve, sample, number; writes only with ``--apply``.

Each stage is a table that a later run with the same files and settings takes up, so a run that died goes on where it was.
"""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import clusters, conflicts, hamming, quality, sampling
from siftwell.sources import images, manifest
from siftwell.sources.file_sink import write_files
from siftwell.sources.shared import Stages, deleted, exists, fingerprint, published, scratch, written


def grouped(profiled: DataFrame, *, min_side: int = quality.MIN_SIDE, blur: float = quality.BLUR, threshold: int = hamming.THRESHOLD, cap: int | None = hamming.CAP) -> DataFrame:
    """The sound records that pass the filter, with source and group_id, before any policy.

    Pseudo-sources come before duplicates go, as their cutoff counts all rows that pass
    the filter.
    """
    sound, _ = quality.split_broken(profiled)
    rows = quality.pseudo_sources(quality.quality_filter(sound, min_side, blur))
    return rows.join(hamming.duplicate_groups(rows, threshold, cap, id_col="path"), "path")


def resolved(rows: DataFrame, *, policy: str = "report", targets: dict[str, int] | None = None) -> DataFrame:
    """The records of ``grouped`` that stay, with vcluster, stratum and new_path.

    Classes with a target are clustered and sampled to it; others are kept.
    """
    kept = written(rows.join(conflicts.survivors(rows, policy, "cls", "path").select("path"), "path", "left_semi"), "kept")
    kept = kept.withColumn("vcluster", F.lit(manifest.NONE)).withColumn("stratum", F.lit(manifest.NONE))
    for name in sorted(targets or {}):
        own = clusters.visual_clusters(kept.where(F.col("cls") == name).drop("vcluster").withColumn("features", clusters.features())).drop("features")
        own = own.withColumn("stratum", sampling.stratum("subclass", "source", "vcluster")).select(*kept.columns)
        kept = kept.where(~F.col("cls").eqNullSafe(name)).unionByName(own)
    return manifest.numbered(sampling.sampled_classes(kept, targets or {}, id_col="path"))


def curated(profiled: DataFrame, *, policy: str = "report", targets: dict[str, int] | None = None, **filters) -> DataFrame:
    """``grouped``, written once, then ``resolved``."""
    return resolved(written(grouped(profiled, **filters), "grouped"), policy=policy, targets=targets)


#: Conflict groups and broken rows that a report lists; its purpose is reading.
LISTED = 300


def report(profiled: DataFrame, rows: DataFrame, kept: DataFrame, *, min_side: int = quality.MIN_SIDE, blur: float = quality.BLUR) -> dict[str, DataFrame]:
    """Tables of the report. ``rows``: ``grouped``; ``kept``: ``resolved``; the bounds are those of the filter.

    Conflicts are all members of the first ``LISTED`` groups of several classes as they were before the
    policy; leaks are by falling size, sources all of each class.
    """
    sound, broken = quality.split_broken(profiled)
    first = conflicts.conflict_groups(rows).orderBy("group_id").limit(LISTED)
    members = conflicts.conflict_members(rows, id_col="path").join(first.select("group_id"), "group_id")
    counts = rows.groupBy("cls").agg(F.count("*").alias("n_good")).join(kept.groupBy("cls").agg(F.count("*").alias("n_kept")), "cls", "left")
    return {
        "rejects": quality.quality_rejects(sound, min_side=min_side, blur=blur),
        "survivors": counts.na.fill(0, ["n_kept"]).orderBy("cls"),
        "classes": quality.imbalance(kept),
        "sources": rows.groupBy("cls", "source").agg(F.count("*").alias("n")).orderBy("cls", F.desc("n"), "source"),
        "leaks": quality.leak_audit(quality.quality_filter(sound, min_side, blur)).orderBy(F.desc("n"), "raw_sig"),
        "duplicates": conflicts.duplicate_stats(rows),
        "conflicts": members.orderBy("group_id", "cls", "path"),
        "broken": broken.select("path", "error").orderBy("path").limit(LISTED),
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("root")
    ap.add_argument("out")
    ap.add_argument("--apply", action="store_true", help="copy files and write the manifest and report")
    ap.add_argument("--policy", choices=conflicts.POLICIES, default="report")
    ap.add_argument("--targets", type=json.loads, default={}, help='such as {"eczema": 4000}')
    ap.add_argument("--min-side", type=int, default=quality.MIN_SIDE)
    ap.add_argument("--blur", type=float, default=quality.BLUR)
    ap.add_argument("--extensions", default=",".join(images.EXTENSIONS))
    ap.add_argument("--classes", type=lambda s: s.split(","), help="only these folders; absent ones are warned about")
    ap.add_argument("--no-cap", action="store_true", help=f"buckets of over {hamming.CAP} hashes link too")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.apply and exists(spark, args.out):
        raise FileExistsError(args.out)
    extensions, cap = tuple(args.extensions.split(",")), None if args.no_cap else hamming.CAP
    bounds = {"min_side": args.min_side, "blur": args.blur}
    found = fingerprint(spark, args.root)
    # A stage's name says all that its table hangs on, so a dry run and the run that writes share it, and a run that died is taken up.
    profiles = Stages(spark, args.root, found, extensions, args.classes)
    groups = Stages(spark, args.root, found, extensions, args.classes, bounds, cap)
    chosen = Stages(spark, args.root, found, extensions, args.classes, bounds, cap, args.policy, args.targets)

    def profile() -> DataFrame:
        rows = images.records(spark, args.root, extensions)
        return images.of_classes(rows, args.classes) if args.classes else rows

    with scratch(spark):
        profiled = profiles("profiled", profile)
        good = groups("grouped", lambda: grouped(profiled, cap=cap, **bounds))
        rows = chosen("curated", lambda: resolved(good, policy=args.policy, targets=args.targets))
        tables = report(profiled, good, rows, **bounds)
        if args.apply:
            apply(spark, args.root, extensions, rows, tables, args.out)
        else:
            for name in ("rejects", "survivors", "classes", "sources", "duplicates", "leaks"):
                print(name)
                tables[name].show(8 if name == "leaks" else 1000, truncate=False)
    for stages in (profiles, groups, chosen):
        stages.close()


def apply(spark: SparkSession, root: str, extensions: tuple[str, ...], rows: DataFrame, tables: dict[str, DataFrame], out: str) -> None:
    """Copies, manifest and report, made beside ``out`` and given its name in one step: it is whole or not there."""
    made = f"{out.rstrip('/')}.making-{uuid.uuid4().hex}"
    try:
        seen = images.scan(spark, root, extensions).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
        write_files(seen.select("path", "content").join(rows.select("path", "new_path"), "path"), made)
        manifest.write_csv(manifest.manifest_projection(rows).orderBy("class", "new_path"), f"{made}/manifest.csv")
        for name, t in tables.items():
            manifest.write_json(t, f"{made}/report/{name}")
        published(spark, made, out)
    finally:
        deleted(spark, made)


if __name__ == "__main__":
    main()
