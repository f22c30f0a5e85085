"""The commands' gates, stages that are taken up again, files that are all there or none."""

import glob
import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import hamming, splitting
from siftwell.plans import curate, evaluate
from siftwell.sources import archives, file_sink, manifest, results, shared
from test_images import png


def scratch_tables(spark):
    return {p for p in glob.glob(f"{shared.shared_dir(spark).removeprefix('file://')}/siftwell-*") if os.path.isdir(p)}


def rows_of(n=120, classes="ab", per_hash=1):
    return [(f"{classes[i % len(classes)]}/{i:03d}.jpg", classes[i % len(classes)], f"s{i % 6}", f"{(i // per_hash * 2654435761 * 97) % 2**64:016x}") for i in range(n)]


def manifest_at(spark, path, rows):
    spark.createDataFrame(rows, "new_path string, class string, pseudo_source string, phash string").coalesce(1).write.option("header", True).csv(str(path))
    return str(path)


def split(*args):
    evaluate.main(["split", *map(str, args)])


def test_a_listed_class_without_rows_stops_the_split(spark, tmp_path):
    m = manifest_at(spark, tmp_path / "m", rows_of())
    for more in ((), ("--kfold", 3), ("--source-holdout",)):
        with pytest.raises(ValueError, match="zzz"):
            split(m, tmp_path / "o", "--classes", "a,b,zzz", *more)
    assert not (tmp_path / "o").exists()


def test_a_class_that_a_split_lacks_stops_it_before_the_folds(spark, tmp_path):
    m = manifest_at(spark, tmp_path / "m", rows_of() + [("c/1.jpg", "c", "s", "f" * 16)])
    for more in ((), ("--kfold", 3)):
        with pytest.raises(ValueError, match="missing from a split"):
            split(m, tmp_path / "o", "--classes", "a,b,c", *more)
    assert not (tmp_path / "o").exists()


def test_leaks_stop_the_split(spark, tmp_path, monkeypatch):
    m = manifest_at(spark, tmp_path / "m", rows_of(per_hash=4))
    before = scratch_tables(spark)
    torn = lambda rows, **_: rows.withColumn("split", F.element_at(F.array(*map(F.lit, splitting.SPLITS)), (F.pmod(F.xxhash64("path"), F.lit(3)) + 1).cast("int")))
    monkeypatch.setattr(splitting, "three_way", torn)
    for more in ((), ("--kfold", 3)):
        with pytest.raises(ValueError, match="dup_group in several splits"):
            split(m, tmp_path / "o", "--classes", "a,b", *more)
    assert not (tmp_path / "o").exists() and scratch_tables(spark) == before


def test_buckets_up_to_seven_hundred_rows_link_and_no_cap_links_all(spark, tmp_path):
    same = [(f"a/{i}.jpg", "ab"[i % 2], "s", "0123456789abcdef") for i in range(600)]
    frame = manifest.labelled(manifest.training_frame(spark.createDataFrame(same, "new_path string, class string, pseudo_source string, phash string")), ["a", "b"])
    assert evaluate.labelled_groups(frame).select("dup_group").distinct().count() == 1
    more = frame.unionByName(frame.limit(200).withColumn("path", F.concat(F.lit("x"), "path")))
    assert evaluate.labelled_groups(more).select("dup_group").distinct().count() == 800
    assert evaluate.labelled_groups(more, None).select("dup_group").distinct().count() == 1


def test_folds_record_and_options(spark, tmp_path):
    m = manifest_at(spark, tmp_path / "m", rows_of(240, per_hash=2))
    split(m, tmp_path / "o", "--classes", "a,b", "--kfold", 3, "--balanced", "--no-cap")
    parts = spark.read.option("header", True).csv(str(tmp_path / "o/splits")).collect()
    folds = spark.read.option("header", True).csv(str(tmp_path / "o/folds")).collect()
    test = {r.path for r in parts if r.split == "test"}
    for k in range(3):
        assert {r.path for r in folds if r.fold == k and r.role == "test"} == test
    assert sorted(r.path for r in folds if r.role == "val") == sorted(r.path for r in parts if r.split != "test")
    groups = {}
    for r in folds:
        groups.setdefault((r.fold, r.dup_group), set()).add(r.role)
    assert all(len(g) == 1 for g in groups.values())
    run = results.read_run(spark, str(tmp_path / "o/run.json")).first()
    assert run.args["kfold"] == "3" and run.args["no_cap"] == "True" and run.environment["seed"] == "42" and run.timestamp
    assert sum(run.split_sizes.values()) == 240 and {c: sum(n.values()) for c, n in run.class_counts.items()} == {"a": 120, "b": 120}
    assert all(run.split_sizes[s] == sum(n[s] for n in run.class_counts.values()) for s in splitting.SPLITS)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("images"), np.random.default_rng(2)
    for i in range(40):
        path = root / "ab"[i % 2] / f"{i:03d}.png"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(png(np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((4, 4, 1)))))
    (root / "a/broken.png").write_bytes(b"\x89PNG nothing")
    return root


def test_paths_are_repaired_and_missing_and_broken_files_dropped(spark, tree, tmp_path):
    rows = [(f"C:\\old\\{'ab'[i % 2]}\\{i:03d}.png", "ab"[i % 2], "s", f"{(i * 2654435761 * 97) % 2**64:016x}") for i in range(40)]
    rows += [("gone/a/none.png", "a", "s", "-"), ("a/broken.png", "a", "s", "-"), (f"{tree}/a/000.png", "a", "s", "-")]
    m = manifest_at(spark, tmp_path / "m", rows)
    with pytest.warns(UserWarning) as said:
        frame = evaluate.sound_frame(spark, m, str(tree), ["a", "b"])
    assert [str(w.message).split(",")[0] for w in said if w.category is UserWarning] == ["1 rows without a file", "1 files that can't be decoded"]
    paths = [r.path for r in frame.collect()]
    assert len(paths) == len(set(paths)) == 40 and all(p.startswith("file:/") and p.endswith(".png") for p in paths)
    with pytest.warns(UserWarning, match="rows without a file"):
        assert evaluate.sound_frame(spark, m, str(tree), ["a", "b"], verify=False).count() == 41


def test_images_without_a_manifest(spark, tree, tmp_path):
    with pytest.warns(UserWarning) as said:
        split(tmp_path / "none.csv", tmp_path / "o", "--classes", "a,b", "--root", tree)
    assert {w.split(":")[0].split(",")[0] for w in map(lambda w: str(w.message), said)} >= {"no manifest", "1 files that can't be decoded", "0.0% of the hashes are valid"}
    assert spark.read.option("header", True).csv(str(tmp_path / "o/splits")).count() == 40
    with pytest.raises(FileNotFoundError):
        split(tmp_path / "none.csv", tmp_path / "p", "--classes", "a,b")
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="zzz"):
        split(tmp_path / "none.csv", tmp_path / "p", "--classes", "a,b,zzz", "--root", tree)


def test_a_curation_that_died_goes_on_where_it_was(spark, tree, tmp_path, monkeypatch):
    before, calls = scratch_tables(spark), []
    groups = hamming.duplicate_groups
    monkeypatch.setattr(hamming, "duplicate_groups", lambda *a, **b: calls.append(1) or groups(*a, **b))
    args = [str(tree), str(tmp_path / "out"), "--apply", "--min-side", "10", "--blur", "0"]
    with monkeypatch.context() as broken:
        broken.setattr(curate, "resolved", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            curate.main(args)
    assert len(calls) == 1 and {os.path.basename(p).rsplit("-", 1)[-1] for p in scratch_tables(spark) - before} == {"profiled", "grouped"}
    with monkeypatch.context() as broken:
        broken.setattr(manifest, "write_csv", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            curate.main(args)
    assert len(calls) == 1 and os.listdir(tmp_path) == []
    curate.main(args)
    assert len(calls) == 1 and scratch_tables(spark) == before
    assert os.listdir(tmp_path) == ["out"] and len(glob.glob(str(tmp_path / "out/*/*.png"))) == 40
    with pytest.raises(FileExistsError):
        curate.main(args)
    assert shared.fingerprint(spark, str(tree)) == shared.fingerprint(spark, str(tree))
    (tree / "b/extra.png").write_bytes(b"x")
    changed = shared.fingerprint(spark, str(tree))
    os.remove(tree / "b/extra.png")
    assert changed != shared.fingerprint(spark, str(tree))


def test_files_are_all_there_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i % 3}/{i:02d}.bin", bytes([i]) * i) for i in range(20)] + [("c0/empty.bin", None)], "new_path string, content binary").repartition(5)
    file_sink.write_files(rows.withColumn("extra", F.lit(1)), f"file://{tmp_path}/t")
    assert {p.relative_to(tmp_path / "t").as_posix(): p.read_bytes() for p in (tmp_path / "t").rglob("*.bin")} == {r.new_path: bytes(r.content or b"") for r in rows.collect()}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["c0", "c1", "c2"]
    late = rows.withColumn("content", F.when(F.col("new_path") == "c1/19.bin", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    for bad in (late, rows.unionByName(rows.limit(1)), rows.withColumn("new_path", F.concat(F.lit("../"), "new_path"))):
        with pytest.raises(Exception):  # noqa: B017
            file_sink.write_files(bad, str(tmp_path / "u"))
        assert not list((tmp_path / "u").rglob("*.bin")) and not list((tmp_path / "u").glob("_staged*"))
    file_sink.write_files(rows.limit(0), str(tmp_path / "v"))


def test_a_task_that_ran_twice_leaves_no_double(tmp_path):
    import pyarrow as pa

    writer = file_sink.FileWriter(str(tmp_path / "w"), "r")
    batch = pa.RecordBatch.from_pydict({"new_path": ["a/1", "a/2"], "content": [b"x", b"y"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.files != kept.files and not (tmp_path / "w/a").exists()
    writer.commit([kept, None])
    assert sorted(p.relative_to(tmp_path / "w").as_posix() for p in (tmp_path / "w").rglob("*")) == ["a", "a/1", "a/2"]


def test_zip_entries_are_read_by_ranges(spark, tmp_path):
    rng, made = np.random.default_rng(1), {}
    kinds = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.mkdir("folder")
        for i in range(3000):
            made[f"folder/{i} é.bin"] = rng.bytes(int(rng.integers(0, 300))) * int(rng.integers(1, 4))
            z.writestr(zipfile.ZipInfo(f"folder/{i} é.bin"), made[f"folder/{i} é.bin"], kinds[i % 4])
    data = bytearray((tmp_path / "big.zip").read_bytes())
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entry = z.getinfo("folder/8 é.bin")
    data[entry.header_offset + 30 + len("folder/8 é.bin".encode()) + 3] ^= 255
    (tmp_path / "spoilt.zip").write_bytes(data)
    (tmp_path / "cut.zip").write_bytes(data[: len(data) // 2])
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    tasks = archives.zip_entries(spark, str(tmp_path), range_bytes=50_000).withColumn("task", F.spark_partition_id())
    rows = tasks.collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r.archive), {})[r.name] = r
    assert {k: len(v) for k, v in by.items()} == {"big.zip": 3000, "spoilt.zip": 3000, "cut.zip": 1, "bad.zip": 1}
    assert all(r.error is None and bytes(r.content) == made[n] for n, r in by["big.zip"].items())
    assert [n for n, r in by["spoilt.zip"].items() if r.error] == ["folder/8 é.bin"] and by["bad.zip"][None].error and by["cut.zip"][None].error
    assert len({r.task for r in by["big.zip"].values()}) >= 4
