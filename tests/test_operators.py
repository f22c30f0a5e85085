"""Golden cases, brute force and properties of the library's operators."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import hashes as words
from siftwell.functions.hashes import bits_lsb_first, hex_to_long, simhash, valid_hash
from siftwell.operators import clusters, conflicts, hamming, history, metrics, quality, sampling, splitting
from siftwell.operators.components import connected_components
from siftwell.plans import queries
from siftwell.sources import archives, images, manifest
from siftwell.sources.shared import written


def col(df, name):
    return sorted(r[name] for r in df.collect())


def test_hash_parsing_and_validity(spark):
    cases = ["ffffffffffffffff", "8000000000000001", "-", "0" * 15, "0" * 17, "0" * 15 + "\n", None]
    df = spark.createDataFrame([(c,) for c in cases], "phash string")
    got = df.select(valid_hash(F.col("phash")).alias("ok"), F.when(valid_hash(F.col("phash")), hex_to_long(F.col("phash"))).alias("h")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False, False]
    assert [got[0].h, got[1].h] == [-1, -(2**63) + 1]
    bits = spark.createDataFrame([(1,), (-(2**63),)], "h long").select(bits_lsb_first(F.col("h")).alias("b")).collect()
    assert bits[0].b == [1] + [0] * 63 and bits[1].b == [0] * 63 + [1]


def hashes(spark, values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else f"{v:016x}") for i, v in enumerate(values)], "doc_id long, phash string")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.doc_id)
    return sorted(map(sorted, out.values()))


def test_chain_links_beyond_the_threshold_and_bounds(spark):
    a = 0x0123456789ABCDEF
    b, c = a ^ 0b1111, a ^ 0b1111 ^ (0b1111 << 40)
    assert groups(hamming.duplicate_groups(hashes(spark, [a, b, c]))) == [[0, 1, 2]]
    five, six = a ^ 0b11111, a ^ (0b111111 << 30)
    assert groups(hamming.duplicate_groups(hashes(spark, [a, five, six]))) == [[0, 1], [2]]


def test_cap_and_invalid_hashes(spark):
    many = hashes(spark, [7] * 12 + ["-"])
    assert len(groups(hamming.duplicate_groups(many, cap=11))) == 13
    assert groups(hamming.duplicate_groups(many, cap=12)) == [list(range(12)), [12]]
    assert groups(hamming.duplicate_groups(many, cap=11, exact_first=True)) == [list(range(12)), [12]]
    upper = hashes(spark, ["ABCDEFABCDEFABCD", "abcdefabcdefabcd"])
    assert groups(hamming.duplicate_groups(upper)) == [[0, 1]]


@pytest.mark.parametrize("whole", [False, True])
def test_edges_equal_brute_force(spark, whole):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    values = base + [v ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 9), replace=False))) for v in base for _ in range(4)]
    got = {(r.a, r.b) for r in hamming.edges(hashes(spark, values), cap=None, whole=whole).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(values[i] ^ values[j]).count("1") <= 5}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, group_id long, cls string, min_side int, blur double")


def test_policies_ties_and_statistics(spark):
    rows = records(spark, [(1, 1, "a", 300, 9.0), (2, 1, "a", 300, 9.0), (3, 3, "a", 500, 1.0), (4, 3, "b", 400, 2.0), (5, 3, "b", 400, 3.0), (6, 6, "a", 1, 1.0)])
    assert col(conflicts.survivors(rows, "report"), "doc_id") == [1, 3, 5, 6]
    assert col(conflicts.survivors(rows, "keep_rarest"), "doc_id") == [1, 5, 6]
    assert col(conflicts.survivors(rows, "drop_all"), "doc_id") == [1, 6]
    s = conflicts.duplicate_stats(rows).first()
    assert (s.dup_within, s.n_conflicts, s.conflict_rows, s.dup_in_conflict) == (1, 1, 3, 2)
    with pytest.raises(ValueError):
        conflicts.survivors(rows, "other")


def test_quality_bounds_and_leaks(spark):
    df = spark.createDataFrame([(200, 25.0, "a"), (199, 99.0, "a"), (300, 24.9, "a"), (None, 30.0, "b")], "min_side int, blur double, cls string")
    assert quality.quality_filter(df).count() == 1
    assert {r.cls: r.n_rejected for r in quality.quality_rejects(df).collect()} == {"a": 2, "b": 1}
    sigs = [("x", "a")] * 90 + [("x", "b")] * 10 + [("y", "a")] * 99 + [("z", "a")] * 899 + [("z", "b")] * 101
    found = quality.leak_audit(spark.createDataFrame(sigs, "raw_sig string, cls string")).collect()
    assert [(r.raw_sig, r.n, r.top_cls, r.top_n) for r in found] == [("x", 100, "a", 90)]


def strata_rows(spark, sizes):
    rows = [(f"s{k}-{i}", f"s{k}", float(i)) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, stratum string, blur double")


def test_sample_is_exact_and_takes_the_sharp_pool(spark):
    for sizes, target in (([90, 10, 3], 50), ([5, 5, 5, 5], 10), ([2, 2], 9)):
        got = sampling.stratified_sample(strata_rows(spark, sizes), target).collect()
        assert len(got) == min(target, sum(sizes)) and len({r.doc_id for r in got}) == len(got)
    pool = sampling.stratified_sample(strata_rows(spark, [90, 90]), 124).collect()
    assert min(r.blur for r in pool) >= 90 - 62


def test_quotas_round_half_to_even(spark):
    q = {r.stratum: r.quota for r in sampling.strata_quota(strata_rows(spark, [5, 7, 8]), 10).collect()}
    assert q == {"s0": 2, "s1": 4, "s2": 4}


def test_weighted_draws(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    got = sampling.weighted_draw(rows, 1000, F.when(F.col("doc_id") < 10, 9.0).otherwise(1.0)).collect()
    assert sorted(r.draw for r in got) == list(range(1000))
    assert 450 < sum(r.doc_id < 10 for r in got) < 550


def split_rows(spark, n=600):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, int(rng.integers(0, 250)), int(rng.integers(0, 3)), f"src{int(rng.integers(0, 9))}") for i in range(n)], "doc_id long, group_id long, label int, source string")


def test_splits_are_disjoint_whole_and_near_their_shares(spark):
    rows = split_rows(spark)
    for split in (splitting.three_way(rows), splitting.holdout_split(rows)):
        got = split.collect()
        assert sorted(r.doc_id for r in got) == list(range(600))
        by_group = {}
        for r in got:
            by_group.setdefault(r.group_id, set()).add(r.split)
        assert all(len(s) == 1 for s in by_group.values())
        assert splitting.split_overlap(split).count() == 0
    share = splitting.three_way(rows).where("split = 'test'").count() / 600
    assert 0.08 < share < 0.22
    classes = metrics.labels_table(spark, 3)
    assert splitting.checked(splitting.three_way(rows), classes, id_col="doc_id").count() == 600
    with pytest.raises(ValueError):
        splitting.checked(splitting.three_way(rows), metrics.labels_table(spark, 4))
    folds = splitting.k_folds(rows, 4)
    assert folds.count() == 2400 and folds.where("role = 'val'").count() == 600


def test_holdout_prefix_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(label, f"s{s}") for label in range(6) for s in range(rng.integers(2, 9)) for _ in range(rng.integers(1, 40))]
    got = {(r.label, r.source) for r in splitting.source_holdout(spark.createDataFrame(rows, "label int, source string")).collect()}
    expected = set()
    for label in range(6):
        own = [s for k, s in rows if k == label]
        want, have = max(1, int(0.15 * len(own))), 0
        for s in sorted(set(own), key=lambda s: (own.count(s), s)):
            n = own.count(s)
            if have < want and n <= 0.5 * len(own) and (have == 0 or have + n <= 1.4 * want):
                expected.add((label, s))
                have += n
    assert got == expected


def predictions(spark, rows):
    return spark.createDataFrame([(i, y, p, max(q), f"s{i % 2}", q) for i, (y, p, q) in enumerate(rows)], "id long, label int, prediction int, conf double, source string, probs array<double>")


def test_absent_classes(spark):
    p = predictions(spark, [(0, 0, [0.9, 0.1, 0.0]), (1, 1, [0.2, 0.8, 0.0])])
    report = {r.name: r for r in metrics.classification_report(p, 3).collect()}
    assert report["2"].f1 == 0 and report["macro avg"].f1 == pytest.approx(2 / 3)
    assert metrics.macro_f1_observed(p, 3).first().macro_f1 == 1
    assert {r.what for r in metrics.confidence_summary(p).collect()} == {"all", "correct"}
    assert {r.threshold for r in metrics.confidence_sweep(p).collect()} == {0.5, 0.6, 0.7, 0.8, 0.9}
    assert metrics.confusion_matrix(p, 3).agg(F.sum("n")).first()[0] == 2


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(120):
        q = np.round(rng.dirichlet([1, 1, 1]), 1)
        rows.append((int(rng.integers(0, 3)), int(q.argmax()), [float(x) for x in q]))
    got = {r.cls: r.auc for r in metrics.auc(predictions(spark, rows), 3).collect()}
    for c in range(3):
        pos, neg = [q[c] for y, _, q in rows if y == c], [q[c] for y, _, q in rows if y != c]
        assert got[c] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert 0 <= metrics.macro_auc(predictions(spark, rows), 3).first().auc <= 1


def test_early_stop_and_gaps(spark):
    rows = [(0, 0.9, True), (1, 0.1, True)] + [(i, 0.5, False) for i in range(2, 14)]
    got = history.best_epoch_early_stop(spark.createDataFrame(rows, "epoch int, val_macro_f1 double, frozen boolean")).collect()
    assert [r.epoch for r in got if r.stop] == [9] and [r.epoch for r in got if r.improved] == [0]
    with pytest.raises(ValueError):
        history.history_concat(spark.createDataFrame([(2, 0)], "stage int, epoch int"))


def test_lloyd_keeps_the_centre_of_an_empty_cluster(spark):
    rows = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [10.0])], "id long, features array<double>")
    start = spark.createDataFrame([(0, [0.0]), (1, [9.0]), (2, [99.0])], "cluster int, centre array<double>")
    assert {r.cluster: r.centre for r in clusters.lloyd(rows, start, 1).collect()} == {0: [1.0], 1: [10.0], 2: [99.0]}
    assert clusters.cluster_count(39) == 1 and clusters.cluster_count(40) == 2 and clusters.cluster_count(10**6) == 20


def test_manifest_round_trip_with_byte_order_mark(spark, out_dir):
    with open(f"{out_dir}/m.csv", "wb") as f:
        f.write("﻿class,new_path,orig_path,subclass,pseudo_source,width,height,vcluster,blur,phash,qsig\na,a/0.png,x.png,,misc,1,2,,3.5,0123456789012345,na\n".encode())
    frame = manifest.training_frame(manifest.read_manifest(spark, f"{out_dir}/m.csv")).first()
    assert (frame.path, frame.class_dir, frame.source, frame.vcluster, frame.phash) == ("a/0.png", "a", "misc", "-", "0123456789012345")


def ppm(x):
    return b"P6 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.astype(np.uint8).tobytes()


def test_image_tree(spark, out_dir, tmp_path):
    rng = np.random.default_rng(6)
    picture = np.kron(rng.integers(0, 255, (16, 16, 3)), np.ones((20, 20, 1)))
    for name, data in {"a/sub/x.PPM": ppm(picture), "a/y.ppm": ppm(picture[::2, ::2]), "b/z.ppm": b"P6 9 9", "b/note.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    seen = images.scan(spark, out_dir, ("ppm",))
    rows = {r.path.rpartition("/")[2]: r for r in images.profiled(seen).collect()}
    assert set(rows) == {"x.PPM", "y.ppm", "z.ppm"} and rows["z.ppm"].error and not rows["x.PPM"].error
    assert rows["x.PPM"].subclass == "sub" and rows["y.ppm"].subclass == "-" and rows["x.PPM"].cls == "a"
    assert bin(int(rows["x.PPM"].phash, 16) ^ int(rows["y.ppm"].phash, 16)).count("1") <= 5
    assert images.sound(seen).count() == 2


def test_quantization_signature():
    table = bytes([0]) + bytes(range(1, 65))
    jpeg = b"\xff\xd8\xff\xdb" + (2 + len(table)).to_bytes(2, "big") + table + b"\xff\xda\0\0"
    import hashlib

    assert images.quantization_signature(jpeg) == hashlib.md5(",".join(map(str, range(1, 17))).encode()).hexdigest()[:6]
    assert images.quantization_signature(b"P6") == "na"


def test_zip_entries(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/a.txt", "hello")
    (tmp_path / "good.zip").write_bytes(buffer.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    got = archives.zip_entries(spark, str(tmp_path)).collect()
    assert sorted((r.name or "", bytes(r.content or b""), bool(r.error)) for r in got) == [("", b"", True), ("d/a.txt", b"hello", False)]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("Acne-1.jpg",), ("ISIC_9.png",), ("cutaneous-x",), ("other",)], "n string")
    assert [r[0] for r in df.select(manifest.class_of_name(F.col("n"))).collect()] == ["acne", "melanoma", "bites", None]


def test_numbers_of_seven_digits_stay_whole(spark):
    rows = spark.range(1_000_002).select(F.lit("c").alias("cls"), F.format_string("%08d.TXT", "id").alias("path"))
    got = {r.path: r.new_path for r in manifest.numbered(rows).where("path IN ('00000007.TXT', '00100000.TXT', '01000000.TXT', '01000001.TXT')").collect()}
    assert sorted(got.values()) == ["c/000007.txt", "c/100000.txt", "c/1000000.txt", "c/1000001.txt"]


def test_exact_join_has_no_cap(spark, split=8):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2**20, 6)]
    values = base + [v ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 8), replace=False))) for v in base for _ in range(12)] + [base[0]] * 30
    pairs = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if 0 < bin(values[i] ^ values[j]).count("1") <= 5}
    got = {(r.a, r.b) for r in hamming.exact_edges(hashes(spark, values), split=split).collect()}
    assert got == {(i, j) for i, j in pairs if values.index(values[i]) == i and values.index(values[j]) == j}
    same = hashes(spark, [7] * 600 + [7 ^ 1 << 40] + ["-"])
    assert groups(hamming.exact_groups(same, split=split)) == [list(range(601)), [601]]
    assert len(groups(hamming.duplicate_groups(same))) > 2


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _near_pairs():
    return [int(v) ^ flip for v in np.random.default_rng(5).integers(0, 1 << 62, 1500) for flip in (0, 1)]


def test_dealt_rows_of_links_are_shuffled_once_and_not_broadcast(spark, monkeypatch):
    """Each hash is dealt as 66 rows, which Spark takes for one when it chooses a join."""
    monkeypatch.setattr(hamming, "DEALT", 256, raising=False)
    plan = _final_plan(hamming.exact_edges(hashes(spark, _near_pairs())))
    assert "SortMergeJoin" in plan and "ReusedExchange" in plan and "Broadcast" not in plan


def test_dealt_rows_of_groups_are_shuffled_once(spark):
    rows = hashes(spark, _near_pairs()).select(hex_to_long(F.col("phash")).alias("h")).distinct()
    assert _final_plan(hamming._stars(rows, 5)).count("Generate posexplode") == 1


def test_groups_without_cap_take_few_links(spark, monkeypatch):
    """All hashes that differ in ten bits: 326,144 pairs are near, and the groups need less than an eighth of these as links."""
    seen = []

    def counted(edges, *ends):
        seen.append(edges.count())
        return connected_components(edges, *ends)

    monkeypatch.setattr(hamming, "connected_components", counted)
    got = groups(hamming.exact_groups(hashes(spark, [*range(1024), 1 << 40 | 0x3F << 20])))
    assert got == [list(range(1024)), [1024]]
    assert 1024 <= sum(seen) < 326_144 / 8, seen


@pytest.mark.parametrize("threshold", [1, 2, 5, 7])
def test_exact_join_of_other_thresholds(spark, threshold, split=4):
    rng = np.random.default_rng(threshold)
    base = [int(x) for x in rng.integers(0, 2**63, 5, dtype=np.uint64) * 2 + 1]
    values = list(dict.fromkeys(base + [v ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 10), replace=False))) for v in base for _ in range(8)]))
    near = sorted((i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := bin(values[i] ^ values[j]).count("1")) <= threshold)
    got = [tuple(r) for r in hamming.exact_edges(hashes(spark, values), threshold, split=split).collect()]
    assert sorted(got) == near
    label = list(range(len(values)))
    for _ in values:
        for i, j, _d in near:
            label[i] = label[j] = min(label[i], label[j])
    want = {i: x for i, x in enumerate(label)}
    assert {r.doc_id: r.group_id for r in hamming.exact_groups(hashes(spark, values), threshold, split=split).collect()} == want


def test_report_lines_round_what_is_stored(spark):
    """0.12315 is stored as a little less, 0.03125 exactly, which goes to the even digit."""
    from siftwell.sources import results

    r = spark.createDataFrame([("3", 0.12315, 0.03125, 1.0, 7), ("macro avg", 0.00005, 0.99995, 0.28125, 20)], "name string, precision double, recall double, f1 double, support long")
    got = [x.value for x in results.report_lines(r).orderBy("at").collect()]
    assert got == ["%-16s%12.4f%12.4f%12.4f%12d" % tuple(x) for x in r.collect()] and "0.1231" in got[0]


def test_measures_of_words_in_one_pass(spark):
    """As by ``simhash`` and Spark's array functions: spaces only end words, case is Spark's, and what is held or split at once changes nothing."""
    texts = [None, "", "   ", "a", "a a b", "\ta\nb  c", "\u0130\u00c9 \u03a3\u03a3 \u03a3", "x" * 200 + " y " + "x" * 200, " ".join(f"W{i % 9000}" for i in range(20_000)), "a b " * words.PIECE]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    each = docs.withColumn("w", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), ""))
    hashed = simhash(each.select("id", F.explode("w").alias("token")), "id", "token")
    want = each.select("id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d")).join(hashed, "id", "left").na.fill("0" * 16, ["phash"])
    got = words.word_hashes(docs)
    assert got.columns == ["id", "n_words", "n_distinct", "phash"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "n", "d", "phash").collect()))


@pytest.mark.parametrize("exact", [True, False])
def test_groups_of_filtered_rows_read_each_text_once(spark, monkeypatch, exact):
    seen = []

    def counted(df, tag):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("text:string"))
        return written(df, tag)

    monkeypatch.setattr(queries, "written", counted)
    monkeypatch.setattr(hamming, "written", counted)
    queries.grouped(spark, "/root/testdata/sf0.001", exact)
    assert sum(seen) == 1, seen
