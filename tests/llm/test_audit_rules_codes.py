"""Filter audit, adaptive quality rules and vector codes against plain versions."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import filter_audit, quality_rules, va_codes

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        if name in tables:
            con.register(name, tables[name])
        else:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con.sql(sql).df()


def same(spark_df, pdf):
    got = spark_df.toPandas()[sorted(pdf.columns)]
    key = lambda t: sorted(repr(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in t.itertuples(index=False, name=None))
    return key(got) == key(pdf[sorted(pdf.columns)]) and len(got) == len(pdf)


# Filter audit


def audited(rows, names, losses):
    """rows: (part, failing names, lost names); the plain audit, order by order and row by row."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations(names):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), *(sum(x in r[2] for r in gone) for x in losses), f]
        for key, v in out.items():
            if key[0] == part:
                v.insert(-1, total[v[-1]])
    return out


def test_audit_of_any_conditions(spark):
    rng = np.random.default_rng(5)
    raw = [(None if i % 9 == 0 else "ab"[i % 2], *[None if x == 2 else bool(x) for x in rng.choice([0, 1, 2], 4, p=[0.6, 0.3, 0.1])], bool(i % 3), 1, 2) for i in range(150)]
    df = spark.createDataFrame(raw, "part string, w boolean, x boolean, y boolean, z boolean, lost boolean, n int, state int").repartition(4)
    got = filter_audit.interaction_audit(df, {c: F.col(c) for c in "wxyz"}, {"lost": F.col("lost")})
    rows = [(r[0] or "", {c for c, v in zip("wxyz", r[1:5], strict=True) if v}, {"lost"} if r[5] else set()) for r in raw]
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.lost_lost, r.shapley, r.filter] for r in got.collect()} == audited(rows, "wxyz", ["lost"])
    assert filter_audit.interaction_audit(df.limit(0), {c: F.col(c) for c in "wx"}, {}).count() == 0
    one = filter_audit.interaction_audit(df, {"w": F.col("w")}, {}).collect()
    assert {(r.part, r.unique_fails, r.shapley) for r in one} == {(p, n, n) for p in ("", "a", "b") for n in [sum("w" in r[1] for r in rows if r[0] == p)]}
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(df, {f"f{i}": F.col("w") for i in range(8)}, {})


def test_frames_are_shared_and_let_go(spark, monkeypatch):
    held, most = [0], [0]
    frame = type(spark.range(1))
    for name, step in (("persist", 1), ("unpersist", -1)):

        def counted(self, *a, f=getattr(frame, name), step=step, **b):
            held[0] += step
            most[0] = max(most[0], held[0])
            counted.calls = getattr(counted, "calls", 0) + 1
            made.append(step)
            return f(self, *a, **b)

        monkeypatch.setattr(frame, name, counted)
    made = []
    rows = spark.range(40).select(F.lit("p").alias("part"), *[(F.col("id") % k == 0).alias(f"f{k}") for k in (2, 3, 5)])
    filter_audit.counted_edges(rows, {f"f{k}": F.col(f"f{k}") for k in (2, 3, 5)}, {})
    assert made.count(1) == made.count(-1) == 7 and most[0] == 3


def failing(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    flags = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": copy}
    return {k for k, v in flags.items() if v}


def test_audit_of_awkward_documents(spark, awkward):
    texts = [*awkward, "A#b " * 60, "a\x0bb c d " * 30, awkward[7]]
    docs = [(i, t, "en", None if i % 5 == 0 else "s", 0, "x", 7, 9) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 0, "x", 7, 9), (3, texts[3], "en", "s", 0, "x", 7, 9)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (99, 1, 1), (None, 1, 1), (6, 0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, part string, n_words long, copy_of long")
    got = filter_audit.audited_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    first = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(first.get(d[1] or "", 1 << 60), d[0])
    said = {1: {"good", "toxic"}, 6: {"toxic"}}
    rows = [(d[3] or "", failing(d[1] or "", d[0] is not None and first[d[1] or ""] < d[0]), said.get(d[0], set())) for d in docs]
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley, r.filter] for r in got.collect()} == audited(rows, "ABCDE", ["good", "toxic"])
    assert filter_audit.audited_documents(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@has_tables
def test_op11(spark):
    assert same(filter_audit.op11_permutation_trie_audit(spark, SF), by_sql(filter_audit.ORACLE))


# Quality rules


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)]


MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def test_measures_of_any_text(make, awkward):
    rng = np.random.default_rng(4)
    some = ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "<", "cé", "\t", "\x0c", "\U0001f600", " ", "\x1c"], rng.integers(0, 90))) for _ in range(300)]
    texts = [*awkward, *some, "a " * 7, "a b c d e a b c d e", "a b c d e x b c d e f", "1 2 3 4 5 6 " * 3, "\n\n x\n x\nx \n\r\n\r\n"]
    got = {r.doc_id: r for r in quality_rules.measures(make(texts)).collect()}
    for i, t in enumerate(texts):
        assert [got[i][c] for c in MEASURED] == measured(t or ""), repr(t)[:80]


def test_buckets_are_narrow_and_in_order(spark):
    values = [*range(300), *(2**k + d for k in range(9, 40) for d in (-1, 0, 1, 2**k // 3))]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality_rules.bucket(F.col("v")))
    lo, hi = quality_rules.bucket_ends(F.col("b"))
    rows = df.select("v", "b", lo.alias("lo"), hi.alias("hi")).orderBy("v").collect()
    assert all(r.lo <= r.v <= r.hi and r.hi - r.lo <= r.v / 32 for r in rows)
    assert all(a.b <= b.b and (a.b == b.b) == (b.v <= a.hi) for a, b in zip(rows, rows[1:], strict=False))


def test_sketches_merge_and_groups_without_documents_take_their_languages(spark):
    rng = np.random.default_rng(6)
    text = lambda n, junk: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) + ("#$%" if junk and rng.random() < 0.7 else "") for _ in range(n))
    docs = [(i, text(40, i % 10 == 0), "en", "big" if i < 150 else f"s{i % 7}") for i in range(220)]
    docs += [(500, text(40, False), "xx", "one"), (501, text(40, True), None, None), (502, None, None, None), (503, "", "en", "none"), (504, "w" * 30 + " " + text(8, False) + " x", "en", "big"), (None, text(40, False), "en", "big")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, source string, cuts int, n int").repartition(5)
    rows = quality_rules.measures(df)
    own = quality_rules.sketches(rows)
    parts = quality_rules.merged(quality_rules.sketches(rows.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(rows.where("NOT coalesce(doc_id % 2 = 0, false)"))), ["lang", "source"])
    assert sorted(map(repr, own.select(parts.columns).collect())) == sorted(map(repr, parts.collect()))
    levels = {(r.lang, r.source): (r.level, r.n_docs) for r in quality_rules.adaptive_cutoffs(rows).collect()}
    assert levels["en", "big"] == ("source", 152) and levels["en", "s3"][0] == "lang" and levels["xx", "one"] == ("all", 1) and levels[None, None] == ("all", 1)
    out = quality_rules.judged(df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs) and all(got[i].kept == (i % 10 > 0) for i in range(220))
    assert got[None].kept and got[500].kept and not got[501].kept and "symbols" in got[501].failed
    assert got[502].base_failed and got[503].base_failed and not got[502].kept and not got[504].base_failed
    assert quality_rules.judged(df.limit(0)).count() == 0


@has_tables
def test_op12(spark):
    assert same(quality_rules.op12_adaptive_quality_rules(spark, SF), by_sql(quality_rules.ORACLES["op12_adaptive_quality_rules"]))
    rows = {r.doc_id: r for r in quality_rules.op12_adaptive_quality_rules(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r, m = rows[d.doc_id], measured(d.text or "")
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [*m[:3], *m[4:]]
        assert r.base_failed == (m[0] < 10 or 100 * m[5] > 20 * m[0]) and not (r.base_failed and r.kept)


# Vector codes


def plain_codes(vectors, ids, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks, distance by distance."""
    first = sorted((i, v) for i, v in zip(ids, vectors, strict=True) if i is not None)[:entries]
    width = len(vectors[0]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = defaultdict(list)
            for v in vectors:
                own[near(cut(v)[p], book)[1]].append(cut(v)[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(book)])
        books = new
    found = [[near(x, b) for x, b in zip(cut(v), books, strict=True)] for v in vectors]
    return [bytes(k for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_nearest_entries_are_exact_and_few_are_looked_at():
    rng = np.random.default_rng(8)
    for k, width, spread in ((64, 4, 60), (64, 4, 1), (1, 4, 9), (5, 2, 3), (200, 8, 300), (64, 1, 40), (3, 0, 1)):
        entries = np.round(rng.normal(0, spread, (k, width))).astype(np.int64)
        queries = np.concatenate([np.round(rng.normal(0, spread * 1.5, (500, width))).astype(np.int64), entries, np.full((1, width), -900)])
        cells = va_codes.Cells(entries)
        exact = ((queries[:, None] - entries[None]) ** 2).sum(2)
        low, high = cells.bounds(queries)
        assert (low <= exact).all() and (exact <= high).all()
        best, distance = cells.nearest(queries)
        assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        if spread == 60:
            assert cells.candidates(queries).mean() < 0.35


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(9)
    good = [(int(i), [float(x) for x in rng.normal(0, 0.3, 32).astype(np.float32)]) for i in rng.permutation(150)]
    good += [(7, good[0][1]), (None, good[1][1]), (None, [-1.0] * 32), (3, [0.5 / 256] * 32), (900, [-1e-9] * 32)]
    bad = [(1000, None), (-1, [math.nan] + [0.0] * 31), (-2, [math.inf] * 32), (-3, [None] * 32), (1001, [1.0] * 16), (1002, [])]
    rows = [(i, v, None if k % 4 == 0 else k % 3, 1, 2) for k, (i, v) in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code int, error int").repartition(5)
    codes, books = va_codes.compressed(df)
    ints = [[math.floor(256 * x) for x in v] for _, v in good]
    want = plain_codes(ints, [i for i, _ in good])
    assert books.tolist() == want[2]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.vec_id, bytes(r.code), r.error) for r in codes.collect()), key=key)
    assert got == sorted(((i, c, e) for (i, _), c, e in zip(good, want[0], want[1], strict=True)), key=key)
    back = {r.vec_id: r.approx for r in va_codes.decoded(codes.where("vec_id = 900"), books).collect()}[900]
    assert back == [(books[p][want[0][-1][p]][d] + 0.5) / 256 for p in range(16) for d in range(2)]
    for some in (df.limit(0), df.where("embedding IS NULL"), df.where("vec_id IS NULL")):
        assert va_codes.compressed(some)[0].count() == 0
    few, small = va_codes.compressed(df.where("vec_id IN (10, 11, 12)"), entries=256)
    assert small.shape == (16, 3, 2) and {r.error for r in few.collect()} == {0}
    empty, none = va_codes.compressed(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>").withColumn("label", F.lit("x")))
    assert [(bytes(r.code), r.error) for r in empty.collect()] == [(bytes(16), 0)] * 2 and none.shape == (16, 2, 0)
    with pytest.raises(Exception, match="64 bits"):
        va_codes.compressed(spark.createDataFrame([(1, [1e30] * 16, 0)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(ValueError):
        va_codes.compressed(df, entries=257)


@has_tables
def test_op13(spark):
    got = va_codes.op13_va_file_codes(spark, SF)
    assert same(got, by_sql(va_codes.ORACLES["op13_va_file_codes"]))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    code, error, books = plain_codes([[math.floor(256 * x) for x in r.embedding] for r in rows], [r.vec_id for r in rows])
    by_label = Counter()
    for r, e in zip(rows, error, strict=True):
        by_label[r.label] += e
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()} == {(r.vec_id, c.hex(), e, by_label[r.label], h) for r, c, e in zip(rows, code, error, strict=True)}
