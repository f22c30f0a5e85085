"""Near duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import repeats, setsketch


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(texts, k, percent):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def copies(seed, families=12, size=14, words=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, words, 3 * words]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 15))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(make, awkward, k, percent):
    texts = [*awkward, *copies(k)]
    got = {r.doc_id: r for r in setsketch.near_duplicates(make(texts), shingle=k, percent=percent).collect()}
    label, sizes = components(texts, k, percent)
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (label[i] == i) for i in got)


def test_many_near_copies_in_small_blocks(make, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    texts = copies(9, families=2, size=60, words=120)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(make(texts), shingle=3, percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 3, 85)[0]


def boilerplate(seed, families, shared=45, own=25, size=3):
    """Small families of near copies, all of which begin with the same words."""
    rng = random.Random(seed)
    head, out = [f"h{i}" for i in range(shared)], []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(own)]
        for _ in range(rng.randint(1, size)):
            body = list(base)
            for _ in range(rng.randint(0, 2)):
                body[rng.randrange(own)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(head + body))
    return out


def test_buckets_of_many_small_components_are_split_by_a_second_band(spark, make, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    monkeypatch.setattr(setsketch, "AT_ONCE", 5)
    texts = [*boilerplate(4, 90), *copies(3, families=2, size=20)]
    label = components(texts, 3, 85)[0]
    sent, rows = setsketch._sent, {}

    def counted(*a):
        out = sent(*a)
        rows.setdefault(setsketch.OUTSIDERS, []).append(out.join(a[0].select("bucket").distinct(), "bucket", "left_anti").count())
        return out

    monkeypatch.setattr(setsketch, "_sent", counted)
    for outsiders in (4096, 6):
        monkeypatch.setattr(setsketch, "OUTSIDERS", outsiders)
        got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(make(texts), shingle=3, percent=85).collect()}
        assert [got[i] for i in range(len(texts))] == label
    assert rows[4096][0] == 0 < rows[6][0]


def test_results_do_not_depend_on_which_buckets_are_split(spark, make, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    # One band of one register: no two documents share a second bucket.
    monkeypatch.setattr(setsketch, "layout", lambda *a: (1, 1))
    texts = [*boilerplate(4, 90), *copies(3, families=2, size=20)]
    got = {}
    for outsiders in (4096, 3):
        monkeypatch.setattr(setsketch, "OUTSIDERS", outsiders)
        got[outsiders] = {r.doc_id: r.component_id for r in setsketch.near_duplicates(make(texts), shingle=3, percent=85).collect()}
    assert got[3] == got[4096]
    assert len(set(got[3].values())) < len(texts)


def test_rows_without_an_id_or_with_the_same_one(spark):
    a, b, c = ("one two three four five six seven eight nine", "red green blue black white grey pink brown teal", "no other text has any of these words in it")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, None), (4, ""), (4, "")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert len(got) == len(rows)
    by = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got)
    # Each row of 2 goes by its own text.
    assert by == sorted([(1, 7, 1, True), (2, 7, 1, False), (2, 7, 2, True), (3, 7, 2, False), (0, 7, 1, True), (0, 8, 0, True), (0, 0, 0, True), (4, 0, 4, True), (4, 0, 4, True)])
    long = "".join(chr(97 + i * 7 % 26) for i in range(150))
    rows = [(1, "x" + long), (1, long + "y"), (None, long), (None, None), (2, "short")]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 130)
    want = [(i, *r) for (i, _), r in zip(rows, removed([t for _, t in rows], 130), strict=True)]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).digest()) for r in out.collect()) == sorted((w[0] or 0, *w[1:]) for w in want)


def test_nothing(make):
    assert setsketch.near_duplicates(make(["x"]).limit(0)).count() == 0
    assert repeats.without_repeats(make(["x"]).limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 200))
    one = lambda s: setsketch.sketches(np.unique(s), np.zeros(len(np.unique(s)), np.int64), 1, 252)[0]
    union = np.concatenate([a, b])
    assert (np.maximum(one(a), one(b)) == one(union)).all()
    x, y = one(a).astype(int), one(union).astype(int)
    counts = [np.array([c]) for c in ((x > y).sum(), (x < y).sum(), (x == y).sum())]
    assert abs(setsketch.likeliest(*counts, np.array([300.0]), np.array([500.0]))[0] - 0.6) < 0.12
    bands, rows = setsketch.layout(0.85)
    assert (1 - 0.85**rows) ** bands < 1e-5


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~cover]) if d else b""
        out.append((len(d), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).digest()))
    return out


def passages(seed, n=40, length=150):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdef ghé") for _ in range(k))
    shared = [text(rng.randint(length - 20, 3 * length)) for _ in range(5)]
    out = []
    for _ in range(n):
        own = text(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            lo = rng.randint(0, 40)
            own += p[lo:] + text(rng.randint(0, 200))
        out.append(own)
    return [*out, "ab" * 400, "a" * 1000, out[0], None, ""]


@pytest.mark.parametrize("group", [8192, 3])
def test_repeats_equal_brute_force(make, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SHARD", 4)
    texts = passages(group)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(make(texts), 150, keep_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 150)


def test_awkward_texts_and_kept_bytes(make, awkward):
    got = {r.doc_id: r for r in repeats.without_repeats(make(awkward), 400).collect()}
    expected = removed(awkward, 400)
    for i, t in enumerate(awkward):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, hashlib.sha256(bytes(got[i].kept)).digest()) == expected[i]


def test_shard_transforms_merge_like_a_sort():
    rng = np.random.default_rng(2)
    bodies = [bytes(rng.integers(97, 99, 140, dtype=np.uint8)) for _ in range(60)]
    bodies += [b[:130] + b"x" * 10 for b in bodies[:20]]
    starts, before = np.full(len(bodies), 141 - 130), np.full(len(bodies), 20)
    group = np.zeros(len(bodies), np.int64)
    got = repeats.repeated_starts(group, before, starts, bodies, 130)
    for i, b in enumerate(bodies):
        for s in range(11):
            assert got[i][s] == any(o[s : s + 130] == b[s : s + 130] for k, o in enumerate(bodies) if k != i)
