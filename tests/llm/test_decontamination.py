"""Benchmark decontamination against a plain version of all its ways, window by window."""

import os
import random
from collections import Counter, defaultdict

import pytest
import regex

from siftwell.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def tokens(text, opening):
    """Lower-case words and slots with their values."""
    s = regex.sub(r"\s+", " ", regex.sub(D.RESERVED, " ", text or ""))
    for pattern, slot in D.RULES:
        s = regex.sub(pattern, rf"\1<{slot}=\2>", s)
    if opening:
        s = regex.sub(D.OPENING, r"\1<name=\2>", s)
    return regex.findall(D.TOKEN, s.lower())


def bare(v):
    return tuple(regex.sub("=[^>]*>", "=>", t) for t in v)


def windows(v):
    """(place, template, valued) of each window, from place 1."""
    return [(i + 1, bare(v[i : i + 5]), tuple(v[i : i + 5])) for i in range(len(v) - 4)]


def judged(met, n_windows):
    """(n_found, n_slots, n_consistent, same) of distinct (template, valued, doc_valued), or None."""
    found = len({t for t, _, _ in met})
    if found < 0.8 * n_windows:
        return None
    by = defaultdict(Counter)
    for _, own, other in met:
        for a, b in zip(own, other, strict=True):
            if a.startswith("<"):
                by[a][b] += 1
    slots, best, same = (sum(f(a, c) for a, c in by.items()) for f in (lambda _, c: sum(c.values()), lambda _, c: max(c.values()), lambda a, c: c[a]))
    return (found, slots, best, same) if best >= 0.8 * slots else None


def occurrence(placed, n_windows, length):
    """The best place where the item could start: each of its windows with its nearest counterpart at most the item's length away."""
    best = None
    for start in {p - q for q, _, _, p, _ in placed}:
        near = {}
        for q, template, valued, p, other in placed:
            away = abs(p - q - start)
            if away <= length:
                near[q, template, valued] = min(near.get((q, template, valued), (1 << 60,)), (away, p - q, other))
        # One row for each window of the item: repeated ones count as often.
        rows = [(t, v, m[2]) for (_, t, v), m in near.items()]
        found = judged(rows, n_windows)
        if found:
            key = (found[0], found[2] - found[1], found[3], -start, found[1], found[2])
            best = max(best, (key, found)) if best else (key, found)
    return best and best[1]


def plain(docs, items):
    """{(doc_id, item_id): (n_windows, n_found, n_slots, n_consistent, kind)}."""
    known = {}
    for name, text in items:
        for scheme in (0, 1):
            own = [(q, t, v) for q, t, v in windows(tokens(text, scheme)) if sum(not x.startswith("<") for x in t) >= D.LITERALS]
            if own:
                known.setdefault(name, {})[scheme] = own
    out = {}
    for doc, text in docs:
        v = [tokens(text, k) for k in (0, 1)]
        every = {t for x in v for _, t, _ in windows(x)}
        for name, item in items:
            if name not in known:
                own = tokens(item, 0)
                if own and own == v[0]:
                    slots = sum(t.startswith("<") for t in own)
                    out[doc, name] = (1, 1, slots, slots, "exact")
                continue
            ways = {}
            placed = {}
            for scheme, own in known[name].items():
                n, length = len({t for _, t, _ in own}), max(q for q, _, _ in own) + 4
                if len({t for _, t, _ in own} & every) < 0.8 * n:
                    continue
                rows = {(q, t, a, p, b) for q, t, a in own for p, s, b in windows(v[scheme]) if s == t}
                placed[scheme] = rows, n, length
                whole = judged({(t, a, b) for _, t, a, _, b in rows}, n)
                if whole:
                    ways[2 * scheme] = (n, *whole)
                verbatim = {(t, a, b) for _, t, a, _, b in rows if a == b}
                if len({a for _, a, _ in verbatim}) >= 0.8 * len({a for _, _, a in own}):
                    equal = judged(verbatim, n)
                    if equal:
                        ways[2 * scheme + 1] = (n, *equal)
            if not ways:
                for scheme, (rows, n, length) in placed.items():
                    found = occurrence(rows, n, length)
                    if found:
                        ways[4 + scheme] = (n, *found)
            if ways:
                n, found, slots, best, same = ways[min(ways)]
                out[doc, name] = (n, found, slots, best, "exact" if slots == same else "template")
    return out


def got(df):
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.n_slots, r.n_consistent, r.kind) for r in df.collect()}


ITEMS = [
    "Maria has 12 apples and gives 5 apples to Peter each day. How many apples are left after 2 days?",
    "A train travels 60 km in 45 minutes and then waits for 10 minutes. What is the average speed of the train in km?",
    "The shop of Anna sells pens for 3 dollars and books for 15 dollars. How much do 4 pens and 2 books cost at the shop of Anna?",
    "Peter runs to the lake and then Peter swims across the lake while Maria waits at the old boat house for Peter.",
    "What is 7 plus 8?",
    "Name the capital",
]


def changed(rng, text):
    """The question with other numbers and names, each replaced throughout or here and there."""
    names = {"Maria": "Olga", "Peter": "Hugo", "Anna": "Ines"}
    steady = rng.random() < 0.6
    numbers = {}

    def number(m):
        new = numbers.setdefault(m[0], str(rng.randint(2, 99)))
        return new if steady or rng.random() < 0.5 else str(rng.randint(100, 999))

    out = regex.sub("[0-9]+", number, text)
    return regex.sub("Maria|Peter|Anna", lambda m: names[m[0]] if steady or rng.random() < 0.5 else m[0], out)


def test_all_ways_equal_the_plain_version(spark):
    rng, prose = random.Random(17), "the old man went to see his house by the lake and then Bernd came in with 14 dogs . A cat of Clara saw them".split(" ")
    filler = lambda: " ".join(rng.choice(prose) for _ in range(rng.randint(0, 25)))
    docs = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(ITEMS)
            text = rng.choice([item, changed(rng, item), changed(rng, item)])
            words = text.split(" ")
            for _ in range(rng.randint(0, 2)):  # words put in or left out
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(prose)] * rng.randint(0, 1)
            parts += [filler(), " ".join(words)]
        docs.append((i, " ".join([*parts, filler()])))
    docs += [(900, None), (901, ""), (902, "What is 7 plus 8?"), (903, "what is 7 plus 8"), (904, "What is 9 plus 8?"), (905, ITEMS[0] + " " + changed(rng, ITEMS[0])), (906, "name the <capital>")]
    items = list(enumerate(ITEMS))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, template string").repartition(4)
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    have = got(D.contaminated(df, bench))
    assert have == want
    assert len(want) > 60 and {k for *_, k in want.values()} == {"exact", "template"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_op10(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(D.op10_template_decontamination(spark, SF)) == plain(docs, items)
