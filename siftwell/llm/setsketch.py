"""Near duplicates by SetSketch registers, banded, estimated by likelihood and verified.

A document's set is its distinct word shingles. Each of the sketch's registers keeps
the truncated, exponentially spaced minimum of exponential variables, one for each
shingle: registers of a union are maxima of registers, and two sets agree in a
register with a probability that grows with their similarity.

1. Equal sets become one class, which its least doc_id represents.
2. Bands of registers are hashed; representatives that share a band's hash meet.
3. Inside a band's bucket the similarity of two sketches is the likeliest one given how
   many registers are equal, greater and less, and given both set sizes. Sets of no more
   shingles than a sketch has registers are carried along and compared themselves.
4. Pairs that may pass are confirmed on full sets, in three rounds, each of which
   leaves out pairs that the rounds before have linked: each representative with
   its likeliest partner of lower id; the likeliest pair of each two components that
   meet; and at last every pair of different components.

So a group of n copies costs about n confirmations and not n squared, and yet no pair that
could join two components goes without one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import bucketed, released, remembered, slices, table, text_of, written
from siftwell.operators.components import connected_components

# Parameters of the sketch: spacing, rate and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair is confirmed if its estimate is below the threshold by less than so many standard deviations.
DEVIATIONS = 4.0
#: A band's bucket is looked at in blocks of about so many members.
BLOCK = 1024
#: Members outside of a bucket's largest component that are sent to all of its blocks; members of buckets with more meet by their rarest shingles.
OUTSIDERS = 4096
#: Members of sets that a matrix of theirs has columns for.
MEMBERS = 1024
#: Members that are compared with a block at a time, and rows of blocks that a task's group gets.
AT_ONCE, GROUP = 1024, 8192
#: Documents that one task compares with the same document.
CHUNK = 256
#: Distinct words that a worker remembers, and bytes of text that it works on at a time.
REMEMBERED, SLICE = 150_000, 1 << 22


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z in lower case. With
    fewer words than ``size`` the whole sequence is the one shingle; without words the
    set is empty.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(remembered("hashes of words", WordHashes).__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _MIX[0] + h[i : n - k + 1 + i])
    return np.unique(out)


def sketches(elements: np.ndarray, owner: np.ndarray, n_sets: int, registers: int) -> np.ndarray:
    """Registers (sets, registers) of hashed elements; every set holds at least one.

    An element's arrivals are a Poisson process with a random register for each, so its first
    arrivals in the registers are independent exponential variables. Arrivals are
    drawn in order and stop once none of them can lower a register of its set.
    """
    least = np.full((n_sets, registers), np.inf)
    flat = least.reshape(-1)
    state, at = elements.copy(), np.zeros(len(elements))
    step = 0
    while len(state):
        step += 1
        state = mixed(state + _MIX[0])
        # Forty bits for the waiting time, the other twenty-four for the register.
        at -= np.log1p(-((state >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40)) / registers
        spot = ((state & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, owner * registers + spot, at)
        if step < 4 or step % 4 == 0:
            live = np.unique(owner)
            limit = np.zeros(n_sets)
            limit[live] = least[live].max(1)
            on = at < limit[owner]
            state, at, owner = state[on], at[on], owner[on]
    return np.clip(np.floor(1 - np.log(least / RATE) / math.log(BASE)), 0, TOP).astype(np.uint16)


def band_hashes(regs: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) int64; the band's number is part of its hash."""
    n, m = regs.shape
    parts = regs.reshape(n, m // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows)).copy()
    for i in range(rows):
        out = mixed(out * _MIX[0] + parts[:, :, i])
    return out.view(np.int64)


def layout(similarity: float, registers: int = 252, missed: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair of this similarity with probability below ``missed``."""
    best = (registers, 1)
    for rows in range(1, 16):
        bands = registers // rows
        if (1 - similarity**rows) ** bands < missed:
            best = (bands, rows)
    return best


GRID = np.linspace(0.3, 1.0, 141)


def likeliest(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest similarity on a grid from 0.3, given how registers of a and b compare and their set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(GRID, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    say = lambda n, q: n[:, None] * np.log(np.clip(q, 1e-12, 1))
    best = (say(greater, up) + say(less, down) + say(equal, 1 - up - down)).argmax(1)
    return j[np.arange(len(j)), best]


def _floor(similarity: float, registers: int) -> float:
    return similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / registers)


def _regs(column: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, registers)


def _shared(sets: list[np.ndarray | None], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Intersection sizes of small sets, as products of their membership matrices over members that occur twice."""
    held = [i for i, s in enumerate(sets) if s is not None]
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not held:
        return out
    owner = np.repeat(held, [len(sets[i]) for i in held])
    _, member, counts = np.unique(np.concatenate([sets[i] for i in held]), return_inverse=True, return_counts=True)
    twice = counts > 1
    on = twice[member]
    owner, member = owner[on], (np.cumsum(twice) - 1)[member[on]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    bounds = np.searchsorted(member, np.arange(0, int(twice.sum()) + MEMBERS, MEMBERS))
    place, own = np.full((2, len(sets)), -1), (rows, cols)
    place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        sides = []
        for where, names in zip(place, own, strict=True):
            m = np.zeros((len(names), MEMBERS), np.float32)
            at = where[owner[lo:hi]]
            m[at[at >= 0], member[lo:hi][at >= 0] - k * MEMBERS] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal registers of each row of x with each of y, in slices."""
    out = np.empty((len(x), len(y)), np.int32)
    room = max(1, (1 << 22) // max(1, x.shape[1] * len(y)))
    for lo in range(0, len(x), room):
        out[lo : lo + room] = (x[lo : lo + room, None] == y[None]).sum(2)
    return out


def _likeliest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """``likeliest`` for rows of registers, a few thousand at a time."""
    out = np.empty(len(x))
    for lo in range(0, len(x), 4096):
        at = slice(lo, lo + 4096)
        g, e = (x[at] > y[at]).sum(1), (x[at] == y[at]).sum(1)
        out[at] = likeliest(g, x.shape[1] - e - g, e, nx[at].astype(float), ny[at].astype(float))
    return out


class Block:
    """Representatives of one block of a bucket: ids, set sizes, registers and small sets."""

    def __init__(self, t: pa.Table, registers: int, similarity: float):
        self.rep, self.n, self.x = t["rep"].to_numpy(), t["n"].to_numpy(), _regs(t["sketch"], registers)
        self.sets = [None if s is None else np.frombuffer(s, "<u4") for s in t["small"].to_pylist()]
        self.small = np.array([s is not None for s in self.sets])
        self.similarity, self.floor = similarity, _floor(similarity, registers)

    def scores(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(similarity of each row with each column, whether it is that of the sets): else the share of equal registers; 0 where sizes forbid it."""
        n, m = self.n[rows][:, None], self.n[cols][None]
        sized = np.minimum(n, m) >= self.similarity * np.maximum(n, m) * (1 - 1e-9)
        exact = self.small[rows][:, None] & self.small[cols][None]
        shared = _shared(self.sets, rows, cols)
        out = shared / (n + m - shared)
        rest = sized & ~exact
        some = np.flatnonzero(rest.any(1))
        if len(some):
            equal = _equal(self.x[rows[some]], self.x[cols]) / self.x.shape[1]
            out[some] = np.where(exact[some], out[some], equal)
        return np.where(sized, out, 0), exact

    def passing(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs may pass, their estimates)."""
        est = score.astype(np.float64)
        large = np.flatnonzero(~exact)
        est[large] = _likeliest(self.x[i[large]], self.x[j[large]], self.n[i[large]], self.n[j[large]])
        return est >= np.where(exact, self.similarity * (1 - 1e-6), self.floor), est


def _by_block(rows: DataFrame, n_rows: int, keys: tuple[str, str], kernel, schema: T.StructType) -> DataFrame:
    """``kernel(table of one block)`` -> list of columns, over blocks of two or more rows.

    ``n_rows``: how many rows there are; a group of blocks has about ``GROUP`` of them, however many that makes.
    """
    deal = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n_rows // GROUP))))

    def run(t: pa.Table) -> pa.Table:
        a, b = t[keys[0]].to_numpy(), t[keys[1]].to_numpy()
        order = np.lexsort((b, a))
        t, a, b = t.take(pa.array(order)).combine_chunks(), a[order], b[order]
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        out = [[np.empty(0, np.int64)] for _ in schema.names]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
            if hi - lo > 1:
                for column, part in zip(out, kernel(t.slice(lo, hi - lo)), strict=True):
                    column.append(part)
        kinds = [pa.float64() if f.dataType == T.DoubleType() else pa.int64() for f in schema.fields]
        return pa.table([pa.array(np.concatenate(c).astype(np.float64 if k == pa.float64() else np.int64), k) for c, k in zip(out, kinds, strict=True)], names=schema.names)

    return rows.withColumn("__sw_deal", deal).groupBy("__sw_deal").applyInArrow(run, schema)


SKETCHED = T.StructType().add("doc_id", T.LongType()).add("th", T.LongType()).add("n", T.LongType()).add("key", T.BinaryType()).add("sketch", T.BinaryType()).add("small", T.BinaryType())
PAIRS = T.StructType().add("a", T.LongType()).add("b", T.LongType()).add("est", T.DoubleType())


def sketched(docs: DataFrame, *, shingle: int = 3, registers: int = 252) -> DataFrame:
    """doc_id, th (the text's hash), n (set size), key (the set's fingerprint), sketch and small of each row.

    ``small``: the set itself, in 32 bits, if it has no more members than the sketch has
    registers and these stay distinct. Without words: n 0, no key and no sketch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))

    def small(s: np.ndarray) -> bytes | None:
        own = np.unique(s.astype(np.uint32)) if 0 < len(s) <= registers else ()
        return own.astype("<u4").tobytes() if len(own) == len(s) > 0 else None

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            texts, lo = batch["text"].to_pylist(), 0
            while lo < len(texts):
                sets, total = [], 0
                while lo + len(sets) < len(texts) and total < 400_000:
                    sets.append(shingle_set(texts[lo + len(sets)], shingle))
                    total += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                got: list = [None] * len(sets)
                if full:
                    elements = np.concatenate([sets[i] for i in full])
                    owner = np.repeat(np.arange(len(full)), [len(sets[i]) for i in full])
                    for i, row in zip(full, sketches(elements, owner, len(full), registers), strict=True):
                        got[i] = row.astype("<u2").tobytes()
                part = batch.slice(lo, len(sets))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [part["doc_id"], part["th"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(got, pa.binary()), pa.array([small(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=SKETCHED.names)
                lo += len(sets)
        released()

    return rows.mapInArrow(run, SKETCHED)


def _buckets(reps: DataFrame, bands: int, rows: int, registers: int) -> DataFrame:
    """(bucket, rep, members, block) of all representatives that share a band with another one."""
    schema = T.StructType().add("bucket", T.LongType()).add("rep", T.LongType())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h = band_hashes(_regs(batch["sketch"], registers)[:, : bands * rows], rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1)), pa.array(np.repeat(batch["rep"].to_numpy(), bands))], names=schema.names)

    banded = reps.select("rep", "sketch").mapInArrow(run, schema)
    held = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK).cast("long")).cast("int")
    return banded.join(held, "bucket").select("bucket", "rep", "members", block.alias("block"))


def _nearest_lower(buckets: DataFrame, reps: DataFrame, registers: int, similarity: float) -> DataFrame:
    """For each representative the likeliest partner of lower id in its blocks."""

    def kernel(t: pa.Table) -> list[np.ndarray]:
        t = t.take(pa.array(np.argsort(t["rep"].to_numpy(), kind="stable")))
        k = Block(t, registers, similarity)
        every = np.arange(len(k.rep))
        score, exact = k.scores(every, every)
        score = np.tril(score, -1)
        j = score.argmax(1)
        i = np.flatnonzero(score[every, j] > 0)
        j = j[i]
        on, est = k.passing(i, j, score[i, j], exact[i, j])
        return [k.rep[j[on]], k.rep[i[on]], est[on]]

    near = _by_block(buckets.join(reps.select("rep", "n", "sketch", "small"), "rep"), buckets.count(), ("bucket", "block"), kernel, PAIRS)
    return near.groupBy("b").agg(F.max(F.struct("est", F.negative("a").alias("a"))).alias("m")).select(F.negative("m.a").alias("a"), "b")


def _mixed_up(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with ``other``: not of the bucket's top component."""
    mixed_up = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("size", "comp")).alias("top")).where("lo <> hi")
    return placed.join(mixed_up.select("bucket", F.col("top.comp").alias("top")), "bucket").withColumn("other", F.col("comp") != F.col("top")).drop("top")


def _split_again(heavy: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows of buckets with too many outsiders, in a bucket for each of their rarest shingles: (bucket, rep, members, block, comp, size).

    Two sets of the threshold similarity share ``percent`` of a hundred members of either, so in any one order of shingles the first ones
    of both, one more than may be missing, have one in common. No pair that could be linked is left out, and the rarest come first.
    """
    schema = T.StructType().add("rep", T.LongType()).add("n", T.LongType()).add("e", T.LongType())
    whole = heavy.groupBy("rep").agg(F.first("comp").alias("comp"), F.first("size").alias("size"))

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            for rep, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = shingle_set(text, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x, np.int64)) for x in (rep, len(own))] + [pa.array(own)], names=schema.names)
        released()

    members = written(texts.join(whole.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(run, schema), "members")
    common = members.groupBy("e").agg(F.count("*").alias("members")).where("members > 1")
    shared = members.join(common, "e")
    # Shingles of one set only come first of all.
    before = F.col("n") - F.count("*").over(Window.partitionBy("rep"))
    place = before + F.row_number().over(Window.partitionBy("rep").orderBy("members", "e"))
    missing = F.col("n") - F.expr(f"({percent} * n + 99) DIV 100")
    first = shared.withColumn("place", place).where(F.col("place") <= missing + 1).select(F.xxhash64("e").alias("bucket"), "rep")
    held = first.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK).cast("long")).cast("int")
    return written(first.join(held, "bucket").join(whole, "rep").select("bucket", "rep", "members", block.alias("block"), "comp", "size"), "rare")


def _sent(buckets: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(bucket, rep, comp, other, at, block): which members of which buckets of several components are looked at in which block.

    The members of a bucket's largest component stay in their blocks, and all others are also sent to every block, so
    a block sees each pair across components. Members of buckets with over ``OUTSIDERS`` others meet by their rarest shingles
    instead, without a limit: all pairs that could be linked are looked at, and rows grow with the members and not with their square,
    unless very many have a rare shingle in common and are yet of different components.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    placed = buckets.join(labels.join(sizes, "label"), buckets.rep == labels.node, "left").select(
        "bucket", "rep", "members", "block", F.coalesce("label", "rep").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")
    )
    rest = written(_mixed_up(placed), "mixed")
    heavy = written(rest.groupBy("bucket").agg(F.count_if("other").alias("n")).where(F.col("n") > OUTSIDERS).select("bucket"), "heavy")
    every = F.sequence(F.lit(0), (F.ceil(F.col("members") / BLOCK) - 1).cast("int"))
    columns = ["bucket", "rep", "comp", "other", F.explode(F.when(F.col("other"), every).otherwise(F.array("block"))).alias("at"), "block"]
    if not heavy.limit(1).count():
        return rest.select(*columns)
    light = rest.join(heavy, "bucket", "left_anti")
    return light.select(*columns).unionByName(_mixed_up(_split_again(rest.join(heavy, "bucket"), texts, shingle, percent)).select(*columns))


def _banded_alike(x: np.ndarray, y: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Which rows of registers agree in a whole band."""
    out = np.empty(len(x), bool)
    for lo in range(0, len(x), 4096):
        same = x[lo : lo + 4096, : bands * rows] == y[lo : lo + 4096, : bands * rows]
        out[lo : lo + 4096] = same.reshape(-1, bands, rows).all(2).any(1)
    return out


def _across(buckets: DataFrame, reps: DataFrame, labels: DataFrame, texts: DataFrame, registers: int, shingle: int, percent: int, best: bool) -> DataFrame:
    """Pairs of different components that share a band and may pass: the likeliest of each two components in a block, or all."""
    similarity = percent / 100
    bands, rows = layout(similarity, registers)
    narrow = written(_sent(buckets, labels, texts, shingle, percent), "sent")
    sent = narrow.join(reps.select("rep", "n", "sketch", "small"), "rep")
    schema = T.StructType([*PAIRS.fields]).add("ca", T.LongType()).add("cb", T.LongType())

    def kernel(t: pa.Table) -> list[np.ndarray]:
        k, comp = Block(t, registers, similarity), t["comp"].to_numpy()
        rep, other = k.rep, t["other"].to_numpy(zero_copy_only=False)
        every, them = np.flatnonzero(other), np.flatnonzero(t["block"].to_numpy() == t["at"].to_numpy())
        found: list = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]]
        for lo in range(0, len(every), AT_ONCE):
            us = every[lo : lo + AT_ONCE]
            score, exact = k.scores(us, them)
            score[comp[us][:, None] == comp[them][None]] = 0
            score[other[them][None] & (rep[us][:, None] > rep[them][None])] = 0
            r, c = np.nonzero(score >= np.where(exact, similarity * (1 - 1e-6), k.floor - 0.05))
            i, j, score, exact = us[r], them[c], score[r, c], exact[r, c]
            on, est = k.passing(i, j, score, exact)
            # Pairs that meet by a shingle count if they share a band, as if their bucket had not been split.
            on &= _banded_alike(k.x[i], k.x[j], bands, rows)
            found.append([i[on], j[on], est[on]])
        i, j, est = (np.concatenate(f) for f in zip(*found, strict=True))
        swap = rep[i] > rep[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        lo, hi = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        if best and len(i):
            order = np.lexsort((rep[j], rep[i], -est, hi, lo))
            first = np.ones(len(order), bool)
            first[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
            pick = order[first]
            i, j, est, lo, hi = i[pick], j[pick], est[pick], lo[pick], hi[pick]
        return [rep[i], rep[j], est, lo, hi]

    pairs = _by_block(sent, narrow.count(), ("bucket", "at"), kernel, schema)
    if best:
        top = F.max(F.struct("est", F.negative("a").alias("a"), F.negative("b").alias("b"))).alias("m")
        pairs = pairs.groupBy("ca", "cb").agg(top).select(F.negative("m.a").alias("a"), F.negative("m.b").alias("b"))
    return pairs.select("a", "b").distinct()


LINKS = T.StructType().add("a", T.LongType()).add("b", T.LongType())


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) for which 100 * intersection >= percent * union on full sets.

    ``texts``: doc_id and text, one row for each id. The text of ``a`` goes to each chunk of its
    partners, that of ``b`` to each of its pairs, so no task holds more than a chunk's rows.
    """
    degrees = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = pairs.join(degrees, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    heads = degrees.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"))
    wanted = cut.union(heads).withColumn("doc_id", F.coalesce("b", "a"))
    rows = wanted.join(texts, "doc_id").select("a", "chunk", "b", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches):
        head, head_set = None, None
        for batch in slices(batches, "text", SLICE):
            left, right = [], []
            for a, chunk, b, text in zip(*(batch[c].to_pylist() for c in ("a", "chunk", "b", "text")), strict=True):
                own = shingle_set(text, shingle)
                if b is None:
                    head, head_set = (a, chunk), own
                elif head == (a, chunk):
                    shared = np.intersect1d(head_set, own, assume_unique=True).size
                    if 100 * shared >= percent * (len(head_set) + len(own) - shared):
                        left.append(a)
                        right.append(b)
                else:
                    raise RuntimeError(f"document {a} is missing")
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=LINKS.names)
        released()

    return sorted_rows.mapInArrow(run, LINKS)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, registers: int = 252) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id that links lead to, the own one included, and a
    document is kept if that is its own. Texts that are null, empty or have no words have
    n_shingles 0 and no links. A null doc_id takes the component of its text and is kept. doc_ids are meant to be unique: rows that
    repeat one with another text go by their own texts, and of two texts for which it is the least doc_id one is its node. Other columns don't count; an
    empty table gives an empty result.

    A link of just the threshold is missed with a probability of about 3e-5 by the
    bands and the estimate together; all links that are used are exact. Results don't depend on which buckets are split.
    """
    similarity = percent / 100
    bands, rows = layout(similarity, registers)
    own = written(sketched(docs, shingle=shingle, registers=registers), "sketches")
    classes = own.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "th", "n", "sketch", "small")).alias("m"))
    reps = classes.select("key", F.col("m.doc_id").alias("rep"), *[F.col(f"m.{c}").alias(c) for c in ("th", "n", "sketch", "small")])
    reps = bucketed(reps.dropDuplicates(["rep"]), "rep", "classes")
    buckets = written(_buckets(reps, bands, rows, registers), "buckets")
    # The texts of all representatives that meet another one at all.
    met = buckets.select("rep").distinct().join(reps.select("rep", "th"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    # By doc_id alone, so that rows are dealt as the table's buckets are; the text's hash is compared inside.
    same = (F.col("doc_id") == F.col("rep")) & (F.col("th").bitwiseXOR(F.col("own")) == 0)
    texts = texts.join(met.select("rep", F.col("th").alias("own")), same, "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
    texts = bucketed(texts, "doc_id", "texts")

    links = written(confirmed(written(_nearest_lower(buckets, reps, registers, similarity), "pairs"), texts, shingle, percent), "links")
    labels = connected_components(links)
    for best in (True, False):
        pairs = written(_across(buckets, reps, labels, texts, registers, shingle, percent, best), "pairs")
        if not pairs.limit(1).count():
            break
        links = written(links.union(confirmed(pairs, texts, shingle, percent)), "links")
        labels = connected_components(links)

    named = reps.join(labels, reps.rep == labels.node, "left").select("key", F.coalesce("label", "rep").alias("component_id"))
    out = own.join(named, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op4_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of all documents: three words, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


QUERIES = {"op4_setsketch_near_dedup": op4_setsketch_near_dedup}
ORACLES: dict[str, str] = {}
