"""Exact repeated substrings by merging shard Burrows-Wheeler transforms.

Whole suffixes need not be sorted to find strings of ``length`` bytes that start in
two places. Each such string is filed under one of its own grams, the least by hash
(the leftmost of equal ones), so equal strings are always filed under equal grams at
equal distances. Neighbouring starts with the same gram make up a run, whose
bytes are the context of the gram.

1. Runs are counted by gram and context. A gram that occurs once holds no repeat; a context
   that occurs twice is a repeat at all of its starts. Both take two hashes and no text.
2. Only different contexts of the same gram are left. They are lined up at the gram, and
   shards of them get a positional Burrows-Wheeler transform: for each column the
   symbols before it, in the order of what follows.
3. The shards are merged by refining their interleave column by column: symbols are read
   from the shards' transforms and the interleave is sorted stably by them, so no
   suffix is sorted again. Common prefix lengths of neighbours follow from those of the
   column before; starts whose neighbour shares ``length`` bytes are the repeated ones.
4. Grams with very many contexts are first cut into ranges of starts, filed anew under the
   bytes that all strings of a range share, until groups are small or single starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import released, slices, table, text_of, written

GRAM = 64
#: Bytes that are hashed at a time (about ten 64-bit arrays of their number); longer texts are cut, overlapping.
SLAB = 1 << 19
#: Bytes of contexts or of texts that a task hands on at a time.
HANDED = 1 << 22
POSITION = np.uint64((1 << 24) - 1)
#: Contexts of one group that are merged in one task; larger groups are cut first.
GROUP = 8192
#: Contexts of a shard, and about how many a task gets.
SHARD, BUCKET = 1024, 4096
#: Widths of ranges of starts by which large groups are cut, one after the other.
CELLS = (64, 8, 1)

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    h = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _C[0]
    h ^= h >> np.uint64(32)
    for i, step in enumerate((8, 16, 32)):
        h = h[:-step] * _C[i + 1] + h[step:]
        h ^= h >> np.uint64(29)
        h *= _C[0]
        h ^= h >> np.uint64(32)
    return h


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(texts: list[bytes], length: int) -> list[np.ndarray]:
    """(text's index, first start, starts, distance from the first start to the gram, gram, context) of all runs."""
    pieces = [(i, lo, t[lo : lo + SLAB + length - 1]) for i, t in enumerate(texts) for lo in range(0, max(0, len(t) - length + 1), SLAB)]
    out = [[] for _ in range(6)]
    at = 0
    while at < len(pieces):
        some, size = [], 0
        while at < len(pieces) and (not some or size + len(pieces[at][2]) <= SLAB):
            some.append(pieces[at])
            size += len(pieces[at][2])
            at += 1
        data = b"".join(p for _, _, p in some)
        sizes = np.array([len(p) for _, _, p in some])
        begins = np.cumsum(sizes) - sizes
        h = gram_hashes(data)
        least = window_minima((h & ~POSITION) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begins, sizes, strict=True)])
        spot = (least[starts] & POSITION).astype(np.int64)
        first = np.flatnonzero(np.diff(spot, prepend=-1))
        counts = np.diff(first, append=len(spot))
        begin, gram = starts[first], spot[first]
        owner = np.searchsorted(begins, begin, side="right") - 1
        view = memoryview(data)
        context = [xxhash.xxh3_64_intdigest(view[b : b + n + length - 1]) for b, n in zip(begin.tolist(), counts.tolist(), strict=True)]
        out[0].append(np.array([i for i, _, _ in some])[owner])
        out[1].append(begin - begins[owner] + np.array([lo for _, lo, _ in some])[owner])
        out[2].append(counts)
        out[3].append(gram - begin)
        out[4].append(h[gram].view(np.int64))
        out[5].append(np.array(context, np.uint64).view(np.int64))
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def transform(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positional Burrows-Wheeler transform of a shard: row c has column c of the rows in the order of what follows.

    ``symbols``: (rows, columns), 0 where a row has no byte, else byte + 1 in uint16.
    Rows come ordered by ``group``, and stay so.
    """
    rows, columns = symbols.shape
    out = np.empty((columns, rows), symbols.dtype)
    order, base = np.arange(rows), group * 512
    for c in range(columns - 1, -1, -1):
        out[c] = symbols[order, c]
        order = order[np.argsort(base + out[c], kind="stable")]
    return out


def merged(shards: list[np.ndarray], groups: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each shard (rows, columns) whether the string of ``length`` symbols there occurs in another row of its group.

    Group numbers are those of the whole task; each shard's rows are ordered by them.
    """
    sizes = [len(g) for g in groups]
    rows, columns = sum(sizes), shards[0].shape[0]
    group = np.concatenate(groups)
    shard = np.repeat(np.arange(len(shards)), sizes)
    begin = np.cumsum([0, *sizes[:-1]])
    order = np.argsort(group, kind="stable")  # the interleave before any symbol: groups only
    group, shard = group[order], shard[order]
    base = group * 512
    row = order  # which row of all shards stands where
    lcp = np.zeros(rows + 1, np.int32)
    lcp[1:rows][group[1:] == group[:-1]] = 0
    found = np.zeros((rows, columns), bool)
    for c in range(columns - 1, -1, -1):
        sym = np.empty(rows, shards[0].dtype)
        for k, s in enumerate(shards):
            sym[shard == k] = s[c]
        key = base + sym
        step = np.argsort(key, kind="stable")
        moved = key[step]
        same = (moved[1:] == moved[:-1]) & (sym[step][1:] > 0)
        lo, hi = step[:-1][same], step[1:][same]
        # Common prefix of two rows that were lo < hi: the least of those between them.
        between = np.empty(2 * len(lo), np.int64)
        between[::2], between[1::2] = lo + 1, hi + 1
        now = np.zeros(rows + 1, np.int32)
        if len(lo):
            now[1:rows][same] = 1 + np.minimum.reduceat(lcp, between)[::2]
        lcp, shard, row = now, shard[step], row[step]
        hit = np.maximum(lcp[:rows], lcp[1:]) >= length
        found[row[hit], c] = True
    return [found[b : b + n] for b, n in zip(begin, sizes, strict=True)]


def repeated_starts(group: np.ndarray, before: np.ndarray, starts: np.ndarray, bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each context whether each of its starts is repeated in another context of its group.

    ``before``: bytes from a context's first start to its gram.
    """
    n = len(bodies)
    reach = length - GRAM
    out: list = [None] * n
    order = np.argsort(group, kind="stable")
    number = np.unique(group, return_inverse=True)[1]
    cuts = [order[lo : lo + SHARD] for lo in range(0, n, SHARD)]
    shards = []
    for cut in cuts:
        symbols = np.zeros((len(cut), reach + length), np.uint16)
        for r, i in enumerate(cut.tolist()):
            lo = reach - before[i]
            symbols[r, lo : lo + len(bodies[i])] = np.frombuffer(bodies[i], np.uint8) + np.uint16(1)
        shards.append(transform(symbols, number[cut]))
    for cut, found in zip(cuts, merged(shards, [number[c] for c in cuts], length), strict=True):
        for r, i in enumerate(cut.tolist()):
            lo = reach - before[i]
            out[i] = found[r, lo : lo + starts[i]]
    return out


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, sizes) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


RUNS = (
    T.StructType()
    .add("id", T.LongType())
    .add("th", T.LongType())
    .add("start", T.LongType())
    .add("n", T.IntegerType())
    .add("a", T.IntegerType())
    .add("gram", T.LongType())
    .add("context", T.LongType())
)
BODIES = T.StructType().add("gram", T.LongType()).add("context", T.LongType()).add("off", T.IntegerType()).add("a", T.IntegerType()).add("n", T.IntegerType()).add("done", T.BooleanType()).add("body", T.BinaryType())
MARKS = T.StructType().add("gram", T.LongType()).add("context", T.LongType()).add("off", T.IntegerType()).add("n", T.IntegerType())


def _named(docs: DataFrame) -> DataFrame:
    """id, th, text: rows that agree in doc_id and text share their result."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))


def _runs(named: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", HANDED):
            texts = [t.encode() for t in batch["text"].to_pylist()]
            owner, start, n, a, gram, context = runs_of(texts, length)
            columns = [batch["id"].take(pa.array(owner)), batch["th"].take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(gram, pa.int64()), pa.array(context, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=RUNS.names)
        released()

    return named.mapInArrow(run, RUNS)


def _bodies(named: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted contexts; ``wanted``: gram, context, done and a place (id, th, start, n, a)."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "a", "gram", "context", "done")).alias("w"))
    rows = named.join(lists, ["id", "th"]).dropDuplicates(["id", "th"]).select("text", "w")

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        out, held = [[] for _ in BODIES.names], 0
        ready = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=BODIES.names)
        for batch in slices(batches, "text", HANDED):
            for text, places in zip(batch["text"], batch["w"], strict=True):
                data = text.as_py().encode()
                for p in places.as_py():
                    row = (p["gram"], p["context"], 0, p["a"], p["n"], p["done"], data[p["start"] : p["start"] + p["n"] + length - 1])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    held += len(row[-1])
                    if held > HANDED:
                        yield ready()
                        out, held = [[] for _ in BODIES.names], 0
        yield ready()
        released()

    return rows.mapInArrow(run, BODIES)


def _cut_large(bodies: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cut groups of over ``GROUP`` contexts; gives contexts with a group number and marks found on the way.

    A cell holds the starts of ``width`` neighbouring distances from the gram. All its strings
    share ``length - width + 1`` bytes, so these and the cell name a new group. Equal
    pieces then count as one; at width 1 a group holds one string.
    """
    now, marks = bodies.withColumn("grp", F.col("gram")), []
    for width in CELLS:
        large = written(now.groupBy("grp").count().where(F.col("count") > GROUP).select("grp"), "large")
        if not large.limit(1).count():
            break
        cells = F.explode(F.expr(f"sequence((a - n + 1) DIV {width}, a DIV {width})")).alias("cell")
        cut = now.join(large, "grp").select("*", cells).withColumn("cell", F.col("cell").cast("int"))
        cut = cut.withColumn("hi", F.least("a", F.expr(f"cell * {width} + {width - 1}"))).withColumn("lo", F.greatest(F.expr("a - n + 1"), F.expr(f"cell * {width}")))
        cut = cut.select(
            "gram", "context", F.expr("off + a - hi").alias("off"), F.col("hi").alias("a"), F.expr("hi - lo + 1").alias("n"), "done",
            F.expr(f"substring(body, a - hi + 1, hi - lo + {length})").alias("body"), "cell",
        )
        core = F.expr(f"substring(body, a - cell * {width} + 1, {length + 1 - width})")
        cut = written(cut.select(*BODIES.names, F.xxhash64("gram", "cell", core).alias("grp"), F.xxhash64("a", "body").alias("piece")), "cut")
        kinds = written(cut.groupBy("grp", "piece").agg(F.count("*").alias("c"), F.min(F.struct(*BODIES.names)).alias("m")), "kinds")
        marks.append(cut.join(kinds.where("c > 1").select("grp", "piece"), ["grp", "piece"]).where("NOT done").select(*MARKS.names))
        shared = kinds.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
        one = kinds.join(shared, "grp").select("m.*", "grp", (F.col("m.done") | (F.col("c") > 1)).alias("settled"))
        one = one.select(*[c if c != "done" else F.col("settled").alias("done") for c in BODIES.names], "grp")
        now = written(now.join(large, "grp", "left_anti").select(*BODIES.names, "grp").unionByName(one), "groups")
    return now, marks


def _marks(groups: DataFrame, length: int) -> DataFrame:
    """Repeated starts of all contexts that are not done, by merging shard transforms in each bucket of groups."""
    buckets = max(1, -(-groups.count() // BUCKET))

    def run(t: pa.Table) -> pa.Table:
        group, a, n = (t[c].to_numpy() for c in ("grp", "a", "n"))
        done = t["done"].to_pylist()
        flags = repeated_starts(group, a, n, t["body"].to_pylist(), length)
        row, off, size = [], [], []
        for i, f in enumerate(flags):
            if not done[i] and f.any():
                lo, k = stretches(f)
                row += [i] * len(lo)
                off += lo.tolist()
                size += k.tolist()
        some = t.select(["gram", "context", "off"]).take(pa.array(row, pa.int64()))
        moved = pa.array((some["off"].to_numpy() + np.array(off, np.int32)).astype(np.int32), pa.int32())
        return pa.table([some["gram"], some["context"], moved, pa.array(size, pa.int32())], names=MARKS.names)

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, MARKS)


def repeated_runs(docs: DataFrame, length: int = 400) -> DataFrame:
    """(id, th, spans): for each text with repeats the begins and sizes of runs of repeated starts."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    named = _named(docs)
    runs = written(_runs(named, length), "runs")
    kinds = runs.groupBy("gram", "context").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "start", "n", "a")).alias("m"))
    grams = kinds.groupBy("gram").agg(F.count("*").alias("k"), F.sum("c").alias("total")).where("total > 1").select("gram", "k")
    kinds = written(kinds.join(grams, "gram"), "kinds")
    wanted = kinds.where("k > 1").select("gram", "context", (F.col("c") > 1).alias("done"), "m.*")
    groups, marks = _cut_large(written(_bodies(named, wanted, length), "bodies"), length)
    settled = kinds.where("c > 1").select("gram", "context", F.lit(0).alias("off"), F.col("m.n").alias("n"))
    for m in [_marks(groups, length), *marks]:
        settled = settled.unionByName(m)
    found = runs.select("id", "th", "start", "gram", "context").join(settled, ["gram", "context"])
    return found.groupBy("id", "th").agg(F.collect_set(F.struct((F.col("start") + F.col("off")).alias("lo"), "n")).alias("spans"))


REMOVED = T.StructType().add("doc_id", T.LongType()).add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept", T.BinaryType())


def without_repeats(docs: DataFrame, length: int = 400, *, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept of each row of ``docs``.

    Removes each byte that lies in a string of ``length`` bytes which also starts somewhere
    else in any row, the same one included. ``kept`` (binary) is the bytes that are left, or their
    SHA-256 if ``keep_text`` is false. Null and empty texts have no bytes; repeated rows
    repeat each other; other columns don't count; an empty table gives an empty result.
    """
    spans = repeated_runs(docs, length)
    named = docs.select("doc_id", *[F.expr(e) for e in ("coalesce(cast(doc_id AS bigint), cast(-9223372036854775808 AS bigint)) AS id",)], F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    rows = named.join(spans, ["id", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def run(batches):
        for batch in slices(batches, "text", HANDED):
            out = [[] for _ in REMOVED.names]
            for name, text, own in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data = text.encode()
                cover: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["lo"] + s["n"] + length - 1) for s in own or ()):
                    if cover and lo <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], hi)
                    else:
                        cover.append([lo, hi])
                at, left = 0, []
                for lo, hi in cover:
                    left.append(data[at:lo])
                    at = hi
                kept = b"".join([*left, data[at:]])
                for column, value in zip(out, (name, len(data), len(data) - len(kept), len(cover), kept if keep_text else hashlib.sha256(kept).digest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=REMOVED.names)
        released()

    return rows.mapInArrow(run, REMOVED)


def op9_bwt_merge_repeats(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that occur twice."""
    done = without_repeats(table(spark, sf_dir, "documents"), 400, keep_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


QUERIES = {"op9_bwt_merge_repeats": op9_bwt_merge_repeats}
ORACLES: dict[str, str] = {}
