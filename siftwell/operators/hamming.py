"""Near duplicates by Hamming distance of 64-bit hashes: a banded equi-join, then components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.hashes import BITS, hamming, hex_to_long, valid_hash
from siftwell.operators.components import connected_components
from siftwell.sources.shared import written

THRESHOLD, CAP = 5, 500
#: The exact join splits buckets of more rows, down to so many bits; no result depends on it.
SPLIT, LEAST = 4096, 16
#: Hashes that a task deals to their buckets.
DEALT = 8192
#: Masks that turn hashes for the orders of which a bucket's least is taken.
ORDERS = [0, -1, 0x5555555555555555, 0x0F0F0F0F33CC55AA]


def band_bounds(bands: int, whole: bool = False) -> list[tuple[int, int]]:
    """(first bit, bits) of each band: of equal width, or ``whole``: bounded by 64 b / bands over all bits."""
    if whole:
        return [(64 * b // bands, 64 * (b + 1) // bands - 64 * b // bands) for b in range(bands)]
    return [(b * (64 // bands), 64 // bands) for b in range(bands)]


def banded(hashes: DataFrame, threshold: int = THRESHOLD, cap: int | None = CAP, whole: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, h, band, key) of the valid hashes, without buckets of one row or of over ``cap`` rows.

    Two hashes at most ``threshold`` bits apart agree in one of threshold + 1 bands. Bucket sizes
    are a partial aggregate that is joined back. ``cap`` is part of the semantics: a larger
    bucket links nothing; None has no cap.
    """
    h = hex_to_long(F.lower("phash"))
    # Written once: what the hashes come from would else run for each side of the join.
    rows = written(hashes.where(valid_hash(F.lower("phash"))).select(F.col(id_col).alias("id"), h.alias("h")), "hashes")
    spots = [F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for b, (lo, width) in enumerate(band_bounds(threshold + 1, whole))]
    spread = rows.select("id", "h", F.explode(F.array(*spots)).alias("s")).select("id", "h", "s.*")
    sizes = spread.groupBy("band", "key").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= (cap or 2**62)))
    return spread.join(sizes.select("band", "key"), ["band", "key"])


def candidates(hashes: DataFrame, **options) -> DataFrame:
    """Pairs (a, b), a < b, that share a bucket, with their distance; each pair once."""
    spread = banded(hashes, **options)
    left = spread.select("band", "key", F.col("id").alias("a"), F.col("h").alias("ha"))
    right = spread.select("band", "key", F.col("id").alias("b"), F.col("h").alias("hb"))
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b", hamming(F.col("ha"), F.col("hb")).cast("int").alias("hamming")).distinct()


def edges(hashes: DataFrame, threshold: int = THRESHOLD, **options) -> DataFrame:
    """Candidate pairs of at most ``threshold`` bits; the distance is checked before pairs are made distinct."""
    spread = banded(hashes, threshold=threshold, **options)
    left = spread.select("band", "key", F.col("id").alias("a"), F.col("h").alias("ha"))
    right = spread.select("band", "key", F.col("id").alias("b"), F.col("h").alias("hb"))
    d = hamming(F.col("ha"), F.col("hb"))
    close = left.join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & (d <= threshold))
    return close.select("a", "b", d.cast("int").alias("hamming")).distinct()


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _shares(bits: int, threshold: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the parts of which one differs in at most two bits between values at most ``threshold`` bits apart."""
    parts = threshold // 3 + 1
    return [(bits * b // parts, bits * (b + 1) // parts - bits * b // parts) for b in range(parts)]


def _bits(value: Column, lo: int, width: int) -> Column:
    if lo >= BITS or not width:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(value, lo).bitwiseAND(F.lit(_signed((1 << width) - 1)))


def _tasks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // DEALT))


def _dealt(rows: DataFrame, value: str, level: int, shares: list[tuple[int, int]]) -> DataFrame:
    """Each row with a key, and the key's place ``at``, for each string at most one bit from one of the shares of ``value``.

    Shares at most two bits apart have such a string in common, so two rows of which a share is that near
    have a key in common. The 66 keys of a hash tell apart as much as 32 bits do.
    """
    own = F.array(*[_bits(F.col(value), lo, width).bitwiseOR(F.lit(p << 56)) for p, (lo, width) in enumerate(shares)])
    # A constant array: one expression for each key makes a method that the JVM doesn't compile.
    changed = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << j)).cast("long") for j in range(max(w for _, w in shares))])
    spread = rows.select("*", F.explode(own).alias("__sw_own")).select("*", F.posexplode(changed).alias(f"at{level}", "__sw_bit"))
    return spread.withColumn(f"k{level}", F.col("__sw_own").bitwiseXOR(F.col("__sw_bit"))).drop("__sw_own", "__sw_bit")


def _left_over(value: str, level: int, shares: list[tuple[int, int]]) -> Column:
    """The bits of ``value`` outside of the share that the row's key of the level is of."""
    rest = [_bits(F.col(value), 0, lo).bitwiseOR(F.shiftleft(_bits(F.col(value), lo + width, BITS - lo - width), lo)) for lo, width in shares]
    return F.element_at(F.array(*rest), (F.shiftrightunsigned(f"k{level}", 56) + 1).cast("int"))


def _first_key(level: int, x: Column, shares: list[tuple[int, int]]) -> Column:
    """Whether rows a and b, of which shares differ by ``x``, meet for the first time in the key that they have in common.

    No share before is near, and of the strings near to both it is the one for which b alone or a later bit of b is changed.
    """
    part = F.shiftrightunsigned(f"a.k{level}", 56)
    before = [(part <= q) | (F.bit_count(_bits(x, lo, width)) > 2) for q, (lo, width) in enumerate(shares[:-1])]
    i, j = F.col(f"a.at{level}"), F.col(f"b.at{level}")
    out = (i < j) | ((i == 0) & (j == 0))
    for one in before:
        out = out & one
    return out


def exact_edges(hashes: DataFrame, threshold: int = THRESHOLD, split: int = SPLIT, id_col: str = "doc_id") -> DataFrame:
    """(a, b, hamming) for all pairs of different hashes at most ``threshold`` bits apart; a hash goes by its least id.

    Rows meet by the keys of ``_dealt``, and a pair is made in the first key that both have, so none has to be made distinct. A bucket of over ``split``
    rows is dealt anew by its rows' other bits, until sixteen are left. No bucket is left out.
    """
    h = hex_to_long(F.lower("phash"))
    now = written(hashes.where(valid_hash(F.lower("phash"))).groupBy(h.alias("r0")).agg(F.min(id_col).alias("id")), "hashes")
    now = now.repartition(_tasks(now), "r0")
    keys, width, out = [], BITS, None
    first, distance = F.lit(True), F.lit(0)
    while True:
        level, shares = len(keys), _shares(width, threshold)
        keys = [*keys, f"k{level}"]
        spread = _dealt(now, f"r{level}", level, shares)
        width -= min(w for _, w in shares)
        over = None
        if width >= LEAST:
            over = written(spread.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > split).select(*keys), "over")
            over = over if over.limit(1).count() else None
        light = spread if over is None else spread.join(over, keys, "left_anti")
        x = F.col("a.r0").bitwiseXOR(F.col("b.r0"))
        distance = F.bit_count(x)
        first = first & _first_key(level, F.col(f"a.r{level}").bitwiseXOR(F.col(f"b.r{level}")), shares)
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        # Spark takes the dealt rows for as few as the hashes and would send all of them to each executor.
        close = light.alias("a").join(light.alias("b").hint("merge"), same & (F.col("a.id") < F.col("b.id")) & (distance <= threshold) & first)
        close = close.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.cast("int").alias("hamming"))
        out = close if out is None else out.union(close)
        if over is None:
            return out
        now = written(spread.join(over, keys, "left_semi").withColumn(f"r{level + 1}", _left_over(f"r{level}", level, shares)), "heavy")


def _stars(rows: DataFrame, threshold: int) -> DataFrame:
    """(h, m) of hashes at most ``threshold`` bits apart: each with the least of its buckets by four orders. Most rows of a component are linked by these already."""
    # One shuffle serves the aggregate and the join.
    spread = _dealt(rows.select("h"), "h", 0, _shares(BITS, threshold)).select("h", "k0").repartition("k0")
    turned = [F.min(F.col("h").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"m{i}") for i, m in enumerate(ORDERS)]
    heads = spread.groupBy("k0").agg(F.count("*").alias("n"), *turned).where("n > 1").drop("n")
    near = F.filter(F.array(*[f"m{i}" for i in range(len(ORDERS))]), lambda m: (m != F.col("h")) & (hamming(m, F.col("h")) <= threshold))
    return spread.join(heads, "k0").select("h", F.explode(near).alias("m")).distinct()


def _across(placed: DataFrame, threshold: int, split: int) -> DataFrame:
    """(a, b) of components that some hashes at most ``threshold`` bits apart join. ``placed``: h and comp of each hash; of larger components, ``comp`` is larger.

    Only rows outside of a bucket's largest component are compared with its others. A bucket with over ``split`` of these is dealt anew by its rows'
    other bits, until sixteen are left, so a row is compared with ``split`` at most before.
    """
    now, keys, width, out = placed.select("h", "comp", F.col("h").alias("r0")), [], BITS, None
    while True:
        level, shares = len(keys), _shares(width, threshold)
        keys = [*keys, f"k{level}"]
        held = ["h", f"r{level}"] if level else ["h"]
        # One shuffle serves the aggregate and the join, as both take all columns.
        spread = _dealt(now, f"r{level}", level, shares).select(*keys, *held, "comp").repartition(*keys)
        width -= min(w for _, w in shares)
        ends = spread.groupBy(*keys).agg(F.max(F.struct("comp", *held)).alias("hi"), F.min(F.struct("comp", *held)).alias("lo"))
        mixed = ends.where("lo.comp <> hi.comp").select(*keys, F.col("hi.comp").alias("top"))
        rest = written(spread.join(mixed, keys).select(*keys, *held, "comp", (F.col("comp") != F.col("top")).alias("other")), "mixed")
        over = None
        if width >= LEAST:
            over = written(rest.where("other").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > split).select(*keys), "over")
            over = over if over.limit(1).count() else None
        light = (rest if over is None else rest.join(over, keys, "left_anti")).select(*keys, "h", "comp", "other")
        x, y = light.alias("x"), light.where("other").alias("y")
        same = (F.col("x.comp") != F.col("y.comp")) & (hamming(F.col("x.h"), F.col("y.h")) <= threshold) & (~F.col("x.other") | (F.col("x.comp") < F.col("y.comp")))
        for k in keys:
            same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
        pairs = x.join(y, same).select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct()
        out = pairs if out is None else out.union(pairs)
        if over is None:
            return out
        deeper = _left_over(f"r{level}" if level else "h", level, shares).alias(f"r{level + 1}")
        now = written(rest.join(over, keys, "left_semi").select(*keys, "h", "comp", deeper), "heavy")


def exact_groups(hashes: DataFrame, threshold: int = THRESHOLD, split: int = SPLIT, id_col: str = "doc_id") -> DataFrame:
    """``duplicate_groups`` without a cap: equal hashes are one, then all links within the threshold.

    Links of one component are as many as its square, so they are not made: ``_stars`` joins what a few comparisons a row can, and
    only rows of different components are compared from there on.
    """
    # Written once: what the hashes come from would else run for each use.
    ids = written(hashes.select(F.col(id_col).alias("id"), F.when(valid_hash(F.lower("phash")), hex_to_long(F.lower("phash"))).alias("h")), "ids")
    rows = ids.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("id"))
    tasks = _tasks(ids)
    labels = connected_components(_stars(rows.repartition(tasks, "h"), threshold), "h", "m")
    known = rows.join(labels, rows.h == labels.node, "left").select("id", "h", F.coalesce("label", "h").alias("label"))
    # Components are numbered by size, so the largest of a bucket is a plain maximum.
    sizes = known.groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label").select("label", F.monotonically_increasing_id().alias("comp"))
    placed = written(known.join(written(sizes, "sizes"), "label").select("id", "h", "comp"), "placed")
    roots = connected_components(_across(placed.repartition(tasks, "h"), threshold, split))
    joined = placed.join(roots, placed.comp == roots.node, "left").select("id", "h", F.coalesce("label", "comp").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("id").alias("label")), "root").select("h", "label")
    return ids.join(named, "h", "left").select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("group_id"))


def duplicate_groups(hashes: DataFrame, threshold: int = THRESHOLD, cap: int | None = CAP, whole: bool = False, exact_first: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, group_id): the least id of the group; links are transitive.

    Rows with an invalid or null hash are groups of their own. ``exact_first`` joins equal hashes
    before the bands, so a bucket of many equal hashes is no longer capped. Without a cap
    (None) the groups are those of ``exact_groups``, which never compares all pairs of a large bucket.
    """
    if cap is None:
        return exact_groups(hashes, threshold, id_col=id_col)
    ids = hashes.select(F.col(id_col).alias("id"), F.lower("phash").alias("phash"))
    if exact_first:
        first = ids.where(valid_hash(F.col("phash"))).groupBy("phash").agg(F.min("id").alias("rep"))
        labels = connected_components(edges(first.select(F.col("rep").alias("id"), "phash"), threshold, cap=cap, whole=whole, id_col="id"))
        named = first.join(labels, first.rep == labels.node, "left").select("phash", F.coalesce("label", "rep").alias("label"))
        out = ids.join(named, "phash", "left")
    else:
        labels = connected_components(edges(hashes, threshold, cap=cap, whole=whole, id_col=id_col))
        out = ids.select("id").join(labels, ids.id == labels.node, "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("group_id"))


def group_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, groups of several rows and rows in these."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_members"))


def hash_coverage(hashes: DataFrame) -> DataFrame:
    """One row: rows, rows with a valid hash (null has none), and their share; null over no rows."""
    return hashes.agg(F.count("*").alias("n"), F.count_if(valid_hash(F.lower("phash"))).alias("n_valid"), F.avg(valid_hash(F.lower("phash")).cast("int")).alias("ratio"))
