"""Exact-size stratified sampling and seeded draws.

Random order is the order of a hash of (id, seed): the same however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.operators.running import join_null_safe, row_numbers, shares
from siftwell.sources.shared import written

POOL = 0.7


def draw_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratum(*columns: str) -> Column:
    """The stratum's name: the columns joined by ``||``; nulls are left out."""
    return F.concat_ws("||", *columns)


def strata_quota(rows: DataFrame, target: int, key: str = "stratum") -> DataFrame:
    """(stratum, n, quota): proportional quotas, rounded half to even, that sum to ``target``.

    What rounding leaves over or short is one step for each of the largest strata that
    have room (ties by name). At most ``target`` rows: each stratum keeps all.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    q = n.join(F.broadcast(total)).withColumn("q", F.rint(F.lit(float(target)) * F.col("n") / F.col("total")).cast("long"))
    diff = q.agg((F.lit(target) - F.sum("q")).alias("diff"))
    q = q.join(F.broadcast(diff)).withColumn("step", F.signum("diff").cast("long"))
    room = (F.col("q") + F.col("step") >= 0) & (F.col("q") + F.col("step") <= F.col("n"))
    # A row for each stratum, not for each record, is ranked.
    rank = F.row_number().over(Window.partitionBy(room.alias("room")).orderBy(F.desc("n"), key))
    quota = F.when(F.col("total") <= target, F.col("n")).otherwise(F.col("q") + F.when(room & (rank <= F.abs("diff")), F.col("step")).otherwise(0))
    return q.select(key, "n", quota.alias("quota"))


def stratified_sample(rows: DataFrame, target: int, key: str = "stratum", id_col: str = "doc_id", seed: int = 42, pool: float = POOL) -> DataFrame:
    """Exactly ``target`` rows (all, if there are no more): from each stratum its quota of the sharpest ``pool``.

    Ranks are taken in ranges of a stratum, so none has to fit in a task. Null is a stratum; rows of
    equal sharpness go by id, a null sharpness is the least. Ids must not repeat or be null.
    """
    # What ranks need, written once: dealing by ranges looks at its input twice, and the rows may be dear to make.
    narrow = written(rows.select(F.col(id_col).alias("i"), F.col(key).alias("k"), F.col("blur").alias("b")), "narrow")
    quotas = strata_quota(narrow, target, "k")
    ranked = join_null_safe(row_numbers(narrow, ["k"], [F.desc("b"), F.col("i")], "sharp"), quotas, ["k"])
    inside = ranked.where(F.col("sharp") <= F.greatest("quota", F.floor(F.col("n") * F.lit(float(pool))))).select("i", "k", "quota")
    drawn = row_numbers(inside, ["k"], [draw_key("i", seed), F.col("i")], "drawn").where("drawn <= quota")
    return rows.join(drawn.select(F.col("i").alias(id_col)), id_col, "left_semi")


def sampled_classes(rows: DataFrame, targets: dict[str, int], cls: str = "cls", **options) -> DataFrame:
    """Classes with a target are sampled to it, all others, null too, are kept."""
    out = rows.where(~F.coalesce(F.col(cls).isin(*targets), F.lit(False))) if targets else rows
    for name, target in sorted(targets.items()):
        out = out.unionByName(stratified_sample(rows.where(F.col(cls) == name), target, **options).select(*rows.columns))
    return out


def lost_groups(before: DataFrame, after: DataFrame, key: str = "stratum") -> DataFrame:
    """Values of ``key`` that no longer occur."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def weighted_draw(rows: DataFrame, n: int, weight: Column, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, proportional to ``weight``: (draw, id).

    Each row takes the draws that fall in its share of [0, 1): the number of grid points
    (k + u) / n, with one shift u for all. Shares are running sums over ranges of ids, so
    no task sees all rows; a share begins where the one before ends, so each draw is made once. Null and negative weights count as 0;
    without any weight there are no draws.
    """
    w = rows.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    placed = shares(w, [F.col("id")], "w").where("all > 0")
    shift = (seed * 2654435761 % 2**32) / 2**32
    upto = lambda x: F.least(F.greatest(F.ceil(F.lit(float(n)) * F.col(x) / F.col("all") - shift), F.lit(0)), F.lit(n))
    draws = placed.select("id", upto("lo").alias("lo"), upto("hi").alias("up"))
    return draws.where("up > lo").select(F.explode(F.sequence("lo", F.col("up") - 1)).alias("draw"), F.col("id").alias(id_col))
