"""Row numbers and running sums inside large groups: no task has to hold a whole group.

Rows are dealt by ranges of (keys, order) and written with the number of their range, so that
number holds however tasks are run again. A count or sum for each key and range gives what
lies before a range; a window inside the range gives the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.sources.shared import written

PART = "__sw_part"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by ``keys``, nulls equal to each other; the keys come from the left, the other columns of both must differ in name."""
    renamed = right.withColumnsRenamed({k: f"__sw_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__sw_right_{k}`")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__sw_right_{k}" for k in keys])


def ranged(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def _before(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each key and range the sums over the key's earlier ranges: a row for each, whatever the number of rows."""
    each = parts.groupBy(*keys, PART).agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keys, PART, *[(F.sum(k).over(w) - F.col(k)).alias(k) for k in sums])


def row_numbers(rows: DataFrame, keys: list[str], order: list[Column], to: str) -> DataFrame:
    """Add ``to``: the row's number, from 1, inside its ``keys`` (null is a key) by ``order``, which should have no ties."""
    parts = ranged(rows, keys, order)
    before = _before(parts, keys, {"__sw_before": F.count("*")})
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    numbered = join_null_safe(parts, before, [*keys, PART])
    return numbered.withColumn(to, F.row_number().over(w) + F.col("__sw_before")).drop(PART, "__sw_before")


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add for each (new, column) of ``sums`` the sum of ``column`` up to the row inside its ``keys`` by ``order``."""
    parts = ranged(rows, keys, order)
    before = _before(parts, keys, {f"__sw_{new}": F.sum(column) for new, column in sums.items()})
    w = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(parts, before, [*keys, PART])
    return out.withColumns({new: F.sum(column).over(w) + F.col(f"__sw_{new}") for new, column in sums.items()}).drop(PART, *[f"__sw_{new}" for new in sums])


def shares(rows: DataFrame, order: list[Column], weight: str) -> DataFrame:
    """Add ``lo`` and ``hi``, the sums of ``weight`` (none negative) before and up to each row by ``order``, and ``all``, the last of them.

    Sums of doubles hang on how they are bracketed, so a row's ``lo`` is the ``hi`` of the row before
    it, also over the bounds of ranges: shares neither overlap nor leave gaps.
    """
    parts = ranged(rows.withColumn("__sw_k", F.lit(0)), ["__sw_k"], order)
    before = _before(parts, ["__sw_k"], {"__sw_before": F.sum(weight)})
    w = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = join_null_safe(parts, before, ["__sw_k", PART]).withColumn("hi", F.sum(weight).over(w) + F.col("__sw_before")).drop("__sw_before")
    summed = written(summed, "sums")
    # A row for each range.
    ends = summed.groupBy(PART).agg(F.max("hi").alias("end"))
    up = Window.partitionBy(F.lit(0)).orderBy(PART)
    floors = ends.select(PART, F.coalesce(F.max("end").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__sw_floor"), F.max("end").over(Window.partitionBy(F.lit(0))).alias("all"))
    placed = summed.join(F.broadcast(floors), PART).withColumn("hi", F.greatest("hi", "__sw_floor"))
    lo = F.coalesce(F.lag("hi").over(Window.partitionBy(PART).orderBy("hi", *order)), "__sw_floor")
    return placed.withColumn("lo", lo).drop(PART, "__sw_k", "__sw_floor")
