"""What stays of a duplicate group: policies for groups of one class and of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.running import join_null_safe

POLICIES = ("report", "keep_rarest", "drop_all")


def _mixed(cls: str) -> Column:
    """Whether a group has several classes; null is a class."""
    several = F.coalesce(F.min(cls) != F.max(cls), F.lit(False))
    return several | ((F.count(cls) > 0) & (F.count(cls) < F.count("*")))


def _classified(rows: DataFrame, cls: str) -> DataFrame:
    """Rows of groups with ``mixed``: whether their group has several classes."""
    return rows.join(rows.groupBy("group_id").agg(_mixed(cls).alias("mixed")), "group_id")


def _best(rows: DataFrame, keys: list[str], cls: str, id_col: str) -> DataFrame:
    """The row of each key with the largest (min_side, blur); ties: least class, then id."""
    order = F.struct(F.negative("min_side").alias("s"), F.negative("blur").alias("b"), F.col(cls).alias("c"), F.col(id_col).alias("i"))
    return rows.groupBy(*keys).agg(F.min(order).alias("o")).select(*keys, F.col("o.i").alias(id_col), F.col("o.c").alias("__c"))


def survivors(rows: DataFrame, policy: str = "report", cls: str = "cls", id_col: str = "doc_id") -> DataFrame:
    """(id, group_id) of rows that stay. Only id, group_id, class, min_side and blur of ``rows`` count.

    Rows without a group (null) all stay, as nothing says that they repeat others. Null is a class of its own;
    ties go to the least class and id; an empty table gives an empty one.
    Groups of one class keep their best row. Groups of several classes keep the best row of each class
    (``report``), only that of the class with fewest rows in all (``keep_rarest``; ties: least
    class) or none (``drop_all``). All are minima of partial aggregates.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rows = rows.select(id_col, "group_id", cls, "min_side", "blur")
    alone, rows = rows.where("group_id IS NULL").select(id_col, "group_id"), rows.where("group_id IS NOT NULL")
    known = _classified(rows, cls)
    out = alone.unionByName(_best(known.where("NOT mixed"), ["group_id"], cls, id_col).select(id_col, "group_id"))
    mixed = known.where("mixed")
    if policy == "drop_all":
        return out
    per_class = _best(mixed, ["group_id", cls], cls, id_col)
    if policy == "report":
        return out.unionByName(per_class.select(id_col, "group_id"))
    sizes = rows.groupBy(cls).agg(F.count("*").alias("__sw_size"))
    rarest = join_null_safe(per_class, sizes, [cls]).groupBy("group_id").agg(F.min(F.struct("__sw_size", cls, id_col)).alias("m"))
    return out.unionByName(rarest.select(F.col(f"m.{id_col}").alias(id_col), "group_id"))


def conflict_groups(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """(group_id, n, n_classes, first_cls, last_cls) of groups with several classes; nulls don't count, neither as groups nor as classes."""
    g = rows.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct(cls).alias("n_classes"), F.min(cls).alias("first_cls"), F.max(cls).alias("last_cls"))
    return g.where("n_classes > 1")


def conflict_members(rows: DataFrame, cls: str = "cls", id_col: str = "doc_id") -> DataFrame:
    """(group_id, id, class) of all rows of groups with several classes, before any policy."""
    return _classified(rows.select(id_col, "group_id", cls), cls).where("mixed").select("group_id", id_col, cls)


def duplicate_stats(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """One row: duplicates in groups of one class, and groups, rows and surplus of groups of several. Rows without a group don't count."""
    g = rows.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("n"), _mixed(cls).alias("mixed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return g.agg(
        total(F.when(~F.col("mixed"), F.col("n") - 1)).alias("dup_within"),
        F.count_if("mixed").alias("n_conflicts"),
        total(F.when(F.col("mixed"), F.col("n"))).alias("conflict_rows"),
        total(F.when(F.col("mixed"), F.col("n") - 1)).alias("dup_in_conflict"),
    )
