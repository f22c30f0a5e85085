"""Quality filter, provenance signatures and skew audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_SIDE, BLUR = 200, 25.0
SOURCE_RATIO = 0.02
LEAK_IMAGES, LEAK_RATIO = 100, 0.90
MISC = "misc"


def passes(min_side: int = MIN_SIDE, blur: float = BLUR) -> Column:
    """Both bounds are inclusive; a null fails."""
    return F.coalesce((F.col("min_side") >= min_side) & (F.col("blur") >= F.lit(float(blur))), F.lit(False))


def quality_filter(records: DataFrame, min_side: int = MIN_SIDE, blur: float = BLUR) -> DataFrame:
    """The records that pass both bounds; a null measure fails."""
    return records.where(passes(min_side, blur))


def quality_rejects(records: DataFrame, cls: str = "cls", min_side: int = MIN_SIDE, blur: float = BLUR) -> DataFrame:
    """Rejected rows of each class."""
    return records.groupBy(cls).agg(F.count_if(~passes(min_side, blur)).alias("n_rejected"))


def split_broken(profiled: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(sound, broken) rows by whether ``error`` is null."""
    return profiled.where(F.col(error).isNull()), profiled.where(F.col(error).isNotNull())


def pseudo_sources(records: DataFrame, cls: str = "cls", sig: str = "raw_sig", ratio: float = SOURCE_RATIO) -> DataFrame:
    """Add ``source``: the signature if it is frequent in its class, else ``misc``.

    Frequent: at least max(2, floor(ratio * rows of the class)). Two small aggregates are
    joined back, so no class has to fit in a task.
    """
    by_sig = records.groupBy(cls, sig).agg(F.count("*").alias("n"))
    total = by_sig.groupBy(cls).agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(2), F.floor(F.col("total") * F.lit(float(ratio))))
    major = by_sig.join(total, cls).where(F.col("n") >= least).select(cls, sig, F.col(sig).alias("source"))
    return records.drop("source").join(major, [cls, sig], "left").na.fill(MISC, ["source"])


def source_topk(sourced: DataFrame, k: int = 3, cls: str = "cls") -> DataFrame:
    """The ``k`` largest sources of each class; ties by name."""
    w = Window.partitionBy(cls).orderBy(F.desc("n"), "source")
    return sourced.groupBy(cls, "source").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def leak_audit(records: DataFrame, sig: str = "raw_sig", cls: str = "cls", least: int = LEAK_IMAGES, share: float = LEAK_RATIO) -> DataFrame:
    """Signatures of at least ``least`` rows of which a class has at least ``share``: (sig, n, top_cls, top_n, share)."""
    two = records.groupBy(sig, cls).agg(F.count("*").alias("c"))
    per = two.groupBy(sig).agg(F.sum("c").alias("n"), F.min(F.struct(F.negative("c").alias("c"), cls)).alias("top"))
    per = per.select(sig, "n", F.col(f"top.{cls}").alias("top_cls"), F.negative("top.c").alias("top_n"))
    per = per.withColumn("share", F.col("top_n").cast("double") / F.col("n"))
    return per.where((F.col("n") >= least) & (F.col("share") >= F.lit(float(share))))


def imbalance(records: DataFrame, cls: str = "cls") -> DataFrame:
    """Rows and share of each class, and the ratio of the largest to the smallest."""
    n = records.groupBy(cls).agg(F.count("*").alias("n"))
    all_ = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))
    return n.join(F.broadcast(all_)).select(cls, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), (F.col("most").cast("double") / F.col("least")).alias("ratio"))


def totals(rows: DataFrame, levels: list[str], side: str = "min_side") -> DataFrame:
    """(levels, level, n, least_side, most_side): a row for each value of all ``levels``, and totals over the last of them, over the last two, ..., over all.

    ``level`` is the grouping id: its bits say, for the last column first, which columns a row is a total over, so a
    null there is no value. Partial aggregates of all levels go through one shuffle.
    """
    counts = [F.count("*").alias("n"), F.min(side).cast("long").alias("least_side"), F.max(side).cast("long").alias("most_side")]
    return rows.rollup(*levels).agg(F.grouping_id(*levels).cast("int").alias("level"), *counts)


def signature_pivot(rows: DataFrame, classes: list[str], sig: str = "raw_sig", cls: str = "cls") -> DataFrame:
    """(sig, a count for each of ``classes``, n): rows of each signature by class; n counts other classes too.

    The classes are given, so no pass is needed to find them.
    """
    return rows.groupBy(sig).agg(*[F.count_if(F.col(cls) == c).alias(c) for c in classes], F.count("*").alias("n"))
