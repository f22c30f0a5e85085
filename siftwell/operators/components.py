"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.sources.shared import written


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one edge and is no lower end, so labels can be read off."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    sides = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return not sides.where("ups > 1 OR (ups > 0 AND n > ups)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of an undirected edge table; label: the least node that it reaches.

    Each round hooks every neighbourhood to its least member, first upward (large
    star), then downward (small star); the rounds grow with the logarithm of the
    size of a component. A neighbourhood is never gathered: its minimum is
    a partial aggregate that is joined back. Edges are cut from their lineage each
    round. Null ends and loops are left out; repeated edges count once.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    now = written(ends.toDF("u", "v", "whole").where("whole AND u <> v").select("u", "v").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = large.join(lower, "u").select(hooked.alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "edges")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
