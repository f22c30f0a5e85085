"""Training-history bookkeeping: schedules, stages, best epoch and early stop.

A history has a row for each epoch, a number that doesn't grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PATIENCE = 8


def cosine_rate(step: Column, total: Column | int, warmup: Column | int) -> Column:
    """Warm-up (s + 1) / w, then half a cosine from 1 to 0."""
    total, warmup = (x if isinstance(x, Column) else F.lit(x) for x in (total, warmup))
    progress = F.least(F.lit(1.0), (step - warmup).cast("double") / F.greatest(F.lit(1), total - warmup))
    return F.when(step < warmup, (step + 1).cast("double") / F.greatest(F.lit(1), warmup)).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))


def lr_schedule(spark: SparkSession, freeze_steps: int, total_steps: int, warmup_steps: int, head: float = 1e-3, backbone: float = 1e-4) -> DataFrame:
    """(step, factor, lr_head, lr_backbone): factor 1 while frozen, and then no backbone rate but the schedule's."""
    step = F.col("step")
    frozen = step < freeze_steps
    factor = F.when(frozen, F.lit(1.0)).otherwise(cosine_rate(step - freeze_steps, max(1, total_steps - freeze_steps), warmup_steps))
    rows = spark.range(total_steps).select(F.col("id").alias("step")).withColumn("factor", factor)
    return rows.select("step", "factor", (F.col("factor") * head).alias("lr_head"), F.when(frozen, F.lit(0.0)).otherwise(F.col("factor") * backbone).alias("lr_backbone"))


def history_concat(stages: DataFrame) -> DataFrame:
    """Stages in order with a running ``global_epoch`` from 0; a later stage needs all before it."""
    lacking = stages.agg((F.max("stage") - F.min("stage") + 1 - F.countDistinct("stage")).alias("gaps"), F.min("stage").alias("first")).first()
    if lacking["first"] is not None and (lacking["gaps"] or lacking["first"] != 1):
        raise ValueError("a stage is missing before a later one")
    per = stages.groupBy("stage").agg(F.min("epoch").alias("lo"), (F.max("epoch") - F.min("epoch") + 1).alias("size"))
    offsets = per.withColumn("offset", F.sum("size").over(Window.orderBy("stage")) - F.col("size"))
    return stages.join(F.broadcast(offsets), "stage").withColumn("global_epoch", F.col("offset") + F.col("epoch") - F.col("lo")).drop("lo", "size", "offset")


def best_epoch_early_stop(history: DataFrame, metric: str = "val_macro_f1", patience: int = PATIENCE) -> DataFrame:
    """Each epoch with ``improved``, ``stale`` (unfrozen epochs since the best) and ``stop``.

    An epoch improves if it is strictly above all before it; the first always does.
    Frozen epochs don't count as stale. ``stop``: the first epoch with ``patience`` stale ones.
    """
    w = Window.orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("improved", F.col(metric) > F.coalesce(F.max(metric).over(before), F.lit(-1.0)))
    rows = rows.withColumn("island", F.sum(F.col("improved").cast("int")).over(w))
    counts = F.sum((~F.col("improved") & ~F.col("frozen")).cast("int")).over(Window.partitionBy("island").orderBy("epoch"))
    rows = rows.withColumn("stale", counts)
    reached = (F.col("stale") >= patience) & ~F.col("frozen")
    rows = rows.withColumn("stop", reached & (F.sum(reached.cast("int")).over(w) == 1))
    return rows.select("epoch", metric, "frozen", "improved", "stale", "stop")


def best_and_final(history: DataFrame, metric: str = "val_accuracy", order: str = "epoch") -> DataFrame:
    """(best, best_epoch, final): ties of the best go to the first epoch; final is the last row."""
    best = F.max(F.struct(F.col(metric).alias("m"), F.negative(order).alias("e")))
    return history.agg(best.alias("b"), F.max_by(metric, order).alias("final")).select(F.col("b.m").alias("best"), F.negative("b.e").alias("best_epoch"), "final")
