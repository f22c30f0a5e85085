"""Histories, reports and metadata of training runs as files that Spark reads and writes."""

from __future__ import annotations

import json
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.sources.shared import exists

HISTORY = "epoch int, loss double, accuracy double, val_loss double, val_accuracy double"


def read_histories(spark: SparkSession, paths: list[str], schema: str = HISTORY) -> DataFrame:
    """The histories at ``paths``, each with its place in the list as ``stage``, from 1; absent paths are left out.

    Columns are taken by name; those that a file lacks are null. Without any file the result is empty.
    """
    fields = T.StructType.fromDDL(schema).fields
    out = spark.createDataFrame([], T.StructType([T.StructField("stage", T.IntegerType()), *fields]))
    for stage, path in enumerate(paths, 1):
        if exists(spark, path):
            raw = spark.read.option("header", True).csv(path)
            columns = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
            out = out.unionByName(raw.select(F.lit(stage).alias("stage"), *columns))
    return out


def append_history(rows: DataFrame, path: str) -> None:
    """Add rows to a history in CSV; the files that are there stay."""
    rows.write.mode("append").option("header", True).csv(path)


def mismatched(test: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n_test, n_scored) of ids that are not in one test row and one prediction each; a null id never is."""
    each = test.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("t")).join(scored.groupBy(F.col(id_col).alias("j")).agg(F.count("*").alias("s")), F.col("i") == F.col("j"), "full")
    zero = F.lit(0).cast("long")
    odd = each.where("t IS NULL OR s IS NULL OR t <> 1 OR s <> 1")
    return odd.select(F.coalesce("i", "j").alias(id_col), F.coalesce("t", zero).alias("n_test"), F.coalesce("s", zero).alias("n_scored"))


def predictions_of(test: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """Test rows with their predictions, joined by id.

    An error if a test row has no prediction or several, or a prediction has no test row:
    rows that don't line up would give wrong metrics in silence. Null ids never line up.
    """
    odd = mismatched(test, scored, id_col).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).first()
    if odd.n:
        raise ValueError(f"{odd.n} ids of test rows and predictions don't match one to one, such as {odd.first}")
    return test.join(scored, id_col)


def report_lines(report: DataFrame, digits: int = 4) -> DataFrame:
    """A classification report as lines of text (at, value), in the report's order: classes, accuracy, averages."""
    rank = F.when(F.col("name") == "accuracy", 1).when(F.col("name") == "macro avg", 2).when(F.col("name") == "weighted avg", 3).otherwise(0)
    # Of the number as it is stored: the JVM rounds its shortest decimal form, so 0.12315, which is stored as less, would go up.
    fixed = F.udf(lambda x: None if x is None else f"{x:.{digits}f}", "string")
    numbers = [F.format_string("%12s", fixed(c)) for c in ("precision", "recall", "f1")]
    value = F.concat(F.format_string("%-16s", "name"), *numbers, F.format_string("%12d", F.col("support").cast("long")))
    return report.select(F.struct(rank.alias("r"), F.try_to_number("name", F.lit("999999")).alias("n"), "name").alias("at"), value.alias("value"))


def write_report(report: DataFrame, confusion: DataFrame, path: str) -> None:
    """``path``/report as text lines and ``path``/confusion as rows (label, prediction, n) in CSV."""
    report_lines(report).orderBy("at").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    confusion.orderBy("label", "prediction").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion")


def write_kfold_summary(summary: DataFrame, path: str) -> None:
    """(metric, mean, std) in CSV."""
    summary.orderBy("metric").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def environment(spark: SparkSession, seed: int, **parameters) -> DataFrame:
    """One row (name, value) for each fact that a run should be repeated with: versions, settings, seed and parameters."""
    facts = {"seed": seed, "python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "time_zone": spark.conf.get("spark.sql.session.timeZone")}
    rows = [(k, str(v)) for k, v in sorted((facts | parameters).items())]
    return spark.createDataFrame(rows, "name string, value string").withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def write_metadata(classes: list[str], facts: DataFrame, path: str) -> None:
    """``path``/classes.json (class_dir, label) and ``path``/run_meta.json (name, value, at), a JSON object a line."""
    spark = facts.sparkSession
    spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "class_dir string, label int").coalesce(1).write.mode("overwrite").json(f"{path}/classes.json")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/run_meta.json")


#: A run's record: settings and versions by name, rows of each split, and of each class in each split.
RUN = "timestamp string, args map<string, string>, environment map<string, string>, split_sizes map<string, bigint>, class_counts map<string, map<string, bigint>>"


def counted(rows: DataFrame, split: str = "split", cls: str = "class_dir") -> DataFrame:
    """One row (split_sizes, class_counts): maps of counts, nested for classes. Null names are ``-``."""
    named = rows.select(F.coalesce(F.col(split).cast("string"), F.lit("-")).alias("s"), F.coalesce(F.col(cls).cast("string"), F.lit("-")).alias("c"))
    cells = named.groupBy("c", "s").agg(F.count("*").alias("n"))
    as_map = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    sizes = cells.groupBy("s").agg(F.sum("n").alias("n")).agg(as_map("s", "n").alias("split_sizes"))
    classes = cells.groupBy("c").agg(as_map("s", "n").alias("m")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", F.map_entries("m").alias("e"))))).alias("m"))
    nested = F.transform_values("m", lambda _, e: F.map_from_entries(e))
    return sizes.join(F.broadcast(classes.select(nested.alias("class_counts"))))  # one row each


def run_record(spark: SparkSession, counts: DataFrame, args: dict, seed: int) -> DataFrame:
    """One row of ``RUN``: ``counted`` with args and environment."""
    facts = {r.name: r.value for r in environment(spark, seed).collect()}
    text = lambda d: F.from_json(F.lit(json.dumps({k: str(v) for k, v in sorted(d.items())}, ensure_ascii=False)), "map<string, string>")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return counts.select(now.alias("timestamp"), text(args).alias("args"), text(facts).alias("environment"), "split_sizes", "class_counts")


def write_run(record: DataFrame, path: str) -> None:
    """The record as one JSON object in ``path``."""
    record.select(F.to_json(F.struct(*record.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_run`` wrote, by the declared schema; fields that a file lacks are null."""
    return spark.read.text(path).select(F.from_json("value", RUN).alias("r")).select("r.*")
