"""Manifests, splits, reports and metadata as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.running import row_numbers

MANIFEST = "class string, new_path string, orig_path string, subclass string, pseudo_source string, width int, height int, vcluster string, blur double, phash string, qsig string"
NONE = "-"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A manifest in CSV, with or without a byte order mark, whatever columns it has and in any order.

    Columns that the file lacks, and missing values, are ``-`` (strings) or null (numbers). Columns beyond ``schema`` are dropped.
    """
    raw = spark.read.option("header", True).csv(path)
    found = {c.lstrip("\ufeff"): c for c in raw.columns}
    fields = T.StructType.fromDDL(schema).fields
    columns = [F.col(f"`{found[f.name]}`").try_cast(f.dataType) if f.name in found else F.lit(None).cast(f.dataType) for f in fields]
    return raw.select(*[c.alias(f.name) for c, f in zip(columns, fields, strict=True)]).na.fill(NONE)


def training_frame(manifest: DataFrame) -> DataFrame:
    """path, class_dir, source, vcluster and phash (lower case); absent columns and nulls are ``-``."""
    named = {"new_path": "path", "class": "class_dir", "pseudo_source": "source", "vcluster": "vcluster", "phash": "phash"}
    columns = [F.coalesce(F.col(old), F.lit(NONE)).alias(new) if old in manifest.columns else F.lit(NONE).alias(new) for old, new in named.items()]
    return manifest.select(*columns).withColumn("phash", F.lower("phash"))


def labelled(frame: DataFrame, classes: list[str]) -> DataFrame:
    """Rows of the listed classes with ``label``, the class's place in the list."""
    dim = frame.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], "class_dir string, label int")
    return frame.join(F.broadcast(dim), "class_dir")


def first_rows(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each ``key``: the first by ``order``."""
    names = frame.columns
    first = frame.groupBy(key).agg(F.min(F.struct(*order, *[c for c in names if c not in order])).alias("m"))
    return first.select(*[F.col(f"m.{c}").alias(c) for c in names])


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, r"[/\\]"), -1)


def path_repair(frame: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Paths that the listing has, as they are or as root/class_dir/basename; other rows are dropped. Adds ``repaired``."""
    files = listing.select(F.col("path").alias("found")).distinct()
    moved = F.concat_ws("/", F.lit(root.rstrip("/")), "class_dir", basename("path"))
    direct = frame.join(files, F.col("path") == F.col("found"), "left").withColumn("path", F.coalesce("found", moved)).withColumn("repaired", F.col("found").isNull()).drop("found")
    return direct.join(files, F.col("path") == F.col("found"), "left_semi")


# File name prefixes of classes, in order.
PREFIXES = (("acne-", "acne"), ("eczema-", "eczema"), ("infestations_bites-", "bites"), ("cutaneous-", "bites"), ("scabies-", "bites"), ("melanoma", "melanoma"), ("isic_", "melanoma"))


def class_of_name(name: Column) -> Column:
    """Class by the file name's prefix, whatever its case; null for others."""
    out = F.lit(None).cast("string")
    for prefix, cls in reversed(PREFIXES):
        out = F.when(F.startswith(F.lower(name), F.lit(prefix)), F.lit(cls)).otherwise(out)
    return out


def numbered(rows: DataFrame, cls: str = "cls", order: str = "path") -> DataFrame:
    """Add ``new_path``: class/000000.ext, numbered by ``order`` in each class; numbers above 999999 are longer.

    Numbers are taken in ranges of a class, so none has to fit in a task. A null class is the class ``-``.
    """
    dot = F.regexp_extract(basename(order), r"(\.[^.]*)\z", 1)
    name = F.concat(F.coalesce(F.col(cls), F.lit(NONE)), F.lit("/"), F.format_string("%06d", F.col("__sw_n") - 1), F.lower(dot))
    return row_numbers(rows, [cls], [F.col(order)], "__sw_n").withColumn("new_path", name).drop("__sw_n")


def manifest_projection(rows: DataFrame) -> DataFrame:
    """The eleven columns of a manifest; blur to two digits."""
    return rows.select(
        F.col("cls").alias("class"), "new_path", F.col("path").alias("orig_path"), "subclass", F.col("source").alias("pseudo_source"),
        "width", "height", "vcluster", F.round("blur", 2).alias("blur"), "phash", "qsig",
    )


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, also for no rows."""
    rows.write.mode(mode).option("header", True).csv(path)


def write_splits(split: DataFrame, path: str, columns: tuple[str, ...] = ("path", "label", "class_dir", "source", "dup_group")) -> None:
    """One table in folders split=train, split=val and split=test."""
    split.select(*columns, "split").write.partitionBy("split").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line; an error if ``path`` is there."""
    rows.write.json(path)
