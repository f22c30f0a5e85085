"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.shared import shared_dir, written

__all__ = ["bucketed", "parts", "released", "remembered", "shared_dir", "slices", "table", "text_of", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` bytes of ``column``, or of one row that is longer."""
    for batch in batches:
        lo = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def parts(arrays: Iterable[pa.Array], size: int) -> Iterator[pa.Array]:
    """The same for single arrays of strings or bytes."""
    for batch in slices((pa.RecordBatch.from_arrays([a], names=["a"]) for a in arrays), "a", size):
        yield batch["a"]


def released() -> None:
    """Give memory that is free back to the system: an executor's idle workers stay, and count."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # with the GNU library only
    if trim:
        trim(0)


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """``written``, with rows in buckets by ``key``, so that joins by it don't shuffle this table again.

    There are as many buckets as shuffle partitions. The table is in the shared folder; the catalog knows it only while it is opened.
    """
    spark = df.sparkSession
    name = f"siftwell_{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved, so the catalog is not asked again
    spark.sql(f"DROP TABLE {name}")
    return out


_HELD: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What this worker holds under ``name`` from task to task; what it held for other names is let go."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]
