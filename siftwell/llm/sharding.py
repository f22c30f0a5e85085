"""Sharding by a hypergeometric communication matrix.

A uniform shuffle of N rows into shards of exact sizes, in three steps:

1. each input partition permutes its own rows;
2. a matrix of counts, whose row sums are the partition sizes and whose column
   sums are the slice sizes, is drawn from the multivariate hypergeometric law
   and says how many rows go from each partition to each slice of a shard;
3. after the exchange every slice permutes what it has received.

No task needs the whole matrix: a seeded binary tree over the partitions halves
the column sums, and a partition walks from the root to its own leaf, so all
tasks agree on the matrix without the driver ever holding it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftwell.llm.common import table, text_of, written

#: numpy's own sampler takes populations below this size.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good; any population."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    p = good / (good + bad)
    mean = n * p
    sd = np.sqrt(max(1.0, n * p * (1 - p) * (good + bad - n) / (good + bad - 1)))
    first, last = max(lo, int(mean - 12 * sd)), min(hi, int(mean + 12 * sd) + 1)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return first + int(np.searchsorted(cdf, rng.random() * cdf[-1]))


def draw_columns(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """Split ``n`` rows over ``columns`` by the multivariate hypergeometric law."""
    total = int(columns.sum())
    if n == 0 or total == 0:
        return np.zeros_like(columns)
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(columns, n, method="marginals")
    half = len(columns) // 2
    if half == 0:
        return np.array([n], dtype=np.int64)
    left = int(columns[:half].sum())
    to_left = hypergeometric(rng, left, total - left, n)
    return np.concatenate([draw_columns(rng, columns[:half], to_left), draw_columns(rng, columns[half:], n - to_left)])


def matrix_row(seed: int, before: np.ndarray, columns: np.ndarray, part: int) -> np.ndarray:
    """The matrix row of one partition. ``before[i]``: rows of all partitions before i."""
    lo, hi, own = 0, len(before) - 1, columns
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = draw_columns(rng, own, int(before[mid] - before[lo]))
        own, lo, hi = (left, lo, mid) if part < mid else (own - left, mid, hi)
    return own


def slice_sizes(rows: int, shards: int, slices: int) -> np.ndarray:
    sizes = [rows // shards + (j < rows % shards) for j in range(shards)]
    return np.array([(k + 1) * s // slices - k * s // slices for s in sizes for k in range(slices)], dtype=np.int64)


def shuffle_to_shards(docs: DataFrame, n_shards: int, *, seed: int = 17, rows_per_slice: int = 1 << 15, stable: bool = False) -> DataFrame:
    """All rows of ``docs`` in uniformly random order over ``n_shards`` shards.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); columns
    of these names are replaced, all others are kept. Shard sizes differ by one row
    at most. Nulls, empty texts and repeated rows are rows like any other; an empty
    table gives an empty result. Rows of a hot key spread like all others, since no
    column decides where a row goes.

    ``stable``: ``docs`` is a plain file scan, whose partitions are the same each
    time they are read. Anything else is first written to the shared folder.
    A partition that still changes between the two passes stops the job.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    src = docs if stable else written(docs, "shard-input")
    row_id = F.monotonically_increasing_id()
    # One row for each input partition comes to the driver: 16 bytes for some 128 MB of input.
    counted = src.select(F.shiftrightunsigned(row_id, 33).alias("part")).groupBy("part").count().collect()
    rows = sum(r["count"] for r in counted)
    sizes = np.zeros(max((r["part"] for r in counted), default=0) + 1, dtype=np.int64)
    for r in counted:
        sizes[r["part"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(sizes)])
    slices = max(1, -(-rows // (n_shards * rows_per_slice)))
    held = docs.sparkSession.sparkContext.broadcast((before, slice_sizes(rows, n_shards, slices)))

    plans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def plan_of(part: int) -> tuple[np.ndarray, np.ndarray]:
        if part not in plans:
            plans.clear()
            before, columns = held.value
            order = np.random.default_rng([seed, 1, part]).permutation(before[part + 1] - before[part])
            plans[part] = order, np.cumsum(matrix_row(seed, before, columns, part))
        return plans[part]

    @F.pandas_udf(T.IntegerType())
    def slice_for(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy()
        parts, index = ids >> 33, ids & ((1 << 33) - 1)
        out = np.empty(len(ids), dtype=np.int32)
        for part in np.unique(parts):
            at = parts == part
            order, ends = plan_of(int(part))
            if index[at].max() >= len(order):
                raise RuntimeError("a partition has changed since it was counted; pass stable=False")
            out[at] = np.searchsorted(ends, order[index[at]], side="right")
        return pd.Series(out)

    sent = src.select(*kept, row_id.alias("__sw_id")).withColumn("__sw_slice", slice_for("__sw_id"))
    inside = Window.partitionBy("__sw_slice").orderBy(F.xxhash64(F.lit(seed), "__sw_id"), "__sw_id")
    shard = F.expr(f"CAST(__sw_slice DIV {slices} AS INT)")
    size = F.expr(f"{rows // n_shards}L + IF(__sw_slice DIV {slices} < {rows % n_shards}, 1L, 0L)")
    return (
        sent.withColumn("__sw_rank", F.row_number().over(inside))
        .withColumn("shard", shard)
        .withColumn("__sw_size", size)
        .withColumn("slot", F.expr(f"((__sw_slice % {slices}) * __sw_size) DIV {slices} + __sw_rank - 1L"))
        .select(*kept, "shard", "slot")
    )


def op2_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts differ by one at most (law ``rows``)."""
    placed = shuffle_to_shards(table(spark, sf_dir, "documents"), 8, stable=True)
    text = text_of()
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_hypergeometric_sharding": op2_hypergeometric_sharding}
ORACLES: dict[str, str] = {}
