"""Vector codes by product quantization, their nearest entries found in a VA-file.

A vector of integers is cut into parts, and each part is coded by the nearest entry of its
position's codebook. The entries' coordinates are quantised to a few bits: the cells of a VA-file. For a
query, a table for each coordinate holds the least and the largest squared distance to
every cell; their sums bound the distance to each entry from below and above. Only
entries whose lower bound doesn't exceed the least upper bound are looked at, with integer distances,
so codes are exact, ties go to the lower index, and no float takes part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import released, table, written
from siftwell.operators.running import join_null_safe

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Bits of a cell.
BITS = 3
#: Vectors that are looked at together.
SLICE = 2048
#: Components of a larger size would overflow 64-bit sums of squares.
LARGEST = 1 << 26


class Cells:
    """The VA-file of one codebook: ``entries`` (k, width) int64, all of them kept beside their cells.

    Cells are cut at quantiles of the entries' coordinates, and each is as narrow as its entries allow.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        k, width = entries.shape
        n = min(1 << bits, max(1, k))
        self.entries = entries
        self.cell = np.empty((k, width), np.int64)
        self.lo, self.hi = np.zeros((width, n), np.int64), np.zeros((width, n), np.int64)
        for d in range(width):
            order = np.sort(entries[:, d])
            cuts = order[(np.arange(1, n) * k) // n]
            self.cell[:, d] = np.searchsorted(cuts, entries[:, d], side="right")
            for c in range(n):
                own = entries[self.cell[:, d] == c, d]
                if len(own):
                    self.lo[d, c], self.hi[d, c] = own.min(), own.max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distances of each query to each entry, from tables of its distances to cells."""
        low = np.zeros((len(queries), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            below, above = self.lo[d][None] - q, q - self.hi[d][None]
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            low += (least * least)[:, self.cell[:, d]]
            high += (most * most)[:, self.cell[:, d]]
        return low, high

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """(queries, entries): which entries may be nearest."""
        low, high = self.bounds(queries)
        return low <= high.min(1, keepdims=True)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each query; ties to the lower index."""
        row, entry = np.nonzero(self.candidates(queries))
        gap = queries[row] - self.entries[entry]
        distance = np.full((len(queries), len(self.entries)), np.iinfo(np.int64).max)
        distance[row, entry] = (gap * gap).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(len(queries)), best]


def integer_vectors(rows: DataFrame, scale: int = SCALE, *, vector: str = "embedding", id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label and v (floor of ``scale`` times each component) of the rows whose vector can be coded.

    Null vectors and vectors with null or non-finite components are dropped.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = named.where(F.col("x").isNotNull() & ~odd)
    large = F.exists("x", lambda c: F.abs(c) > LARGEST / scale)
    sure = F.when(large, F.raise_error(F.lit(f"components beyond {LARGEST // scale} can't be coded in 64 bits"))).otherwise(F.col("x"))
    return kept.select("vec_id", "label", F.transform(sure, lambda c: F.floor(c * F.lit(float(scale))).cast("int")).alias("v"))


def _sliced(batches, size: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), width)


def _first_entries(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of the least ids, at most ``entries`` rows of the driver's memory."""
    rows = vectors.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()
    width = len(rows[0].v) // parts if rows else 0
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, s): how many parts are nearest to each entry, and their sums. A batch gives a row for each entry at most."""
    parts, entries, width = books.shape
    schema = T.StructType().add("part", T.IntegerType()).add("entry", T.IntegerType()).add("n", T.LongType()).add("s", T.ArrayType(T.LongType()))

    def run(batches):
        cells = [Cells(b) for b in books]
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _sliced(batches, SLICE):
            x = _matrix(batch["v"], parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                best, _ = cells[p].nearest(own)
                n[p] += np.bincount(best, minlength=entries)
                np.add.at(s[p], best, own)
        part, entry = np.nonzero(n)
        sums = s[part, entry]
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums.reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), column], names=schema.names)
        released()

    each = vectors.select("v").mapInArrow(run, schema)
    totals = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals)


def codebooks(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, width) int64 after ``rounds`` steps from the vectors of least ids.

    ``vectors``: ``integer_vectors``, all of one length, which ``parts`` divides. A round assigns every part, then
    replaces each entry by the floor of the mean of its parts; unused entries stay. With fewer
    vectors than entries there are as many entries as vectors. A round brings parts * entries rows to the
    driver, whatever the number of vectors.
    """
    books = _first_entries(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        moved = books.copy()
        for r in _sums(vectors, books).collect():
            moved[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(books.shape[2])]
        books = moved
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (a byte for each part) and error (the squared distances of all parts) of each vector."""
    parts, entries, width = books.shape
    schema = T.StructType().add("vec_id", T.LongType()).add("label", vectors.schema["label"].dataType).add("code", T.BinaryType()).add("error", T.LongType())

    def run(batches):
        cells = [Cells(b) for b in books]
        for batch in _sliced(batches, SLICE):
            x = _matrix(batch["v"], parts * width)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                best, distance = cells[p].nearest(x[:, p * width : (p + 1) * width])
                code[:, p] = best
                error += distance
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=schema.names)
        released()

    return vectors.select("vec_id", "label", "v").mapInArrow(run, schema)


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, approx) of ``coded`` rows: the vector that a code stands for, each component the middle of its integer's range."""
    schema = T.StructType().add("vec_id", T.LongType()).add("approx", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in _sliced(batches, SLICE):
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            x = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(((x + 0.5) / scale).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], column], names=schema.names)

    return codes.select("vec_id", "code").mapInArrow(run, schema)


def compressed(rows: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks) of the vectors in ``rows`` (vec_id, embedding, label; other columns don't count).

    Vectors that are null or hold null or non-finite components are dropped, and so are those of another
    length than the vector of the least vec_id (where its length isn't a multiple of ``parts``, all).
    Null and repeated vec_ids get codes as others do; the first entries come from vec_ids that aren't null, equal ones by their
    vectors. An empty table has no codebooks and no codes.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    whole = written(integer_vectors(rows, scale), "vectors")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    n = first.n if first else 0
    vectors = whole.where(F.size("v") == (n if n % parts == 0 else -1))
    books = codebooks(vectors, parts=parts, entries=entries, rounds=rounds)
    if not books.shape[1] and first:  # vectors, but none with an id
        vectors = vectors.limit(0)
    return coded(vectors, books), books


def op13_va_file_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, two rounds."""
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    codes = written(codes, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_null_safe(codes, by_label, ["label"]).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    distance = " + ".join(f"(p.x[{i}] - c.x[{i}]) * (p.x[{i}] - c.x[{i}])" for i in range(1, 5))
    near = f"SELECT p.vec_id, p.part, any_value(p.x) AS x, min(({distance}) * {ENTRIES} + entry) AS best FROM p JOIN c{{r}} c ON p.part = c.part GROUP BY p.vec_id, p.part"
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, 4 * part + 1, 4 * part + 4) AS x FROM v, (SELECT range AS part FROM range({PARTS})))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(rounds):
        mean = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
        parts.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, best % {ENTRIES} AS entry, [{mean}] AS x FROM n{r} GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry)")
    return f"""WITH {", ".join(parts)}, last AS MATERIALIZED ({near.format(r=rounds)}),
codes AS (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN v USING (vec_id), books"""


QUERIES = {"op13_va_file_codes": op13_va_file_codes}
ORACLES = {"op13_va_file_codes": _oracle()}
