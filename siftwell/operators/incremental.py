"""Near duplicates of rows that arrive in batches. An extension: nothing like it is in what the rest follows.

The hashes seen so far and the buckets of their bands are tables on disk. A batch meets itself and what was
there before in an equi-join by band, and its links are kept beside those of other batches. Links of
all batches together are those of one batch with all rows, so groups don't hang on how rows were cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siftwell.functions.hashes import hamming, hex_to_long, valid_hash
from siftwell.operators.components import connected_components
from siftwell.operators.hamming import THRESHOLD, band_bounds
from siftwell.sources.shared import exists, written

HASHES, BANDS, LINKS = "id long, h long, batch long", "h long, band int, key long, batch long", "a long, b long, batch long"


class NearDuplicateIndex:
    """A folder with the hashes, band buckets and links of all batches so far.

    A batch is known by its number: adding it again replaces what it had left, so a batch that failed half way, or that a
    stream delivers twice, counts once. Batches have to be added one after the other.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int = THRESHOLD):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold

    def _table(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(where) if exists(self.spark, where) else self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _spots(self, h: Column) -> Column:
        """The band and its bits of a hash, for each band."""
        bands = enumerate(band_bounds(self.threshold + 1, whole=True))
        return F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for b, (lo, width) in bands])

    def add(self, rows: DataFrame, batch: int, id_col: str = "doc_id") -> None:
        """Add the rows (id, phash) of a batch. Rows with an invalid hash have no links; null ids don't count.

        Equal hashes are one: the bands hold each hash once, and its rows are tied by the hash itself. So many copies cost no
        pairs, and a bucket holds different hashes only.
        """
        own = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(valid_hash(F.lower("phash")), hex_to_long(F.lower("phash"))).alias("h"))
        own = written(own.distinct(), "batch")
        before = self._table("bands", BANDS).where(F.col("batch") != batch)
        fresh = own.where("h IS NOT NULL").select("h").distinct().join(before.where("band = 0").select("h"), "h", "left_anti")
        spread = written(fresh.select("h", F.explode(self._spots(F.col("h"))).alias("s")).select("h", "s.band", "s.key"), "bands")
        there = before.select(F.col("h").alias("o"), "band", "key").unionByName(spread.select(F.col("h").alias("o"), "band", "key"))
        close = (F.col("h") != F.col("o")) & (hamming(F.col("h"), F.col("o")) <= self.threshold)
        links = spread.join(there, ["band", "key"]).where(close).select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct()
        self._put(links, "links", batch)
        self._put(spread, "bands", batch)
        self._put(own, "hashes", batch)

    def groups(self, id_col: str = "doc_id") -> DataFrame:
        """(id, group_id) of all rows so far: the least id of the group; rows without a valid hash are groups of their own."""
        rows = self._table("hashes", HASHES).select("id", "h").distinct()
        labels = connected_components(self._table("links", LINKS).select("a", "b"))
        named = rows.join(labels, rows.h == labels.node, "left").withColumn("own", F.coalesce("label", "h"))
        least = named.where("own IS NOT NULL").groupBy("own").agg(F.min("id").alias("group_id"))
        return named.join(least, "own", "left").select(F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id")).groupBy(id_col).agg(F.min("group_id").alias("group_id"))

    def sink(self, id_col: str = "doc_id") -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` of a stream takes."""
        return lambda rows, batch: self.add(rows, batch, id_col)

    def follow(self, stream: DataFrame, checkpoint: str, id_col: str = "doc_id") -> DataStreamWriter:
        """A writer that adds each micro-batch of a stream of (id, phash); its checkpoint makes batch numbers last over restarts."""
        return stream.writeStream.foreachBatch(self.sink(id_col)).option("checkpointLocation", checkpoint)
