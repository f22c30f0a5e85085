"""Visual clusters: features, Lloyd steps and k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.hashes import bits_lsb_first, hex_to_long

K, ROUNDS, ROWS_PER_CLUSTER, COLOUR_WEIGHT = 20, 25, 20, 8.0
#: Vectors whose distances to all centres a worker holds.
AT_ONCE = 4096


def features(phash: str = "phash", colours: str | Column = "color_feat") -> Column:
    """64 hash bits, least significant first, and weighted colour statistics."""
    c = F.col(colours) if isinstance(colours, str) else colours
    return F.concat(F.transform(bits_lsb_first(hex_to_long(F.col(phash))), lambda b: b.cast("double")), F.transform(c, lambda x: x * COLOUR_WEIGHT))


def cluster_count(rows: int, k: int = K) -> int:
    return max(1, min(k, rows // ROWS_PER_CLUSTER))


def _distance(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def nearest(rows: DataFrame, centres: DataFrame, vector: str = "features", id_col: str = "id") -> DataFrame:
    """(id, cluster, d2) of the nearest centre; ties to the least cluster. ``centres``: cluster, centre.

    Centres are a fixed small number, so all of them go to each task as one array.
    """
    held = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("all"))
    best = F.array_min(F.transform("all", lambda c: F.struct(_distance(F.col(vector), c["centre"]).alias("d2"), c["cluster"].alias("cluster"))))
    return rows.join(F.broadcast(held)).select(id_col, vector, best.alias("b")).select(id_col, vector, "b.cluster", "b.d2")


def lloyd(rows: DataFrame, centres: DataFrame, rounds: int, vector: str = "features", id_col: str = "id") -> DataFrame:
    """Centres after ``rounds`` steps: (cluster, centre); an empty cluster keeps its centre."""
    for _ in range(rounds):
        near = nearest(rows, centres, vector, id_col)
        cells = near.select("cluster", F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
        moved = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("moved"))
        centres = centres.join(moved, "cluster", "left").select("cluster", F.coalesce("moved", "centre").alias("centre"))
    return centres


def _nearest(vectors: pa.Array, centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance to the nearest centre, its number) of each vector; ties to the least.

    Dimensions are added in their order, as by ``_distance``. As in SQL a distance to what holds a null or has another length is null,
    which comes first of all, and one that is no number comes last.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    d2, cluster = np.full(len(sizes), np.nan), np.zeros(len(sizes), np.int32)
    null = sizes < 0
    for size in np.unique(sizes[sizes >= 0]).tolist():
        own = np.flatnonzero(sizes == size)
        values = vectors.take(pa.array(own)).flatten()
        gaps = pc.is_null(values).to_numpy(zero_copy_only=False).reshape(len(own), size).any(1)
        x = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(own), size)
        other = [j for j, c in enumerate(centres) if len(c) != size]
        if other:
            null[own], cluster[own] = True, np.where(gaps, 0, other[0])
            continue
        c, d = np.stack(centres), np.zeros((len(own), len(centres)))
        with np.errstate(all="ignore"):
            for i in range(size):
                step = x[:, i, None] - c[None, :, i]
                d += step * step
        j = np.where(np.isnan(d), np.inf, d).argmin(1)
        lost = np.isnan(d[np.arange(len(own)), j])
        j[lost] = np.isnan(d[lost]).argmin(1)
        null[own], d2[own], cluster[own] = gaps, d[np.arange(len(own)), j], np.where(gaps, 0, j)
    return np.ma.masked_array(d2, null), cluster


def _best(vector: str, centres: list[list[float]]) -> Column:
    """(d2, cluster) of the nearest centre; ties to the least. The centres, a number of them that is a parameter, go with the function."""
    held = [np.array(c, float) for c in centres]

    @F.arrow_udf("struct<d2: double, cluster: int>")
    def best(v: pa.Array) -> pa.Array:
        d2, cluster = zip(*(_nearest(v.slice(lo, AT_ONCE), held) for lo in range(0, len(v), AT_ONCE)), strict=True) if len(v) else ([], [])
        parts = [pa.array(np.concatenate([d.data for d in d2]) if d2 else [], pa.float64(), mask=np.concatenate([d.mask for d in d2]) if d2 else None)]
        return pa.StructArray.from_arrays([*parts, pa.array(np.concatenate(cluster) if cluster else [], pa.int32())], names=["d2", "cluster"])

    return best(F.col(vector))


def _waiting(id_col: str, seed: int, draw: int) -> Column:
    """An exponential waiting time for each row and draw, from a hash: the same however rows are dealt."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(str(draw)))), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52)))


def plus_plus(rows: DataFrame, k: int, seed: int = 42, vector: str = "features", id_col: str = "id") -> list[list[float]]:
    """At most ``k`` starting centres: the first by equal chances, each next one in proportion to the squared distance to the nearest so far.

    A row's waiting time over its squared distance is least for one row with just that
    probability, so a draw is one minimum over all rows, a partial aggregate; no running sum is needed. If
    all distances are 0, chances are equal. Rows with a null id or vector are never drawn.
    """
    centres: list[list[float]] = []
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).alias("v"))
    for j in range(k):
        d2 = _best("v", centres)["d2"] if centres else F.lit(1.0)
        key = F.when(d2 > 0, _waiting("i", seed, j) / d2)
        drawn = usable.agg(F.min(F.struct(key.isNull().alias("none"), F.coalesce(key, _waiting("i", seed, j)).alias("key"), "i", "v")).alias("m")).first().m
        if drawn is None:
            break
        centres.append(list(drawn.v))
    return centres


def k_means(rows: DataFrame, k: int, seed: int = 42, rounds: int = ROUNDS, vector: str = "features", id_col: str = "id") -> tuple[DataFrame, list[list[float]]]:
    """((id, cluster), centres): k-means from ``plus_plus``, until no label changes or ``rounds`` are over.

    Labels count as 0 before the first round. A round is one pass: it assigns all rows by the centres of now and of the
    round before, counts what differs, and averages each cluster; an empty cluster keeps its centre. Rows with a null vector have
    no cluster.
    """
    usable = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).alias("v"))
    centres = plus_plus(usable, k, seed, "v", "i")
    before: list[list[float]] | None = None
    final = centres
    for _ in range(rounds if centres else 0):
        label = _best("v", centres)["cluster"]
        changed = label != (_best("v", before)["cluster"] if before is not None else F.lit(0))
        means = [F.avg(F.col("v")[d]).alias(f"m{d}") for d in range(len(centres[0]))]
        found = usable.select("v", label.alias("cluster"), changed.alias("changed")).groupBy("cluster").agg(F.count_if("changed").alias("n_changed"), *means).collect()
        final = centres
        if not sum(r.n_changed for r in found):
            break
        moved = {r.cluster: [r[f"m{d}"] for d in range(len(centres[0]))] for r in found}
        before, centres = centres, [moved.get(j, c) for j, c in enumerate(centres)]
    out = rows.select(id_col, F.when(F.col(vector).isNotNull() & F.lit(bool(final)), _best(vector, final)["cluster"]).alias("cluster"))
    return out, final


def visual_clusters(rows: DataFrame, vector: str = "features", k: int = K, seed: int = 42, rounds: int = ROUNDS, id_col: str = "path") -> DataFrame:
    """Add ``vcluster`` such as ``c07`` by ``k_means``; with too few rows for two clusters all are ``c00``.

    A column ``vcluster`` is replaced; a row without a vector has none.
    """
    rows = rows.drop("vcluster")
    k = cluster_count(rows.count(), k)
    if k <= 1:
        return rows.withColumn("vcluster", F.lit("c00"))
    _, centres = k_means(rows, k, seed, rounds, vector, id_col)
    return rows.withColumn("vcluster", F.when(F.col(vector).isNotNull(), F.format_string("c%02d", _best(vector, centres)["cluster"])) if centres else F.lit(None).cast("string"))


def mllib_clusters(rows: DataFrame, vector: str = "features", k: int = K, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """``visual_clusters`` by Spark's own k-means, with its random starts."""
    k = cluster_count(rows.count(), k)
    if k <= 1:
        return rows.withColumn("vcluster", F.lit("c00"))
    vectors = rows.withColumn("__v", array_to_vector(F.col(vector)))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="__c").fit(vectors)
    return model.transform(vectors).withColumn("vcluster", F.format_string("c%02d", "__c")).drop("__v", "__c")
