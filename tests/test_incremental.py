"""Near duplicates in batches: groups don't hang on how the rows are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import hamming
from siftwell.operators.incremental import NearDuplicateIndex


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    values = []
    for _ in range(150):
        v = base[rng.integers(0, 12)]
        for _ in range(rng.integers(0, 5)):
            v ^= 1 << int(rng.integers(0, 64))
        values.append(f"{v:016x}")
    data = [(i, v) for i, v in enumerate(values)] + [(200, "bad"), (201, None), (202, values[0].upper())]
    return spark.createDataFrame(data, "doc_id long, phash string").repartition(3)


def groups(df):
    return {r.doc_id: r.group_id for r in df.collect()}


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_cut_gives_the_groups_of_one_batch(spark, rows, tmp_path, cuts):
    index = NearDuplicateIndex(spark, str(tmp_path / "index"))
    for k in range(cuts):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(cuts)) == k), k)
    want = groups(hamming.exact_groups(rows))
    assert groups(index.groups()) == want
    index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(cuts)) == 0), 0)  # delivered again
    index.add(rows.limit(0), 99)
    assert groups(index.groups()) == want


def test_a_stream_of_files(spark, rows, tmp_path):
    index = NearDuplicateIndex(spark, str(tmp_path / "index"))
    for k in range(2):
        rows.where(F.col("doc_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = index.follow(stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert groups(index.groups()) == groups(hamming.exact_groups(rows))
