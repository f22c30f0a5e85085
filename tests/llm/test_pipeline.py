"""The pipeline on small corpora, each stage against a plain version of it."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import langid, pii, registry
from test_decontamination import plain
from test_dedup import components
from test_training_data import library

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def replaced(text, spans):
    """The text with every position that a span covers gone, and each span's kind where a run of them begins."""
    out, at = "", 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += text[at:s] + f"<{kind.upper()}>"
        at = max(at, e)
    return out + text[at:]


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS)
    odd = docs.limit(3).select(F.col("doc_id") + 10**6, F.lit(None).cast("string"), "lang", "source", "n_chars").toDF(*COLUMNS)
    again = docs.limit(4).select((F.col("doc_id") + 2 * 10**6).alias("doc_id"), *COLUMNS[1:])
    now = docs.unionByName(odd).unionByName(again)
    stages = dict(corpus_pipeline.STAGES)
    text_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    was = text_of(now)

    kept = stages["language_id"](spark, now, SF)
    assert kept.columns == COLUMNS
    model = langid.fit(now.where(~langid.held_out(F.col("doc_id"))))
    names = sorted(was)
    labels, scores = langid.Predictor(model)([was[i] for i in names])
    least = 0.25 + 0.75 * corpus_pipeline.LEAST_MARGIN
    assert len(model.labels) == 4
    assert set(text_of(kept)) == {i for i, name, s in zip(names, labels, scores, strict=True) if name != "und" and s >= least}
    assert kept.where("lang IS NULL").count() == 0
    now = spark.createDataFrame(kept.collect(), kept.schema)

    was = text_of(now)
    kept = stages["near_dedup"](spark, now, SF)
    names = sorted(was)
    label, _ = components([was[i] for i in names], 5, 80)
    assert kept.columns == COLUMNS and set(text_of(kept)) == {names[k] for k, own in enumerate(label) if own == k}
    now = spark.createDataFrame(kept.collect(), kept.schema)

    was = text_of(now)
    kept = stages["benchmark_decontamination"](spark, now, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = was.keys() - text_of(kept).keys()
    assert kept.columns == COLUMNS and gone == {doc for doc, _ in plain(sorted(was.items()), items)} and gone
    now = spark.createDataFrame(kept.collect(), kept.schema)

    was = text_of(now)
    kept = stages["personal_data"](spark, now, SF)
    field = pii.fitted()
    after = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert kept.columns == COLUMNS
    assert after == {i: (replaced(t, pii.all_spans(t, field)), len(replaced(t, pii.all_spans(t, field)))) for i, t in was.items()}
    marked = [(3 * 10**6, "T\u0308 aW\u030ax J\u030c, H\u0331o", "en", "s", 12)]  # capitals that don't compose as their small letters do
    now = spark.createDataFrame([*kept.collect(), *marked], kept.schema)

    was, t = text_of(now), library("word_bpe_49k.json")
    pieces = stages["best_fit_packing"](spark, now, SF).collect()
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        assert zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in was.items()}
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]]
        assert sum(n for _, n in own) <= 2048


@pytest.mark.parametrize("case", ["empty", "repeated", "clashing"])
def test_odd_tables(spark, case):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS).limit(40)
    if case == "empty":
        docs = docs.limit(0)
    elif case == "repeated":
        docs = docs.unionByName(docs).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    else:
        docs = docs.withColumns({c: F.lit(7) for c in ("n", "th", "rep", "piece", "label", "scheme", "h", "pii", "bucket")})
    columns = docs.columns
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = docs.collect()
    assert {r.doc_id for r in left} <= before
    assert bool(left) == (case != "empty")


def test_registry_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert registry.oracle_sql().keys() <= names.keys()
