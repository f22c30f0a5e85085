"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept and is
written as Parquet before the next reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, langid, packing, pii, setsketch
from siftwell.llm.common import table, text_of, written

#: A score has to be so far from a guess among the learnt languages to certainty: 0.3625 with four of them.
LEAST_MARGIN = 0.15
SEQUENCE_TOKENS = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null or letterless texts, and scores within ``LEAST_MARGIN`` of a guess.

    The network learns from the labelled rows that are not held out. A null ``lang`` becomes
    the predicted one. Without labelled rows every document is rejected.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    guess = 1 / len(model.labels) if model else 1.0
    found = docs.withColumn("__sw_p", langid.predicted(model, text_of()))
    sure = found.where((F.col("__sw_p.lang_pred") != langid.UNKNOWN) & (F.col("__sw_p.score") >= guess + LEAST_MARGIN * (1 - guess)))
    return sure.withColumn("lang", F.coalesce("lang", "__sw_p.lang_pred")).drop("__sw_p")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group: five words, similarity 0.8.

    Rows of one doc_id stay or go together; rows without doc_id stay.
    """
    groups = setsketch.near_duplicates(docs, shingle=5, percent=80)
    return docs.join(groups.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or the same question with other values; rows without doc_id stay."""
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; ``n_chars`` follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most ``SEQUENCE_TOKENS``: a row for each piece with its ids and its place."""
    pieces = packing.cut_pieces(docs, "word_bpe_49k.json", SEQUENCE_TOKENS)
    return packing.packed(written(pieces, "pieces"), SEQUENCE_TOKENS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: No stage but decontamination can be said in SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
