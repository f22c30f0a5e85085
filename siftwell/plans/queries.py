"""All queries of the library over the tables at hand, each with its oracle in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import classifier, clusters, conflicts, hamming, history, metrics, quality, running, sampling, splitting
from siftwell.plans import oracles as O
from siftwell.sources import adapters, images, manifest, results
from siftwell.sources.adapters import N_CLASSES
from siftwell.sources.shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Sampling target of the class ``en`` and the audit's share for bucket signatures.
TARGET, BUCKET_SHARE = 300, 0.60


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(adapters.records(spark, sf_dir))


#: Queries with a twin ``<name>_exact`` that has no bucket cap.
TWINS: list[str] = []


def grouped(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """Filtered records with their duplicate group, written once; ``exact``: without the bucket cap."""
    # Written once: each text is read for its hash and its measures in one pass.
    rows = written(quality.quality_filter(adapters.records(spark, sf_dir, "phash")), "records")
    groups = (hamming.exact_groups if exact else hamming.duplicate_groups)(rows.select("doc_id", "phash"))
    return written(rows.drop("phash").join(groups, "doc_id"), "grouped")


def uncapped(sql: str) -> str:
    """The SQL of a capped query with all buckets."""
    out = re.sub(r"WHERE n BETWEEN 2 AND (500|700)\)", "WHERE n >= 2)", sql)
    if out == sql:
        raise ValueError("no bucket cap")
    return out


def twin(f):
    """Register a query that takes ``exact``, and its twin without the bucket cap."""

    def exact(spark, sf_dir):
        return f(spark, sf_dir, exact=True)

    exact.__name__, exact.__doc__ = f"{f.__name__}_exact", f"``{f.__name__}`` without the bucket cap."
    TWINS.append(f.__name__)
    QUERIES[exact.__name__], ORACLES[exact.__name__] = exact, uncapped(ORACLES[f.__name__])
    return f


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pseudo_sources(filtered(spark, sf_dir))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sourced(spark, sf_dir).where("cls = 'en'")
    return rows.withColumn("stratum", sampling.stratum("subclass", "source"))


def labelled(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """Grouped records with cls7 as label and their source column."""
    return grouped(spark, sf_dir, exact).select("doc_id", "group_id", F.col("cls7").alias("label"), F.col("subclass").alias("source"))


# Quality and provenance


@query(f"WITH {O.RECORDS} SELECT doc_id, min_side::BIGINT AS min_side, round(blur, 6) AS blur, cls FROM good")
def quality_filter(spark, sf_dir):
    return filtered(spark, sf_dir).select("doc_id", "min_side", F.round("blur", 6).alias("blur"), "cls")


@query(f"WITH {O.RECORDS} SELECT cls, count(*) FILTER (NOT (min_side >= 200 AND blur >= 25)) AS n_rejected FROM rec GROUP BY cls")
def quality_rejects(spark, sf_dir):
    return quality.quality_rejects(adapters.records(spark, sf_dir))


@query(f"WITH {O.SOURCED} SELECT doc_id, cls, raw_sig, source FROM sourced")
def pseudo_sources(spark, sf_dir):
    return sourced(spark, sf_dir).select("doc_id", "cls", "raw_sig", "source")


@query(f"""WITH {O.SOURCED}, c AS (SELECT cls, source, count(*) AS n FROM sourced GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, source)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 3""")
def source_topk(spark, sf_dir):
    return quality.source_topk(sourced(spark, sf_dir))


def _leak(sig: str, share: float, least: int = 100) -> str:
    return f"""WITH {O.RECORDS}, two AS (SELECT {sig} AS sig, cls, count(*) AS c FROM good GROUP BY ALL),
    r AS (SELECT sig, cls, c, sum(c) OVER (PARTITION BY sig) AS n, row_number() OVER (PARTITION BY sig ORDER BY c DESC, cls) AS k FROM two)
    SELECT sig, n::BIGINT AS n, cls AS top_cls, c AS top_n, round(c::DOUBLE / n, 9) AS share FROM r WHERE k = 1 AND n >= {least} AND c::DOUBLE / n >= {share}::DOUBLE"""


@query(_leak("raw_sig", 0.9))
def leak_audit(spark, sf_dir):
    return quality.leak_audit(filtered(spark, sf_dir)).select(F.col("raw_sig").alias("sig"), "n", "top_cls", "top_n", F.round("share", 9).alias("share"))


@query(_leak("raw_sig", 0.9, 5))
def leak_audit_small(spark, sf_dir):
    """The same from five rows on."""
    return quality.leak_audit(filtered(spark, sf_dir), least=5).select(F.col("raw_sig").alias("sig"), "n", "top_cls", "top_n", F.round("share", 9).alias("share"))


@query(_leak("sig_b", BUCKET_SHARE))
def leak_audit_buckets(spark, sf_dir):
    return quality.leak_audit(filtered(spark, sf_dir), sig="sig_b", share=BUCKET_SHARE).select(F.col("sig_b").alias("sig"), "n", "top_cls", "top_n", F.round("share", 9).alias("share"))


@query(f"WITH {O.RECORDS} SELECT raw_sig, cls, count(*) AS n FROM good GROUP BY ALL")
def signature_by_class(spark, sf_dir):
    return filtered(spark, sf_dir).groupBy("raw_sig", "cls").agg(F.count("*").alias("n"))


@query(f"""WITH {O.RECORDS}, c AS (SELECT cls, count(*) AS n FROM good GROUP BY cls)
SELECT cls, n, round(100.0::DOUBLE * n / sum(n) OVER (), 9) AS pct, round(max(n) OVER ()::DOUBLE / min(n) OVER (), 9) AS ratio FROM c""")
def class_imbalance(spark, sf_dir):
    return quality.imbalance(filtered(spark, sf_dir)).select("cls", "n", F.round("pct", 9).alias("pct"), F.round("ratio", 9).alias("ratio"))


@query(f"""WITH {O.SOURCED} SELECT cls, source, subclass, grouping(cls, source, subclass)::INT AS level, count(*) AS n, min(min_side)::BIGINT AS least_side, max(min_side)::BIGINT AS most_side
FROM sourced GROUP BY ROLLUP (cls, source, subclass)""")
def provenance_totals(spark, sf_dir):
    """Totals of each class, source and folder, of each class and source, of each class, and of all; ``level`` tells a total from a null value."""
    return quality.totals(sourced(spark, sf_dir), ["cls", "source", "subclass"])


@query(f"""WITH {O.RECORDS}, c AS (SELECT sig_b, {", ".join(f"count(*) FILTER (cls = '{c}') AS {c}" for c in ("de", "en", "es", "fr"))}, count(*) AS n FROM good GROUP BY sig_b) SELECT * FROM c""")
def signature_pivot(spark, sf_dir):
    """A row for each signature, a column for each class."""
    return quality.signature_pivot(filtered(spark, sf_dir), ["de", "en", "es", "fr"], sig="sig_b")


# Near duplicates


@query(f"WITH {O.edges('rec')} SELECT a, b, hamming FROM pairs")
def band_candidates(spark, sf_dir):
    return hamming.candidates(adapters.hashed(spark, sf_dir))


@query(f"WITH {O.edges('rec')} SELECT a, b, hamming FROM edges")
def near_dup_edges(spark, sf_dir):
    return hamming.edges(adapters.hashed(spark, sf_dir))


@query(f"WITH {O.edges('rec', cap=20)} SELECT a, b, hamming FROM edges")
def near_dup_edges_capped(spark, sf_dir):
    """A cap of twenty rows, which many buckets reach even in small tables."""
    return hamming.edges(adapters.hashed(spark, sf_dir), cap=20)


@query(f"WITH {O.edges('rec', cap=700, whole=True)} SELECT a, b, hamming FROM edges")
def near_dup_edges_whole(spark, sf_dir):
    return hamming.edges(adapters.hashed(spark, sf_dir), cap=700, whole=True)


@twin
@query(f"WITH RECURSIVE {O.groups('rec')} SELECT doc_id, group_id FROM grp")
def near_dup_groups(spark, sf_dir, exact=False):
    return hamming.duplicate_groups(adapters.hashed(spark, sf_dir), cap=None if exact else hamming.CAP)


@twin
@query(f"""WITH RECURSIVE {O.groups('rec')}, s AS (SELECT group_id, count(*) AS n FROM grp GROUP BY group_id)
SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_multi, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_members FROM s""")
def group_stats(spark, sf_dir, exact=False):
    return hamming.group_stats(hamming.duplicate_groups(adapters.hashed(spark, sf_dir), cap=None if exact else hamming.CAP))


@query(f"""WITH {O.HASHED}, x AS (SELECT CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN substr(lower(printf('%016x', h)), 2) WHEN doc_id % 5 = 0 THEN upper('g' || substr(lower(printf('%016x', h)), 2)) ELSE upper(printf('%016x', h)) END AS p FROM hashed)
SELECT count(*) AS n, count(*) FILTER (regexp_full_match(lower(p), '[0-9a-f]{{16}}')) AS n_valid, round(avg(coalesce(regexp_full_match(lower(p), '[0-9a-f]{{16}}'), false)::INT), 9) AS ratio FROM x""")
def hash_coverage(spark, sf_dir):
    """Some hashes are absent, too short or hold another letter; capitals count."""
    cut = F.substring("phash", 2, 15)
    odd = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, cut).when(F.col("doc_id") % 5 == 0, F.upper(F.concat(F.lit("g"), cut))).otherwise(F.upper("phash"))
    return hamming.hash_coverage(adapters.hashed(spark, sf_dir).withColumn("phash", odd)).withColumn("ratio", F.round("ratio", 9))


def _stats(cls: str) -> str:
    return f"""WITH RECURSIVE {O.GROUPED}, g AS (SELECT group_id, count(*) AS n, min({cls}) <> max({cls}) AS mixed FROM grouped GROUP BY group_id)
    SELECT coalesce(sum(n - 1) FILTER (NOT mixed), 0)::BIGINT AS dup_within, count(*) FILTER (mixed) AS n_conflicts,
      coalesce(sum(n) FILTER (mixed), 0)::BIGINT AS conflict_rows, coalesce(sum(n - 1) FILTER (mixed), 0)::BIGINT AS dup_in_conflict FROM g"""


@twin
@query(_stats("cls"))
def dup_stats(spark, sf_dir, exact=False):
    return conflicts.duplicate_stats(grouped(spark, sf_dir, exact))


@twin
@query(_stats("cls7"))
def dup_stats_conflicting(spark, sf_dir, exact=False):
    return conflicts.duplicate_stats(grouped(spark, sf_dir, exact), "cls7")


@twin
@query(f"""WITH RECURSIVE {O.GROUPED} SELECT group_id, count(*) AS n, count(DISTINCT cls7) AS n_classes, min(cls7)::INT AS first_cls, max(cls7)::INT AS last_cls
FROM grouped GROUP BY group_id HAVING count(DISTINCT cls7) > 1""")
def conflict_groups(spark, sf_dir, exact=False):
    return conflicts.conflict_groups(grouped(spark, sf_dir, exact), "cls7")


@twin
@query(f"""WITH RECURSIVE {O.GROUPED}, m AS (SELECT group_id FROM grouped GROUP BY group_id HAVING count(DISTINCT cls7) > 1)
SELECT group_id, doc_id, cls7 FROM grouped SEMI JOIN m USING (group_id)""")
def conflict_members(spark, sf_dir, exact=False):
    return conflicts.conflict_members(grouped(spark, sf_dir, exact), "cls7")


@twin
@query(O.policy("report", "cls"))
def near_dup_survivors(spark, sf_dir, exact=False):
    """The flagship: quality filter, banded Hamming join, components, best row of each group."""
    return conflicts.survivors(grouped(spark, sf_dir, exact), "report", "cls")


# The same without the cap: the result of a row does not depend on how many others there are.


@query(f"""WITH {O.HASHED}, f AS (SELECT h, min(doc_id) AS id FROM hashed GROUP BY h)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS hamming FROM f x JOIN f y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 5""")
def near_dup_edges_exact(spark, sf_dir):
    """Between the first rows of different hashes; equal hashes are not paired."""
    return hamming.exact_edges(adapters.hashed(spark, sf_dir))


@twin
@query(O.policy("report", "cls7"))
def keep_report(spark, sf_dir, exact=False):
    return conflicts.survivors(grouped(spark, sf_dir, exact), "report", "cls7")


@twin
@query(O.policy("keep_rarest", "cls7"))
def keep_rarest(spark, sf_dir, exact=False):
    return conflicts.survivors(grouped(spark, sf_dir, exact), "keep_rarest", "cls7")


@twin
@query(O.policy("drop_all", "cls7"))
def drop_all(spark, sf_dir, exact=False):
    return conflicts.survivors(grouped(spark, sf_dir, exact), "drop_all", "cls7")


# Sampling


@query(f"WITH {O.quota(TARGET)} SELECT stratum, n, quota FROM quota")
def strata_quota(spark, sf_dir):
    return sampling.strata_quota(strata(spark, sf_dir), TARGET)


@query(f"WITH {O.sample(TARGET)} SELECT doc_id, stratum FROM sampled")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(strata(spark, sf_dir), TARGET).select("doc_id", "stratum")


@query(f"WITH {O.sample(8)} SELECT DISTINCT stratum FROM strata ANTI JOIN sampled USING (stratum)")
def lost_clusters(spark, sf_dir):
    """A target below the number of strata."""
    rows = strata(spark, sf_dir)
    return sampling.lost_groups(rows, sampling.stratified_sample(rows, 8))


CLASS_TARGETS = {"en": 150, "de": 20}


@query(f"""WITH {O.samples(CLASS_TARGETS)} SELECT doc_id, cls FROM sourced WHERE cls NOT IN ('en', 'de')
UNION ALL SELECT doc_id, 'en' FROM sampled_en UNION ALL SELECT doc_id, 'de' FROM sampled_de""")
def sampled_classes(spark, sf_dir):
    rows = sourced(spark, sf_dir).withColumn("stratum", sampling.stratum("subclass", "source"))
    return sampling.sampled_classes(rows, CLASS_TARGETS).select("doc_id", "cls")


@query("""WITH w AS (SELECT doc_id, coalesce(n_chars, 0)::DOUBLE AS w, sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS hi, sum(coalesce(n_chars, 0)) OVER ()::DOUBLE AS total FROM documents),
d AS (SELECT range AS draw FROM range(500)), s AS (SELECT (42::BIGINT * 2654435761 % 4294967296)::DOUBLE / 4294967296 AS shift)
SELECT draw, doc_id FROM d, s, w WHERE draw >= greatest(0, ceil(500.0::DOUBLE * (hi - w) / total - shift)) AND draw < least(500, greatest(0, ceil(500.0::DOUBLE * hi / total - shift)))""")
def weighted_draw(spark, sf_dir):
    """Five hundred draws with replacement, by length."""
    return sampling.weighted_draw(adapters.read(spark, sf_dir, "documents"), 500, F.col("n_chars"))


@query("SELECT path FROM (SELECT lang || '/' || doc_id || '.jpg' AS path FROM documents) ORDER BY md5(path || ':42'), path LIMIT 25")
def sampled_files(spark, sf_dir):
    return images.sampled_files(_listing(spark, sf_dir, "jpg").select("path"), 25)


# Splits


@twin
@query(f"WITH RECURSIVE {O.SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY ALL")
def group_split_sizes(spark, sf_dir, exact=False):
    return splitting.split_sizes(splitting.three_way(labelled(spark, sf_dir, exact)))


@twin
@query(f"WITH RECURSIVE {O.SPLIT} SELECT group_id, count(DISTINCT split) AS n_splits FROM split GROUP BY group_id HAVING count(DISTINCT split) > 1")
def split_overlap(spark, sf_dir, exact=False):
    return splitting.split_overlap(splitting.three_way(labelled(spark, sf_dir, exact)))


@twin
@query(f"WITH RECURSIVE {O.SPLIT} SELECT source, count(DISTINCT split) AS n_splits FROM split GROUP BY source HAVING count(DISTINCT split) > 1")
def split_overlap_sources(spark, sf_dir, exact=False):
    """Sources are not kept whole here, so they are in several splits."""
    return splitting.split_overlap(splitting.three_way(labelled(spark, sf_dir, exact)), "source")


@twin
@query(f"""WITH RECURSIVE {O.SPLIT}, marked AS (SELECT label, (split = 'test')::INT AS t FROM split)
SELECT 'large_test' AS what, 'all' AS label, round(avg(t), 9) AS value FROM marked HAVING avg(t) > 2 * 0.05::DOUBLE
UNION ALL SELECT 'skewed_label', label::VARCHAR, round(avg(t), 9) FROM marked GROUP BY label HAVING avg(t) > 0.45""")
def split_warnings(spark, sf_dir, exact=False):
    """Judged as if five per cent had been asked for."""
    w = splitting.split_warnings(splitting.three_way(labelled(spark, sf_dir, exact)), test=0.05)
    return w.select("what", F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("label"), F.round("value", 9).alias("value"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id || ':123'), 1, 8))::UBIGINT % 100 < 20 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return adapters.read(spark, sf_dir, "documents").select("doc_id", splitting.hash_split("doc_id").alias("split"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id || ':123'), 1, 8))::UBIGINT % 100 < 20 THEN 'val' ELSE 'train' END AS split,
(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END)::INT AS label FROM documents WHERE lang IN ('de', 'en', 'es', 'fr'))
SELECT doc_id, split, label, (label = 0)::INT || ',' || (label = 1)::INT || ',' || (label = 2)::INT || ',' || (label = 3)::INT AS one_hot FROM d""")
def labelled_split(spark, sf_dir):
    """Eighty to twenty, with one-hot labels."""
    rows = manifest.labelled(adapters.read(spark, sf_dir, "documents").withColumnRenamed("lang", "class_dir"), ["de", "en", "es", "fr"])
    hot = F.array_join(splitting.one_hot(F.col("label"), 4).cast("array<string>"), ",")
    return rows.select("doc_id", splitting.hash_split("doc_id").alias("split"), "label", hot.alias("one_hot"))


@twin
@query(f"WITH RECURSIVE {O.KFOLD_TEST} SELECT fold, role, count(*) AS n FROM kfold GROUP BY ALL")
def kfold_test_sizes(spark, sf_dir, exact=False):
    return splitting.k_folds_with_test(labelled(spark, sf_dir, exact), 4).groupBy("fold", "role").agg(F.count("*").alias("n"))


@twin
@query(f"""WITH RECURSIVE {O.SPLIT}, every AS (SELECT s.split, l.label FROM (VALUES ('train'), ('val'), ('test')) s(split), (SELECT range::INT AS label FROM range({N_CLASSES + 1})) l)
SELECT split, label FROM every ANTI JOIN split USING (split, label)""")
def missing_classes(spark, sf_dir, exact=False):
    classes = metrics.labels_table(spark, N_CLASSES + 1)
    return splitting.missing_classes(splitting.three_way(labelled(spark, sf_dir, exact)), classes)


@twin
@query(f"WITH RECURSIVE {O.KFOLD} SELECT fold, role, count(*) AS n FROM kfold GROUP BY ALL")
def kfold_sizes(spark, sf_dir, exact=False):
    return splitting.k_folds(labelled(spark, sf_dir, exact), 5).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {O.HOLDOUT} SELECT label, source, n FROM held")
def source_holdout(spark, sf_dir):
    return splitting.source_holdout(labelled(spark, sf_dir))


@twin
@query(f"WITH RECURSIVE {O.CLOSURE} SELECT doc_id FROM grouped_l WHERE group_id IN (SELECT group_id FROM chosen_groups)")
def holdout_closure(spark, sf_dir, exact=False):
    return splitting.holdout_split(labelled(spark, sf_dir, exact)).where("split = 'test'").select("doc_id")


@query(f"WITH RECURSIVE {O.balanced(5, 42)} SELECT fold, label, count(*) AS n FROM grouped_l JOIN dealt USING (group_id) GROUP BY ALL")
def balanced_folds(spark, sf_dir):
    """Five folds over which each label's rows spread evenly, groups whole, all their labels counting."""
    rows = labelled(spark, sf_dir)
    return running.join_null_safe(rows, splitting.balanced_folds(rows, 5, 42), ["group_id"]).groupBy("fold", "label").agg(F.count("*").alias("n"))


# Metrics


@query(f"""WITH {O.PREDICTIONS}, c AS (SELECT l.label, greatest(1, count(p.id)) AS n FROM (SELECT range::INT AS label FROM range({N_CLASSES})) l LEFT JOIN p USING (label) GROUP BY l.label),
w AS (SELECT label, n, pow(sum(n) OVER () / ({N_CLASSES}.0::DOUBLE * n), 0.5::DOUBLE) AS raw FROM c) SELECT label, n, round(raw / avg(raw) OVER (), 9) AS weight FROM w""")
def class_weights_soft(spark, sf_dir):
    return metrics.class_weights_soft(adapters.predictions(spark, sf_dir), N_CLASSES).withColumn("weight", F.round("weight", 9))


@query(f"WITH {O.PREDICTIONS}, c AS (SELECT label, count(*) AS n FROM p GROUP BY label) SELECT label, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 9) AS weight FROM c")
def class_weights_balanced(spark, sf_dir):
    return metrics.class_weights_balanced(adapters.predictions(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {O.PREDICTIONS}, k AS (SELECT range::INT AS c FROM range({N_CLASSES}))
SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM p WHERE label = a.c AND prediction = b.c) AS n FROM k a, k b""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(adapters.predictions(spark, sf_dir), N_CLASSES)


@query(O.REPORT)
def classification_report(spark, sf_dir):
    r = metrics.classification_report(adapters.predictions(spark, sf_dir), N_CLASSES)
    return r.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {O.SCORES} SELECT round(avg(f1), 9) AS macro_f1 FROM scores WHERE support + predicted > 0")
def macro_f1_observed(spark, sf_dir):
    return metrics.macro_f1_observed(adapters.predictions(spark, sf_dir), N_CLASSES).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {O.PREDICTIONS} SELECT source, count(*) AS n, round(avg((label = prediction)::INT), 9) AS accuracy FROM p GROUP BY source HAVING count(*) >= 20")
def accuracy_by_source(spark, sf_dir):
    return metrics.accuracy_by_source(adapters.predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {O.PREDICTIONS}, x AS (SELECT 'all' AS what, conf FROM p UNION ALL SELECT CASE WHEN label = prediction THEN 'correct' ELSE 'wrong' END, conf FROM p)
SELECT what, count(*) AS n, round(avg(conf), 9) AS mean_conf FROM x GROUP BY what""")
def confidence_summary(spark, sf_dir):
    return metrics.confidence_summary(adapters.predictions(spark, sf_dir)).withColumn("mean_conf", F.round("mean_conf", 9))


@query(f"""WITH {O.PREDICTIONS} SELECT t.threshold, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM p), 9) AS coverage, round(avg((label = prediction)::INT), 9) AS accuracy
FROM p JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) t ON p.conf >= t.threshold GROUP BY t.threshold""")
def confidence_sweep(spark, sf_dir):
    s = metrics.confidence_sweep(adapters.predictions(spark, sf_dir))
    return s.select("threshold", "n", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {O.PREDICTIONS}, t AS (SELECT label, count(*) AS n, avg((label = prediction)::INT) AS recall FROM p GROUP BY label),
s AS (SELECT prediction AS label, avg(conf) AS mean_conf FROM p GROUP BY prediction)
SELECT label, n, round(recall, 9) AS recall, round(mean_conf, 9) AS mean_conf FROM t LEFT JOIN s USING (label)""")
def confidence_by_class(spark, sf_dir):
    c = metrics.confidence_by_class(adapters.predictions(spark, sf_dir))
    return c.select("label", "n", F.round("recall", 9).alias("recall"), F.round("mean_conf", 9).alias("mean_conf"))


@query(f"WITH {O.roc(False)} SELECT cls, threshold, tp, fp, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc")
def roc_points(spark, sf_dir):
    r = metrics.roc_points(adapters.predictions(spark, sf_dir), N_CLASSES)
    return r.withColumn("fpr", F.round("fpr", 9)).withColumn("tpr", F.round("tpr", 9))


@query(f"WITH {O.roc(False)}, {O.AREA} SELECT cls, round(auc, 9) AS auc FROM area")
def auc_ovr(spark, sf_dir):
    return metrics.auc(adapters.predictions(spark, sf_dir), N_CLASSES).withColumn("auc", F.round("auc", 9))


@query(f"WITH {O.roc(True)}, {O.AREA} SELECT cls, round(auc, 9) AS auc FROM area")
def auc_micro(spark, sf_dir):
    return metrics.auc(adapters.predictions(spark, sf_dir), N_CLASSES, micro=True).withColumn("auc", F.round("auc", 9))


@query(O.MACRO_AUC)
def auc_macro(spark, sf_dir):
    return metrics.macro_auc(adapters.predictions(spark, sf_dir), N_CLASSES).withColumn("auc", F.round("auc", 8))


@query(f"WITH {O.MEAN_ROC} SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM mean")
def mean_roc(spark, sf_dir):
    m = metrics.mean_roc(adapters.predictions(spark, sf_dir), N_CLASSES)
    return m.select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"""WITH {O.PREDICTIONS}, b AS (SELECT id // 64 AS batch, count(*) AS n, sum((label = prediction)::INT) AS n_correct, avg(-ln(greatest(probs[label + 1], 1e-6::DOUBLE))) AS loss FROM p GROUP BY batch)
SELECT round(sum(n_correct)::DOUBLE / sum(n), 9) AS accuracy, round(sum(loss * n) / sum(n), 9) AS loss FROM b""")
def batch_accuracy_loss(spark, sf_dir):
    p = adapters.predictions(spark, sf_dir)
    loss = -F.log(F.greatest(F.element_at("probs", (F.col("label") + 1).cast("int")), F.lit(1e-6)))
    batches = p.groupBy(F.expr("id DIV 64")).agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("int")).alias("n_correct"), F.avg(loss).alias("loss"))
    return metrics.accuracy_and_loss(batches).select(F.round("accuracy", 9).alias("accuracy"), F.round("loss", 9).alias("loss"))


@query("""WITH e AS (SELECT vec_id AS id, list_transform(list_slice(embedding, 1, 5), lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
p AS (SELECT id, list_transform(e, lambda x: x / list_aggregate(e, 'sum')) AS p FROM e)
SELECT id, round(p[1], 9) AS first, round(list_max(p), 9) AS best, round(list_aggregate(p, 'sum'), 9) AS total FROM p""")
def softmax(spark, sf_dir):
    p = metrics.softmax(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")))
    rows = adapters.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), p.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.round(F.col("p")[0], 9).alias("first"), F.round(F.array_max("p"), 9).alias("best"), F.round(total, 9).alias("total"))


@query(f"WITH {O.PREDICTIONS} SELECT id, label, prediction, conf FROM p")
def joined_predictions(spark, sf_dir):
    """Test rows and predictions, which must match one to one."""
    p = adapters.predictions(spark, sf_dir)
    return results.predictions_of(p.select("id", "label"), p.select("id", "prediction", "conf"))


@query("""WITH t AS (SELECT vec_id AS id, count(*) AS n_test FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY vec_id),
s AS (SELECT vec_id AS id, count(*) AS n_scored FROM (SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 11 = 0) GROUP BY vec_id)
SELECT id, coalesce(n_test, 0) AS n_test, coalesce(n_scored, 0) AS n_scored FROM t FULL JOIN s USING (id) WHERE coalesce(n_test, 0) <> 1 OR coalesce(n_scored, 0) <> 1""")
def mismatched_predictions(spark, sf_dir):
    """Test rows that lack a seventh of the vectors, predictions that lack a fifth and have an eleventh once more: what the guard finds."""
    p = adapters.predictions(spark, sf_dir).select("id")
    return results.mismatched(p.where("id % 7 <> 0"), p.where("id % 5 <> 0").unionByName(p.where("id % 11 = 0")))


@query(f"SELECT printf('%-16s%12.4f%12.4f%12.4f%12d', name, precision, recall, f1, support) AS value FROM ({O.REPORT})")
def report_lines(spark, sf_dir):
    r = metrics.classification_report(adapters.predictions(spark, sf_dir), N_CLASSES)
    return results.report_lines(r.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")).select("value")


# History: runs of the stand-in classifier on the embeddings.

PLAN = classifier.Plan(epochs=18, patience=None)
FOLD_PLAN = classifier.Plan(epochs=6, freeze=1, warmup=1, patience=None)
FOLDS, BATCH, EPOCHS, FROZEN, WARM = 3, 64, 10, 2, 1
_EIGHT = "('0x' || substr(md5(vec_id || ':123'), 1, 8))::UBIGINT"
_SINGLE = O.training(1, f"CASE WHEN {_EIGHT} % 100 < 20 THEN 0 ELSE 1 END", PLAN)
_STAGES = "s AS (SELECT (epoch - 1) // 6 + 1 AS stage, (epoch - 1) % 6 AS epoch, round(val_acc, 9) AS val_accuracy, epoch - 1 AS global_epoch FROM history)"


def _trained(spark, sf_dir, folds=1, plan=PLAN) -> list[classifier.Run]:
    """Runs on the embeddings: a fifth of the vectors validates, or is the test set of ``folds`` runs."""
    eight = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit("123"))), 1, 8), 16, 10).cast("long")
    held = eight % 100 < 20
    fold = F.when(held, 0).otherwise(1) if folds == 1 else F.when(held, classifier.TEST).otherwise(F.floor(eight / 100) % folds)
    rows = adapters.read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("features"), (F.col("label") % N_CLASSES).alias("label"), fold.alias("fold"))
    return classifier.trained(rows, N_CLASSES, folds, plan)


def _history(spark, sf_dir) -> DataFrame:
    return classifier.history(spark, _trained(spark, sf_dir))


def _stages(spark, sf_dir) -> DataFrame:
    """The run in three stages of six epochs."""
    h = _history(spark, sf_dir)
    return h.select((F.floor((F.col("epoch") - 1) / 6) + 1).cast("int").alias("stage"), ((F.col("epoch") - 1) % 6).alias("epoch"), F.round("val_acc", 9).alias("val_accuracy"))


@query(f"""WITH {_SINGLE} SELECT epoch::INT AS epoch, frozen, round(lr_head, 9) AS lr_head, round(lr_backbone, 9) AS lr_backbone, round(train_loss, 7) AS train_loss, round(train_acc, 9) AS train_acc,
round(val_loss, 7) AS val_loss, round(val_acc, 9) AS val_acc, round(val_macro_f1, 9) AS val_macro_f1 FROM history""")
def training_history(spark, sf_dir):
    digits = {"lr_head": 9, "lr_backbone": 9, "train_loss": 7, "train_acc": 9, "val_loss": 7, "val_acc": 9, "val_macro_f1": 9}
    return _history(spark, sf_dir).select("epoch", "frozen", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(f"""WITH n AS (SELECT greatest(1, ceil(count(*) / {BATCH}.0::DOUBLE))::BIGINT AS per FROM embeddings), s AS (SELECT unnest(range({EPOCHS} * per)) AS step, {FROZEN} * per AS fr, {WARM} * per AS wa, {EPOCHS} * per AS total FROM n),
f AS (SELECT step, fr, CASE WHEN step < fr THEN 1.0::DOUBLE WHEN step - fr < wa THEN (step - fr + 1)::DOUBLE / wa
  ELSE 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (step - fr - wa)::DOUBLE / greatest(1, total - fr - wa)))) END AS factor FROM s)
SELECT step, round(factor, 9) AS factor, round(factor * 1e-3::DOUBLE, 9) AS lr_head, CASE WHEN step < fr THEN 0.0::DOUBLE ELSE round(factor * 1e-4::DOUBLE, 9) END AS lr_backbone FROM f""")
def lr_schedule(spark, sf_dir):
    """The schedule of as many steps as the embeddings make in batches of 64."""
    per = max(1, -(-adapters.read(spark, sf_dir, "embeddings").count() // BATCH))
    s = history.lr_schedule(spark, FROZEN * per, EPOCHS * per, WARM * per)
    return s.select("step", *[F.round(c, 9).alias(c) for c in ("factor", "lr_head", "lr_backbone")])


@query(f"WITH {_SINGLE}, {_STAGES} SELECT stage::INT AS stage, epoch::INT AS epoch, val_accuracy, global_epoch::BIGINT AS global_epoch FROM s")
def history_concat(spark, sf_dir):
    return history.history_concat(_stages(spark, sf_dir)).select("stage", "epoch", "val_accuracy", F.col("global_epoch").cast("long").alias("global_epoch"))


@query(f"""WITH {_SINGLE}, h AS (SELECT epoch::INT AS epoch, round(val_macro_f1, 9) AS val_macro_f1, frozen FROM history),
i AS (SELECT *, val_macro_f1 > coalesce(max(val_macro_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS improved FROM h),
g AS (SELECT *, (SELECT max(epoch) FROM i j WHERE j.improved AND j.epoch <= i.epoch) AS best FROM i),
s AS (SELECT *, (SELECT count(*) FROM h k WHERE k.epoch > g.best AND k.epoch <= g.epoch AND NOT k.frozen) AS stale FROM g)
SELECT epoch, val_macro_f1, frozen, improved, stale, coalesce(epoch = (SELECT min(epoch) FROM s WHERE stale >= 3 AND NOT frozen), false) AS stop FROM s""")
def best_epoch_early_stop(spark, sf_dir):
    """With a patience of three epochs."""
    h = _history(spark, sf_dir).select("epoch", F.round("val_macro_f1", 9).alias("val_macro_f1"), "frozen")
    return history.best_epoch_early_stop(h, patience=3)


@query(f"WITH {_SINGLE}, {_STAGES} SELECT max(val_accuracy) AS best, arg_min(global_epoch, (-val_accuracy, global_epoch))::BIGINT AS best_epoch, arg_max(val_accuracy, global_epoch) AS final FROM s")
def history_best_final(spark, sf_dir):
    h = history.history_concat(_stages(spark, sf_dir)).withColumn("at", F.col("global_epoch").cast("long"))
    return history.best_and_final(h, "val_accuracy", "at")


@query(f"""WITH {O.training(FOLDS, f"CASE WHEN {_EIGHT} % 100 < 20 THEN -1 ELSE ({_EIGHT} // 100) % {FOLDS} END", FOLD_PLAN)},
best AS (SELECT run, arg_min(epoch, (-round(val_macro_f1, 12), epoch)) AS epoch FROM history GROUP BY run), h AS (SELECT * FROM history SEMI JOIN best USING (run, epoch)),
m AS (SELECT 'val_macro_f1' AS metric, val_macro_f1 AS v FROM h UNION ALL SELECT 'test_acc', test_acc FROM h UNION ALL SELECT 'test_macro_f1', test_f1 FROM h)
SELECT metric, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std FROM m GROUP BY metric""")
def kfold_summary(spark, sf_dir):
    """Three runs that share a test set, each at its best epoch."""
    scores = classifier.fold_scores(spark, _trained(spark, sf_dir, FOLDS, FOLD_PLAN))
    s = metrics.kfold_summary(scores, ["val_macro_f1", "test_acc", "test_macro_f1"])
    return s.select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


# Files


def _listing(spark, sf_dir, *endings: str) -> DataFrame:
    """path, content and cls as of an image tree: a file for each document."""
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % len(endings) + 1).cast("int"))
    docs = adapters.read(spark, sf_dir, "documents")
    return docs.select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("path"), F.col("text").alias("content"), F.col("lang").alias("cls"), "source", "doc_id")


@query("""WITH n AS (SELECT lang AS cls, count(*) AS n FROM documents WHERE doc_id % 4 <> 3 GROUP BY lang)
SELECT cls, n, (row_number() OVER (ORDER BY cls) - 1)::INT AS label FROM n""")
def class_counts(spark, sf_dir):
    """Files of three of four endings, one of them in capitals."""
    return images.class_counts(_listing(spark, sf_dir, "jpg", "PNG", "jpeg", "gif").where("cls IS NOT NULL"))


@query("""SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang NULLS FIRST, n_chars, doc_id) AS k FROM documents) WHERE k = 1""")
def first_by_order(spark, sf_dir):
    """One document of each source: the first by language, length and id."""
    docs = adapters.read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return manifest.first_rows(docs, "source", ["lang", "n_chars", "doc_id"])


@query("""SELECT lang || '/' || doc_id || '.jpg' AS path, lang AS class_dir, source, '-' AS vcluster, '-' AS phash, (CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END)::INT AS label
FROM documents WHERE lang IN ('fr', 'en', 'es')""")
def training_frame(spark, sf_dir):
    """A manifest without clusters and hashes, and the listed classes of it."""
    rows = _listing(spark, sf_dir, "jpg").select(F.col("path").alias("new_path"), F.col("cls").alias("class"), F.col("source").alias("pseudo_source"))
    return manifest.labelled(manifest.training_frame(rows), ["fr", "en", "es"])


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Acne-' WHEN 1 THEN 'eczema-' WHEN 2 THEN 'INFESTATIONS_BITES-' WHEN 3 THEN 'cutaneous-' WHEN 4 THEN 'scabies-' WHEN 5 THEN 'Melanoma' WHEN 6 THEN 'isic_' ELSE 'other' END || doc_id || '.jpg' AS name FROM documents)
SELECT name, CASE WHEN lower(name) LIKE 'acne-%' THEN 'acne' WHEN lower(name) LIKE 'eczema-%' THEN 'eczema' WHEN regexp_matches(lower(name), '^(infestations_bites-|cutaneous-|scabies-)') THEN 'bites'
WHEN regexp_matches(lower(name), '^(melanoma|isic_)') THEN 'melanoma' END AS cls FROM n""")
def class_of_name(spark, sf_dir):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("Acne-", "eczema-", "INFESTATIONS_BITES-", "cutaneous-", "scabies-", "Melanoma", "isic_", "other")]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(prefix, F.col("doc_id").cast("string"), F.lit(".jpg"))
    return adapters.read(spark, sf_dir, "documents").select(name.alias("name"), manifest.class_of_name(name).alias("cls"))


@query("""WITH d AS (SELECT coalesce(lang, '-') AS class_dir, CASE WHEN ('0x' || substr(md5(doc_id || ':123'), 1, 8))::UBIGINT % 100 < 20 THEN 'val' ELSE 'train' END AS split FROM documents),
c AS (SELECT class_dir, split, count(*) AS n FROM d GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY split)::BIGINT AS split_size FROM c""")
def run_metadata(spark, sf_dir):
    """Sizes of splits and nested counts of classes, through JSON and back."""
    rows = adapters.read(spark, sf_dir, "documents").select(F.col("lang").alias("class_dir"), splitting.hash_split("doc_id").alias("split"))
    record = results.run_record(spark, results.counted(rows), {"table": "documents"}, 42)
    back = record.select(F.from_json(F.to_json(F.struct("*")), results.RUN).alias("r")).select("r.*")
    each = back.select("split_sizes", F.explode("class_counts").alias("class_dir", "m")).select("split_sizes", "class_dir", F.explode("m").alias("split", "n"))
    return each.select("class_dir", "split", "n", F.col("split_sizes")[F.col("split")].alias("split_size"))


@query("SELECT what, count(*) AS n FROM (SELECT CASE WHEN n_chars < 500 THEN 'broken' ELSE 'sound' END AS what FROM documents) GROUP BY what")
def broken_split(spark, sf_dir):
    """Records with an error, here the short ones, apart from the sound ones."""
    rows = adapters.read(spark, sf_dir, "documents").withColumn("error", F.when(F.coalesce("n_chars", F.lit(500)) < 500, "too short"))
    sound, broken = quality.split_broken(rows)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(sound, "sound").unionByName(count(broken, "broken")).where("n > 0")


@query(f"""WITH {O.SOURCED} SELECT cls AS class, cls || '/' || lpad((row_number() OVER (PARTITION BY cls ORDER BY doc_id::VARCHAR || '.TXT') - 1)::VARCHAR, 6, '0') || '.txt' AS new_path,
doc_id::VARCHAR || '.TXT' AS orig_path, subclass, source AS pseudo_source, min_side::INT AS width, min_side::INT AS height, '-' AS vcluster, round(blur, 2) AS blur, '-' AS phash, 'na' AS qsig FROM sourced""")
def manifest_projection(spark, sf_dir):
    rows = sourced(spark, sf_dir).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".TXT")))
    size = F.col("min_side").cast("int")
    full = rows.withColumns({"width": size, "height": size, "vcluster": F.lit("-"), "phash": F.lit("-"), "qsig": F.lit("na")})
    return manifest.manifest_projection(manifest.numbered(full))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN '/data/' || lang || '/' || doc_id || '.png' ELSE 'root/' || lang || '/' || doc_id || '.png' END AS path,
lang AS class_dir, doc_id % 3 <> 0 AS repaired FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0""")
def path_repair(spark, sf_dir):
    """Every third path is listed as it is; of the others, written with backslashes, some are missing."""
    docs = adapters.read(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    direct = F.col("doc_id") % 3 == 0
    frame = docs.select(F.when(direct, F.concat(F.lit("/data/"), "lang", F.lit("/"), name)).otherwise(F.concat(F.lit("C:\\old\\"), "lang", F.lit("\\"), name)).alias("path"), F.col("lang").alias("class_dir"))
    listing = docs.select(F.when(direct, F.concat(F.lit("/data/"), "lang", F.lit("/"), name)).when(F.col("doc_id") % 5 != 0, F.concat(F.lit("root/"), "lang", F.lit("/"), name)).alias("path"))
    return manifest.path_repair(frame, listing.where("path IS NOT NULL"), "root")


# Clusters


@query(f"""WITH {O.HASHED} SELECT doc_id, list_aggregate(list_transform(range(64), lambda i: ((h >> i::UBIGINT) & 1::UBIGINT)::BIGINT * (i + 1)), 'sum')::BIGINT AS bit_sum,
((h & 1::UBIGINT))::INT AS first_bit FROM hashed""")
def kmeans_features(spark, sf_dir):
    """The 64 hash bits, least significant first, summed up with their places."""
    f = adapters.hashed(spark, sf_dir).withColumn("f", clusters.features("phash", F.array(F.lit(0.0))))
    weighted = F.aggregate(F.zip_with(F.slice("f", 1, 64), F.sequence(F.lit(1), F.lit(64)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return f.select("doc_id", weighted.cast("long").alias("bit_sum"), F.col("f")[0].cast("int").alias("first_bit"))


def _vectors(spark, sf_dir) -> DataFrame:
    return adapters.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query(O.LLOYD)
def kmeans_lloyd(spark, sf_dir):
    """Two Lloyd steps from the vectors of ids 0 to 7: the cluster of each vector."""
    rows = _vectors(spark, sf_dir)
    start = rows.where("id < 8").select(F.col("id").cast("int").alias("cluster"), F.col("features").alias("centre"))
    return clusters.nearest(rows, clusters.lloyd(rows, start, 2)).select("id", "cluster", F.round("d2", 6).alias("d2"))


@query(O.k_means(clusters.ROUNDS))
def kmeans_plus_plus(spark, sf_dir):
    """Visual clusters: hash draws in proportion to squared distances, then rounds until labels stand still."""
    return clusters.visual_clusters(_vectors(spark, sf_dir), id_col="id").select("id", "vcluster")


@query()
def kmeans_mllib(spark, sf_dir):
    """k-means with k-means|| starts; its random starts have no counterpart in SQL."""
    return clusters.mllib_clusters(_vectors(spark, sf_dir)).select("id", "vcluster")
