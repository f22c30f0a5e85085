"""Filter interaction audit: what each filter removes after any others.

A trie of all orders of n filters has n! leaves, but which rows survive a prefix depends
on the set of its filters and not on their order. The walk goes depth first: a prefix's
survivors are one persisted frame, made from that of the prefix above by one more filter.
Its edges are counted while it is held: the rows that each further filter removes from it.
A prefix that was met in another order is remembered by its set and never made again,
so n filters take 2^n - 1 frames, at most n of them held at a time. The n! orders
are read off the counted edges.
"""

from __future__ import annotations

import uuid
from itertools import combinations, permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import shared_dir, table, text_of, written

#: Orders of more filters are too many to list.
MOST_FILTERS = 7


def _sets(names: list[str]) -> list[tuple[str, ...]]:
    """All sets of filters but the whole one, in the order of ``names``."""
    return [s for k in range(len(names)) for s in combinations(names, k)]


def _key(names: tuple[str, ...] | list[str]) -> str:
    return ",".join(names)


def counted_edges(rows: DataFrame, failures: dict[str, Column], losses: dict[str, Column], part: str = "part") -> DataFrame:
    """(part, state, alive, and for each filter outside of the state removed_F and each loss_F) of all sets of filters.

    ``state``: the set, its filters joined by commas; ``alive``: its survivors. Parts without a survivor have no
    row. Every frame is made from what is written, so one that an executor loses is made again.
    """
    spark, names, met = rows.sparkSession, list(failures), set()
    path = f"{shared_dir(spark)}/siftwell-edges-{uuid.uuid4().hex}"
    found = []

    def visit(state: tuple[str, ...], held: DataFrame) -> None:
        met.add(state)
        held.persist(StorageLevel.MEMORY_AND_DISK)
        rest = [f for f in names if f not in state]
        counts = [F.count_if(failures[f]).alias(f"removed_{f}") for f in rest]
        counts += [F.count_if(failures[f] & lost).alias(f"{loss}_{f}") for f in rest for loss, lost in losses.items()]
        edges = held.groupBy(part).agg(F.count("*").alias("alive"), *counts)
        columns = [(F.col(c) if f in rest else F.lit(None).cast("long")).alias(c) for f in names for k in ("removed", *losses) for c in [f"{k}_{f}"]]
        edges = edges.select(part, F.lit(_key(state)).alias("state"), "alive", *columns)
        found.append(f"{path}/{len(found)}")
        edges.write.parquet(found[-1])
        for f in rest:
            below = tuple(x for x in names if x in state or x == f)
            if len(below) < len(names) and below not in met:
                visit(below, held.where(~failures[f]))
        held.unpersist()

    visit((), rows)
    return spark.read.parquet(*found)


def interaction_audit(rows: DataFrame, failures: dict[str, Column], losses: dict[str, Column], part: str = "part") -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter does there.

    ``failures``: for each filter the condition of rows that it removes; ``losses``: conditions whose rows are
    counted among the removed ones. Null conditions count as false, a null part is the part ''. Columns: part,
    filter_order (names joined), step (from 1), filter, kept, removed, redundant (failing, but removed earlier),
    unique_fails (failing this filter only), a ``<loss>_lost`` for each loss, and shapley: what the filter removes, summed over all
    orders. Parts without rows have none; an empty table gives an empty result.
    """
    names = list(failures)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    sure = {f: F.coalesce(c, F.lit(False)) for f, c in failures.items()}
    marked = {k: F.coalesce(c, F.lit(False)) for k, c in losses.items()}
    named = rows.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit("")))
    edges = counted_edges(named, sure, marked, part)
    # A row for each part with all its states, at most 2^n - 1; a state that nothing survives is all zeros.
    kinds = ["removed", *losses]
    cells = F.array(*[F.struct(*[F.col(f"{c}_{f}").alias(c) for c in kinds]) for f in names])
    states = edges.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("alive", cells.alias("cells"))))).alias("m"))
    every = F.array(*[F.struct(F.lit(_key(s)).alias("state"), F.lit(i).alias("at"), F.lit(f).alias("filter"), F.lit(len(s) == len(names) - 1).alias("last"), F.lit(factorial(len(s)) * factorial(len(names) - 1 - len(s))).alias("weight")) for s in _sets(names) for i, f in enumerate(names) if f not in s])
    each = states.select(part, "m", F.explode(every).alias("e")).select(part, "e.*", F.col("m")[F.col("e.state")].alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = each.select(part, "state", "filter", "last", "weight", zero(F.col("s.alive")).alias("alive"), *[zero(F.col("s.cells")[F.col("at")][c]).alias(c) for c in kinds])
    # At most 2^(n - 1) rows for each part and filter.
    over = Window.partitionBy(part, "filter")
    own = own.withColumns(
        {
            "failing": F.max(F.when(F.col("state") == "", F.col("removed"))).over(over),
            "unique_fails": F.max(F.when(F.col("last"), F.col("removed"))).over(over),
            "shapley": F.sum(F.col("removed") * F.col("weight")).over(over),
        }
    )
    steps = [("".join(p), k + 1, f, _key([x for x in names if x in p[:k]])) for p in permutations(names) for k, f in enumerate(p)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state string")  # n! * n rows, whatever the data
    return own.join(F.broadcast(orders), ["state", "filter"]).select(
        part, "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", *[F.col(c).alias(f"{c}_lost") for c in losses], "shapley", "filter",
    )


SPACE = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part (source), n_words, n_distinct, n_capitals, n_chars, marked and copy_of of each document's whole text.

    ``copy_of``: the least doc_id with the same text, by SHA-256. A null text is empty; a null doc_id is
    never the least. Documents and their measures are written once, without the texts.
    """
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("part"), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    narrow = rows.select(
        "doc_id",
        "part",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_capitals"),
        F.length("text").alias("n_chars"),
        F.col("text").rlike("[#$%&*|]").alias("marked"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    narrow = written(narrow, "measured")
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(first, "digest", "left").drop("digest")


def document_failures() -> dict[str, Column]:
    """Five filters over ``measured``: few words, few distinct words, many capitals, a mark, a copy of an earlier document."""
    long = lambda c: F.col(c).cast("long")
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * long("n_distinct") < 65 * long("n_words"),
        "C": 100 * long("n_capitals") > 5 * long("n_chars"),
        "D": F.col("marked"),
        "E": F.col("copy_of") < F.col("doc_id"),
    }


def audited_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interaction_audit`` of the five filters by source; ``good``: labelled quality 1, ``toxic``: labelled toxic 1.

    A doc_id with several labels has what any of them says; labels without a document, and null doc_ids, don't count.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = measured(docs).join(said, "doc_id", "left")
    return interaction_audit(written(rows, "audited"), document_failures(), {"good": F.col("good"), "toxic": F.col("toxic")})


def op11_permutation_trie_audit(spark, sf_dir: str) -> DataFrame:
    """All documents, all 120 orders of the five filters."""
    return audited_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS x
  FROM w LEFT JOIN l USING (doc_id)),
masks AS MATERIALIZED (SELECT part, x[1]::INT + 2 * x[2]::INT + 4 * x[3]::INT + 8 * x[4]::INT + 16 * x[5]::INT AS m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT range::INT AS i FROM range(5)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS MATERIALIZED (SELECT o, j::INT AS step, (1 << o[j]) AS bit, list_sum(list_transform(o[1:j - 1], lambda i: 1 << i)) AS before FROM o, range(1, 6) r(j)),
p AS (SELECT DISTINCT part FROM masks),
c AS MATERIALIZED (SELECT p.part, b.bit, b.before, (SELECT coalesce(sum(n), 0) FROM masks m WHERE m.part = p.part AND m.m & (b.before | b.bit) = 0) AS kept,
  (SELECT coalesce(sum(n), 0) FROM masks m WHERE m.part = p.part AND m.m & b.before = 0 AND m.m & b.bit > 0) AS removed,
  (SELECT coalesce(sum(n), 0) FROM masks m WHERE m.part = p.part AND m.m & b.before > 0 AND m.m & b.bit > 0) AS redundant,
  (SELECT coalesce(sum(n), 0) FROM masks m WHERE m.part = p.part AND m.m = b.bit) AS unique_fails,
  (SELECT coalesce(sum(good), 0) FROM masks m WHERE m.part = p.part AND m.m & b.before = 0 AND m.m & b.bit > 0) AS good_lost,
  (SELECT coalesce(sum(toxic), 0) FROM masks m WHERE m.part = p.part AND m.m & b.before = 0 AND m.m & b.bit > 0) AS toxic_lost
  FROM p, (SELECT DISTINCT bit, coalesce(before, 0)::INT AS before FROM s) b)
SELECT part, list_aggregate(list_transform(o, lambda i: chr(65 + i)), 'string_agg', '') AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, s.bit)::BIGINT AS shapley, chr(65 + o[step]) AS filter
FROM s JOIN c ON c.bit = s.bit AND c.before = coalesce(s.before, 0)
"""
QUERIES = {"op11_permutation_trie_audit": op11_permutation_trie_audit}
ORACLES = {"op11_permutation_trie_audit": ORACLE}
