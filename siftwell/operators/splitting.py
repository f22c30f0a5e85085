"""Splits that keep duplicate groups whole, source holdout, k-fold and leak checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.operators.running import join_null_safe, row_numbers
from siftwell.operators.sampling import draw_key
from siftwell.sources.shared import written

SPLITS = ("train", "val", "test")
TEST, VAL = 0.15, 0.15
NO_SOURCE = "-"


def folds_for(ratio: float) -> int:
    return max(2, round(1 / ratio))


def group_folds(rows: DataFrame, folds: int, seed: int, label: str = "label", group: str = "group_id") -> DataFrame:
    """(group, fold): whole groups, dealt in turn by falling size within their most frequent label.

    A group's label is its most frequent one (ties: the least). Turns go by (size, hash), so
    each label's rows spread evenly. A row for each group is ranked, in ranges of a label. Rows
    without a group (null) are one group, null is a label, and an empty table gives an empty one.
    """
    counts = rows.groupBy(group, label).agg(F.count("*").alias("c"))
    g = counts.groupBy(group).agg(F.sum("c").alias("size"), F.min(F.struct(F.negative("c").alias("c"), label)).alias("m"))
    named = g.select(group, "size", F.col(f"m.{label}").alias("__sw_main"))
    ranked = row_numbers(named, ["__sw_main"], [F.desc("size"), draw_key(group, seed), F.col(group)], "__sw_turn")
    return ranked.select(group, ((F.col("__sw_turn") - 1) % folds).cast("int").alias("fold"))


#: Kinds of groups whose odd ones are dealt greedily, a bound of the driver's memory; those of further kinds are dealt by a hash.
MOST_KINDS = 100_000


def _greedy(kinds: list[tuple[tuple[tuple, ...], int]], totals: dict, folds: int) -> list[list[int]]:
    """For each kind (its labels' counts, how many groups) the folds of its groups.

    Groups with the most uneven labels go first. Each goes where the labels' shares in the folds then deviate least;
    ties: to the fold with fewest rows, then the first.
    """
    names = {label: i for i, label in enumerate(totals)}
    share = 1.0 / np.array([max(1, totals[label]) for label in totals], float)
    vectors = np.zeros((len(kinds), len(names)))
    for r, (counts, _) in enumerate(kinds):
        for label, c in counts:
            vectors[r, names[label]] = c
    held, out = np.zeros((folds, len(names))), [[] for _ in kinds]
    # The variance times the square of the number of labels, a whole number: equal ones are equal, whatever their order.
    spread = len(names) * (vectors**2).sum(1) - vectors.sum(1) ** 2
    for r in np.lexsort((-vectors.sum(1), -spread)):
        for _ in range(kinds[r][1]):
            tried = held[None] + np.eye(folds)[:, :, None] * vectors[r][None, None]
            worst = (tried * share).std(1).mean(1)
            fold = int(np.lexsort((np.arange(folds), held.sum(1), np.round(worst, 12)))[0])
            held[fold] += vectors[r]
            out[r].append(fold)
    return out


def balanced_folds(rows: DataFrame, folds: int, seed: int, label: str = "label", group: str = "group_id") -> DataFrame:
    """(group, fold): whole groups, so that each label's rows spread evenly; all labels of a group count.

    Groups with the same counts of labels are one kind. As many of a kind as ``folds`` divides go to all folds
    alike, in the order of a hash; the rest, fewer than ``folds`` of each kind, go one by one to the fold where shares of labels then deviate least. Only
    kinds come to the driver, no groups. Rows without a group are one group, null is a label, an empty table gives an empty one.
    """
    counts = rows.groupBy(group, label).agg(F.count("*").alias("c"))
    kind = F.array_sort(F.collect_list(F.struct(F.to_json(F.struct(F.col(label).alias("l"))).alias("l"), "c")))
    vectors = counts.groupBy(group).agg(kind.alias("v")).withColumn("__sw_kind", F.to_json("v"))
    ranked = written(row_numbers(vectors.select(group, "v", "__sw_kind"), ["__sw_kind"], [draw_key(group, seed), F.col(group)], "__sw_turn"), "turns")
    kinds = ranked.groupBy("__sw_kind").agg(F.count("*").alias("m"), F.first("v").alias("v"))
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    odd = kinds.where(F.col("m") % folds > 0).orderBy(F.desc(size), "__sw_kind").limit(MOST_KINDS).select("__sw_kind", "v", (F.col("m") % folds).alias("rest")).collect()
    totals = {r.l: r.n for r in ranked.select(F.explode("v").alias("x")).groupBy(F.col("x.l").alias("l")).agg(F.sum("x.c").alias("n")).orderBy("l").collect()}
    dealt = _greedy([(tuple((x.l, x.c) for x in r.v), r.rest) for r in odd], totals, folds)
    taken = rows.sparkSession.createDataFrame([(r["__sw_kind"], d) for r, d in zip(odd, dealt, strict=True)], "__sw_kind string, dealt array<int>")
    both = ranked.join(kinds.select("__sw_kind", "m"), "__sw_kind").join(taken, "__sw_kind", "left")
    turn, even = F.col("__sw_turn") - 1, F.col("m") - F.col("m") % folds
    rest = F.coalesce(F.try_element_at("dealt", (turn - even + 1).cast("int")), F.pmod(F.xxhash64("__sw_kind") + turn, F.lit(folds)).cast("int"))
    return both.select(group, F.when(turn < even, turn % folds).otherwise(rest).cast("int").alias("fold"))


#: (rows, folds, seed, label, group) -> (group, fold).
Deal = Callable[[DataFrame, int, int, str, str], DataFrame]


def _with_fold(rows: DataFrame, folds: DataFrame, group: str, to: str) -> DataFrame:
    return join_null_safe(rows, folds.withColumnRenamed("fold", to), [group], "left")


def three_way(rows: DataFrame, label: str = "label", group: str = "group_id", test: float = TEST, val: float = VAL, seed: int = 42, deal: Deal = group_folds) -> DataFrame:
    """Add ``split``: the first of folds_for(test) folds is the test set, then validation from the rest.

    Every row gets a split, those without a group too (``group_folds``). A column named ``split`` is replaced.
    """
    marked = _with_fold(rows, deal(rows, folds_for(test), seed, label, group), group, "__sw_test")
    second = deal(marked.where("__sw_test <> 0"), folds_for(val / (1 - test)), seed + 1, label, group)
    split = F.when(F.col("__sw_test") == 0, "test").when(F.col("__sw_val") == 0, "val").otherwise("train")
    return _with_fold(marked, second, group, "__sw_val").withColumn("split", split).drop("__sw_test", "__sw_val")


def k_folds(rows: DataFrame, k: int, label: str = "label", group: str = "group_id", seed: int = 42, deal: Deal = group_folds) -> DataFrame:
    """Each row once for each fold, with ``role`` val in its own fold and train in the others. Columns named ``fold`` or ``role`` are replaced."""
    own = _with_fold(rows.drop("fold", "role"), deal(rows, k, seed, label, group), group, "__sw_own")
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return own.select("*", each.alias("fold")).withColumn("role", F.when(F.col("fold") == F.col("__sw_own"), "val").otherwise("train")).drop("__sw_own")


def k_folds_with_test(rows: DataFrame, k: int, label: str = "label", group: str = "group_id", test: float = TEST, seed: int = 42) -> DataFrame:
    """``k_folds`` over what a fixed test set leaves: test rows come once for each fold too, with ``role`` test.

    The test set is that of ``three_way`` with the same seed, so all folds are judged on the same rows.
    """
    marked = _with_fold(rows, group_folds(rows, folds_for(test), seed, label, group), group, "__sw_test")
    rest = k_folds(marked.where("__sw_test <> 0"), k, label, group, seed + 1)
    fixed = marked.where("__sw_test = 0").drop("fold", "role").select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).withColumn("role", F.lit("test"))
    return rest.unionByName(fixed).drop("__sw_test")


def folds_of_split(split: DataFrame, k: int, label: str = "label", group: str = "group_id", seed: int = 42, deal: Deal = group_folds) -> DataFrame:
    """``k_folds`` over the train and validation rows of a split; its test rows come once for each fold, with ``role`` test."""
    rest = k_folds(split.where("split <> 'test'"), k, label, group, seed, deal)
    fixed = split.where("split = 'test'").drop("fold", "role").select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).withColumn("role", F.lit("test"))
    return rest.unionByName(fixed)


def source_holdout(rows: DataFrame, label: str = "label", source: str = "source", ratio: float = TEST) -> DataFrame:
    """(label, source, n) of the sources that are held out whole.

    Sources in ascending size until ``ratio`` of the label is reached; none of over half of its
    label, and none but the first that overshoots by 40 %. Labels with fewer than two named
    sources hold out none. As sizes ascend, what is chosen is a prefix, so running
    sums over a row for each source do.
    """
    named = rows.where(F.col(source) != NO_SOURCE).groupBy(label, source).agg(F.count("*").alias("n"))
    total = rows.groupBy(label).agg(F.count("*").alias("total"))
    by_size = Window.partitionBy(label).orderBy("n", source)
    run = named.join(total, label).select(
        "*",
        F.row_number().over(by_size).alias("r"),
        (F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("c"),
        F.count("*").over(Window.partitionBy(label)).alias("sources"),
        F.greatest(F.lit(1), F.floor(F.lit(float(ratio)) * F.col("total"))).alias("want"),
    )
    take = (F.col("sources") >= 2) & (F.col("c") < F.col("want")) & (F.col("n") <= 0.5 * F.col("total")) & ((F.col("r") == 1) | (F.col("c") + F.col("n") <= 1.4 * F.col("want")))
    return run.where(take).select(label, source, "n")


def holdout_split(rows: DataFrame, label: str = "label", source: str = "source", group: str = "group_id", id_col: str = "doc_id", test: float = TEST, val: float = VAL, seed: int = 42, deal: Deal = group_folds) -> DataFrame:
    """Add ``split`` with whole sources in the test set, topped up by rows and closed over groups.

    Where held-out sources fall short of floor(test * rows) of a label, min(need, max(1, others - 1))
    further rows are drawn by hash; a label of fewer rows than make one needs none. Each group with a test row is test; the rest is
    split into train and val by groups. Rows without a label are never drawn, rows without a group are one
    group. Ids must not repeat or be null. A column named ``split`` is replaced.
    """
    held = rows.join(source_holdout(rows, label, source, test).select(label, source), [label, source], "left_semi").select(id_col, label)
    have = held.groupBy(label).agg(F.count("*").alias("have"))
    total = rows.groupBy(label).agg(F.count("*").alias("total"))
    need = total.join(have, label, "left").na.fill(0, ["have"]).withColumn("need", F.floor(F.lit(float(test)) * F.col("total")) - F.col("have"))
    need = need.withColumn("__sw_take", F.least("need", F.greatest(F.lit(1), F.col("total") - F.col("have") - 1))).where("need > 0 AND total > have")
    others = rows.select(id_col, label).join(held.select(id_col), id_col, "left_anti").join(need.select(label, "__sw_take"), label)
    numbered = row_numbers(others, [label], [draw_key(id_col, seed), F.col(id_col)], "__sw_r")
    chosen = held.select(id_col).union(numbered.where("__sw_r <= __sw_take").select(id_col))
    groups = rows.join(chosen, id_col, "left_semi").select(group).distinct()
    marked = join_null_safe(rows, groups.withColumn("__sw_test", F.lit(True)), [group], "left")
    folds = deal(marked.where("__sw_test IS NULL"), folds_for(val / (1 - test)), seed, label, group)
    split = F.when(F.col("__sw_test"), "test").when(F.col("__sw_val") == 0, "val").otherwise("train")
    return _with_fold(marked, folds, group, "__sw_val").withColumn("split", split).drop("__sw_test", "__sw_val")


def split_sizes(split: DataFrame, label: str = "label") -> DataFrame:
    """(split, label, n); null is a label."""
    return split.groupBy("split", label).agg(F.count("*").alias("n"))


def split_overlap(split: DataFrame, key: str = "group_id") -> DataFrame:
    """Values of ``key`` that occur in several splits: none, unless something leaks."""
    return split.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def missing_classes(split: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """(split, label) pairs of ``classes`` without a row."""
    names = split.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return classes.select(label).distinct().join(F.broadcast(names)).select("split", label).join(split.select("split", label).distinct(), ["split", label], "left_anti")


def split_warnings(split: DataFrame, label: str = "label", test: float = TEST) -> DataFrame:
    """(what, label, value): a test set of over twice its share, and labels with over 45 % of their rows in it."""
    is_test = (F.col("split") == "test").cast("int")
    whole = split.agg(F.avg(is_test).alias("value")).where(F.col("value") > 2 * test).select(F.lit("large_test").alias("what"), F.lit(None).cast(split.schema[label].dataType).alias(label), "value")
    each = split.groupBy(label).agg(F.avg(is_test).alias("value")).where("value > 0.45").select(F.lit("skewed_label").alias("what"), label, "value")
    return whole.unionByName(each)


def checked(split: DataFrame, classes: DataFrame, label: str = "label", group: str = "group_id", id_col: str = "doc_id") -> DataFrame:
    """``split`` itself, or an error if ids or groups leak or a split lacks a class."""
    for key in (id_col, group):
        leaks = [r[0] for r in split_overlap(split, key).select(key).limit(5).collect()]
        if leaks:
            raise ValueError(f"{key} in several splits, such as {leaks}")
    lacking = [(r[0], r[1]) for r in missing_classes(split, classes, label).select("split", label).limit(5).collect()]
    if lacking:
        raise ValueError(f"classes missing from a split, such as {lacking}")
    return split


def hash_split(id_col: str, percent: int = 20, seed: int = 123) -> Column:
    """``val`` for about ``percent`` of ids, else ``train``: by a hash of id and seed, stable under any partitioning. A null id is like any other."""
    eight = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.when(eight % 100 < percent, "val").otherwise("train")


def one_hot(label: Column, k: int) -> Column:
    """An array of ``k`` numbers, 1 at the label's place and else 0; all 0 for a null label or one outside of it."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce((i == label).cast("int"), F.lit(0)))
