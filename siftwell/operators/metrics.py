"""Classifier metrics over a table (id, label, prediction, conf, source, probs).

A null label or prediction is of no class: the row counts as wrong, on the side that is not null only. A null conf
counts in no mean and reaches no threshold; rows with null probs are on no curve. An empty table has
zeros for all given classes, and no rows where classes, sources or thresholds come from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.operators.running import PART, join_null_safe, ranged, running_sums
from siftwell.sources.shared import written

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
LEAST_SLICE = 20


def labels_table(spark: SparkSession, k: int) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("label"))


def class_weights_soft(rows: DataFrame, k: int, beta: float = 0.5, label: str = "label") -> DataFrame:
    """(label, n, weight): (N / (K max(1, n)))^beta over its mean; a class without rows counts as one row."""
    n = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    w = labels_table(rows.sparkSession, k).join(n, "label", "left").select("label", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).alias("n"))
    w = w.join(F.broadcast(w.agg(F.sum("n").alias("total")))).withColumn("raw", F.pow(F.col("total") / (F.lit(float(k)) * F.col("n")), F.lit(float(beta))))
    return w.join(F.broadcast(w.agg(F.avg("raw").alias("mean")))).select("label", F.col("n").cast("long").alias("n"), (F.col("raw") / F.col("mean")).alias("weight"))


def class_weights_balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): N / (K n) over the classes at hand."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    both = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.join(F.broadcast(both)).select(label, "n", (F.col("total").cast("double") / (F.col("k") * F.col("n"))).alias("weight"))


def confusion_matrix(p: DataFrame, k: int) -> DataFrame:
    """All k x k cells (label, prediction, n), zeros too."""
    spark = p.sparkSession
    cells = labels_table(spark, k).join(F.broadcast(labels_table(spark, k).withColumnRenamed("label", "prediction")))
    counts = p.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["label", "prediction"], "left").na.fill(0, ["n"])


def _right():
    return F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))


def _per_class(p: DataFrame, k: int) -> DataFrame:
    """label, tp, support, predicted of all k classes; each from one pass."""
    sides = p.select(F.explode(F.array(F.struct(F.col("label").cast("int").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("prediction").cast("int").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q")))).alias("s"), _right().alias("hit"))
    n = sides.groupBy(F.col("s.c").alias("label")).agg(F.sum("s.t").alias("support"), F.sum("s.q").alias("predicted"), F.sum((F.col("hit").cast("int")) * F.col("s.t")).alias("tp"))
    return labels_table(p.sparkSession, k).join(n, "label", "left").na.fill(0, ["support", "predicted", "tp"])


def _scores(per: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = per.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    return out.withColumn("f1", zero(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))))


def classification_report(p: DataFrame, k: int) -> DataFrame:
    """Rows for each class, then accuracy, macro avg and weighted avg: (name, precision, recall, f1, support)."""
    s = _scores(_per_class(p, k))
    cols = ["precision", "recall", "f1"]
    each = s.select(F.col("label").cast("string").alias("name"), *cols, "support")
    total = F.sum("support").alias("support")
    acc = F.sum("tp") / F.sum("support")
    accuracy = s.agg(acc.alias("a"), total).select(F.lit("accuracy").alias("name"), *[F.col("a").alias(c) for c in cols], "support")
    macro = s.agg(*[F.avg(c).alias(c) for c in cols], total).select(F.lit("macro avg").alias("name"), *cols, "support")
    weighted = s.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], total).select(F.lit("weighted avg").alias("name"), *cols, "support")
    return each.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def macro_f1_observed(p: DataFrame, k: int) -> DataFrame:
    """Mean F1 over classes that occur as label or prediction."""
    return _scores(_per_class(p, k)).where("support + predicted > 0").agg(F.avg("f1").alias("macro_f1"))


def accuracy_and_loss(batches: DataFrame) -> DataFrame:
    """Accuracy and size-weighted mean loss of batch sums (n, n_correct, loss)."""
    return batches.agg((F.sum("n_correct") / F.sum("n")).alias("accuracy"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def accuracy_by_source(p: DataFrame, least: int = LEAST_SLICE) -> DataFrame:
    """(source, n, accuracy) of sources with at least ``least`` rows; nothing if there is one source only."""
    each = p.groupBy("source").agg(F.count("*").alias("n"), F.avg(_right().cast("int")).alias("accuracy"))
    several = each.agg(F.count("source").alias("sources"))
    return each.join(F.broadcast(several)).where((F.col("sources") > 1) & (F.col("n") >= least)).select("source", "n", "accuracy")


def confidence_summary(p: DataFrame) -> DataFrame:
    """Mean confidence of all, correct and wrong rows: (what, n, mean_conf); a part without rows is left out."""
    right = _right()
    parts = F.explode(F.array(F.lit("all"), F.when(right, "correct").otherwise("wrong")))
    return p.select("conf", parts.alias("what")).groupBy("what").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"))


def confidence_sweep(p: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, n, coverage, accuracy) of rows at least that confident; empty thresholds are left out."""
    reached = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("conf") >= t))
    right = _right().cast("int")
    n = p.select(right.alias("right"), reached.alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))
    return n.join(F.broadcast(p.agg(F.count("*").alias("total")))).select("threshold", "n", (F.col("n").cast("double") / F.col("total")).alias("coverage"), "accuracy")


def confidence_by_class(p: DataFrame) -> DataFrame:
    """(label, n, recall, mean_conf): recall over rows of the class, mean confidence over rows predicted as it."""
    right = _right().cast("int")
    true = p.groupBy("label").agg(F.count("*").alias("n"), F.avg(right).alias("recall"))
    said = p.groupBy(F.col("prediction").alias("label")).agg(F.avg("conf").alias("mean_conf"))
    return true.join(said, "label", "left")


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest score is taken off first, so none overflows. Null stays null."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _scored(p: DataFrame, k: int, micro: bool) -> DataFrame:
    """(cls, score, pos): a row for each class and prediction; micro: one class of all."""
    cls = F.lit(-1) if micro else F.col("i")
    each = p.select("label", F.posexplode("probs").alias("i", "score")).where(F.col("i") < k)
    return each.select(cls.cast("int").alias("cls"), "score", (F.col("label") == F.col("i")).cast("int").alias("pos"))


def roc_points(p: DataFrame, k: int, micro: bool = False) -> DataFrame:
    """(cls, threshold, tp, fp, fpr, tpr), equal scores as one point; classes without both kinds of rows are left out.

    Scores are grouped first, and sums run over ranges of the distinct scores, so no
    task holds a class. Rows with null ``probs`` don't count.
    """
    by_score = _scored(p, k, micro).groupBy("cls", "score").agg(F.sum("pos").alias("p"), F.count("*").alias("c"))
    totals = by_score.groupBy("cls").agg(F.sum("p").alias("np"), F.sum(F.col("c") - F.col("p")).alias("nn")).where("np > 0 AND nn > 0")
    # At most k rows of totals: a bounded broadcast.
    counted = by_score.join(F.broadcast(totals), "cls").withColumn("m", F.col("c") - F.col("p"))
    run = running_sums(counted, ["cls"], [F.desc("score")], {"tp": "p", "fp": "m"}).select("cls", F.col("score").alias("threshold"), "tp", "fp", "np", "nn")
    start = totals.select("cls", F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "np", "nn")
    return run.unionByName(start).select("cls", "threshold", "tp", "fp", (F.col("fp").cast("double") / F.col("nn")).alias("fpr"), (F.col("tp").cast("double") / F.col("np")).alias("tpr"))


def _trapezoid(points: DataFrame, by: str) -> DataFrame:
    """(by, auc): steps inside ranges of points, then those from the last point of a range to the first of the next."""
    parts = ranged(points.select(by, "fpr", "tpr"), [by], [F.col("fpr"), F.col("tpr")])
    w = Window.partitionBy(by, PART).orderBy("fpr", "tpr")
    step = lambda x, y: (F.col("fpr") - x) * (F.col("tpr") + y) / 2
    inside = parts.select(by, step(F.lag("fpr").over(w), F.lag("tpr").over(w)).alias("a"))
    ends = parts.groupBy(by, PART).agg(F.min(F.struct("fpr", "tpr")).alias("lo"), F.max(F.struct("fpr", "tpr")).alias("hi"))
    over = Window.partitionBy(by).orderBy(PART)
    between = ends.select(by, F.col("lo.fpr").alias("fpr"), F.col("lo.tpr").alias("tpr"), F.lag("hi").over(over).alias("p"))
    return inside.unionByName(between.select(by, step(F.col("p.fpr"), F.col("p.tpr")).alias("a"))).groupBy(by).agg(F.sum("a").alias("auc"))


def auc(p: DataFrame, k: int, micro: bool = False) -> DataFrame:
    """(cls, auc) by the trapezoid rule; micro: one row of class -1."""
    return _trapezoid(roc_points(p, k, micro), "cls")


def _upper(points: DataFrame) -> DataFrame:
    """The highest point at each false positive rate of each class's curve."""
    return points.groupBy("cls", "fpr").agg(F.max("tpr").alias("tpr"))


def macro_auc(p: DataFrame, k: int) -> DataFrame:
    """Area under the mean of all classes' curves (``mean_roc``); at a rate where a curve rises straight up its highest point counts.

    The curves are interpolated linearly, so the area under their mean is the mean of their
    areas, each from its own points: the union of all rates is not needed.
    """
    return _trapezoid(_upper(roc_points(p, k)), "cls").agg(F.avg("auc").alias("auc"))


def interpolated(points: DataFrame, grid: DataFrame, by: str = "cls", x: str = "fpr", y: str = "tpr") -> DataFrame:
    """(by, x, y) of every ``by`` at every value of ``grid``: linear between the last point at or before and the first at or after.

    An as-of join of both sides at once: points and grid are sorted together in ranges of x, so a range looks at its own rows,
    and at the points nearest to it in other ranges, a row for each range. Before the first point and after the
    last there is no value. ``points`` has one y for each x.
    """
    names = F.array_sort(F.collect_set(by)).alias("names")  # one row with the names of all curves, few as there is one for each class
    asked = grid.select(x).distinct().join(F.broadcast(points.agg(names))).select(F.explode("names").alias(by), x, F.lit(None).cast("double").alias(y), F.lit(1).alias("asked"))
    both = points.select(by, x, y, F.lit(0).alias("asked")).unionByName(asked)
    own = F.when(F.col("asked") == 0, F.struct(x, y))
    merged = both.groupBy(by, x).agg(F.max(own).alias("own"), F.max("asked").alias("asked"))
    parts = ranged(merged, [by], [F.col(x)])
    ends = parts.groupBy(by, PART).agg(F.min("own").alias("first"), F.max("own").alias("last"))
    back, ahead = Window.partitionBy(by).orderBy(PART), Window.partitionBy(by).orderBy(F.desc(PART))
    before = Window.unboundedPreceding
    near = ends.select(by, PART, F.last("last", ignorenulls=True).over(back.rowsBetween(before, -1)).alias("lower"), F.last("first", ignorenulls=True).over(ahead.rowsBetween(before, -1)).alias("upper"))
    up = Window.partitionBy(by, PART).orderBy(x).rowsBetween(before, 0)
    down = Window.partitionBy(by, PART).orderBy(F.desc(x)).rowsBetween(before, 0)
    placed = join_null_safe(parts, near, [by, PART]).select(
        by, x, "asked",
        F.coalesce(F.last("own", ignorenulls=True).over(up), "lower").alias("lo"),
        F.coalesce(F.last("own", ignorenulls=True).over(down), "upper").alias("hi"),
    )
    share = F.coalesce(F.try_divide(F.col(x) - F.col(f"lo.{x}"), F.col(f"hi.{x}") - F.col(f"lo.{x}")), F.lit(0.0))
    return placed.where("asked = 1").select(by, x, (F.col(f"lo.{y}") + share * (F.col(f"hi.{y}") - F.col(f"lo.{y}"))).alias(y))


def mean_roc(p: DataFrame, k: int) -> DataFrame:
    """(fpr, tpr): the mean of all classes' curves on the union of their false positive rates."""
    curves = written(_upper(roc_points(p, k)), "curves")
    return interpolated(curves, curves).groupBy("fpr").agg(F.avg("tpr").alias("tpr"))


def kfold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std) over folds; std of one fold is null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("p")
    return folds.select(pairs).select("p.*").groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
