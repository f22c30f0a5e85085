"""Multinomial logistic regression with the bookkeeping of a training run: the stand-in for a network.

An epoch is one pass over the rows: each task adds up gradients, losses and confusions of its own rows, and
these sums, whose number hangs on classes and features only, are added up by Spark. Several runs,
such as the folds of a cross-validation, share the pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.history import PATIENCE
from siftwell.sources.shared import written

#: Rows without a fold, which are the test set of all runs.
TEST = -1
#: What keeps classes apart that the rows say nothing about, so that equal scores don't hang on rounding.
APART = 1e-6


@dataclass
class Plan:
    """Settings of a run: epochs, those of them with frozen weights, warm-up epochs, and rates of bias (head) and weights (backbone)."""

    epochs: int = 24
    freeze: int = 2
    warmup: int = 2
    head: float = 1.0
    backbone: float = 8.0
    beta: float = 0.5
    patience: int | None = PATIENCE

    def factor(self, step: int) -> float:
        """Of the rates at an epoch, from 0: 1 while frozen, then warm-up and half a cosine."""
        at, total = step - self.freeze, max(1, self.epochs - self.freeze)
        if at < 0:
            return 1.0
        if at < self.warmup:
            return (at + 1) / max(1, self.warmup)
        return 0.5 * (1 + float(np.cos(np.pi * min(1.0, (at - self.warmup) / max(1, total - self.warmup)))))

    def rates(self, step: int) -> tuple[float, float]:
        f = self.factor(step)
        return self.head * f, 0.0 if step < self.freeze else self.backbone * f


@dataclass
class Run:
    """One run: weights (classes, features + 1; the last is the bias), class weights, history and the best epoch's test confusion."""

    weights: np.ndarray
    class_weights: np.ndarray
    history: list[tuple] = field(default_factory=list)
    best: np.ndarray | None = None
    best_f1: float = -1.0
    best_epoch: int = 0
    test: np.ndarray | None = None
    stale: int = 0
    done: bool = False


HISTORY = "run int, epoch int, frozen boolean, lr_head double, lr_backbone double, train_loss double, train_acc double, val_loss double, val_acc double, val_macro_f1 double"


def macro_f1(confusion: np.ndarray) -> float:
    """Mean F1 over classes that occur as label or prediction; 0 without any."""
    hit, seen = np.diag(confusion), confusion.sum(0) + confusion.sum(1)
    return float((2 * hit[seen > 0] / seen[seen > 0]).mean()) if (seen > 0).any() else 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _row_sums(x: np.ndarray, label: np.ndarray, own: np.ndarray, runs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each run its gradient, its sums of training and validation, and confusions of validation and test."""
    out = []
    for number, weights, of_class in runs:
        k = len(weights)
        p = softmax(x @ weights.T)
        said, w = p.argmax(1), of_class[label]
        loss = -np.log(np.maximum(p[np.arange(len(x)), label], 1e-300)) * w
        train, val, test = (own != number) & (own != TEST), own == number, own == TEST
        gap = p[train] * w[train, None]
        gap[np.arange(len(gap)), label[train]] -= w[train]
        cells = [np.bincount(label[at] * k + said[at], minlength=k * k) for at in (val, test)]
        sums = [loss[train].sum(), w[train].sum(), (said == label)[train].sum(), train.sum(), loss[val].sum(), w[val].sum()]
        out.append(np.concatenate([(gap.T @ x[train]).reshape(-1), sums, *cells]))
    return out


def _pass(rows: DataFrame, runs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``_row_sums`` over all rows: partial sums of tasks, added up by place."""
    schema = T.StructType().add("s", T.ArrayType(T.DoubleType()))

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                own = np.concatenate(_row_sums(x, batch["label"].to_numpy(), batch["own"].to_numpy(), runs))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], names=["s"])

    each = rows.select("x", "label", "own").mapInArrow(run, schema)
    places = each.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(sum(w.size + 6 + 2 * len(w) ** 2 for _, w, _ in runs))
    for r in places:
        total[r.i] = r.v
    return np.split(total, np.cumsum([w.size + 6 + 2 * len(w) ** 2 for _, w, _ in runs])[:-1])


def trained(rows: DataFrame, classes: int, folds: int = 1, plan: Plan | None = None, *, vector: str = "features", label: str = "label", fold: str = "fold") -> list[Run]:
    """``folds`` runs: run r validates on the rows of fold r and learns from the other folds; rows of fold ``TEST`` are the test set.

    Rows with a null or empty vector, one of another length than most, or a label outside of 0 to ``classes`` - 1 don't count, and a null fold is a
    test row. Rates, frozen epochs and warm-up are those of ``plan``, class weights are softened as in
    ``class_weights_soft``. An epoch improves if its macro F1 on validation is above all before; a run with
    ``patience`` stale unfrozen epochs ends. The first of equal scores is the prediction. Without rows there are no runs.
    """
    plan = plan or Plan()
    named = rows.select(F.transform(vector, lambda v: v.cast("double")).alias("x"), F.col(label).cast("int").alias("label"), F.coalesce(F.col(fold).cast("int"), F.lit(TEST)).alias("own"))
    usable = written(named.where((F.col("label") >= 0) & (F.col("label") < classes) & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))), "training")
    sizes = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return []
    usable = usable.where(F.size("x") == sizes.d)
    counts = np.zeros((folds + 1, classes))  # folds from ``folds`` on are for learning in all runs
    for r in usable.where(F.col("own") >= 0).groupBy(F.least("own", F.lit(folds)).alias("own"), "label").agg(F.count("*").alias("n")).collect():
        counts[r.own, r.label] = r.n
    runs = []
    for r in range(folds):
        n = np.maximum(counts.sum(0) - counts[r], 1)
        w = (n.sum() / (classes * n)) ** plan.beta
        weights = np.zeros((classes, sizes.d + 1))
        weights[:, -1] = -APART * np.arange(classes)
        runs.append(Run(weights, w / w.mean()))
    for step in range(plan.epochs + 1):
        live = [(i, r) for i, r in enumerate(runs) if not r.done]
        if not live:
            break
        for (_, run), sums in zip(live, _pass(usable, [(i, r.weights, r.class_weights) for i, r in live]), strict=True):
            _advance(run, sums, step, plan)
    return runs


def _advance(run: Run, sums: np.ndarray, step: int, plan: Plan) -> None:
    """Book the epoch that led to the weights, then take the next step; the pass at weights w has both."""
    k, size = len(run.weights), run.weights.size
    gradient, (loss, weight, hits, n, val_loss, val_weight) = sums[:size].reshape(run.weights.shape), sums[size : size + 6]
    val, test = (sums[size + 6 + i * k * k : size + 6 + (i + 1) * k * k].reshape(k, k) for i in (0, 1))
    if step:
        head, backbone = plan.rates(step - 1)
        f1, frozen = macro_f1(val), step <= plan.freeze
        run.history[-1] += (val_loss / val_weight if val_weight else 0.0, float(np.trace(val) / max(1, val.sum())), f1)
        if f1 > run.best_f1:
            run.best, run.best_f1, run.best_epoch, run.test, run.stale = run.weights.copy(), f1, step, test, 0
        elif not frozen:
            run.stale += 1
            run.done = plan.patience is not None and run.stale >= plan.patience
    if step == plan.epochs:
        run.done = True
    if run.done:
        return
    head, backbone = plan.rates(step)
    run.history.append((step + 1, step < plan.freeze, head, backbone, loss / weight if weight else 0.0, hits / max(1, n)))
    if weight:
        rate = np.full(run.weights.shape[1], backbone)
        rate[-1] = head
        run.weights = run.weights - rate * gradient / weight


def history(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """A row for each run and epoch."""
    plain = lambda r: tuple(v.item() if hasattr(v, "item") else v for v in r)
    return spark.createDataFrame([(i, *plain(h)) for i, r in enumerate(runs) for h in r.history], HISTORY)


def fold_scores(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """(fold, val_macro_f1, test_acc, test_macro_f1) of each run at its best epoch."""
    scores = [(i, float(r.best_f1), float(np.trace(r.test) / max(1, r.test.sum())), macro_f1(r.test)) for i, r in enumerate(runs)]
    return spark.createDataFrame(scores, "fold int, val_macro_f1 double, test_acc double, test_macro_f1 double")


def predictions(rows: DataFrame, run: Run, *, vector: str = "features") -> DataFrame:
    """``rows`` with probs, prediction and conf by the run's best weights; null where the vector is null or of another length."""
    weights = run.best if run.best is not None else run.weights
    width = weights.shape[1] - 1

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return softmax(np.concatenate([x, np.ones((len(x), 1))], axis=1) @ weights.T)

        return predict

    score = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=4096, input_tensor_shapes=[[width]])
    fits = F.coalesce(F.size(vector) == width, F.lit(False))
    sure = F.when(fits, F.transform(vector, lambda v: v.cast("double"))).otherwise(F.array_repeat(F.lit(0.0), width))
    out = rows.withColumn("__sw_x", sure).withColumn("probs", score("__sw_x")).withColumn("probs", F.when(fits, F.col("probs"))).drop("__sw_x")
    top = F.array_max("probs")
    return out.withColumn("prediction", (F.array_position("probs", top) - 1).cast("int")).withColumn("conf", top)
