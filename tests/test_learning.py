"""Training runs, k-means, balanced folds and weighted draws against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import classifier, clusters, sampling, splitting
from siftwell.plans import evaluate


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    label = rng.integers(0, 3, 400)
    return rng.normal(0, 1, (400, 5)) + np.eye(5)[label] * 1.5, label, rng.integers(-1, 3, 400)


def frame(spark, vectors, odd=()):
    x, label, fold = vectors
    rows = [(i, [float(v) for v in x[i]], int(label[i]), None if fold[i] == -1 else int(fold[i]), f"s{i % 3}", 1, 2) for i in range(len(x))]
    return spark.createDataFrame([*rows, *odd], "id int, features array<double>, label int, fold int, source string, x int, own int").repartition(5)


def plain_run(x, label, own, r, k, plan):
    """The run with nothing but matrices."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    train, val, test = (own != r) & (own >= 0), own == r, own == -1
    n = np.maximum(np.bincount(label[train], minlength=k), 1)
    cw = (n.sum() / (k * n)) ** plan.beta
    cw = cw / cw.mean()
    w = np.zeros((k, x.shape[1]))
    w[:, -1] = -1e-6 * np.arange(k)
    p = lambda at: np.exp(x[at] @ w.T) / np.exp(x[at] @ w.T).sum(1, keepdims=True)
    loss = lambda at: -(np.log(p(at)[np.arange(at.sum()), label[at]]) * cw[label[at]]).sum() / cw[label[at]].sum()
    acc = lambda at: (p(at).argmax(1) == label[at]).mean()

    def f1(at):
        said, out = p(at).argmax(1), []
        for c in range(k):
            if (said == c).any() or (label[at] == c).any():
                out.append(2 * ((said == c) & (label[at] == c)).sum() / ((said == c).sum() + (label[at] == c).sum()))
        return np.mean(out)

    history, best, stale = [], (-1.0, None), 0
    for e in range(plan.epochs):
        head, backbone = plan.rates(e)
        before = loss(train), acc(train)
        weight = cw[label[train]][:, None]
        g = ((p(train) - np.eye(k)[label[train]]) * weight).T @ x[train] / weight.sum()
        w = w - np.array([backbone] * (x.shape[1] - 1) + [head]) * g
        history.append((e + 1, e < plan.freeze, head, backbone, *before, loss(val), acc(val), f1(val)))
        if f1(val) > best[0]:
            best, stale = (f1(val), (e + 1, acc(test), f1(test))), 0
        elif e >= plan.freeze:
            stale += 1
            if plan.patience is not None and stale >= plan.patience:
                break
    return history, best


def test_runs_are_those_of_plain_matrices(spark, vectors):
    plan = classifier.Plan(epochs=15, freeze=2, warmup=3, backbone=2.0, patience=3)
    odd = [(900, None, 1, 0, "s", 1, 2), (901, [1.0], 1, 0, "s", 1, 2), (902, [0.0] * 5, 9, 1, "s", 1, 2), (903, [0.0] * 5, None, 1, "s", 1, 2), (904, [float("nan")] * 5, 1, 1, "s", 1, 2), (905, [], 1, 1, "s", 1, 2)]
    runs = classifier.trained(frame(spark, vectors, odd), 3, 3, plan)
    rows = classifier.history(spark, runs).collect()
    scores = {r.fold: r for r in classifier.fold_scores(spark, runs).collect()}
    for k in range(3):
        history, best = plain_run(*vectors, k, 3, plan)
        own = [r[1:] for r in rows if r.run == k]
        assert len(own) == len(history) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(own, history, strict=True))
        assert (scores[k].val_macro_f1, runs[k].best_epoch, scores[k].test_acc, scores[k].test_macro_f1) == pytest.approx((best[0], *best[1]))
    assert any(len([r for r in rows if r.run == k]) < 15 for k in range(3))  # one of them stops early
    assert classifier.trained(frame(spark, vectors).limit(0), 3) == []


def test_predictions_are_the_best_epochs(spark, vectors):
    x, label, fold = vectors
    run = classifier.trained(frame(spark, vectors), 3, 1, classifier.Plan(epochs=6, patience=None))[0]
    odd = [(900, None, 1, 0, "s", 1, 2), (901, [1.0], 1, 0, "s", 1, 2)]
    got = {r.id: r for r in classifier.predictions(frame(spark, vectors, odd), run).collect()}
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ run.best.T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for i in range(len(x)):
        assert got[i].probs == pytest.approx(p[i].tolist()) and got[i].prediction == p[i].argmax() and got[i].conf == pytest.approx(p[i].max())
    assert got[900].probs is None and got[901].prediction is None
    assert np.trace(run.test) == sum(got[i].prediction == label[i] for i in np.flatnonzero(fold == -1))


def test_training_command(spark, vectors, tmp_path):
    frame(spark, vectors).write.parquet(str(tmp_path / "v"))
    evaluate.main(["train", str(tmp_path / "v"), str(tmp_path / "o"), "--classes", "a,b,c", "--kfold", "3", "--epochs", "4"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o/history")).count() == 12
    assert {r.metric for r in spark.read.option("header", True).csv(str(tmp_path / "o/kfold_summary")).collect()} == {"val_macro_f1", "test_acc", "test_macro_f1"}
    p = spark.read.parquet(str(tmp_path / "o/predictions")).where("fold = 1").drop("fold")
    p.select("id", "label", "source").write.parquet(str(tmp_path / "t"))
    p.select("id", "prediction", "conf", "probs").write.parquet(str(tmp_path / "p"))
    evaluate.main(["report", str(tmp_path / "t"), str(tmp_path / "p"), str(tmp_path / "e"), "--classes", "a,b,c"])
    assert spark.read.json(str(tmp_path / "e/classes")).count() == 3


# k-means


def test_draws_follow_squared_distances(spark):
    """Of three places the second centre is drawn in proportion to the squared distance to the first."""
    rows = spark.createDataFrame([(i, [[0.0], [1.0], [2.0]][i % 3]) for i in range(30)], "id int, features array<double>")
    n = {}
    for seed in range(60):
        first, second = clusters.plus_plus(rows, 2, seed)
        assert first != second
        if first == [0.0]:
            n[second[0]] = n.get(second[0], 0) + 1
    assert n.get(2.0, 0) > n.get(1.0, 0)  # four to one
    assert clusters.plus_plus(rows, 5, 1)[3:] and clusters.plus_plus(rows.limit(0), 3) == []
    same = spark.createDataFrame([(1, [5.0]), (2, [5.0]), (None, [9.0]), (3, None)], "id int, features array<double>")
    assert clusters.plus_plus(same, 3) == [[5.0]] * 3


def test_rounds_until_labels_stand_still(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 9)])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "id int, features array<double>")
    starts = np.array(clusters.plus_plus(rows, 3))
    labels, c = np.zeros(len(x), int), starts.copy()
    for _ in range(25):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(3)])
    got, centres = clusters.k_means(rows, 3)
    assert {r.id: r.cluster for r in got.collect()} == {**dict(enumerate(labels.tolist())), 999: None}
    assert np.allclose(centres, c)
    named = clusters.visual_clusters(rows.withColumn("vcluster", F.lit("x")), k=3, id_col="id")
    assert {r.id: r.vcluster for r in named.collect()} == {**{i: f"c{j:02d}" for i, j in enumerate(labels.tolist())}, 999: None}
    assert {r.vcluster for r in clusters.visual_clusters(rows.limit(30), id_col="id").collect()} == {"c00"}


# Folds


def test_nearest_centre_equals_sql_expressions(spark):
    centres = [[1.0, 2.0, 0.1], [0.3, 0.3, 0.3], [1.0, 2.0, 0.1]]
    rng = np.random.default_rng(3)
    rows = [[float(x) for x in v] for v in rng.normal(size=(9000, 3))] + [None, [1.0, None, 2.0], [1.0, 2.0], [], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0, 0.1]]
    table = spark.createDataFrame(list(enumerate(rows)), "id int, v array<double>").repartition(2)
    held = F.array(*[F.struct(F.lit(j).alias("cluster"), F.array(*[F.lit(y) for y in c]).alias("centre")) for j, c in enumerate(centres)])
    plain = F.array_min(F.transform(held, lambda c: F.struct(clusters._distance(F.col("v"), c["centre"]).alias("d2"), c["cluster"].alias("cluster"))))
    both = table.select("id", "v", clusters._best("v", centres).alias("got"), plain.alias("want")).where("v IS NOT NULL")
    assert both.count() == len(rows) - 1
    assert both.where("NOT (got.d2 <=> want.d2 AND got.cluster <=> want.cluster)").count() == 0
    # One call of the interpreter for each batch and not one for each dimension of each pair.
    assert "zip_with" not in table.select(clusters._best("v", centres).alias("b"))._jdf.queryExecution().toString()


def deviation(shares):
    return shares.std(0).mean()


def test_folds_balance_all_labels_of_a_group(spark):
    rng = np.random.default_rng(3)
    rows, g = [], 0
    for _ in range(260):
        labels = rng.choice(4, rng.integers(1, 9), p=[0.5, 0.3, 0.15, 0.05]) if rng.random() < 0.4 else [int(rng.integers(0, 4))]
        rows += [(len(rows) + i, g, int(k)) for i, k in enumerate(labels)]
        g += 1
    rows += [(10_000 + i, None, None if i % 2 else 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id int, group_id int, label int").repartition(4)
    got = {r.group_id: r.fold for r in splitting.balanced_folds(df, 5, 42).collect()}
    assert len(got) == g + 1 and set(got.values()) == set(range(5))
    names = [0, 1, 2, 3, None]
    held = np.zeros((5, 5))
    for _, group, label in rows:
        held[got[group], names.index(label)] += 1
    total = held.sum(0)
    # The plain way: all groups one by one, the most uneven first, each to the fold where shares then deviate least.
    each = {}
    for _, group, label in rows:
        each.setdefault(group, np.zeros(5))[names.index(label)] += 1
    plain = np.zeros((5, 5))
    for v in sorted(each.values(), key=lambda v: (-v.std(), -v.sum())):
        plain[min(range(5), key=lambda f: (deviation((plain + np.eye(5)[f][:, None] * v) / total), plain[f].sum()))] += v
    assert deviation(held[:, :4] / total[:4]) <= deviation(plain[:, :4] / total[:4]) + 0.01
    assert splitting.balanced_folds(df.limit(0), 5, 42).count() == 0
    three = splitting.three_way(df.withColumn("split", F.lit("x")), deal=splitting.balanced_folds)
    assert three.count() == len(rows) and splitting.split_overlap(three.where("group_id IS NOT NULL")).count() == 0


# Draws


@pytest.mark.parametrize("seed", range(12))
def test_each_draw_is_made_once(spark, seed):
    rng = np.random.default_rng(seed)
    weights = [0.1, 1 / 3, 1e-9, 0.0, None, 7.7][seed % 6 :] + rng.random(50).tolist()
    df = spark.range(3000).withColumn("w", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("id") % len(weights) + 1).cast("int")))
    got = sampling.weighted_draw(df.withColumnRenamed("id", "doc_id"), 5000, F.col("w"), seed=seed).collect()
    assert sorted(r.draw for r in got) == list(range(5000))
    n = np.bincount([r.doc_id for r in got], minlength=3000)
    w = np.array([weights[i % len(weights)] or 0.0 for i in range(3000)])
    assert (np.abs(n - 5000 * w / w.sum()) < 1 + 1e-6).all()


def test_many_equal_fractions(spark):
    df = spark.range(100_000).withColumnRenamed("id", "doc_id")
    got = sampling.weighted_draw(df, 100_000, F.lit(0.1), seed=0)
    assert got.count() == 100_000 == got.select("draw").distinct().count()
    assert sampling.weighted_draw(df.limit(0), 5, F.lit(1.0)).count() == 0
