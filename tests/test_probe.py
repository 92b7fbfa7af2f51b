"""Cross-validated classification."""

import random

import numpy as np

from helixframe.config import FoldOptions
from helixframe.operators import probe


def test_cross_validation_of_separable_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, i % 3, [rnd.gauss(3 * (i % 3), 0.5), rnd.gauss(-2 * (i % 3), 0.5)]) for i in range(240)]
    df = probe.vector_features(spark.createDataFrame(rows, "id bigint, label int, vec array<double>")).drop("vec")
    found = probe.cross_validate(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "id", "lin", "toy", FoldOptions(folds=4))
    table = found.results.collect()
    assert len(table) == 4 * 3 + 3
    assert {r["evaluation_set"] for r in table} == {"validation", "test"}
    assert all(r["score"] > 0.9 for r in table)
    assert found.best_fold in (1, 2, 3, 4)
    assert found.predictions.count() == 192 and found.predictions.groupBy("fold").count().count() == 4


def test_no_model_is_chosen_without_a_positive_score(spark):
    rows = [(i, 1, [float(i)]) for i in range(20)]
    df = probe.vector_features(spark.createDataFrame(rows, "id bigint, label int, vec array<double>")).drop("vec")
    found = probe.cross_validate(df, df, "id", "lin", "const", FoldOptions(folds=2), max_iter=3)
    assert found.best_fold is None and found.model is None
    assert found.results.where("evaluation_set = 'test'").count() == 0


def test_kmer_features(spark):
    df = spark.createDataFrame([("ACGACG",), ("",)], "sequence string")
    rows = probe.kmer_features(df, k=3, width=64).collect()
    assert rows[0]["features"].toArray().sum() == 2 and rows[1]["features"].toArray().sum() == 0
    assert rows[0]["features"].toArray().max() == 2


def test_all_folds_reach_the_optimum_together(spark):
    rng = np.random.default_rng(7)
    label = rng.integers(0, 3, 150) * 5
    x = rng.normal(size=(150, 4)) * [1, 10, 0.1, 0] + label[:, None] * [0.1, 1, 0, 0]
    fold = rng.integers(1, 4, 150)
    df = spark.createDataFrame([(int(f), int(y), row.tolist()) for f, y, row in zip(fold, label, x)], "fold int, label int, x array<double>")
    models = probe.fit_folds(df.repartition(3), 3, 200, 0.01, 1e-8)
    for k, m in models.items():
        own = fold != k
        z = np.hstack([x[own] / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1), np.ones((own.sum(), 1))])
        p = np.exp(z @ m.weights.T)
        p /= p.sum(1, keepdims=True)
        gradient = (p - (label[own][:, None] == m.labels)).T @ z / own.sum()
        gradient[:, :-1] += 0.01 * m.weights[:, :-1]
        assert m.labels == [0, 5, 10] and np.abs(gradient).max() < 1e-6
    assert probe.fit_folds(df.limit(0), 3, 5, 0.01) == {}


def test_predictions_come_from_the_model_of_the_fold(spark):
    models = {k: probe.LinearModel([0, 9], np.array([[0.0, 0.0], [sign, 0.0]]), np.array([2.0])) for k, sign in ((1, 1.0), (2, -1.0))}
    rows = [(i, i % 2 + 1, 0, [float(v)]) for i, v in enumerate([-3, -3, 4, 4])]
    df = probe.vector_features(spark.createDataFrame(rows, "id bigint, fold int, label int, vec array<double>")).drop("vec")
    assert [(r["id"], r["pred"]) for r in probe.predict(df, models, "id", "fold").orderBy("id").collect()] == [(0, 0), (1, 9), (2, 9), (3, 0)]
    assert probe.predict(df.limit(0), models, "id").count() == 0
