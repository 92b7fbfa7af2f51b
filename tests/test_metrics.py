"""Classification scores against direct formulas."""

import math
import random

import pytest

from helixframe.operators import metrics
from pyspark.sql import functions as F


def brute(pairs):
    labels = sorted({x for p in pairs for x in p})
    n = len(pairs)
    accuracy = sum(a == b for a, b in pairs) / n
    f1 = 0.0
    for c in labels:
        tp = sum(a == b == c for a, b in pairs)
        support = sum(a == c for a, _ in pairs)
        predicted = sum(b == c for _, b in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        if precision + recall:
            f1 += support / n * 2 * precision * recall / (precision + recall)
    t = [sum(a == c for a, _ in pairs) for c in labels]
    p = [sum(b == c for _, b in pairs) for c in labels]
    cov = sum(a == b for a, b in pairs) * n - sum(x * y for x, y in zip(p, t))
    below = math.sqrt(n * n - sum(x * x for x in p)) * math.sqrt(n * n - sum(x * x for x in t))
    return accuracy, f1, cov / below if below else 0.0


def test_scores(spark):
    rnd = random.Random(5)
    runs = {
        "random": [(rnd.randrange(4), rnd.randrange(4)) for _ in range(300)],
        "perfect": [(i % 3, i % 3) for i in range(30)],
        "inverted": [(i % 2, 1 - i % 2) for i in range(30)],
        "one class": [(1, 1)] * 7,
        "one prediction": [(i % 2, 0) for i in range(9)],
        "unseen prediction": [(0, 0), (1, 5), (1, 1)],
    }
    df = spark.createDataFrame([(r, a, b) for r, ps in runs.items() for a, b in ps], "run string, label int, pred int")
    got = {r["run"]: (r["accuracy"], r["f1_score"], r["mcc"]) for r in metrics.evaluate(df, ["run"]).collect()}
    for run, pairs in runs.items():
        assert got[run] == pytest.approx(brute(pairs)), run


def test_argmax_ties_and_nan(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0, float("nan"), 5.0],), ([4.0],)], "logits array<double>")
    assert [r["pred"] for r in metrics.predict_from_logits(df).collect()] == [1, 1, 0]


def test_best_fold(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.0), ("b", 2, -0.1), ("c", 4, 0.2)]
    df = spark.createDataFrame(rows, "run string, fold int, mcc double")
    assert {r["run"]: (r["fold"], r["mcc"]) for r in metrics.best_fold(df, ["run"]).collect()} == {
        "a": (2, 0.7),
        "c": (4, 0.2),
    }


def test_result_rows(spark):
    df = spark.createDataFrame([(0.5, 0.25)], "mcc double, accuracy double")
    out = metrics.result_rows(df, ["mcc", "accuracy"], "test", F.lit("m"), F.lit("d")).collect()
    assert sorted(tuple(r) for r in out) == [
        ("m", "d", "test", "eval_accuracy", 0.25),
        ("m", "d", "test", "eval_mcc", 0.5),
    ]


def test_nan_fold_never_wins(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("a", 1, float("nan")), ("b", 0, float("nan"))], "run string, fold int, mcc double")
    assert [tuple(r) for r in metrics.best_fold(df, ["run"]).collect()] == [("a", 0, 0.9)]
