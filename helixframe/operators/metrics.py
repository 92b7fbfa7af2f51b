"""Classification scores from one confusion count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.vector import argmax


def predict_from_logits(df: DataFrame, logits: str = "logits", name: str = "pred") -> DataFrame:
    return df.withColumn(name, argmax(F.col(logits)))


def confusion(
    df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Rows per (keys, label, prediction). Partial counts leave nothing to skew."""
    return df.groupBy(*keys, label, pred).agg(F.count(F.lit(1)).alias("n"))


def scores(
    counts: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Accuracy, support-weighted F1 and multiclass MCC per ``keys``.

    Each count feeds its label's support and its prediction's total in one pass.
    F1 is 0 for a class without hits, MCC is 0 where its denominator is 0.
    """
    n = F.col("n")
    hit = F.when(F.col(label) == F.col(pred), n).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(label).alias("cls"), n.alias("t"), zero.alias("p"), hit.cast("bigint").alias("tp")),
        F.struct(F.col(pred).alias("cls"), zero.alias("t"), n.alias("p"), zero.alias("tp")),
    )
    per_class = (
        counts.select(*keys, F.inline(sides))
        .groupBy(*keys, "cls")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("t", "p", "tp")])
    )
    t, p, tp = F.col("t"), F.col("p"), F.col("tp")
    sums = per_class.groupBy(*keys).agg(
        F.sum(t).alias("_s"),
        F.sum(tp).alias("_c"),
        F.sum(p * t).alias("_pt"),
        F.sum(p * p).alias("_pp"),
        F.sum(t * t).alias("_tt"),
        F.sum(t * 2.0 * tp / (p + t)).alias("_f1"),
    )
    s = F.col("_s")
    below = F.sqrt(s * s - F.col("_pp")) * F.sqrt(s * s - F.col("_tt"))
    mcc = F.when(below == 0.0, 0.0).otherwise((F.col("_c") * s - F.col("_pt")) / below)
    return sums.select(
        *keys,
        (F.col("_c") / s).alias("accuracy"),
        (F.col("_f1") / s).alias("f1_score"),
        mcc.alias("mcc"),
    )


def evaluate(
    df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """The metric bundle of a prediction table, one row per ``keys``."""
    return scores(confusion(df, keys, label, pred), keys, label, pred)


def best_fold(
    df: DataFrame, keys: Sequence[str], by: str = "mcc", fold: str = "fold"
) -> DataFrame:
    """Fold with the highest score above 0, the earliest on a tie.

    A NaN score never wins, and a run without a positive score has no row. ``max`` over a struct keeps a
    constant-size buffer per run, so no run is sorted.
    """
    top = F.max(F.struct(F.col(by).alias("score"), (-F.col(fold)).alias("order"))).alias("_top")
    return (
        df.where((F.col(by) > 0) & ~F.isnan(F.col(by).cast("double")))
        .groupBy(*keys)
        .agg(top)
        .select(*keys, (-F.col("_top.order")).alias(fold), F.col("_top.score").alias(by))
    )


def result_rows(
    df: DataFrame,
    metrics: Sequence[str],
    evaluation_set: str,
    model: Column,
    dataset: Column,
    prefix: str = "eval_",
) -> DataFrame:
    """Metric columns as long result rows (model, dataset, evaluation_set, metric, score)."""
    pairs = F.array(
        *[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics]
    )
    return df.select(
        model.alias("model"),
        dataset.alias("dataset"),
        F.lit(evaluation_set).alias("evaluation_set"),
        F.inline(pairs),
    )
