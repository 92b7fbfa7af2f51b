"""Cross-validated linear classification of sequence vectors."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import FoldOptions
from helixframe.functions.vector import as_double
from helixframe.operators.corpus import kmer_tokens
from helixframe.operators.folds import assign_folds
from helixframe.operators.metrics import evaluate, result_rows
from helixframe.operators.tables import concat_rows
from helixframe.session import release, settle

METRICS = ["accuracy", "f1_score", "mcc"]


def vector_features(df: DataFrame, vec: str = "vec", name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(as_double(F.col(vec))))


def kmer_features(df: DataFrame, sequence: str = "sequence", k: int = 6, width: int = 4096, name: str = "features") -> DataFrame:
    """Hashed k-mer counts of a sequence as a sparse vector."""
    tokens = df.withColumn("_tokens", kmer_tokens(F.col(sequence), k))
    return HashingTF(numFeatures=width, inputCol="_tokens", outputCol=name).transform(tokens).drop("_tokens")


@dataclass(frozen=True)
class LinearModel:
    """One softmax regression: a row of weights per label, the last one the intercept, for features divided by ``scale``."""

    labels: list[int]
    weights: np.ndarray
    scale: np.ndarray


@dataclass
class ProbeResult:
    """Validation predictions of all folds, the long result table, the chosen fold, the models by fold."""

    predictions: DataFrame
    results: DataFrame
    best_fold: int | None
    model: LinearModel | None
    models: dict[int, LinearModel]


def _dense(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, vector_to_array("features").alias("x"))


def _losses(rows: DataFrame, labels: list[int], scale: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, summed loss, summed gradient) of every fold's training rows, from one pass over all rows.

    ``weights`` is folds x labels x (width + 1). A row counts for all folds but its own. Tasks work on whole batches as matrix
    products and send one number per weight, which the cluster adds up.
    """
    folds, classes, width = weights.shape

    def run(batches):
        total = np.zeros(2 * folds + weights.size)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            x = np.hstack([x / scale, np.ones((n, 1))])
            y = np.searchsorted(labels, batch.column(1).to_numpy(zero_copy_only=False))
            used = (batch.column(0).to_numpy(zero_copy_only=False)[:, None] != np.arange(1, folds + 1)).astype(float)
            logits = (x @ weights.reshape(-1, width).T).reshape(n, folds, classes)
            logits -= logits.max(axis=2, keepdims=True)
            p = np.exp(logits)
            sums = p.sum(axis=2, keepdims=True)
            of_label = logits[np.arange(n), :, y] - np.log(sums[:, :, 0])
            p /= sums
            p[np.arange(n), :, y] -= 1
            p *= used[:, :, None]
            total[:folds] += used.sum(axis=0)
            total[folds : 2 * folds] -= (of_label * used).sum(axis=0)
            total[2 * folds :] += (p.reshape(n, -1).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    sums = rows.select("fold", "label", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * folds + weights.size)
    for row in sums:  # one per weight
        out[row["i"]] = row["v"]
    return out[:folds], out[folds : 2 * folds], out[2 * folds :].reshape(weights.shape)


class _Descent:
    """Limited-memory quasi-Newton steps of one model; a step that does not lower the loss enough is halved."""

    def __init__(self, shape: tuple[int, ...]):
        self.at, self.trial, self.loss, self.gradient = np.zeros(shape), np.zeros(shape), np.inf, None
        self.direction, self.step, self.pairs = None, 1.0, deque(maxlen=10)

    def told(self, loss: float, gradient: np.ndarray) -> None:
        """Takes loss and gradient at ``trial`` and sets the next one."""
        if self.gradient is not None and loss > self.loss + 1e-4 * self.step * float((self.gradient * self.direction).sum()) and self.step > 1e-10:
            self.step /= 2
        else:
            if self.gradient is not None:
                moved, turned = self.trial - self.at, gradient - self.gradient
                if (moved * turned).sum() > 1e-16:
                    self.pairs.append((moved, turned))
            self.at, self.loss, self.gradient, self.step = self.trial, loss, gradient, 1.0
            self.direction = -self._curved(gradient)
        self.trial = self.at + self.step * self.direction

    def _curved(self, gradient: np.ndarray) -> np.ndarray:
        q, shares = gradient.copy(), []
        for moved, turned in reversed(self.pairs):
            share = (moved * q).sum() / (moved * turned).sum()
            shares.append(share)
            q -= share * turned
        if self.pairs:
            moved, turned = self.pairs[-1]
            q *= (moved * turned).sum() / (turned * turned).sum()
        for (moved, turned), share in zip(self.pairs, reversed(shares), strict=True):
            q += moved * (share - (turned * q).sum() / (moved * turned).sum())
        return q


def fit_folds(rows: DataFrame, folds: int, max_iter: int, reg: float, tolerance: float = 1e-6) -> dict[int, LinearModel]:
    """The models of all folds, fitted together: every pass over ``rows`` (fold, label, x) serves one step of each.

    Minimises mean softmax loss plus ``reg`` / 2 times the squared weights (not the intercepts) of features that
    are divided by their standard deviation over all rows. Passes end when all gradients are below
    ``tolerance``, or after ``max_iter``. A NULL label is an error; a fold without training rows has weights 0.
    """
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    if not labels:
        return {}
    spread = rows.select(Summarizer.std(array_to_vector("x")).alias("s")).head()[0].toArray()
    scale = np.where(spread > 0, spread, 1.0)
    shape = (folds, len(labels), len(scale) + 1)
    fits = [_Descent(shape[1:]) for _ in range(folds)]
    for _ in range(max_iter):
        weights = np.stack([f.trial for f in fits])
        n, loss, gradient = _losses(rows, labels, scale, weights)
        n = np.maximum(n, 1)
        penalty = weights.copy()
        penalty[:, :, -1] = 0
        loss = loss / n + reg / 2 * (penalty**2).sum(axis=(1, 2))
        gradient = gradient / n[:, None, None] + reg * penalty
        for k, fit in enumerate(fits):
            fit.told(loss[k], gradient[k])
        if all(np.abs(f.gradient).max() < tolerance for f in fits):
            break
    return {k + 1: LinearModel(labels, f.at, scale) for k, f in enumerate(fits)}


def predict(df: DataFrame, models: dict[int, LinearModel], *keep: str) -> DataFrame:
    """(keep..., label, pred) of rows with ``features`` and ``fold``, each by the model of its fold; one pass for all."""
    columns = [*keep, "label"]

    def run(batches):
        for batch in batches:
            x = batch.column(len(columns) + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            fold = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            pred = np.zeros(batch.num_rows, dtype=np.int32)
            for k, m in models.items():
                own = np.flatnonzero(fold == k)
                if len(own):
                    logits = np.hstack([x[own] / m.scale, np.ones((len(own), 1))]) @ m.weights.T
                    pred[own] = np.array(m.labels)[logits.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(pred)], [*columns, "pred"])

    rows = _dense(df, *columns, F.col("fold").alias("_fold"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.mapInArrow(run, f"{kinds}, pred int")


def cross_validate(
    train: DataFrame,
    test: DataFrame,
    key: str,
    model_name: str,
    dataset: str,
    options: FoldOptions = FoldOptions(),
    max_iter: int = 60,
    reg: float = 1e-3,
) -> ProbeResult:
    """K-fold evaluation, then the best fold's model on the test rows. Runs jobs.

    ``train`` and ``test`` have ``features`` and ``label``. The folded features are
    settled once; all folds are fitted together, in at most ``max_iter`` passes, predicted in one and
    scored in one aggregate. The driver reads k metric rows to
    choose the fold: highest score above 0, the earliest on a tie.
    """
    folded = settle(assign_folds(train, key, options.folds, options.seed))
    dense = settle(_dense(folded, "fold", "label"))
    models = fit_folds(dense, options.folds, max_iter, reg)
    release(dense)
    predictions = predict(folded, models, key, "fold")
    bundle = settle(evaluate(predictions, ["fold"]))
    scored = {r["fold"]: r[options.select_by] for r in bundle.collect()}
    chosen = max(
        (k for k in scored if scored[k] > 0), key=lambda k: (scored[k], -k), default=None
    )
    model, data = F.lit(model_name), F.lit(dataset)
    rows = result_rows(bundle, METRICS, "validation", model, data)
    if chosen is not None:
        scored_test = predict(test.withColumn("fold", F.lit(chosen)), models, key, "fold")
        tested = settle(evaluate(scored_test, ["fold"]))
        rows = concat_rows(rows, result_rows(tested, METRICS, "test", model, data))
    return ProbeResult(predictions, rows, chosen, models.get(chosen), models)
