"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A window of some words is the mean of the embeddings of all its character n-grams; a linear softmax
on that mean says toxic or not. Embeddings and softmax are trained jointly in numpy. Since words
share n-grams, a misspelt or inflected word that was never seen still gets most of its vector. A
document scores as its most toxic window, put through a logistic curve fitted on documents the
embeddings did not see.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.base import held_out, slices, training_rows

_WORD = re.compile(r"[^\s.,;:!?\"()\[\]|]+")
CACHE_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    per_class: int = 3_000  # labelled documents of each class that the model is fitted on, at most
    buckets: int = 1 << 16
    width: int = 8
    window: int = 2  # words; few, so that one bad word among many clean ones is not averaged away
    smallest: int = 3  # n-gram lengths
    largest: int = 5
    epochs: int = 3
    batch: int = 2_048  # windows
    rate: float = 0.4
    least: int = 4  # documents an n-gram must occur in to have a vector
    seed: int = 17


def ngram_buckets(word: str, s: Settings) -> list[int]:
    """Bucket of each character n-gram of ``<word>``."""
    padded = f"<{word}>".encode("utf-32-le", "surrogatepass")  # four bytes a character
    size, mask, crc = len(padded), s.buckets - 1, zlib.crc32
    return [
        crc(padded[at : at + 4 * n]) & mask
        for n in range(s.smallest, s.largest + 1)
        for at in range(0, max(4, size - 4 * n + 4), 4)
    ]


def window_starts(n_words: int, size: int) -> np.ndarray:
    """Windows follow one another; the last one may be shorter."""
    return np.arange(0, n_words, size)


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Concatenated ``range(start, stop)``."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Bags:
    """Windows of documents as bags of n-gram buckets, by way of their distinct words."""

    def __init__(self, texts: list[str], s: Settings):
        ids: dict[str, int] = {}
        words, first, owner = array("i"), array("q"), array("i")
        for doc, text in enumerate(texts):
            at = len(words)
            words.extend(ids.setdefault(w, len(ids)) for w in _WORD.findall(text.lower()))
            starts = window_starts(len(words) - at, s.window)
            first.frombytes((starts + at).astype(np.int64).tobytes())
            owner.frombytes(np.full(len(starts), doc, dtype=np.int32).tobytes())
        first.append(len(words))
        grams, gram_first = array("i"), array("q", [0])
        for word in ids:
            grams.extend(ngram_buckets(word, s))
            gram_first.append(len(grams))
        self.words, self.owner = np.frombuffer(words, dtype=np.int32), np.frombuffer(owner, dtype=np.int32)
        self.first, self.gram_first = np.frombuffer(first, dtype=np.int64), np.frombuffer(gram_first, dtype=np.int64)
        self.grams = np.frombuffer(grams, dtype=np.int32)
        self.documents = self._documents(s.buckets)

    def _documents(self, buckets: int) -> np.ndarray:
        """In how many documents each bucket occurs."""
        out = np.zeros(buckets, dtype=np.int64)
        of_window = np.diff(self.first)
        owner = np.repeat(self.owner, of_window)
        ends = np.flatnonzero(np.diff(owner, append=-1))
        for low, high in zip([0, *(ends[:-1] + 1)], ends + 1, strict=True) if len(owner) else ():
            own = np.unique(self.words[low:high])
            out[np.unique(self.grams[_ranges(self.gram_first[own], self.gram_first[own + 1])])] += 1
        return out

    def batch(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, sizes) of the n-grams of some windows, one after the other."""
        spans = _ranges(self.first[windows], self.first[windows + 1])
        words = self.words[spans]
        starts, stops = self.gram_first[words], self.gram_first[words + 1]
        per_word = np.concatenate([[0], np.cumsum(stops - starts)])
        bounds = np.concatenate([[0], np.cumsum(self.first[windows + 1] - self.first[windows])])
        return self.grams[_ranges(starts, stops)], np.diff(per_word[bounds])


class Network:
    """E (buckets x width) and the softmax's two weight rows, with Adagrad steps."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.table = rng.uniform(-1 / s.width, 1 / s.width, (s.buckets, s.width)).astype(np.float32)
        self.weight = np.zeros((2, s.width), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.seen = np.full((s.buckets, s.width), 1e-2, dtype=np.float32)
        self.seen_weight = np.full((2, s.width), 1e-2, dtype=np.float32)

    def means(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.table[buckets], starts, axis=0) / sizes[:, None]

    def odds(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of toxic."""
        return self.means(buckets, sizes) @ (self.weight[1] - self.weight[0]) + self.bias[1] - self.bias[0]

    def step(self, buckets: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        mean = self.means(buckets, sizes)
        logits = mean @ self.weight.T + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(toxic)), toxic] -= 1
        p *= (weight / weight.sum())[:, None]
        to_mean = (p @ self.weight) / sizes[:, None]
        spread = np.repeat(np.arange(len(sizes)), sizes)
        grad = np.empty_like(self.table)
        for k in range(self.s.width):
            grad[:, k] = np.bincount(buckets, weights=to_mean[spread, k], minlength=self.s.buckets)
        self.seen += (scaled := grad * len(sizes)) ** 2
        self.table -= self.s.rate * scaled / np.sqrt(self.seen)
        to_weight = p.T @ mean * len(sizes)
        self.seen_weight += to_weight**2
        self.weight -= self.s.rate * to_weight / np.sqrt(self.seen_weight)
        self.bias -= 0.1 * p.sum(axis=0)


@dataclass(frozen=True)
class Model:
    """The trained network folded to one number per bucket: its share of a window's log odds."""

    gram: np.ndarray
    bias: float
    slope: float
    offset: float
    settings: Settings


def fit(texts: list[str], toxic: np.ndarray, s: Settings) -> Model:
    """Train on four fifths of the documents, fit the final curve on the rest."""
    order = np.random.default_rng(s.seed).permutation(len(texts))
    kept, rest = order[len(order) // 5 :], order[: len(order) // 5]
    bags = Bags([texts[i] for i in kept], s)
    label = toxic[kept][bags.owner] if len(bags.owner) else np.zeros(0, dtype=np.int64)
    net, rng = Network(s), np.random.default_rng(s.seed + 1)
    rare = bags.documents < s.least
    net.table[rare] = 0
    for epoch in range(s.epochs):
        use = np.arange(len(label))
        if epoch:  # of a toxic document only the windows the network now finds toxic, at least one
            odds = np.concatenate([net.odds(*bags.batch(w)) for w in _pieces(use, 8 * s.batch)])
            best = np.full(len(kept), -np.inf)
            np.maximum.at(best, bags.owner, odds)
            use = np.flatnonzero((label == 0) | (odds > 0) | (odds >= best[bags.owner]))
        share = label[use].mean() if len(use) else 0.5
        weight = np.where(label == 1, 1 - share, share) + 1e-6
        for windows in _pieces(rng.permutation(use), s.batch):
            net.step(*bags.batch(windows), label[windows], weight[windows])
            net.table[rare] = 0
    gram = (net.table @ (net.weight[1] - net.weight[0])).astype(np.float32)
    model = Model(gram, float(net.bias[1] - net.bias[0]), 1.0, 0.0, s)
    scorer = Scorer(model)
    slope, offset = _curve(np.array([scorer.odds(texts[i]) for i in rest]), toxic[rest])
    return Model(gram, model.bias, slope, offset, s)


def _pieces(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression of y on x, classes weighing the same."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-6]) + 1e-9 * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (weight * (p - y)) + np.array([0.1 * w[0], 0.0]))
    return float(max(w[0], 1e-6) / scale), float(w[1] - max(w[0], 1e-6) * centre / scale)


class _Words(dict):
    """Place of each word in ``sums`` and ``sizes``, worked out when it is first asked for."""

    def __init__(self, model: Model):
        self.model = model
        self.sums, self.sizes = array("d"), array("d")

    def __missing__(self, word: str) -> int:
        buckets = ngram_buckets(word, self.model.settings)
        self.sums.append(float(self.model.gram[buckets].sum()))
        self.sizes.append(len(buckets))
        place = self[word] = len(self)
        return place


class Scorer:
    """Scores texts; remembers the n-gram sums of a bounded number of words between texts."""

    def __init__(self, model: Model):
        self.model = model
        self.known = _Words(model)

    def odds(self, text: str) -> float:
        words = _WORD.findall(text.lower())
        if not words:
            return self.model.bias
        if len(self.known) > CACHE_WORDS:
            self.known = _Words(self.model)
        places = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        starts = window_starts(len(words), self.model.settings.window)
        sums = np.add.reduceat(np.frombuffer(self.known.sums)[places], starts)
        sizes = np.add.reduceat(np.frombuffer(self.known.sizes)[places], starts)
        return float((sums / sizes).max() + self.model.bias)

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.odds(text or "") + self.model.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    settings: Settings = Settings(),
) -> Model:
    """Fit a model on at most ``settings.per_class`` labelled documents per class. Runs jobs.

    Without any labelled document of both classes the model scores every text below one half.
    """
    rows = training_rows(docs, labels, label, settings.per_class, id_col, text_col)
    sample = rows.orderBy("_hash", "_id", "text").select("text", "label").toPandas()
    toxic = sample["label"].to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, dtype=np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(settings.buckets, np.float32), -1.0, 1.0, 0.0, settings)
    return fit(sample["text"].tolist(), toxic, settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; NULL and empty texts score as a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            scores = pa.array([scorer.score(x) for x in batch.column(2).to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score below ``limit``, with all their columns, whatever they are called."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            keep = [scorer.score(x) < limit for x in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
