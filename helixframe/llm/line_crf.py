"""Document quality from a linear-chain conditional random field over its lines.

Every line gets the label good or bad. A line is described by its own features and those of the
lines before and after it; transitions tie neighbouring labels together. Forward-backward gives the
probability that each line is good, and the mean of these weighted by line length is the
document's quality. Training lines take the label of their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import textbytes
from helixframe.llm.base import held_out, training_rows


@dataclass(frozen=True)
class Settings:
    per_class: int = 3_000  # labelled documents of each class that the field is fitted on, at most
    chain: int = 48  # lines of a training chain; longer documents train as several chains
    steps: int = 150
    rate: float = 0.15
    ridge: float = 1e-3
    seed: int = 23


_CLASS = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 non-ASCII
_CLASS[33:127] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
OWN = 14  # features of one line
WIDE = 3 * OWN + 3  # with its neighbours, bias, and whether it is the first or last line


@dataclass
class Lines:
    """Features and character counts of all lines of some documents."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray  # lines of document i are [first[i], first[i + 1])


def _sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[stop] - total[start]


def line_features(data: np.ndarray, bounds: np.ndarray) -> Lines:
    """Split documents at newlines and describe each line; an empty document is one empty line."""
    newline = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], newline + 1]))
    stop = np.sort(np.concatenate([newline, bounds[1:]]))
    first = np.searchsorted(newline, bounds) + np.arange(len(bounds))
    kind = _CLASS[data]
    characters = _sums((data & 0xC0) != 0x80, start, stop)
    words = textbytes.find_words(data, bounds)
    word_from, word_to = np.searchsorted(words.start, start), np.searchsorted(words.start, stop)
    n_words = (word_to - word_from).astype(np.float64)
    w = np.maximum(n_words, 1)
    line_of = np.repeat(np.arange(len(start)), word_to - word_from)
    hashes = words.hash  # every word lies in exactly one line, so words and lines come in the same order
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    pairs = np.unique((line_of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=len(start))
    last = np.append(kind, 0)[words.end - 1]
    before_last = np.append(kind, 0)[np.maximum(words.end - 2, words.start)]
    marked = (last == 5) | ((last == 4) & (before_last == 4))
    single = (words.end - words.start == 1) & (last >= 4) & (last < 6)
    per_word = lambda x: np.bincount(line_of, weights=x, minlength=len(start)) / w
    size = np.maximum(stop - start, 1)
    share = lambda k: _sums(kind == k, start, stop) / size
    upper, lower = share(2), share(1)
    end = np.where(stop > start, np.append(kind, 0)[np.maximum(stop - 1, 0)], 0)
    features = np.stack(
        [
            np.log1p(characters) / 5,
            np.log1p(n_words) / 4,
            (n_words == 0).astype(np.float64),
            upper / np.maximum(upper + lower, 1e-9),
            lower,
            share(3),
            share(4),
            np.minimum(share(5) * 5, 1),
            share(6),
            per_word(same),
            1 - distinct / w,
            per_word(marked.astype(np.float64)),
            per_word(single.astype(np.float64)),
            (end == 4).astype(np.float64),
        ],
        axis=1,
    )
    return Lines(features, characters, first)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, those of the line before and after (0 at the ends), bias and end marks."""
    own, n = lines.features, len(lines.features)
    is_first, is_last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    is_first[lines.first[:-1]] = True
    is_last[lines.first[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[is_first] = 0
    after[is_last] = 0
    return np.concatenate([own, before, after, np.ones((n, 1)), is_first[:, None], is_last[:, None]], axis=1)


def marginals(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains ``[first[i], first[i + 1])`` side by side.

    ``emit`` is (lines, 2) and ``move`` (2, 2), both in logs. Returns the probabilities of both labels
    per line, the expected transition counts and the summed log normaliser.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
    forward, scale = np.zeros_like(emit), np.zeros(len(emit))
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        if t:
            prior = forward[at - 1]
            x = np.logaddexp(prior[:, :1] + move[0], prior[:, 1:] + move[1]) + emit[at]
        else:
            x = emit[at]
        scale[at] = z = np.logaddexp(x[:, 0], x[:, 1])
        forward[at] = x - z[:, None]
    back = np.zeros_like(emit)
    moves = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        x = emit[at + 1] + back[at + 1] - scale[at + 1][:, None]
        both = forward[at][:, :, None] + move[None] + x[:, None, :]
        moves += np.exp(both).sum(axis=0)
        back[at] = np.logaddexp(move[:, 0] + x[:, :1], move[:, 1] + x[:, 1:])
    return np.exp(forward + back), moves, float(scale.sum())


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # (WIDE, 2)
    move: np.ndarray  # (2, 2)


def fit(texts: list[str], good: np.ndarray, s: Settings) -> Model:
    """Gradient ascent (Adam) on the conditional log-likelihood of the line labels."""
    xs, ys, sizes = [], [], [0]
    for at, data, bounds in textbytes.chunks(pa.array(texts, type=pa.large_string())):
        lines = line_features(data, bounds)
        n = np.diff(lines.first)
        xs.append(with_neighbours(lines))
        ys.append(np.repeat(good[at : at + len(n)], n))
        for k in n:
            sizes += [s.chain] * (int(k) // s.chain) + ([int(k) % s.chain] if k % s.chain else [])
    x, y, first = np.concatenate(xs), np.concatenate(ys).astype(np.int64), np.cumsum(sizes)
    hot = np.eye(2)[y]
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1]] = False
    inside = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inside - 1], y[inside]), 1)
    weight, move = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    state = [np.zeros_like(p) for p in (weight, weight, move, move)]
    for step in range(1, s.steps + 1):
        p, moves, _ = marginals(x @ weight, move, first)
        grads = (x.T @ (hot - p) / len(y) - s.ridge * weight, (seen - moves) / len(y) - s.ridge * move)
        for i, (value, grad) in enumerate(zip((weight, move), grads, strict=True)):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * grad
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * grad**2
            m, v = state[2 * i] / (1 - 0.9**step), state[2 * i + 1] / (1 - 0.99**step)
            value += s.rate * m / (np.sqrt(v) + 1e-8)
    return Model(weight, move)


def document_quality(texts: pa.Array, model: Model) -> np.ndarray:
    """Length-weighted mean probability of the label good; a line weighs its characters plus one."""
    out = []
    for _, data, bounds in textbytes.chunks(texts):
        lines = line_features(data, bounds)
        p, _, _ = marginals(with_neighbours(lines) @ model.weight, model.move, lines.first)
        weight = lines.length + 1
        out.append(np.add.reduceat(p[:, 1] * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1]))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    settings: Settings = Settings(),
) -> Model:
    """Fit a field on at most ``settings.per_class`` labelled documents per class. Runs jobs.

    Without labelled documents of both classes every line is as likely good as bad.
    """
    rows = training_rows(docs, labels, label, settings.per_class, id_col, text_col)
    sample = rows.orderBy("_hash", "_id", "text").select("text", "label").toPandas()
    good = sample["label"].to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, dtype=np.int64)
    if len(set(good.tolist())) < 2:
        return Model(np.zeros((WIDE, 2)), np.zeros((2, 2)))
    return fit(sample["text"].tolist(), good, settings)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.3
) -> DataFrame:
    """(id, held_out, score, predicted) of every row; NULL and empty texts are one empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(document_quality(batch.column(2), model), type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )
