"""Pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the tokens on both of its sides; the sum of these conditional
log-probabilities scores the document. The network is small and trained in numpy: context embeddings,
weighted by place, add up to a hidden layer, and a softmax over word classes and over the words of a class gives
the token's probability. The vocabulary is counted over all documents; words outside it share one
place in the network, and which of them it was has its own probability, from the counts of all documents. All
positions train the network in rounds: every shard takes gradient steps from the
current network, and the mean of the shards, weighted by positions, is the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import textbytes
from helixframe.session import settle


@dataclass(frozen=True)
class Settings:
    classes: int = 64
    per_class: int = 64  # words of a class; the vocabulary has classes x per_class - 1 words and "other"
    side: int = 2  # context words on each side
    width: int = 16
    share: int = 1  # one of so many positions trains the network: 1 is all of them
    shard: int = 400_000  # training positions of a shard, about
    rounds: int = 3
    batch: int = 1_024
    rate: float = 0.25
    seed: int = 41

    @property
    def words(self) -> int:
        return self.classes * self.per_class


def _merged(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(words, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; a word is its 64-bit hash. Each task sends its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, counts = _merged(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            for at in range(0, len(words), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[part].view(np.int64)), pa.array(counts[part])], ["word", "n"]
                )

        for batch in batches:
            for _, data, bounds in textbytes.chunks(batch.column(0)):
                found = textbytes.find_words(data, bounds).hash
                if len(found):
                    held.append(np.unique(found, return_counts=True))
                    size += len(held[-1][0])
                if size > 1 << 21:
                    held[:] = [_merged(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield from flush()
                        held.clear()
                        size = 0
        if held:
            yield from flush()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Hashes in order, and the id of each; ids count down the frequencies, 0 is any other word.

    ``rest`` has (word, n) of the other words that were counted more than once, ``n_rest`` is the count of all others.
    """

    hashes: np.ndarray
    ids: np.ndarray
    size: int
    rest: DataFrame | None = None
    n_rest: int = 0

    def listed(self) -> Vocabulary:
        """What tasks need: without the table, which stays with the cluster."""
        return replace(self, rest=None)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[place] == words, self.ids[place], 0)


def vocabulary(docs: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> Vocabulary:
    """The most frequent words of all documents, ties by hash, and the counts of the others.

    Runs jobs. The list is bounded by the settings; the other words stay in a written table, however many.
    """
    counts = settle(word_counts(docs, text_col))
    top = counts.orderBy(F.desc("n"), "word").limit(settings.words - 1).collect()
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    rest = counts.where("false")
    if top:
        n, word = top[-1]["n"], top[-1]["word"]
        rest = counts.where((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > word))
    n_rest = rest.agg(F.sum("n")).first()[0] or 0
    return Vocabulary(hashes[order], order + 1, settings.words, rest.where("n > 1"), n_rest)


def _padded(words: textbytes.Words, vocab: Vocabulary, side: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places of the words in them): ``side`` ids ``vocab.size`` stand before, between and after the documents."""
    to = np.arange(len(words.hash)) + (np.repeat(np.arange(len(words.counts)), words.counts) + 1) * side
    ids = np.full(len(words.hash) + (len(words.counts) + 1) * side, vocab.size, dtype=kind)
    ids[to] = vocab.lookup(words.hash)
    return ids, to


def _around(ids: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    return np.stack([ids[at + k] for k in (*range(-side, 0), *range(1, side + 1))], axis=1)


def contexts(words: textbytes.Words, vocab: Vocabulary, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts) of the words at some places; beyond the document's ends stands ``vocab.size``."""
    ids, to = _padded(words, vocab, side, np.int64)
    return ids[to[at]], _around(ids, to[at], side)


class Network:
    """embed (words + 1, width), place (2 side, width), out (classes, per_class, width) with biases, and classes."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.s = s
        self.parts = {
            "embed": draw(s.words + 1, s.width),
            "place": np.ones((2 * s.side, s.width), dtype=np.float32),
            "hidden": np.zeros(s.width, dtype=np.float32),
            "out": draw(s.classes, s.per_class, s.width),
            "out_bias": np.zeros((s.classes, s.per_class), dtype=np.float32),
            "group": draw(s.classes, s.width),
            "group_bias": np.zeros(s.classes, dtype=np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for name, part in self.parts.items():
            self.parts[name] = flat[at : at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size
        return self

    def log_probs(self, targets: np.ndarray, around: np.ndarray) -> np.ndarray:
        """log P(class | context) + log P(word | class, context)."""
        p, s = self.parts, self.s
        placed = [p["embed"] * place for place in p["place"]]
        group, word = np.divmod(targets, s.per_class)
        order = np.argsort(group.astype(np.int16), kind="stable")  # 16 bits are sorted in linear time
        out = np.empty(len(targets))
        for at in range(0, len(order), s.batch):
            rows = order[at : at + s.batch]
            x = p["hidden"] + sum(np.take(e, around[rows, k], axis=0) for k, e in enumerate(placed))
            h = _tanh(x)
            logs = _picked(h @ p["group"].T + p["group_bias"], group[rows])
            ends = [0, *np.flatnonzero(np.diff(group[rows])) + 1, len(rows)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                c = group[rows[a]]
                logs[a:b] += _picked(h[a:b] @ p["out"][c].T + p["out_bias"][c], word[rows[a:b]])
            out[rows] = logs
        return out

    def train(self, targets: np.ndarray, around: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of Adagrad steps over the positions in random order."""
        steps = _Steps(self)
        group = (targets // self.s.per_class).astype(np.int16)
        order = rng.permutation(len(targets))
        for at in range(0, len(order), self.s.batch):
            rows = order[at : at + self.s.batch]
            counts = np.bincount(group[rows], minlength=self.s.classes)
            classes = np.argsort(-counts, kind="stable")
            rank = np.empty(self.s.classes, dtype=np.int16)
            rank[classes] = np.arange(self.s.classes)
            rows = rows[np.argsort(rank[group[rows]], kind="stable")]
            steps.step(targets[rows], np.take(around, rows, axis=0), classes, counts[classes])
        steps.write()


_TILE = 8


class _Steps:
    """Adagrad steps of a network. Its parts lie in one array, biases as a last column; so do gradients.

    A step takes the same sums as the formulas over single positions. Positions come ordered by their class, most
    frequent classes first: a class of more than ``_TILE`` positions is a product of its own, the others,
    filled up with rows of zeros, are products in one call.
    """

    def __init__(self, network: Network):
        self.network, self.s = network, network.s
        s, w = self.s, self.s.width
        shapes = [(s.words + 1, w), (s.classes, w + 1), (s.classes, s.per_class, w + 1), (2 * s.side, w), (w,)]
        ends = np.cumsum([0, *(int(np.prod(shape)) for shape in shapes)])
        parts = lambda flat: [flat[a : a + np.prod(x)].reshape(x) for a, x in zip(ends[:-1], shapes, strict=True)]
        self.values, self.grads, self.room = (np.zeros(ends[-1], dtype=np.float32) for _ in range(3))
        self.seen = np.full(ends[-1], 1e-2, dtype=np.float32)
        self.embed, self.group, self.out, self.place, self.hidden = parts(self.values)
        self.d_embed, self.d_group, self.d_out, self.d_place, self.d_hidden = parts(self.grads)
        for name, part in self._parts().items():
            part[...] = network.parts[name]
        # sums by context word: two numbers at a time, as one complex
        self.pair = np.complex64 if w % 2 == 0 else np.float32
        per = w * 4 // np.dtype(self.pair).itemsize
        self.cells = np.arange((s.words + 1) * per).reshape(s.words + 1, per)
        self.ones = np.ones(s.batch, dtype=np.float32)
        self.logits, self.errors = (
            np.empty((s.batch + s.classes * _TILE) * max(s.classes, s.per_class), dtype=np.float32) for _ in range(2)
        )

    def _parts(self) -> dict[str, np.ndarray]:
        w = self.s.width
        return {
            "embed": self.embed, "place": self.place, "hidden": self.hidden,
            "out": self.out[:, :, :w], "out_bias": self.out[:, :, w],
            "group": self.group[:, :w], "group_bias": self.group[:, w],
        }

    def write(self) -> None:
        self.network.parts |= {name: part.copy() for name, part in self._parts().items()}

    def _less_one(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Softmax of the rows of x, less one at the targets."""
        out = self.errors[: x.size].reshape(x.shape)
        with np.errstate(over="ignore"):
            sums = np.exp(x, out=out) @ np.ones(x.shape[1], dtype=np.float32)
        if not (sums.min() > 1e-30 and sums.max() < 1e30):
            np.exp(x - x.max(axis=1, keepdims=True), out=out)
            sums = out.sum(axis=1)
        out *= (1 / sums)[:, None]
        out.reshape(-1)[at] -= 1
        return out

    def step(self, targets: np.ndarray, around: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> None:
        s, w, n = self.s, self.s.width, len(targets)
        group, word = np.divmod(targets.astype(np.int64), s.per_class)
        around = around.T.astype(np.int64, order="C")
        own = np.take(self.embed, around, axis=0)
        x = own[0] * self.place[0]
        for k in range(1, len(own)):
            x += own[k] * self.place[k]
        x += self.hidden
        h = np.ones((n, w + 1), dtype=np.float32)
        h[:, :w] = x = _tanh(x)
        scaled = h * np.float32(1 / np.sqrt(n))

        logits = np.matmul(h, self.group.T, out=self.logits[: n * s.classes].reshape(n, s.classes))
        err = self._less_one(logits, np.arange(n) * s.classes + group)
        np.matmul(err.T, scaled, out=self.d_group)
        to_h = err @ self.group[:, :w]

        big, few = int((counts > _TILE).sum()), int(((counts > 0) & (counts <= _TILE)).sum())
        ends = np.cumsum(counts)
        first = ends - counts
        many = int(ends[big - 1]) if big else 0
        runs = list(zip(classes[:big].tolist(), first[:big].tolist(), ends[:big].tolist(), strict=True))
        small = slice(big, big + few)
        slots = np.arange(n)
        slots[many:] += np.repeat(many + np.arange(few) * _TILE - first[small], counts[small])
        logits = self.logits[: (many + few * _TILE) * s.per_class].reshape(-1, s.per_class)
        for c, a, b in runs:
            np.matmul(h[a:b], self.out[c].T, out=logits[a:b])
        weights = np.take(self.out, classes[small], axis=0)
        tiles = np.zeros((few * _TILE, w + 1), dtype=np.float32)
        tiles[slots[many:] - many] = h[many:]
        tiles = tiles.reshape(few, _TILE, w + 1)
        np.matmul(tiles, weights.transpose(0, 2, 1), out=logits[many:].reshape(few, _TILE, s.per_class))
        err = self._less_one(logits, slots * s.per_class + word)
        self.d_out[classes[big + few :]] = 0
        for c, a, b in runs:
            np.matmul(err[a:b].T, scaled[a:b], out=self.d_out[c])
            to_h[a:b] += err[a:b] @ self.out[c, :, :w]
        err = err[many:].reshape(few, _TILE, s.per_class)
        to_h[many:] += np.matmul(err, weights[:, :, :w]).reshape(-1, w)[slots[many:] - many]
        tiles *= np.float32(1 / np.sqrt(n))
        self.d_out[classes[small]] = np.matmul(err.transpose(0, 2, 1), tiles)

        to_h *= (1 - x * x) * np.float32(1 / np.sqrt(n))
        ones = self.ones[:n]
        np.matmul(ones, to_h, out=self.d_hidden)
        self.d_embed[...] = 0
        sums = self.d_embed.reshape(-1).view(self.pair)
        for k in range(len(own)):
            np.matmul(ones, own[k] * to_h, out=self.d_place[k])
            cells = np.take(self.cells, around[k], axis=0).reshape(-1)
            np.add.at(sums, cells, (to_h * self.place[k]).reshape(-1).view(self.pair))
        self._adagrad()

    def _adagrad(self) -> None:
        self.seen += np.multiply(self.grads, self.grads, out=self.room)
        np.sqrt(self.seen, out=self.room)
        np.divide(self.grads, self.room, out=self.room)
        self.room *= self.s.rate
        self.values -= self.room


def _tanh(x: np.ndarray) -> np.ndarray:
    """1 - 2 / (exp(2x) + 1), which takes less time than numpy's own."""
    y = np.exp(np.minimum(x, 40) * 2) + 1
    return 1 - 2 / y


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of each row at one place."""
    value = x[np.arange(len(at)), at]
    with np.errstate(over="ignore"):
        sums = np.exp(x) @ np.ones(x.shape[1], dtype=x.dtype)
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        top = x.max(axis=1)
        return value - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
    return value - np.log(sums)


def training_positions(docs: DataFrame, vocab: Vocabulary, text_col: str, s: Settings) -> DataFrame:
    """(n, ids, chosen): blocks of whole documents and how many of their positions train.

    ``ids`` are int16 bytes, ``s.side`` ids ``vocab.size`` before, between and after the documents; ``chosen`` has a bit
    per id. With a share above 1, which positions train is decided by a hash of the place and the words there, in
    every document alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab.listed())
    step = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in textbytes.chunks(batch.column(0)):
                words = textbytes.find_words(data, bounds)
                if not len(words.hash):
                    continue
                ids, to = _padded(words, shared.value, s.side, np.int16)
                chosen = np.zeros(len(ids), dtype=bool)
                doc = np.repeat(words.hash[np.minimum(words.first[:-1], len(words.hash) - 1)], words.counts)
                place = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts).astype(np.uint64)
                draw = textbytes.mix(words.hash + (place + np.uint64(1)) * step + doc * np.uint64(3))
                chosen[to] = draw % np.uint64(s.share) == 0
                columns = [pa.array([x], type=pa.binary()) for x in (ids.tobytes(), np.packbits(chosen).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([chosen.sum()], type=pa.int64()), *columns], ["n", "ids", "chosen"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n bigint, ids binary, chosen binary")


def _positions(blocks: list[tuple[bytes, bytes]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts) of the chosen positions of some blocks."""
    targets, around = [], []
    for raw, bits in blocks:
        ids = np.frombuffer(raw, dtype=np.int16)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(ids)))
        targets.append(ids[at])
        around.append(_around(ids, at, s.side))
    return np.concatenate(targets), np.concatenate(around)


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", settings: Settings = Settings()) -> Network:
    """Train by rounds of local steps and averaging. Runs a job per round; the network alone is fetched."""
    s = settings
    blocks = settle(training_positions(docs, vocab, text_col, s))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    network = Network(s)
    if not total:
        return network
    shards = blocks.coalesce(max(1, round(total / s.shard)))
    for number in range(s.rounds):
        start = docs.sparkSession.sparkContext.broadcast(network.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterator[pa.RecordBatch]:
            own = Network(s).load(start.value)
            held, n, done = [], 0, 0
            rng = np.random.default_rng(s.seed + number)
            for batch in batches:
                for size, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(block)
                    n += size
                    if n >= s.shard:  # memory stays bounded however large a shard is
                        own.train(*_positions(held, s), rng)
                        held, n, done = [], 0, done + n
            if n:
                own.train(*_positions(held, s), rng)
            if done + n:
                values = pa.array([own.flat()], type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([done + n], type=pa.int64()), values], ["n", "values"])

        trained = shards.mapInArrow(run, "n bigint, values array<float>").select("n", F.posexplode("values").alias("i", "value"))
        mean = (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")
        rows = trained.groupBy("i").agg(mean).toPandas()
        network.load(rows.sort_values("i")["value"].to_numpy())
    return network


def score(docs: DataFrame, vocab: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) of every row, over all its tokens.

    A word outside the vocabulary has P(other | context) times n / (n_rest + 1), n being its own count; what was
    never counted has the 1 that is left. The logs of the counts come by a join on the word. Runs a job.
    A text without words (or NULL) has no tokens, log_prob 0 and a NULL mean.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocab.listed(), network.flat()))
    s = network.s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        own = Network(s).load(flat)
        any_rest = np.log(known.n_rest + 1)
        for batch in batches:
            at = 0
            for _, data, bounds in textbytes.chunks(batch.column(1)):
                words = textbytes.find_words(data, bounds)
                targets, around = contexts(words, known, np.arange(len(words.hash)), s.side)
                other = targets == 0
                logs = own.log_probs(targets, around) - any_rest * other
                sums = np.add.reduceat(np.append(logs, 0.0), words.first[:-1]) * (words.counts > 0)
                ends = np.concatenate([[0], np.cumsum(other)])[words.first]
                others = pa.LargeListArray.from_arrays(ends, words.hash[other].view(np.int64)).cast(pa.list_(pa.int64()))
                ids = batch.column(0).slice(at, len(bounds) - 1)
                at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(words.counts, type=pa.int64()), pa.array(sums), others],
                    ["id", "n_tokens", "log_prob", "others"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, log_prob double, others array<bigint>")
    if vocab.rest is not None:  # ids may repeat or be NULL, so rows get numbers, fixed by the writing
        scored = settle(scored.withColumn("_row", F.monotonically_increasing_id()))
        words = scored.select("_row", F.explode("others").alias("word"))
        known_words = vocab.rest.select("word", F.log("n").alias("log_n"))
        more = words.join(known_words, "word").groupBy("_row").agg(F.sum("log_n").alias("more"))
        total = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
        scored = scored.select("_row", "id", "n_tokens", "log_prob").join(more, "_row", "left").withColumn("log_prob", total)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Count the vocabulary, train on the corpus itself, score every document of it."""
    vocab = vocabulary(docs, text_col, settings)
    return score(docs, vocab, train(docs, vocab, text_col, settings), id_col, text_col)
