"""Byte-level BPE: encoding by ranked merges and decoding, for a rank file of a public tokenizer.

``encode`` folds the merges in Python tasks over the distinct words a task meets. ``encode_words``
is the form with Spark's higher-order functions over a literal rank map; it needs the distinct words
of all texts as a table, and joining their ids back to every occurrence moves many times the
input (figures in the README), so it serves tables of words, not whole corpora.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.base import slices

CACHE_WORDS = 400_000
LONG_WORD = 48  # bytes; longer ones merge by a heap, so that one huge word stays n log n


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """Rank of each token of a .tiktoken file; bounded by the vocabulary, read through Spark."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(a): int(b) for a, b in (r["value"].split() for r in lines if r["value"].strip())}


def _merge_short(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    get, none = ranks.get, len(ranks) + (1 << 30)
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
    return parts


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges by a heap of (rank, place) and links to the living neighbours."""
    n, token = len(parts), list(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if token[i] else n
        if j >= n or token[i] != a or token[j] != b:
            continue
        token[i], token[j] = a + b, b""
        right[i] = k = right[j]
        if k < n:
            left[k] = i
        for x, y in ((left[i], i), (i, k)):
            if x >= 0 and y < n and (r := ranks.get(token[x] + token[y])) is not None:
                heapq.heappush(heap, (r, x, token[x], token[y]))
    return [t for t in token if t]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank, leftmost first, is merged until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    merged = _merge_long(parts, ranks) if len(parts) > LONG_WORD else _merge_short(parts, ranks)
    return [ranks[t] for t in merged]


class _Known(dict):
    """Ids of the words met so far in this task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        ids = merge_word(word.encode(), self.ranks)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), _Known(ranks)

    def ids(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = _Known(self.ranks)
        words = self.pattern.findall(text or "")
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), dtype=np.int32)


class Decoder:
    """Token bytes laid end to end, so that a list of ids is one gather."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {i: t for t, i in ranks.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The ids' tokens joined; an id outside the vocabulary is an error."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all():
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1]) + np.repeat(self.first[ids] - (ends - size), size)].tobytes()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row, special tokens taken as plain text; NULL and empty texts have no ids.

    Every match of ``pattern`` is a word and is merged by itself. ``ranks`` is bounded by the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in slices(batches):
            flat, bounds = [], [0]
            for text in batch.column(1).to_pylist():
                own = encoder.ids(text)
                flat.append(own)
                bounds.append(bounds[-1] + len(own))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), type=pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` with the binary pieces of its ids joined; NULL ids decode to no bytes. All columns stay."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    place = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in slices(batches):
            column = batch.column(place)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            pieces = [decoder.bytes_of(flat[b - n : b]) for n, b in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, type=pa.binary())], names)

    names = [*tokens.columns, name]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields]
    return tokens.mapInArrow(run, ", ".join([*kinds, f"`{name}` binary"]))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and digest both: (id, n_tokens, ids_sha256, decoded_sha256)."""
    there_and_back = decode(encode(docs, ranks, pattern, id_col, text_col), ranks)
    return there_and_back.select(
        id_col,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _rank_map(ranks: dict[bytes, int], buckets: int) -> Column:
    """The ranks as one literal: an array of small maps, found by a hash of the token's hex."""
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        hexed = token.hex().upper()
        maps[int(hexed[-6:], 16) * 7919 % buckets][hexed] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = 1 << 14) -> DataFrame:
    """``words`` with the ids of each word, by folding ranked merges with higher-order functions only.

    A word is an array of hex pairs, one per byte. Each of at most length - 1 folds finds the pair of
    lowest rank and joins its first occurrence.
    """
    table = _rank_map(ranks, buckets)

    def rank(token: Column) -> Column:
        bucket = F.conv(F.substring(token, -6, 6), 16, 10).cast("bigint") * 7919 % buckets
        return F.element_at(F.element_at("_ranks", bucket.cast("int") + 1), token)

    def fold(parts: Column, _: Column) -> Column:
        tails = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(parts, 1, F.size(tails)), tails, lambda a, b: rank(F.concat(a, b)))
        at = F.array_position(pairs, F.array_min(pairs)).cast("int")
        joined = F.concat(
            F.slice(parts, 1, at - 1),
            F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))),
            F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))),
        )
        return F.when(F.coalesce(at, F.lit(0)) > 0, joined).otherwise(parts)

    hexed = F.hex(F.encode(F.col(word_col), "UTF-8"))
    split = F.transform(F.sequence(F.lit(1), (F.length("_hex") / 2).cast("int")), lambda i: F.substring(F.col("_hex"), (2 * i - 1).cast("int"), F.lit(2)))
    folds = F.sequence(F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(1)))
    merged = F.when(rank(F.col("_hex")).isNotNull(), F.array("_hex")).otherwise(F.aggregate(folds, F.col("_parts"), fold))
    return (
        words.where(F.length(word_col) > 0)
        .withColumn("_hex", hexed)
        .withColumn("_ranks", table)
        .withColumn("_parts", split)
        .withColumn("ids", F.transform(merged, rank))
        .drop("_hex", "_parts", "_ranks")
    )
