"""Ranked lexical search with range-maximum tables over posting lists.

One pass over the texts builds an index in shards of some thousand documents: for every term that a query asks
for, the documents that hold it, in order, with their counts. Counts over all shards give the weights; a posting's impact is
then a whole number. Each shard answers every query best first: an interval of documents is bounded by the sum of each
list's largest impact inside it, which a sparse table of maxima tells in two look-ups. The interval of the
highest bound is split at the document of its largest impact, until no bound reaches the
last of the best found. The best of the shards a task has seen go along to its next one, so later shards open few intervals.

Queries go in blocks of a bounded number of terms; texts are read once a block and never move.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm import alnum, textbytes
from helixframe.session import settle


@dataclass(frozen=True)
class Settings:
    best: int = 50  # results of a query
    length_percent: int = 50  # how much of a document's length counts
    saturation: int = 20
    shard_documents: int = 4_096
    shard_postings: int = 1 << 20
    leaf: int = 128  # documents of an interval that are scored without a further split
    shards_per_task: int = 4
    block_terms: int = 1_000_000  # terms of the queries that go along to the tasks at a time
    salts: int = 16  # parts in which a query's results are merged first


_NO_ID = np.iinfo(np.int64).max


# queries ------------------------------------------------------------------------------------------


@dataclass
class Queries:
    """A block of queries: item i has the terms ``terms[first[i]:first[i + 1]]``, places in the sorted ``words``."""

    ids: list
    first: np.ndarray
    terms: np.ndarray
    words: np.ndarray  # hashes

    @staticmethod
    def of(rows: list[tuple[int | None, list[int]]]) -> Queries:
        ids = [r[0] for r in rows]
        lists = [np.asarray(r[1], dtype=np.int64) for r in rows]
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        words, terms = np.unique(flat, return_inverse=True)
        return Queries(ids, first, terms.astype(np.int64), words)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): the distinct term hashes of every query, settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for _, data, bounds in textbytes.chunks(batch.column(1)):
                words = alnum.find_spans(data, bounds)
                hashes = alnum.hash_words(words)
                lists += [np.unique(hashes[a:b]) for a, b in zip(words.first, words.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["id", "terms"])

    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return settle(rows.mapInArrow(run, "id bigint, terms array<bigint>"))


def query_blocks(items: DataFrame, id_col: str, text_col: str, s: Settings) -> Iterator[Queries]:
    """The queries in blocks of about ``block_terms`` terms, one at a time on the driver."""
    terms = query_terms(items, id_col, text_col)
    blocks = -(-(terms.agg(F.sum(F.size("terms"))).head()[0] or 0) // s.block_terms)
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == block).collect()
        yield Queries.of(sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0], r[1])))


# index --------------------------------------------------------------------------------------------

_INDEX = "ids binary, lengths binary, terms array<int>, counts array<int>, documents binary, frequencies binary"


def shards(docs: DataFrame, words: np.ndarray, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """One row a shard: its documents by id, and for each term that ``words`` asks for the documents and counts. Settled.

    Only documents with a term are kept. ``lengths`` are all terms of a document, ``counts`` the postings of each
    of ``terms``. A shard is closed by its number of documents or postings, so memory is bounded by it or by one chunk of texts.
    """

    def postings(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lengths, document, term, frequency) of chunks of whole documents."""
        for _, data, bounds in textbytes.chunks(texts):
            found = alnum.find_spans(data, bounds)
            hashes = alnum.hash_words(found)
            place = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
            asked = np.flatnonzero(words[place] == hashes) if len(words) else np.zeros(0, np.int64)
            owner = np.searchsorted(found.first, asked, side="right") - 1
            cells, counts = np.unique(owner * len(words) + place[asked], return_counts=True)
            yield found.counts, cells // max(len(words), 1), cells % max(len(words), 1), counts

    def closed(held: list) -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(h[1]) for h in held)])
        ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        owner = np.concatenate([h[2] + at for h, at in zip(held, starts, strict=False)])
        term, frequency = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        kept = np.flatnonzero(lengths > 0)
        kept = kept[np.argsort(ids[kept], kind="stable")]
        place = np.zeros(len(ids), dtype=np.int64)
        place[kept] = np.arange(len(kept))
        order = np.lexsort((place[owner], term))
        names, counts = np.unique(term, return_counts=True)
        columns = [
            pa.array([ids[kept].astype(np.int64).tobytes()], pa.binary()),
            pa.array([lengths[kept].astype(np.int64).tobytes()], pa.binary()),
            pa.array([names.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([place[owner][order].astype(np.int32).tobytes()], pa.binary()),
            pa.array([frequency[order].astype(np.int32).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "counts", "documents", "frequencies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, cells = [], 0, 0
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            at = 0
            for lengths, owner, term, frequency in postings(batch.column(1)):
                held.append((ids[at : at + len(lengths)], lengths, owner, term, frequency))
                at, rows, cells = at + len(lengths), rows + len(lengths), cells + len(term)
                if rows >= s.shard_documents or cells >= s.shard_postings:
                    yield closed(held)
                    held, rows, cells = [], 0, 0
        if held:
            yield closed(held)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return settle(rows.mapInArrow(run, _INDEX))


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents: those with a term, all terms, and for each asked term the documents that hold it."""

    shards: int
    documents: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.floor(1000 * np.log((2 * self.documents + 2) / (2 * self.holding + 1))).astype(np.int64)


def corpus_counts(index: DataFrame, n_terms: int) -> Corpus:
    """Runs two jobs over the small columns of the index; the driver gets a row for each asked term."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column(0)]
            made = [pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["documents", "terms"])

    totals = index.select("lengths").mapInArrow(sums, "documents bigint, terms bigint")
    totals = totals.agg(F.count(F.lit(1)), F.sum("documents"), F.sum("terms")).head()
    cells = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    rows = cells.groupBy("c.terms").agg(F.sum("c.counts").alias("n")).toPandas()
    holding = np.zeros(n_terms, dtype=np.int64)
    holding[rows["terms"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return Corpus(totals[0], totals[1] or 0, totals[2] or 0, holding)


# search -------------------------------------------------------------------------------------------


class Shard:
    """Posting lists of some documents, one after the other, with a sparse table of where the largest impacts are."""

    def __init__(self, row: dict, corpus: Corpus, s: Settings):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        length = np.frombuffer(row["lengths"], dtype=np.int64)
        self.terms = np.asarray(row["terms"], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.asarray(row["counts"], dtype=np.int64))])
        self.documents = np.frombuffer(row["documents"], dtype=np.int32).astype(np.int64)
        frequency = np.frombuffer(row["frequencies"], dtype=np.int32).astype(np.int64)
        part = s.length_percent
        norm = 100 - part + (part * length * corpus.documents) // max(corpus.terms, 1)
        counts = np.diff(self.first)
        weight = np.repeat(corpus.weights()[self.terms], counts)
        self.impacts = weight * ((1_000_000_000 * frequency) // (1000 * frequency + s.saturation * norm[self.documents]))
        self.keys = np.repeat(np.arange(len(self.terms)), counts) * len(self.ids) + self.documents
        # row j, column p: the place of the largest impact among 2^j postings from p on
        n = len(self.documents)
        longest = int(counts.max()) if len(counts) else 0
        table = np.zeros((max(longest, 1).bit_length(), n), dtype=np.int32)
        table[0] = np.arange(n)
        for j in range(1, len(table)):
            half, full = 2 ** (j - 1), n - 2**j + 1
            a, b = table[j - 1, :full], table[j - 1, half : half + full]
            table[j, :full] = np.where(self.impacts[a] >= self.impacts[b], a, b)
        self.table = table.ravel()

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of the largest impact in each [low, high), none of them empty: two look-ups each."""
        level = np.frexp(high - low)[1] - 1
        row = level * len(self.documents)
        a, b = self.table[row + low], self.table[row + high - (1 << level)]
        x, y = self.impacts[a], self.impacts[b]
        return np.where(x >= y, a, b), np.maximum(x, y)

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Which lists are those of the terms; terms without one are left out."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return place[self.terms[place] == terms] if len(self.terms) else place[:0]

    def search(self, terms: np.ndarray, best: Best, leaf: int) -> None:
        """Adds to ``best`` what this shard has for a query."""
        lists = self.lists(terms)
        if not len(lists):
            return
        waiting: list = []

        def offer(start: int, stop: int, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            some = np.flatnonzero(low < high)
            if len(some):
                if len(some) < len(low):
                    lists, low, high = lists[some], low[some], high[some]
                place, top = self.maxima(low, high)
                # of equal bounds the first documents come first; start is different in all intervals
                if best.reachable(total := int(top.sum()), self.ids[start]):
                    split = int(self.documents[place[top.argmax()]])
                    heapq.heappush(waiting, (-total, start, stop, split, lists, low, high))

        offer(0, len(self.ids), lists, self.first[lists], self.first[lists + 1])
        while waiting:
            bound, start, stop, split, lists, low, high = heapq.heappop(waiting)
            if not best.reachable(-bound, self.ids[start]):
                if -bound < best.least:
                    return
                continue
            if stop - start <= leaf:
                sizes = high - low
                place = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                scores = np.zeros(stop - start, dtype=np.int64)
                np.add.at(scores, self.documents[place] - start, self.impacts[place])
                hit = np.flatnonzero(scores)
                best.add(self.ids[start + hit], scores[hit])
                continue
            # ``split`` lies in the interval, so in each list it falls between low and high
            middle = self.keys.searchsorted(lists * len(self.ids) + split)
            holds = self.keys[np.minimum(middle, len(self.keys) - 1)] == lists * len(self.ids) + split
            best.add(self.ids[split : split + 1], self.impacts[middle[holds]].sum()[None])
            offer(start, split, lists, low, middle)
            offer(split + 1, stop, lists, middle + holds, high)


class Best:
    """The ``n`` results of highest score, equal scores by ascending id."""

    def __init__(self, n: int):
        self.n, self.ids, self.scores = n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = 1, _NO_ID  # the score and id that a further result must come before

    def reachable(self, bound: int, first_id: int) -> bool:
        """Whether a document with this bound and an id of ``first_id`` or more can still come in."""
        return bound > self.least or (bound == self.least and first_id <= self.last)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        able = scores >= self.least
        if not able.any():
            return
        ids, scores = np.concatenate([self.ids, ids[able]]), np.concatenate([self.scores, scores[able]])
        order = np.lexsort((ids, -scores))[: self.n]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.n:
            self.least, self.last = int(self.scores[-1]), int(self.ids[-1])


def shard_results(index: DataFrame, queries: Queries, corpus: Corpus, s: Settings) -> DataFrame:
    """(item, doc_id, score): the best of each query among the shards that a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(s.best) for _ in queries.ids]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, corpus, s)
                for item, best in enumerate(found):
                    shard.search(queries.terms[queries.first[item] : queries.first[item + 1]], best, s.leaf)
        ids = np.concatenate([b.ids for b in found])
        columns = [
            pa.array(np.repeat(np.arange(len(found)), [len(b.ids) for b in found])),
            pa.array(ids, mask=ids == _NO_ID),
            pa.array(np.concatenate([b.scores for b in found])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    spread = index.repartition(max(1, -(-corpus.shards // s.shards_per_task)))  # files would put too many in a task
    return spread.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """(item, rank, id, score): the best documents of every row of ``items`` by score, equal ones by ascending id. Runs jobs.

    Ids are whole numbers. Rows of ``docs`` that repeat an id are ranked each for itself, a row without an id comes last
    among equal scores. Every row of ``items`` is a query, repeated ones too; NULL or wordless texts, on either side, have no
    results. Terms are told apart by 64-bit hashes.
    """
    s, out = settings, None
    for queries in query_blocks(items, item_col, item_text, s):
        index = shards(docs, queries.words, id_col, text_col, s)
        corpus = corpus_counts(index, len(queries.words))
        rows = settle(shard_results(index, queries, corpus, s))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id"), F.lit(s.salts)).alias("_part")
        few = rows.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order)))
        few = few.where(F.col("rank") <= s.best).drop("rank", "_part")
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= s.best)
        names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), "item bigint, name bigint")
        block = ranked.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
        out = block if out is None else out.unionByName(block)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{item_col} bigint, rank int, {id_col} bigint, score bigint")
    return out
