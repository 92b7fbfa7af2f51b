"""Importance resampling to a target distribution over hashed word n-grams.

Every feature (a run of one or two consecutive words) falls into a bucket. What a bucket gains is how much
likelier the target texts fill it than the corpus does, and a document's weight is the mean gain of its features.
Weights get seeded Gumbel noise, so taking the highest scores draws without replacement in proportion
to the weights.

The cutoff of the draw is found without sorting the corpus: a quantile sketch gives a bracket of scores, exact
counts of what lies above and inside validate it or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm import alnum, textbytes
from helixframe.operators.ordering import row_index
from helixframe.session import settle


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    least_words: int = 20  # documents with fewer are never drawn
    percent: int = 25  # of those with enough words
    seed: int = 7
    spare: float = 0.002  # first half width of the bracket, as a share of the ranks
    accuracy: int = 10_000  # of the quantile sketch


def _buckets(texts: pa.Array, n: int) -> Iterator[tuple[alnum.Spans, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, bucket of each word, left word of each pair, bucket of each pair) of chunks of whole documents."""
    for _, data, bounds in textbytes.chunks(texts):
        words = alnum.find_spans(data, bounds)
        crc = alnum.crc32_words(words)
        left, pairs = alnum.crc32_pairs(words, crc)
        yield words, crc % np.uint32(n), left, pairs % np.uint32(n)


def bucket_counts(texts: DataFrame, text_col: str, s: Settings) -> np.ndarray:
    """Features per bucket over all rows. Runs a job; every task sends each bucket once, the driver gets one row a bucket."""
    buckets = s.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, single, _, pair in _buckets(batch.column(0), buckets):
                total += np.bincount(single, minlength=buckets) + np.bincount(pair, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """floor(1000 ln ratio) of every bucket, with one feature added to each bucket of both sides."""
    of_corpus, of_target = float(corpus.sum() + s.buckets), float(target.sum() + s.buckets)
    ratio = ((target + 1).astype(float) * of_corpus) / ((corpus + 1).astype(float) * of_target)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, text_hash, n_words, n_features, weight) of every row; the gains go along as one array of fixed length."""
    buckets = s.buckets

    def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of, features, weights = [], [], []
            for words, single, left, pair in _buckets(batch.column(2), buckets):
                counts = words.counts
                n = np.where(counts > 0, 2 * counts - 1, 0)
                total = sums(gain[single], words.first) + sums(gain[pair], np.searchsorted(left, words.first))
                words_of.append(counts)
                features.append(n)
                weights.append(np.where(n > 0, total // np.maximum(n, 1), 0))
            if words_of:
                made = [pa.array(np.concatenate(x).astype(np.int64)) for x in (words_of, features, weights)]
                names = ["id", "text_hash", "n_words", "n_features", "weight"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 x a Gumbel draw) that depends on the seed and the id alone; a NULL id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def bracket(scored: DataFrame, wanted: int, rows: int, s: Settings) -> tuple[int, int, int]:
    """(low, high, above): scores with the ``wanted``-th highest between them, and how many rows lie above. Runs jobs.

    The sketch is only a guess. It is counted exactly what lies outside, and a bracket that misses the
    wanted rank is widened fourfold, in the end to all scores.
    """
    spare = s.spare
    while True:
        place = 1 - (wanted - 0.5) / rows
        shares = [max(0.0, place - spare), min(1.0, place + spare)]
        low, high = scored.agg(F.percentile_approx("score", shares, s.accuracy)).head()[0]
        if spare >= 1:
            low, high = scored.agg(F.min("score"), F.max("score")).head()
        over, inside = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).head()
        if over < wanted <= over + inside:
            return low, high, over
        spare *= 4


_ORDER = [F.desc, F.asc_nulls_last, F.asc_nulls_last]


def _order() -> list[Column]:
    return [f(c) for f, c in zip(_ORDER, ("score", "id", "text_hash"), strict=True)]


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the order of the draw, from 1.

    Scores are whole numbers in a range that logarithms bound (some 10^5 values whatever the corpus), so each
    is a block of its own: rows move to their score, and the counts per score give each its first place.
    """
    numbered = row_index(rows, _order(), -F.col("score"), name="rank", few_blocks=True)
    return numbered.withColumn("rank", F.col("rank") + 1)


def draw(scored: DataFrame, s: Settings) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the drawn rows, NULL for the rest. Runs jobs; ``scored`` is a settled table."""
    able = scored.where(F.col("n_words") >= s.least_words)
    rows = able.count()
    wanted = s.percent * rows // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    low, high, over = bracket(able, wanted, rows, s)
    inside = _ranked(able.where(F.col("score").between(low, high)).select("score", "id", "text_hash"))
    cutoff = inside.where(F.col("rank") == wanted - over).head()
    tied = F.col("score") == cutoff["score"]
    later_text = F.col("text_hash") > cutoff["text_hash"]
    if cutoff["id"] is None:
        later = F.col("id").isNull() & later_text
    else:
        later = F.col("id").isNull() | (F.col("id") > cutoff["id"]) | ((F.col("id") == cutoff["id"]) & later_text)
    taken = (F.col("n_words") >= s.least_words) & ((F.col("score") > cutoff["score"]) | (tied & ~F.coalesce(later, F.lit(False))))
    drawn = _ranked(scored.where(taken))
    # rows that repeat the cutoff's id and text are told apart by their place alone
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("bigint"))
    return drawn.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``.

    NULL and wordless texts have no features, weight 0 and are never drawn. Rows that repeat an id are
    ranked by a hash of their texts; a NULL id comes last among equal scores. Empty tables give empty
    results; without target texts every bucket counts one feature there. Runs jobs: two passes over the texts,
    then only numbers are read.
    """
    gain = gains(bucket_counts(docs, text_col, settings), bucket_counts(target, "text", settings), settings)
    weighed = weigh(docs, gain, id_col, text_col, settings)
    scored = settle(weighed.withColumn("score", F.col("weight") + noise("id", settings.seed)))
    return draw(scored, settings).drop("text_hash").withColumnRenamed("id", id_col)
