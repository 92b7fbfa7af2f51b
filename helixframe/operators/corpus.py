"""Corpus preparation: tokenise, truncate, pad, mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helixframe.functions import fixed
from helixframe.functions.hashing import digits_to_int, unit_below
from helixframe.operators.ordering import assign_batches
from helixframe.session import settle

IGNORED_LABEL = -100


def kmer_vocab_size(k: int = 6) -> int:
    """Special tokens, all k-mers, single nucleotides."""
    return fixed.SPECIAL_COUNT + 4**k + 4


def kmer_tokens(sequence: Column, k: int = 6) -> Column:
    """Non-overlapping k-mers from the left.

    What does not fill a k-mer (the tail, and stretches cut short by another
    letter) becomes single letters. One regex pass, so linear in the sequence.
    """
    return F.regexp_extract_all(sequence, F.lit(f"(?s)[{fixed.NUCLEOTIDES}]{{{k}}}|."), F.lit(0))


def n_kmer_tokens(sequence: Column, k: int = 6) -> Column:
    """How many tokens ``kmer_tokens`` makes, without making them: all letters, less those that a k-mer saves."""
    return F.char_length(sequence) - (k - 1) * F.regexp_count(sequence, F.lit(f"[{fixed.NUCLEOTIDES}]{{{k}}}"))


def kmer_id(token: Column, k: int = 6) -> Column:
    """Id of a token: specials first, then k-mers in base-4 order, then single letters."""
    value = F.conv(F.translate(token, fixed.NUCLEOTIDES, "0123"), 4, 10).cast("int")
    single = F.instr(F.lit(fixed.NUCLEOTIDES), token)
    return (
        F.when(F.char_length(token) == k, F.lit(fixed.SPECIAL_COUNT) + value)
        .when(single > 0, F.lit(fixed.SPECIAL_COUNT + 4**k - 1) + single)
        .otherwise(F.lit(fixed.UNK))
        .cast("int")
    )


def kmer_ids(sequence: Column, k: int = 6) -> Column:
    return F.transform(kmer_tokens(sequence, k), lambda t: kmer_id(t, k))


def with_specials(ids: Column, max_length: int | None = None) -> Column:
    """Frame with the start and end token; truncation leaves room for both."""
    if max_length is not None:
        ids = F.slice(ids, F.lit(1), F.lit(max_length - 2))
    return F.concat(F.array(F.lit(fixed.CLS)), ids, F.array(F.lit(fixed.SEP)))


def tokenise(df: DataFrame, sequence: str = "sequence", k: int = 6, max_length: int | None = None) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``; the sequence column is dropped.

    Sequences keep all their tokens unless ``max_length`` asks for a cut.
    """
    ids = with_specials(kmer_ids(F.col(sequence), k), max_length)
    return (
        df.withColumn("input_ids", ids)
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
        .drop(sequence)
    )


def padded(ids: Column, length: Column | int, fill: int = fixed.PAD) -> Column:
    width = length if isinstance(length, Column) else F.lit(length)
    missing = F.greatest(F.lit(0), width - F.size(ids))
    return F.concat(ids, F.array_repeat(F.lit(fill), missing))


def pad(df: DataFrame, length: Column | int = 512) -> DataFrame:
    """Pad ids with the pad token and the mask with 0 up to ``length``."""
    return df.withColumns(
        {
            "input_ids": padded(F.col("input_ids"), length),
            "attention_mask": padded(F.col("attention_mask"), length, 0),
        }
    )


def pad_in_batches(df: DataFrame, key: str, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Consecutive batches in ``key`` order, each padded to its longest row.

    Batch numbers and widths are worked out on (key, row length) alone; the token
    arrays move once, in the final join on the key.
    """
    lengths = df.select(key, F.size("input_ids").alias("_length"))
    numbered = assign_batches(lengths, key, batch_size, drop_last)
    widths = numbered.select(
        key, "batch_id", F.max("_length").over(Window.partitionBy("batch_id")).alias("_width")
    )
    return pad(df.join(widths, key), F.col("_width")).drop("_width")


def tokenise_in_batches(
    df: DataFrame, key: str, batch_size: int, sequence: str = "sequence", k: int = 6, drop_last: bool = False
) -> DataFrame:
    """``tokenise`` and ``pad_in_batches`` in one: sequences move as letters, and are tokenised and padded where they arrive.

    Widths come from token counts alone; every sequence is tokenised once. Adds ``batch_id`` and ``n_tokens``. A
    NULL sequence has NULL ids, and a batch of such rows only has no width. Runs a job, which settles the widths.
    """
    lengths = df.select(key, (n_kmer_tokens(F.col(sequence), k) + 2).alias("n_tokens"))  # with both ends
    numbered = assign_batches(lengths, key, batch_size, drop_last)
    width = F.max("n_tokens").over(Window.partitionBy("batch_id")).alias("_width")
    widths = numbered.select(key, "batch_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), width)
    return pad(tokenise(df.join(settle(widths), key), sequence, k), F.col("_width")).drop("_width")


def mask_tokens(
    df: DataFrame,
    key: str,
    vocab_size: int,
    probability: float = 0.15,
    seed: int = 1,
    epoch: int = 0,
) -> DataFrame:
    """Masked-language-model inputs: masked ``input_ids`` and ``labels``.

    Of the chosen positions 80% become the mask token, 10% a random token and 10%
    stay. Labels hold the original id there and -100 elsewhere. Special tokens
    are never chosen. One hash per position gives all three draws.
    """

    def hashed(token: Column, i: Column) -> Column:
        text = F.concat(F.lit(f"mask:{seed}:{epoch}:"), F.col(key).cast("string"), F.lit(":"), i.cast("string"))
        return F.when(token >= fixed.SPECIAL_COUNT, F.md5(text))

    def shown(token: Column, h: Column) -> Column:
        drawn = (
            F.when(unit_below(h, 0.8, 9), F.lit(fixed.MASK))
            .when(unit_below(h, 0.9, 9), (digits_to_int(h, 17, 8) % vocab_size).cast("int"))
            .otherwise(token)
        )
        return F.when(unit_below(h, probability), drawn).otherwise(token)

    def label(token: Column, h: Column) -> Column:
        return F.when(unit_below(h, probability), token).otherwise(F.lit(IGNORED_LABEL))

    # a column of its own: the hashes are worked out once, special tokens have none
    hashes = df.withColumn("_hashes", F.transform("input_ids", hashed))
    return (
        hashes.withColumn("labels", F.zip_with("input_ids", "_hashes", label))
        .withColumn("input_ids", F.zip_with("input_ids", "_hashes", shown))
        .drop("_hashes")
    )


# --- batched Python mappers --------------------------------------------------


# The mappers below only refer to their own locals, so that they travel to the
# Python workers by value and the package need not be installed there.


def kmer_ids_batched(sequence: Column, k: int = 6) -> Column:
    """``kmer_ids`` as an Arrow-batched mapper.

    A batch's ids are one array of whole numbers, four bytes each, filled sequence by sequence.
    """
    letters, first_kmer, unknown = fixed.NUCLEOTIDES.encode(), fixed.SPECIAL_COUNT, fixed.UNK

    def encode(raw: bytes) -> np.ndarray:
        code = np.full(256, 4, dtype=np.int32)
        code[list(letters)] = range(4)
        found = np.frombuffer(raw, dtype=np.uint8)
        found = code[found[(found & 0xC0) != 0x80]]  # one place for each character
        at = np.arange(len(found), dtype=np.int32)
        known = found < 4
        # the start and the length of the stretch of nucleotides around each place
        start = np.maximum.accumulate(np.where(known, -1, at)) + 1
        end = np.minimum.accumulate(np.where(known, len(found), at)[::-1])[::-1]
        offset, filled = at - start, (end - start) // k * k
        inside = known & (offset < filled)
        heads = np.flatnonzero(inside & (offset % k == 0))
        ids = np.where(known, first_kmer + 4**k + found, unknown)
        ids[heads] = first_kmer
        for j in range(k):
            ids[heads] += found[heads + j] * 4 ** (k - 1 - j)
        inside[heads] = False
        return ids[~inside]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_batch(texts: pa.Array) -> pa.Array:
        most = sum(len(t.as_buffer()) for t in texts if t.is_valid)
        flat, ends, missing, n = np.empty(most, dtype=np.int32), [0], [], 0
        for text in texts:
            if text.is_valid:
                ids = encode(text.as_buffer())
                flat[n : n + len(ids)] = ids
                n += len(ids)
            missing.append(not text.is_valid)
            ends.append(n)
        made = pa.array(missing, pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[:n]), mask=made)

    return encode_batch(sequence)


def collate_batches(df: DataFrame, key: str, batch: str = "batch_id") -> DataFrame:
    """One row per batch with its padded id matrix: the shape a training loop reads.

    A batch has a fixed number of rows, so a group always fits one call.
    """

    fill = fixed.PAD

    def collate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        width = int(rows["input_ids"].map(len).max())
        matrix = np.full((len(rows), width), fill, dtype=np.int32)
        for line, ids in zip(matrix, rows["input_ids"], strict=True):
            line[: len(ids)] = ids
        return pd.DataFrame(
            {
                batch: [rows[batch].iloc[0]],
                "keys": [list(rows[key])],
                "width": [width],
                "input_ids": [list(matrix)],
            }
        )

    schema = f"{batch} bigint, keys array<bigint>, width int, input_ids array<array<int>>"
    return df.select(key, batch, "input_ids").groupBy(batch).applyInPandas(collate, schema)
