"""Genome sequences cut into overlapping windows.

A sequence may come whole or in pieces, such as the lines of a FASTA file, and may be longer than a task can hold. Pieces
are dealt to blocks of some thousand windows by their offsets alone, each block is put together in a task
of its own, and windows are cut inside blocks. Letters are single bytes, so that cutting is a copy of a range and
not a walk from the start of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.config import WindowOptions


def pieces(df: DataFrame, key: str, sequence: str, length: int) -> DataFrame:
    """(key, start, sequence): each sequence cut into consecutive pieces of ``length`` letters; NULL and empty ones have none."""
    raw = F.col(sequence).cast("binary")
    rows = df.select(F.col(key), raw.alias("_raw")).where(F.octet_length("_raw") > 0)
    rows = rows.select(key, "_raw", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("_raw") - 1) / length).cast("int"))).alias("_no"))
    part = F.substring(F.col("_raw"), F.col("_no") * length + 1, F.lit(length)).cast("string")
    return rows.select(key, (F.col("_no").cast("bigint") * length).alias("start"), part.alias(sequence))


def n_windows(length: Column, options: WindowOptions) -> Column:
    """How many windows a sequence of ``length`` letters has; a rest that fills none is one more window if ``keep_rest``."""
    if options.keep_rest:
        count = F.ceil((length - max(options.width, options.stride)) / options.stride) + 1
    else:
        count = F.floor((length - options.width) / options.stride) + 1
    shortest = 1 if options.keep_rest else options.width
    return F.when(length < shortest, 0).when(length <= options.width, 1).otherwise(count).cast("bigint")


def window_counts(parts: DataFrame, key: str, sequence: str = "sequence", options: WindowOptions = WindowOptions()) -> DataFrame:
    """(key, length, n_windows) from the lengths of the pieces alone; no text moves."""
    lengths = parts.groupBy(key).agg(F.sum(F.coalesce(F.octet_length(sequence), F.lit(0)).cast("bigint")).alias("length"))
    return lengths.withColumn("n_windows", n_windows(F.col("length"), options))


def cut_windows(
    parts: DataFrame, key: str, sequence: str = "sequence", options: WindowOptions = WindowOptions()
) -> DataFrame:
    """(key, window, start, sequence_length, sequence) of the windows of every sequence, numbered from 0 per key. Runs a job.

    ``parts`` has (key, start, sequence): pieces that follow one another without gaps, in any order, of any size. Starts count from
    0. Consecutive windows are ``stride`` letters apart and ``width`` long, the last one shorter if ``keep_rest``. NULL and
    empty pieces add nothing. The rows are counted before the text moves, and the number of tasks follows that count.
    """
    width, stride, span = options.width, options.stride, options.windows_per_block * options.stride
    reach = (options.windows_per_block - 1) * stride + width  # letters that the windows of a block cover
    total = window_counts(parts, key, sequence, options).agg(F.sum("n_windows")).head()[0] or 0
    tasks = max(1, -(-total // options.windows_per_task))

    raw, start = F.col("_raw"), F.col("_start")
    end = start + F.octet_length(raw)
    rows = parts.select(F.col(key), F.col("start").cast("bigint").alias("_start"), F.col(sequence).cast("binary").alias("_raw"))
    rows = rows.where(F.octet_length("_raw") > 0)
    first = F.greatest(F.floor((start - reach) / span) + 1, F.lit(0)).cast("bigint")
    last = F.floor((end - 1) / span).cast("bigint")
    # strides beyond the width leave letters between blocks that no window reads
    dealt = rows.where(first <= last).select(key, "_start", "_raw", F.explode(F.sequence(first, last)).alias("_block"))
    low = F.greatest(start, F.col("_block") * span)
    high = F.least(end, F.col("_block") * span + reach)
    part = F.substring(raw, (low - start + 1).cast("int"), (high - low).cast("int")).cast("string")
    blocks = dealt.where(low < high).select(key, "_block", low.alias("_low"), part.alias("_part"))
    whole = F.expr("listagg(_part, '') WITHIN GROUP (ORDER BY _low)")
    blocks = blocks.repartition(tasks, key, "_block").groupBy(key, "_block").agg(whole.cast("binary").alias("_text"))
    # a window is there if the one before has not reached the end, and without the rest only if it is full
    size = F.octet_length("_text")
    if options.keep_rest:
        inside = F.ceil((size - max(width - stride, 0)) / stride)
        inside = F.when((F.col("_block") == 0) & (inside < 1), 1).otherwise(inside)
    else:
        inside = F.floor((size - width) / stride) + 1
    count = F.least(inside, F.lit(options.windows_per_block)).cast("int")
    built = blocks.withColumn("_count", count).where("_count > 0")
    cut = built.select(key, "_block", "_text", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_i"))
    window = (F.col("_block") * options.windows_per_block + F.col("_i")).cast("bigint")
    letters = F.substring(F.col("_text"), F.col("_i") * stride + 1, F.lit(width)).cast("string")
    return cut.select(key, window.alias("window"), (window * stride).alias("start"), letters.alias(sequence)).select(
        key, "window", "start", F.octet_length(sequence).alias("sequence_length"), sequence
    )
