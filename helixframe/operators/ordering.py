"""Exact row numbers, running values and batches without one-task windows.

A window over a whole table, or over one very large key, sorts all its rows in
one task. The functions here cut the order into *blocks*: a block is a column
that never decreases along the order and that bounds how many rows share it.
Windows run inside (keys, block); what a block needs from earlier ones comes
from a small table with one row per (keys, block). Blocks are pure functions of
the row, so a recomputed task always lands in the same block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions.hashing import digest, digits_to_int
from helixframe.session import settle

BLOCK = "_block"
_GROUP_MASK = (1 << 20) - 1


def int_block(order: str, bits: int = 20) -> Column:
    """Block of a whole-number order column without repeats: at most 2^bits rows each."""
    return F.shiftright(F.col(order).cast("bigint"), bits)


def hash_block(hex_text: Column, digits: int = 4) -> Column:
    """Block of a hash order: 16^digits blocks of near-equal size."""
    return digits_to_int(hex_text, 1, digits)


def text_bounds(values: DataFrame, column: str, blocks: int = 1024) -> list:
    """Values that cut the order of a column of distinct values into blocks of near-equal size.

    Those of least hash, so it does not matter what the values have in common. Runs a job that
    fetches ``blocks`` - 1 values at most.
    """
    picked = values.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column), column).limit(blocks - 1)
    return [r[0] for r in picked.orderBy(column).collect()]


def text_block(value: Column, bounds: Sequence) -> Column:
    """Block of an order: how many of the sorted ``bounds`` are at most the value.

    A coarse look at every 32nd bound, then a fine one among the next 32.
    """
    if not bounds:
        return F.lit(0).cast("bigint")
    step = 32
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    fine = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    group = F.size(F.filter(coarse, lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda b: b <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside).cast("bigint")


def with_carry(df: DataFrame, keys: Sequence[str], carried: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Add columns that sum up all earlier blocks of the key; NULL in the first block.

    Each entry names a column and gives its per-block aggregate and how those add up
    over blocks: "max", "sum" or "last" (of values that are never NULL). Runs a job: ``df``
    is read once to settle the block table, however often the result goes on to be used.
    The join is on (keys, block), the partitioning that windows inside blocks already
    have, so it adds no shuffle of ``df``. Sparse orders may have as many blocks as rows,
    so blocks are added up inside groups of 2^20 and those groups among themselves.
    """
    parts = [part.alias(f"_part_{name}") for name, (part, _) in carried.items()]
    blocks = settle(df.groupBy(*keys, BLOCK).agg(*parts)).withColumn("_group", _group_of_blocks())
    past = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_group").orderBy(BLOCK).rowsBetween(*past)
    across = Window.partitionBy(*keys).orderBy("_group").rowsBetween(*past)
    ends = blocks.groupBy(*keys, "_group").agg(
        *[
            (F.max_by(f"_part_{name}", BLOCK) if how == "last" else _RUNNING[how](f"_part_{name}")).alias(f"_end_{name}")
            for name, (_, how) in carried.items()
        ]
    )
    before = ends.select(
        *keys, "_group", *[_RUNNING[how](f"_end_{name}").over(across).alias(f"_far_{name}") for name, (_, how) in carried.items()]
    )
    near = blocks.select(
        *keys, BLOCK, "_group", *[_RUNNING[how](f"_part_{name}").over(inside).alias(f"_near_{name}") for name, (_, how) in carried.items()]
    )
    both = near.join(before, [*keys, "_group"]).select(
        *keys, BLOCK, *[_MERGED[how](F.col(f"_near_{name}"), F.col(f"_far_{name}")).alias(name) for name, (_, how) in carried.items()]
    )
    return df.join(both, [*keys, BLOCK])


def _group_of_blocks() -> Column:
    return F.col(BLOCK).bitwiseAND(~_GROUP_MASK)


_RUNNING = {"max": F.max, "sum": F.sum, "last": F.last}
_MERGED = {
    "max": lambda near, far: F.greatest(near, far),
    "sum": lambda near, far: F.coalesce(near + far, near, far),
    "last": lambda near, far: F.coalesce(near, far),
}


def _block_offsets(
    counts: DataFrame, keys: Sequence[str], total: str | None, few_blocks: bool, levels: int = 2
) -> DataFrame:
    """Rows of the key in earlier blocks, as (keys, block, _offset).

    A ``few_blocks`` order has at most some ten thousand blocks per key, which one
    window adds up. Otherwise blocks are added up inside groups of 2^20 blocks and
    those groups among themselves: for blocks of 2^20 ids the second window sees
    at most 2^24 groups however sparse 64-bit ids are. Smaller blocks need a third of
    the ``levels``, groups of groups, for that.
    """
    whole = Window.partitionBy(*keys)
    past = (Window.unboundedPreceding, -1)
    if few_blocks or levels == 1:
        added = counts.withColumn("_offset", _sum_or_zero("_n", whole.orderBy(BLOCK).rowsBetween(*past)))
        return (added.withColumn(total, F.sum("_n").over(whole)) if total else added).drop("_n")
    grouped = counts.withColumn("_group", _group_of_blocks())
    inside = Window.partitionBy(*keys, "_group").orderBy(BLOCK).rowsBetween(*past)
    groups = grouped.groupBy(*keys, F.shiftright("_group", 20).alias(BLOCK)).agg(F.sum("_n").alias("_n"))
    groups = _block_offsets(groups, keys, total, False, levels - 1)
    groups = groups.withColumn("_group", F.shiftleft(BLOCK, 20)).withColumnRenamed("_offset", "_before").drop(BLOCK)
    return (
        grouped.withColumn("_inside", _sum_or_zero("_n", inside))
        .join(groups, [*keys, "_group"])
        .withColumn("_offset", F.col("_before") + F.col("_inside"))
        .drop("_n", "_group", "_before", "_inside")
    )


def _sum_or_zero(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def row_index(
    df: DataFrame,
    order: Sequence[str | Column],
    block: Column,
    keys: Sequence[str] = (),
    name: str = "row_idx",
    total: str | None = None,
    few_blocks: bool = False,
    settled: bool = False,
    levels: int = 2,
) -> DataFrame:
    """Exact 0-based position in ``order``, per ``keys`` or over the whole table.

    ``total`` also adds the row count of the key; ``few_blocks`` says that ``block``
    is a hash block. Rows move once, to their (keys, block); everything else
    happens on block counts, added up in ``levels`` (see ``_block_offsets``). ``settled`` runs a job for those counts, so that a result
    which is read several times does not count its rows again each time.
    """
    blocked = df.withColumn(BLOCK, block)
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    if settled:
        counts = settle(counts)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (
        blocked.withColumn("_local", F.row_number().over(inside) - 1)
        .join(_block_offsets(counts, keys, total, few_blocks, levels), [*keys, BLOCK])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop(BLOCK, "_local", "_offset")
    )


def previous_value(
    df: DataFrame,
    value: str,
    order: str,
    keys: Sequence[str],
    block_bits: int = 20,
    name: str = "previous",
) -> DataFrame:
    """Value of the row before in ``order`` within ``keys``; NULL for the first. Runs a job, see ``with_carry``."""
    blocked = df.withColumn(BLOCK, int_block(order, block_bits))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    local = blocked.withColumn("_lag", F.lag(F.struct(value)).over(inside))
    last = F.max_by(F.struct(value), F.col(order))
    carried = with_carry(local, keys, {"_carry": (last, "last")})
    return carried.withColumn(
        name, F.coalesce(F.col("_lag"), F.col("_carry"))[value]
    ).drop(BLOCK, "_lag", "_carry")


def shuffled_index(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """Position of every row in a seeded random order of the whole table."""
    hashed = df.withColumn("_hash", digest("shuffle", seed, key))
    return row_index(hashed, ["_hash", key], hash_block(F.col("_hash")), name=name, few_blocks=True).drop("_hash")


def _levels(block_bits: int) -> int:
    return 2 if block_bits >= 20 else 3


def buffered_shuffle(
    df: DataFrame, key: str, buffer: int, seed: int, block_bits: int = 8, name: str = "position"
) -> DataFrame:
    """Random order inside consecutive buffers of ``buffer`` rows (in ``key`` order)."""
    indexed = row_index(df, [key], int_block(key, block_bits), name="_idx", levels=_levels(block_bits))
    hashed = indexed.withColumn("_buffer", F.floor(F.col("_idx") / buffer)).withColumn(
        "_hash", digest("shuffle", seed, key)
    )
    inside = Window.partitionBy("_buffer").orderBy("_hash", key)
    return hashed.withColumn(
        name, F.col("_buffer") * buffer + F.row_number().over(inside) - 1
    ).drop("_idx", "_buffer", "_hash")


def assign_batches(
    df: DataFrame,
    order: str,
    batch_size: int,
    drop_last: bool = False,
    block_bits: int = 8,
    name: str = "batch_id",
) -> DataFrame:
    """Consecutive batches in ``order``; ``drop_last`` leaves out a short final one.

    Whole rows move to their block, so blocks are small: rows may hold texts or arrays.
    """
    block = int_block(order, block_bits)
    indexed = row_index(df, [order], block, name="_idx", total="_total", levels=_levels(block_bits))
    out = indexed.withColumn(name, F.floor(F.col("_idx") / batch_size).cast("bigint"))
    if drop_last:
        out = out.where(F.col(name) < F.floor(F.col("_total") / batch_size))
    return out.drop("_idx", "_total")


def cap_batches(df: DataFrame, cap: int, batch: str = "batch_id") -> DataFrame:
    """Keep batches 0..cap, so cap + 1 of them; a cap of 0 or less keeps all."""
    return df if cap <= 0 else df.where(F.col(batch) <= cap)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows of a stated order (a distributed top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)
