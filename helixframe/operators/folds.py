"""Seeded k-fold assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.hashing import digest
from helixframe.operators.ordering import hash_block, row_index


def assign_folds(
    df: DataFrame, key: str, k: int = 10, seed: int = 123, by: Sequence[str] = (), name: str = "fold"
) -> DataFrame:
    """Fold 1..k in a seeded random order; sizes differ by at most one, larger first.

    ``by`` folds each dataset on its own.
    """
    hashed = df.withColumn("_hash", digest("fold", seed, *by, key))
    indexed = row_index(
        hashed,
        ["_hash", key],
        hash_block(F.col("_hash")),
        keys=by,
        name="_idx",
        total="_total",
        few_blocks=True,
    )
    size = F.floor(F.col("_total") / k)
    larger = F.col("_total") % k
    in_larger = larger * (size + 1)
    fold = F.when(
        F.col("_idx") < in_larger, F.floor(F.col("_idx") / (size + 1))
    ).otherwise(larger + F.floor((F.col("_idx") - in_larger) / F.greatest(size, F.lit(1))))
    return indexed.withColumn(name, (fold + 1).cast("int")).drop("_hash", "_idx", "_total")


def fold_train(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != k)


def fold_validation(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == k)
