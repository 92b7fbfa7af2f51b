"""Projection, filtering, joining and reshaping of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.text import literal_map
from helixframe.operators.ordering import row_index, text_block, text_bounds
from helixframe.session import settle

# --- projection -------------------------------------------------------------


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def pack_columns(df: DataFrame, columns: Sequence[str], name: str = "vec") -> DataFrame:
    """Gather scalar columns into one double array, the in-memory form of a vector."""
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(columns)]
    return df.select(*rest, cells.alias(name))


def pack_matching(df: DataFrame, pattern: str, name: str = "vec") -> DataFrame:
    return pack_columns(df, columns_matching(df, pattern), name)


def pack_leading(df: DataFrame, count: int, name: str = "vec") -> DataFrame:
    """The first ``count`` columns, by position, as one vector."""
    return pack_columns(df, df.columns[:count], name)


def unpack_vector(df: DataFrame, vec: str, width: int, prefix: str = "v_") -> DataFrame:
    """One column per element: the layout of a vector file."""
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, *[F.get(vec, F.lit(i)).alias(f"{prefix}{i}") for i in range(width)])


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def map_codes(df: DataFrame, column: str, names: Mapping, name: str) -> DataFrame:
    """Translate codes by a short fixed map. An unknown code fails the job."""
    known = F.try_element_at(literal_map(names), F.col(column))
    message = F.concat(F.lit(f"no name for {column} = "), F.col(column).cast("string"))
    return df.withColumn(
        name,
        F.when(F.col(column).isNull() | known.isNotNull(), known).otherwise(
            F.raise_error(message).cast("string")
        ),
    )


def label_codes(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """0-based code of each text label in sorted order; NULL has none.

    The order is made over the distinct labels. They are settled in a job of their
    own, so the rows are joined to a table of known size and never sorted. A small
    hash-picked part of them is fetched first, to cut the order into even blocks.
    """
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    labels = settle(labels)
    coded = row_index(labels, [label], text_block(F.col(label), text_bounds(labels, label)), name=name, few_blocks=True)
    return df.join(settle(coded.withColumn(name, F.col(name).cast("int"))), label, "left")


# --- filters ----------------------------------------------------------------


def is_in(column: str, values: Sequence) -> Column:
    """Membership that is false, not NULL, for a NULL value."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def not_in(column: str, values: Sequence) -> Column:
    """The complement: a NULL value is kept."""
    return ~is_in(column, values)


def open_range(column: str, low, high) -> Column:
    return (F.col(column) > low) & (F.col(column) < high)


def clamp_negative(value: Column) -> Column:
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def level_order(column: str, levels: Sequence[str]) -> Column:
    """1-based place of a category among ``levels``; NULL outside them."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column))
    return F.nullif(place, F.lit(0).cast("bigint")).cast("int")


# --- joins ------------------------------------------------------------------


def left_join_nulls_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join in which a NULL key matches a NULL key."""
    right = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, same, "left").drop(*[f"_r_{k}" for k in keys])


def run_grid(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every (model, dataset) pair of two work lists; the product of the two is the feature."""
    return models.select("model").distinct().join(datasets.select("dataset").distinct(), how="cross")


def pending_runs(models: DataFrame, datasets: DataFrame, finished: DataFrame) -> DataFrame:
    """The grid without the runs that already have a result."""
    return run_grid(models, datasets).join(
        finished.select("model", "dataset").distinct(), ["model", "dataset"], "left_anti"
    )


def align_by_key(tables: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per key with one column per named table.

    Row position says nothing here, so tables are matched on ``key``. A key that
    is repeated in a table fails the job; one missing from a table gives NULL.
    """
    tagged = [df.select(F.col(key), F.lit(tag).alias("_tag"), F.col(value)) for tag, df in tables.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    return stack_columns(stacked, key, "_tag", value, list(tables))


def stack_columns(df: DataFrame, key: str, tag: str, value: str, tags: Sequence[str]) -> DataFrame:
    """Long (key, tag, value) to one column per tag; a repeated (key, tag) fails the job."""
    cells = []
    for t in tags:
        hit = F.col(tag) == t
        cells.append(
            F.when(F.count(F.when(hit, 1)) <= 1, F.max(F.when(hit, F.col(value))))
            .otherwise(
                F.raise_error(F.concat(F.lit(f"repeated {key} in {t}: "), F.first(key).cast("string"))).cast(
                    df.schema[value].dataType
                )
            )
            .alias(t)
        )
    return df.groupBy(key).agg(*cells)


# --- reshaping --------------------------------------------------------------


def concat_rows(*tables: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column that one table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def long_to_wide(
    df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Sequence[str]
) -> DataFrame:
    """Pivot with the column names given, so no job runs to find them."""
    return df.groupBy(*keys).pivot(name, list(columns)).agg(F.first(value, ignorenulls=True))


def wide_to_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "values"
) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def metrics_to_rows(df: DataFrame, keys: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """A map of metrics as one row per entry."""
    return df.select(*keys, F.explode(metrics).alias("metric", "score"))


def generalisation_gap(wide: DataFrame) -> DataFrame:
    return wide.withColumn("difference", F.col("test") - F.col("validation"))
