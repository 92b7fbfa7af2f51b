"""Grouped statistics for score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.operators.tables import left_join_nulls_match
from helixframe.session import settle


def strict(value: str, result: Column) -> Column:
    """NULL as soon as the group holds a NULL; Spark's own aggregates skip them."""
    return F.when(F.count(F.col(value)) == F.count(F.lit(1)), result)


def grouped_mean(
    df: DataFrame, keys: Sequence[str], value: str = "score", name: str = "avg_score"
) -> DataFrame:
    return df.groupBy(*keys).agg(strict(value, F.avg(value)).alias(name))


def mean_and_error(df: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Mean and standard error with the bounds of its error bar.

    The error of a single row is NULL.
    """
    mean = strict(value, F.avg(value))
    error = strict(value, F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)).cast("double")))
    out = df.groupBy(*keys).agg(mean.alias("score_mean"), error.alias("se"))
    return out.withColumn("ymin", F.col("score_mean") - F.col("se")).withColumn(
        "ymax", F.col("score_mean") + F.col("se")
    )


def group_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values of each column, long.

    Each (column, value) pair is made distinct before it is counted, so the plan
    is a plain two-step aggregation instead of one expanded row set per column. 0.0
    and -0.0 are one value.
    """
    real = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    value = lambda c: (F.col(c) + F.lit(0.0) if c in real else F.col(c)).cast("string")
    cells = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]
            )
        )
    )
    return (
        cells.where(F.col("value").isNotNull())
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


_COARSE = 1e4
_PARTS = 4096
_BIN_ROWS = 1 << 16


def _coarse_bin(x: Column) -> Column:
    """Bins of even relative width, 1e-4, over the whole double range down to its smallest value."""
    place = F.when(x == 0.0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 745.0))
    return F.floor(place * _COARSE)


def _count_below(keys: Sequence[str], bin_name: str) -> Column:
    """Rows of the key in the bins before this one."""
    along = Window.partitionBy(*keys).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("n").over(along) - F.col("n")


def _targets_inside(targets: Column) -> Column:
    """Wanted ranks that fall into this bin, counted from its start."""
    below, above = F.col("below"), F.col("below") + F.col("n")
    return F.transform(
        F.filter(targets, lambda t: (t["rank"] >= below) & (t["rank"] < above)),
        lambda t: t.withField("rank", t["rank"] - below),
    )


def _cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(_key, x) with NULL and NaN values left out.

    The keys travel as one struct, in which NULL equals NULL, so that joins keep
    groups whose key is NULL.
    """
    return df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    )


def _place(p: float) -> Column:
    """Place of a quantile among the 0-based ranks of its group."""
    return (F.col("total") - 1) * F.lit(float(p))


def _coarse_bins(cells: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Rows, smallest and largest value of each occupied bin, and the wanted ranks (``targets``) in it."""
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank"))
            for i, p in enumerate(probabilities)
            for side, rank in ((0, F.floor(_place(p))), (1, F.ceil(_place(p))))
        ]
    )
    return (
        cells.groupBy("_key", _coarse_bin(F.col("x")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .withColumn("below", _count_below(["_key"], "bin"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("_key")))
        .withColumn("targets", _targets_inside(wanted))
        .drop("below")
    )


def _values_of(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """The distinct values of the given bins with their counts; a bin of one value needs no look at the rows."""
    known = bins.where("lo = hi").select("_key", "bin", F.col("lo").alias("x"), "n")
    read = (
        cells.withColumn("bin", _coarse_bin(F.col("x")))
        .join(bins.where("lo < hi").select("_key", "bin"), ["_key", "bin"])
        .groupBy("_key", "bin", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return known.unionByName(read)


def _ranked_values(near: DataFrame, bins: DataFrame, probabilities: Sequence[float], bin_rows: int) -> DataFrame:
    """(_key, total, p0, p1, ...) from settled bins with targets and the settled values of those bins.

    Bins with more than ``bin_rows`` rows and two values or more are cut into even parts between their
    smallest and largest value, as often as it takes; a part is then put in order by one window.
    A job per round; no round is needed where no bin is that full.
    """
    near = near.withColumn("bin", F.array("bin"))
    bins = bins.where(F.size("targets") > 0).withColumn("bin", F.array("bin"))
    while not bins.where((F.col("n") > bin_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
        share = F.when(F.col("lo") < F.col("hi"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        parted = near.join(bins.select("_key", "bin", "lo", "hi"), ["_key", "bin"]).select(
            "_key", "bin", F.concat("bin", F.array(F.floor(share * _PARTS))).alias("part"), "x", "n"
        )
        bins = settle(
            parted.groupBy("_key", "bin", "part")
            .agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .withColumn("below", _count_below(["_key", "bin"], "part"))
            .join(bins.select("_key", "bin", "total", "targets"), ["_key", "bin"])
            .select("_key", F.col("part").alias("bin"), "n", "lo", "hi", "total", _targets_inside(F.col("targets")).alias("targets"))
            .where(F.size("targets") > 0)
        )
        near = settle(
            parted.select("_key", F.col("part").alias("bin"), "x", "n").join(bins.select("_key", "bin"), ["_key", "bin"])
        )
    found = (
        near.join(bins.select("_key", "bin", "total", "targets"), ["_key", "bin"])
        .withColumn("below", _count_below(["_key", "bin"], "x"))
        .select("_key", "x", "n", "below", "total", F.inline("targets"))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
    )
    picks = [
        F.max(F.when((F.col("q") == i) & (F.col("side") == side), F.col("x"))).alias(f"_{i}_{side}")
        for i in range(len(probabilities))
        for side in (0, 1)
    ]
    out = found.groupBy("_key").agg(F.max("total").alias("total"), *picks)
    values = []
    for i, p in enumerate(probabilities):
        low, high, rest = F.col(f"_{i}_0"), F.col(f"_{i}_1"), _place(p) - F.floor(_place(p))
        values.append(F.when(rest == 0.0, low).otherwise(low + (high - low) * rest).alias(f"p{i}"))
    return out.select("_key", "total", *values)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    bin_rows: int = _BIN_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles as (keys, n, p0, p1, ...), exact at any group size.

    No group is gathered, and no row outside the bins around a wanted rank is
    shuffled. One scan counts rows per bin of a fixed logarithmic scale; a second
    one takes the distinct values of the bins that hold a wanted rank (at most two per
    quantile). Bins of more than ``bin_rows`` rows are refined between their smallest and
    largest value until every part that one task sorts is small. Runs one job per scan.
    """
    cells = _cells(df, keys, value)
    bins = settle(_coarse_bins(cells, probabilities).where(F.size("targets") > 0))
    found = _ranked_values(settle(_values_of(cells, bins)), bins, probabilities, bin_rows)
    return found.select("_key.*", F.col("total").alias("n"), *[f"p{i}" for i in range(len(probabilities))])


_QUARTILES = (0.25, 0.5, 0.75)


def box_stats(
    df: DataFrame, keys: Sequence[str], value: str = "score", whisker: float = 1.5, bin_rows: int = _BIN_ROWS
) -> DataFrame:
    """Quartiles, whisker ends (furthest rows inside the fences) and outlier count.

    NULL, NaN and infinite values take no part. Two scans of the rows, each a job: one
    counts the bins, one takes the values of the bins that hold a quartile or may hold a
    fence. All other bins lie wholly inside or outside the fences, and their
    counts and ends say all that is needed of them.
    """
    keys = list(keys)
    cells = _cells(df.where(_finite(value)), keys, value)
    near = "near"
    counted = _coarse_bins(cells, _QUARTILES)
    bins = settle(counted.withColumn(near, (F.size("targets") > 0) | _may_hold_fence(whisker)))
    values = settle(_values_of(cells, bins.where(near)))
    quartiles = _ranked_values(values, bins, _QUARTILES, bin_rows).withColumnsRenamed({"p0": "q1", "p1": "median", "p2": "q3"})
    fenced = fences(settle(quartiles), whisker)
    parts = bins.where(~F.col(near)).select("_key", "lo", "hi", "n").unionByName(
        values.select("_key", F.col("x").alias("lo"), F.col("x").alias("hi"), "n")
    )
    inside = (F.col("lo") >= F.col("fence_low")) & (F.col("hi") <= F.col("fence_high"))
    return (
        parts.join(fenced, "_key")
        .groupBy("_key", "total", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("lo"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("hi"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
        .select("_key.*", F.col("total").alias("n"), "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")
    )


def _may_hold_fence(whisker: float) -> Column:
    """Whether a fence can lie in a bin, going by the ends of the bins that hold the quartiles."""
    group = Window.partitionBy("_key")

    def end(quartile: int, side: int, column: str) -> Column:
        here = F.exists("targets", lambda t: (t["q"] == quartile) & (t["side"] == side))
        return F.max(F.when(here, F.col(column))).over(group)

    q1_low, q1_high, q3_low, q3_high = end(0, 0, "lo"), end(0, 1, "hi"), end(2, 0, "lo"), end(2, 1, "hi")
    reach_least, reach_most = (q3_low - q1_high) * whisker, (q3_high - q1_low) * whisker
    slack = (F.abs(q1_low) + F.abs(q3_high) + F.abs(reach_most)) * 1e-12

    def meets(low: Column, high: Column) -> Column:
        return (F.col("lo") <= high + slack) & (F.col("hi") >= low - slack)

    return meets(q1_low - reach_most, q1_high - reach_least) | meets(q3_low + reach_least, q3_high + reach_most)


def _finite(value: str) -> Column:
    return F.abs(F.col(value).cast("double")) < float("inf")


def fences(boxes: DataFrame, whisker: float = 1.5) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * whisker
    return boxes.withColumn("fence_low", F.col("q1") - reach).withColumn(
        "fence_high", F.col("q3") + reach
    )


def outliers(
    df: DataFrame, boxes: DataFrame, keys: Sequence[str], value: str = "score", whisker: float = 1.5
) -> DataFrame:
    """The finite rows beyond the fences of their group's box. Runs a job to settle the boxes."""
    fenced = settle(fences(boxes, whisker).select(*keys, "fence_low", "fence_high"))
    x = F.col(value)
    beyond = (x < F.col("fence_low")) | (x > F.col("fence_high"))
    return (
        left_join_nulls_match(df, fenced, keys)
        .where(beyond & _finite(value))
        .drop("fence_low", "fence_high")
    )


def overlay(boxes: DataFrame, points: DataFrame, keys: Sequence[str], name: str = "test_score") -> DataFrame:
    """Box statistics with one further value per group, such as the test score."""
    return left_join_nulls_match(boxes, points.select(*keys, F.col("avg_score").alias(name)), list(keys))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Rank inside ``keys`` with ties sharing their mean rank; a NULL value has no rank.

    Meant for dimension tables, such as the distinct models per vocabulary size:
    the window orders all distinct values of a key in one task.
    """
    by_value = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    tied = Window.partitionBy(*keys, value)
    rank = F.rank().over(by_value) + (F.count(F.lit(1)).over(tied) - 1) / 2.0
    return df.withColumn(name, F.when(F.col(value).isNotNull(), rank.cast("double")))


def shape(df: DataFrame, vec: str) -> DataFrame:
    """Row count and vector width of an array column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(vec)).alias("min_width"),
        F.max(F.size(vec)).alias("max_width"),
    )
