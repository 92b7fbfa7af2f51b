"""Standardising, principal components and drift of vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.text import percent
from helixframe.functions.vector import as_double, cosine_similarity, dot, l2_distance
from helixframe.operators.tables import long_to_wide
from helixframe.session import settle


def standardise(
    df: DataFrame, vec: str = "vec", by: Sequence[str] = (), sample_sd: bool = False, name: str = "scaled"
) -> DataFrame:
    """Centre and scale every dimension, over the table or within ``by``.

    Uses the population standard deviation unless ``sample_sd``. A constant
    dimension becomes 0. With ``by`` a job settles the statistics, one pair of
    vectors per group, before they are joined to the rows.
    """
    by = list(by)
    stats = (
        df.select(*by, array_to_vector(as_double(F.col(vec))).alias("_v"))
        .groupBy(*by)
        .agg(Summarizer.metrics("mean", "std", "count").summary(F.col("_v")).alias("_s"))
    )
    shrink = F.lit(1.0) if sample_sd else F.sqrt((F.col("_s.count") - 1) / F.col("_s.count"))
    held = F.struct(
        vector_to_array("_s.mean").alias("mean"),
        F.transform(vector_to_array("_s.std"), lambda s: s * shrink).alias("sd"),
    )
    if by:
        joined = df.join(settle(stats.select(*by, held.alias("_stats"))), by)
    else:
        joined = df.withColumn("_stats", stats.select(held).scalar())
    centred = F.zip_with(as_double(F.col(vec)), F.col("_stats.mean"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("_stats.sd"), lambda x, s: F.when(s == 0.0, 0.0).otherwise(x / s))
    return joined.withColumn(name, scaled).drop("_stats")


def principal_components(df: DataFrame, vec: str, k: int, name: str = "pc") -> tuple[DataFrame, DataFrame]:
    """Coordinates on the first ``k`` components and the table of explained variance.

    ``vec`` must be centred, as ``standardise`` leaves it. The sign of a component
    is set so that its largest loading is positive. Runs Spark jobs for the fit;
    the driver holds one width x width matrix.
    """
    features = df.withColumn("_v", array_to_vector(as_double(F.col(vec))))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(features)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    coords = F.zip_with(vector_to_array("_pc"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    projected = model.transform(features).withColumn(name, coords).drop("_v", "_pc")
    ratios = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    explained = df.sparkSession.createDataFrame(ratios, "component int, ratio double").withColumn(
        "axis_label",
        F.concat(F.lit("PC"), F.col("component"), F.lit(" ("), percent(F.col("ratio"), 1), F.lit(")")),
    )
    return projected, explained


def principal_components_by(
    df: DataFrame, vec: str, k: int, by: str, sample_sd: bool = True, name: str = "pc"
) -> tuple[DataFrame, DataFrame]:
    """Standardises and reduces each group of ``by`` on its own: coordinates, and explained variance per group. Runs jobs.

    All groups are fitted by one aggregate: their counts, sums and products of dimensions. A task then solves one group's
    width x width problem. The second table also has ``sdev``, the standard deviation along the component. A group
    of fewer than two rows has no components: its coordinates are NULL. A NULL group is a group. The sign of a component
    is set so that its largest loading is positive; a constant dimension counts as 0.
    """
    solved = settle(_solved(gram_matrices(df, vec, by), by, k, sample_sd))
    fits = solved.select(F.col(by).alias("_by"), "_mean", "_sd", "_axes")
    joined = df.join(fits, F.col(by).eqNullSafe(F.col("_by")), "left")
    centred = F.zip_with(as_double(F.col(vec)), F.col("_mean"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("_sd"), lambda x, s: F.when(s == 0.0, 0.0).otherwise(x / s))
    place = F.transform(F.array(scaled), lambda z: F.transform("_axes", lambda axis: dot(z, axis)))
    coords = joined.withColumn(name, F.when(F.col("_axes").isNotNull() & F.col(vec).isNotNull(), F.element_at(place, 1))).drop("_by", "_mean", "_sd", "_axes")
    shares = solved.where("_axes is not null").select(by, F.posexplode(F.arrays_zip("_ratio", "_sdev")).alias("_i", "_s"))
    label = F.concat(F.lit("PC"), F.col("component"), F.lit(" ("), percent(F.col("ratio"), 1), F.lit(")"))
    explained = shares.select((F.col("_i") + 1).alias("component"), F.col("_s._ratio").alias("ratio"), F.col("_s._sdev").alias("sdev"), by)
    return coords, explained.select("component", "ratio", label.alias("axis_label"), "sdev", by)


def gram_matrices(df: DataFrame, vec: str, by: str) -> DataFrame:
    """(by, i, j, s): per group the sum of products of dimensions i <= j over its rows; dimension -1 is the constant 1.

    Tasks add up whole batches of vectors as matrix products and send one sum per group and pair of
    dimensions, so a hot group costs a task's share of its rows. Rows with a NULL vector are left out.
    """
    limit = 1 << 22

    def run(batches):
        sums: dict = {}

        def drained():
            for group, total in sums.items():
                i, j = np.triu_indices(len(total))
                columns = [pa.array([group] * len(i), kind), pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(total[i, j])]
                yield pa.RecordBatch.from_arrays(columns, ["g", "i", "j", "s"])
            sums.clear()

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            groups, vectors = batch.column(0).to_pylist(), batch.column(1)
            places: dict = {}
            for at, group in enumerate(groups):
                places.setdefault(group, []).append(at)
            for group, rows in places.items():
                own = vectors.take(pa.array(rows))
                x = own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                x = np.hstack([np.ones((len(rows), 1)), x])
                product = x.T @ x
                sums[group] = sums[group] + product if group in sums else product
            if sum(t.size for t in sums.values()) > limit:
                yield from drained()
        if sums:
            yield from drained()

    kind = df.schema[by].dataType.simpleString()
    rows = df.where(F.col(vec).isNotNull()).select(F.col(by).alias("g"), as_double(F.col(vec)).alias("v"))
    parts = rows.mapInArrow(run, f"g {kind}, i int, j int, s double")
    return parts.groupBy(F.col("g").alias(by), "i", "j").agg(F.sum("s").alias("s"))


def _solved(grams: DataFrame, by: str, k: int, sample_sd: bool) -> DataFrame:
    """(by, _mean, _sd, _axes, _ratio, _sdev) of each group, from its sums of products."""
    ddof = 1 if sample_sd else 0

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, s = (rows[c].to_numpy() for c in ("i", "j", "s"))
        gram = np.zeros((i.max() + 2, i.max() + 2))
        gram[i + 1, j + 1] = gram[j + 1, i + 1] = s
        n, total = gram[0, 0], gram[0, 1:]
        mean = total / n
        out = {by: [rows[by].iloc[0]], "_mean": [mean], "_sd": [None], "_axes": [None], "_ratio": [None], "_sdev": [None]}
        if n >= 2:
            spread = gram[1:, 1:] - np.outer(total, mean)
            square = np.diag(gram)[1:]
            # what is left of a constant dimension is rounding
            variance = np.where(np.diag(spread) > 1e-13 * square, np.diag(spread), 0.0)
            sd = np.sqrt(variance / (n - ddof))
            scale = np.where(sd > 0, sd, 1.0)
            spread = np.where((sd[:, None] > 0) & (sd > 0), spread / np.outer(scale, scale), 0.0) / (n - 1)
            values, axes = np.linalg.eigh(spread)
            values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1].T[:k]
            signs = np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)
            whole = values.sum()
            ratio = values[:k] / whole if whole > 0 else np.zeros(len(axes))
            out |= {"_sd": [sd], "_axes": [list(axes * signs[:, None])], "_ratio": [ratio], "_sdev": [np.sqrt(values[:k])]}
        return pd.DataFrame(out)

    kind = grams.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, _mean array<double>, _sd array<double>, _axes array<array<double>>, _ratio array<double>, _sdev array<double>"
    return grams.groupBy(by).applyInPandas(solve, schema)  # a group is the half of a width x width matrix


def pairs_with_base(df: DataFrame, key: str = "token", model: str = "model", vec: str = "vec", base: str = "base") -> DataFrame:
    """Every variant's vector next to the base vector of the same key."""
    basis = df.where(F.col(model) == base).select(key, F.col(vec).alias("base_vec"))
    return df.where(F.col(model) != base).join(basis, key)


def drift(
    df: DataFrame,
    measure: str = "l2",
    key: str = "token",
    model: str = "model",
    vec: str = "vec",
    base: str = "base",
) -> DataFrame:
    """Distance ("l2") or similarity ("cosine") of each variant to the base, long.

    A join on the key replaces the all-against-all matrix and its diagonal.
    """
    function = {"l2": l2_distance, "cosine": cosine_similarity}[measure]
    paired = pairs_with_base(df, key, model, vec, base)
    return paired.select(key, model, function(F.col(vec), F.col("base_vec")).alias("value"))


def drift_wide(long: DataFrame, variants: Sequence[str], key: str = "token", model: str = "model") -> DataFrame:
    """One column per variant."""
    return long_to_wide(long, [key], model, "value", variants)
