"""Token vectors to sequence vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.vector import as_double


def pool(
    df: DataFrame,
    seq: str = "seq_id",
    pos: str = "pos",
    mask: str = "mask",
    vec: str = "vec",
    empty_as_zero: bool = True,
    exclude_pad: bool = False,
) -> DataFrame:
    """Mean, max, first-token and concatenated vectors of each sequence.

    Padding counts as 0: it adds nothing to the mean, but a dimension that is
    negative throughout gets a maximum of 0 as soon as there is padding.
    ``exclude_pad`` takes the maximum over real tokens only. A sequence of padding
    alone has mean 0, or NaN without ``empty_as_zero``, and no maximum over real tokens.

    Vectors are summed element-wise inside one aggregate with map-side partials;
    they are not exploded into a row per element.
    """
    kept = F.col(mask).cast("double")
    values = as_double(F.col(vec))
    zeroed = F.transform(values, lambda v: v * kept)
    masked = array_to_vector(zeroed).alias("_masked")
    aggregates = [
        Summarizer.metrics("sum", "max").summary(F.col("_masked")).alias("_s"),
        F.sum(kept).alias("_tokens"),
        F.first(F.when(F.col(pos) == 0, values), ignorenulls=True).alias("cls_vec"),
    ]
    columns = [F.col(seq), F.col(pos), F.col(mask), F.col(vec), masked]
    if exclude_pad:
        low = F.lit(float("-inf"))
        columns.append(
            array_to_vector(F.transform(values, lambda v: F.when(kept > 0, v).otherwise(low))).alias("_real")
        )
        aggregates.append(Summarizer.metrics("max").summary(F.col("_real")).alias("_m"))
    pooled = df.select(*columns).groupBy(seq).agg(*aggregates)
    tokens = F.greatest(F.col("_tokens"), F.lit(1.0)) if empty_as_zero else F.col("_tokens")
    nan = F.lit(float("nan"))
    mean = F.transform(
        vector_to_array("_s.sum"), lambda v: F.when(tokens == 0.0, nan).otherwise(F.try_divide(v, tokens))
    )
    if exclude_pad:
        largest = F.when(F.col("_tokens") > 0, vector_to_array("_m.max"))
    else:
        largest = vector_to_array("_s.max")
    return pooled.select(
        seq,
        mean.alias("mean_vec"),
        largest.alias("max_vec"),
        "cls_vec",
    ).withColumn("concat_vec", F.concat("cls_vec", "max_vec", "mean_vec"))


def labelled_vectors(pooled: DataFrame, model_type: str, labels: DataFrame, seq: str = "seq_id") -> DataFrame:
    """One row per sequence and vector type, tagged with model type and label."""
    kinds = F.array(
        *[
            F.struct(F.col(column).alias("vec"), F.lit(name).alias("vec_type"))
            for name, column in (("Mean", "mean_vec"), ("Max", "max_vec"), ("CLS", "cls_vec"))
        ]
    )
    return (
        pooled.join(labels.select(seq, "label"), seq, "left")
        .select(seq, "label", F.inline(kinds))
        .withColumn("model_type", F.lit(model_type))
    )
