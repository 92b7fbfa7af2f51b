"""Score report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import ReportNames
from helixframe.functions import fixed, text
from helixframe.operators import stats, tables
from helixframe.session import settle

THROUGHPUT = "eval_samples_per_second"
DEFAULT_METRIC = "eval_mcc"


def clean_results(results: DataFrame, excluded_dataset: str = "promoter_tata") -> DataFrame:
    """Drop the excluded dataset, add the task group, put dataset names in display form."""
    return (
        results.where(F.col("dataset") != excluded_dataset)
        .withColumn("group_data", text.task_group(F.col("dataset")))
        .withColumn("dataset", text.clean_dataset_name(text.alias(F.col("dataset"), fixed.DATASET_ALIASES)))
    )


def with_model_parts(df: DataFrame, names: ReportNames, model: str = "model") -> DataFrame:
    """Family, size in million parameters and vocabulary size of each model name."""
    name = F.col(model)
    return df.withColumns(
        {
            "model_type": text.model_family(name, names.prefix),
            "model_info": text.model_size_million(name, names.prefix),
            "vocab_size": text.model_vocab_size(name, names.prefix),
        }
    )


def gap_table(clean: DataFrame, metric: str = DEFAULT_METRIC) -> DataFrame:
    """Mean test score minus mean validation score per model and dataset."""
    means = stats.grouped_mean(
        clean.where(F.col("metric") == metric), ["model", "dataset", "evaluation_set", "metric"]
    )
    wide = tables.long_to_wide(
        means, ["model", "dataset", "metric"], "evaluation_set", "avg_score", ["test", "validation"]
    )
    return tables.generalisation_gap(wide)


def overview(clean: DataFrame, names: ReportNames) -> DataFrame:
    """Mean scores of the compared models with their parsed names."""
    kept = clean.where(
        tables.is_in("metric", fixed.OVERVIEW_METRICS)
        & tables.not_in("model", names.excluded)
    )
    means = stats.grouped_mean(kept, ["model", "dataset", "evaluation_set", "metric", "group_data"])
    return with_model_parts(means, names)


def size_ranked(clean: DataFrame, names: ReportNames) -> DataFrame:
    """Plain models with the rank of their size among those of equal vocabulary.

    The ranked table holds one row per (vocabulary, size), not one per score; a job
    settles it before it is joined to the scores.
    """
    plain = clean.where(
        F.col("model").contains(names.prefix) & ~F.col("model").contains("esm") & ~F.col("model").rlike("at|M-M")
    )
    parsed = with_model_parts(plain, names)
    sizes = parsed.select("vocab_size", "model_info").distinct()
    ranks = stats.average_rank(sizes, ["vocab_size"], "model_info")
    return tables.left_join_nulls_match(parsed, settle(ranks), ["model_info", "vocab_size"])


def report_slice(clean: DataFrame, models: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of the listed models with display name and place in the list."""
    names = dict(models)
    levels = [shown for _, shown in models]
    return (
        clean.where(tables.is_in("model", list(names)))
        .withColumn("model_n", text.alias(F.col("model"), names))
        .withColumn("ord", tables.level_order("model_n", levels))
    )


SLICE_KEYS = ["dataset", "metric", "group_data", "model", "model_n", "ord"]


def slice_boxes(sliced: DataFrame, metric: str = DEFAULT_METRIC, keys: Sequence[str] = SLICE_KEYS) -> DataFrame:
    """Box statistics of the validation scores with the mean test score beside them."""
    scored = sliced.where(F.col("metric") == metric)
    boxes = stats.box_stats(scored.where(F.col("evaluation_set") == "validation"), keys)
    tests = stats.grouped_mean(scored.where(F.col("evaluation_set") == "test"), keys)
    return stats.overlay(boxes, tests, keys)


def slice_throughput(sliced: DataFrame) -> DataFrame:
    """Mean and standard error of evaluation throughput."""
    return stats.mean_and_error(sliced.where(F.col("metric") == THROUGHPUT), SLICE_KEYS)


def token_map(points: DataFrame, names: ReportNames) -> DataFrame:
    """Token coordinates with token length, display name and a mark for chosen tokens."""
    shown = [names.variants[v] for v in fixed.VARIANTS]
    return (
        points.withColumn("token_len", F.char_length("token"))
        .withColumn("model", text.alias(F.col("model"), names.variants))
        .withColumn("ord", tables.level_order("model", shown))
        .withColumn("marked", tables.is_in("token", fixed.HIGHLIGHT_TOKENS))
    )


def drift_long(wide: DataFrame, names: ReportNames, keys: Sequence[str] = ()) -> DataFrame:
    """Token drift with one row per token and variant, variants by display name."""
    long = tables.wide_to_long(wide, keys, fixed.VARIANTS[:-1], "model", "value")
    return long.withColumn("model", text.alias(F.col("model"), names.variants))


def drift_boxes(wide: DataFrame, names: ReportNames) -> DataFrame:
    """Distribution of token drift per variant, from one column per variant."""
    return stats.box_stats(drift_long(wide.drop("token"), names), ["model"], "value")


def facets(points: DataFrame) -> DataFrame:
    """Facet label of each point, and its fine-tuning state in display form."""
    shown = F.when(F.col("fine_tuned") == "Yes", "Fine-tuned").otherwise("Base model")
    return points.withColumn(
        "facet_label", F.concat_ws(" - ", "fine_tuned", "vec_type")
    ).withColumn("fine_tuned", shown)
