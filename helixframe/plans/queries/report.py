"""Score reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import fixed, text
from helixframe.operators import stats, tables
from helixframe.plans import report, views
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql

_STRICT_MEAN = "CASE WHEN count(score) = count(*) THEN avg(score) END"
_STRICT_SE = "CASE WHEN count(score) = count(*) THEN stddev_samp(score) / sqrt(count(*)) END"

_GROUP = """CASE WHEN dataset LIKE 'H%' THEN 'Chromatin profiles'
    WHEN dataset LIKE 'enhan%' OR dataset LIKE 'promo%' THEN 'Regulatory elements'
    WHEN dataset LIKE 'spli%' THEN 'Splicing' ELSE 'Genome origin' END"""

_ALIAS = "CASE dataset WHEN 'plasmid_detection' THEN 'Plasmid' WHEN 'four_kingdoms' THEN 'Four kingdom' ELSE dataset END"
_SPACED = (
    f"replace(replace(replace(replace({_ALIAS}, '_', ' '), 'splice sites donors', 'donors'), "
    "'splice sites acceptors', 'acceptors'), 'splice sites all', 'all')"
)
_CASED = f"CASE WHEN {_SPACED} LIKE 'H%' THEN {_SPACED} ELSE upper({_SPACED}[1]) || lower({_SPACED}[2:]) END"
_CLEAN_NAME = f"replace(replace({_CASED}, 'no tata', '(no TATA)'), 'types', '(types)')"

_CLEAN = {
    "clean": f"""SELECT event_id, model, evaluation_set, metric, score, {_GROUP} AS group_data,
        {_CLEAN_NAME} AS dataset FROM results WHERE dataset <> 'promoter_tata'"""
}

_PARTS = """CASE WHEN model NOT LIKE 'seqm%' THEN 'NT' WHEN model LIKE '%esm%' THEN 'ESM' ELSE 'DeBERTa' END AS model_type,
    TRY_CAST(regexp_extract(CASE WHEN model NOT LIKE 'seqm%' THEN upper(str_split(model, '-')[4])
        WHEN model LIKE '%esm%' THEN str_split(model, '_')[5] ELSE str_split(model, '_')[4] END,
        '^(\\d{2,3})M', 1) AS DOUBLE) AS model_info,
    TRY_CAST(CASE WHEN model NOT LIKE 'seqm%' THEN '4096'
        WHEN model LIKE '%esm%' THEN str_split(model, '_')[3] ELSE str_split(model, '_')[2] END AS DOUBLE) AS vocab_size"""


def _clean(spark, folder):
    return report.clean_results(views.results(spark, folder))


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("clean_results", sql("SELECT * FROM clean", **_CLEAN))
def clean_results(spark, folder):
    return _clean(spark, folder)


@query("name_clean", sql(f"SELECT DISTINCT dataset, {_CLEAN_NAME} AS shown FROM results"))
def name_clean(spark, folder):
    names = views.results(spark, folder).select("dataset").distinct()
    shown = text.clean_dataset_name(text.alias(F.col("dataset"), fixed.DATASET_ALIASES))
    return names.withColumn("shown", shown)


@query(
    "task_group",
    sql(
        f"""SELECT group_data, list_position(['Chromatin profiles', 'Genome origin', 'Splicing', 'Regulatory elements'],
                   group_data)::INT AS ord, count(*) AS n FROM (SELECT {_GROUP} AS group_data FROM results) GROUP BY ALL"""
    ),
)
def task_group(spark, folder):
    rows = views.results(spark, folder).withColumn("group_data", text.task_group(F.col("dataset")))
    ordered = rows.withColumn("ord", tables.level_order("group_data", fixed.TASK_GROUPS))
    return stats.group_counts(ordered, ["group_data", "ord"]).orderBy("ord")


@query("model_id_parse", sql(f"SELECT DISTINCT model, {_PARTS} FROM results"))
def model_id_parse(spark, folder):
    return report.with_model_parts(views.results(spark, folder).select("model").distinct(), views.NAMES)


@query(
    "score_mean",
    sql(
        f"""SELECT *, {_PARTS} FROM (
            SELECT model, dataset, evaluation_set, metric, group_data, round({_STRICT_MEAN}, 6) AS avg_score
            FROM clean WHERE metric IN ({_names(fixed.OVERVIEW_METRICS)})
              AND model NOT IN ({_names(views.NAMES.excluded)}) GROUP BY ALL)""",
        **_CLEAN,
    ),
)
def score_mean(spark, folder):
    return rounded(report.overview(_clean(spark, folder), views.NAMES), "avg_score")


@query(
    "score_se",
    sql(
        f"""SELECT model, dataset, metric, round({_STRICT_MEAN}, 6) AS score_mean, round({_STRICT_SE}, 6) AS se,
            round({_STRICT_MEAN} - {_STRICT_SE}, 6) AS ymin, round({_STRICT_MEAN} + {_STRICT_SE}, 6) AS ymax
            FROM results GROUP BY model, dataset, metric"""
    ),
)
def score_se(spark, folder):
    table = stats.mean_and_error(views.results(spark, folder), ["model", "dataset", "metric"])
    return rounded(table, "score_mean", "se", "ymin", "ymax")


_BOX = """SELECT {keys}, count(score) AS n, round(any_value(b1), 6) AS q1, round(any_value(b2), 6) AS median,
    round(any_value(b3), 6) AS q3,
    round(min(score) FILTER (score BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)), 6) AS whisker_low,
    round(max(score) FILTER (score BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)), 6) AS whisker_high,
    count(*) FILTER (score NOT BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)) AS n_outliers
    FROM (SELECT *, quantile_cont(score, 0.25) OVER w AS b1, quantile_cont(score, 0.5) OVER w AS b2,
                 quantile_cont(score, 0.75) OVER w AS b3
          FROM {source} WINDOW w AS (PARTITION BY {keys})) GROUP BY ALL"""
_BOX_COLUMNS = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query(
    "box_stats",
    sql(_BOX.format(keys="dataset, metric", source="(SELECT * FROM results WHERE score IS NOT NULL)")),
)
def box_stats(spark, folder):
    return rounded(stats.box_stats(views.results(spark, folder), ["dataset", "metric"]), *_BOX_COLUMNS)


@query(
    "box_outliers",
    sql(
        """SELECT event_id, dataset, metric, round(score, 6) AS score FROM (
               SELECT *, quantile_cont(score, 0.25) OVER w AS b1, quantile_cont(score, 0.75) OVER w AS b3
               FROM results WHERE score IS NOT NULL WINDOW w AS (PARTITION BY dataset, metric))
           WHERE score < b1 - 1.5 * (b3 - b1) OR score > b3 + 1.5 * (b3 - b1)"""
    ),
)
def box_outliers(spark, folder):
    rows = views.results(spark, folder)
    keys = ["dataset", "metric"]
    found = stats.outliers(rows, stats.box_stats(rows, keys), keys)
    return rounded(found.select("event_id", "dataset", "metric", "score"), "score")


def _slice_sql(models, metric: str | None) -> dict[str, str]:
    shown = " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in models)
    place = " ".join(f"WHEN '{m}' THEN {i}" for i, (m, _) in enumerate(models, 1))
    where = f" AND metric = '{metric}'" if metric else ""
    return _CLEAN | {
        "sliced": f"""SELECT *, CASE model {shown} END AS model_n, (CASE model {place} END)::INT AS ord
            FROM clean WHERE model IN ({_names(m for m, _ in models)}){where}"""
    }


def _register_slice(name: str, models) -> None:
    keys = ", ".join(report.SLICE_KEYS)
    box = _BOX.format(
        keys=keys, source="(SELECT * FROM sliced WHERE evaluation_set = 'validation' AND score IS NOT NULL)"
    )
    same = " AND ".join(f"b.{k} = t.{k}" for k in report.SLICE_KEYS)

    @query(
        f"{name}_boxes",
        sql(
            f"""SELECT b.*, t.test_score FROM ({box}) b LEFT JOIN (
                    SELECT {keys}, round({_STRICT_MEAN}, 6) AS test_score FROM sliced
                    WHERE evaluation_set = 'test' GROUP BY ALL) t ON {same}""",
            **_slice_sql(models, report.DEFAULT_METRIC),
        ),
    )
    def boxes(spark, folder):
        sliced = report.report_slice(_clean(spark, folder), models)
        return rounded(report.slice_boxes(sliced), *_BOX_COLUMNS, "test_score")

    if name == "continual":
        return

    @query(
        f"{name}_throughput",
        sql(
            f"""SELECT {keys}, round({_STRICT_MEAN}, 6) AS score_mean, round({_STRICT_SE}, 6) AS se,
                round({_STRICT_MEAN} - {_STRICT_SE}, 6) AS ymin, round({_STRICT_MEAN} + {_STRICT_SE}, 6) AS ymax
                FROM sliced GROUP BY ALL""",
            **_slice_sql(models, report.THROUGHPUT),
        ),
    )
    def throughput(spark, folder):
        sliced = report.report_slice(_clean(spark, folder), models)
        return rounded(report.slice_throughput(sliced), "score_mean", "se", "ymin", "ymax")


for _name, _models in views.NAMES.slices.items():
    _register_slice(_name, _models)


@query(
    "generalisation_gap",
    sql(
        f"""SELECT model, dataset, metric, round(test, 6) AS test, round(validation, 6) AS validation,
                   round(test - validation, 6) AS difference
            FROM (SELECT model, dataset, metric,
                         max(m) FILTER (evaluation_set = 'test') AS test,
                         max(m) FILTER (evaluation_set = 'validation') AS validation
                  FROM (SELECT model, dataset, evaluation_set, metric, {_STRICT_MEAN} AS m FROM clean
                        WHERE metric = 'eval_mcc' GROUP BY ALL) GROUP BY ALL)""",
        **_CLEAN,
    ),
)
def generalisation_gap(spark, folder):
    return rounded(report.gap_table(_clean(spark, folder)), "test", "validation", "difference")


_PLAIN = _CLEAN | {
    "plain": f"""SELECT *, {_PARTS} FROM clean
        WHERE model LIKE '%seqm%' AND model NOT LIKE '%esm%' AND NOT regexp_matches(model, 'at|M-M')""",
    "ranks": """SELECT vocab_size, model_info,
        CASE WHEN model_info IS NOT NULL THEN (rank() OVER (PARTITION BY vocab_size ORDER BY model_info NULLS LAST))::DOUBLE END AS rank
        FROM (SELECT DISTINCT vocab_size, model_info FROM plain)""",
}


@query(
    "size_rank_join",
    sql(
        """SELECT p.model, p.vocab_size, p.model_info, r.rank, count(*) AS n FROM plain p
           LEFT JOIN ranks r ON p.vocab_size IS NOT DISTINCT FROM r.vocab_size
                            AND p.model_info IS NOT DISTINCT FROM r.model_info GROUP BY ALL""",
        **_PLAIN,
    ),
)
def size_rank_join(spark, folder):
    ranked = report.size_ranked(_clean(spark, folder), views.NAMES)
    return stats.group_counts(ranked, ["model", "vocab_size", "model_info", "rank"])


@query(
    "size_rank_throughput",
    sql(
        f"""SELECT r.rank, p.model, p.dataset, p.metric, p.group_data, round({_STRICT_MEAN}, 6) AS score_mean,
                   round({_STRICT_SE}, 6) AS se, round({_STRICT_MEAN} - {_STRICT_SE}, 6) AS ymin,
                   round({_STRICT_MEAN} + {_STRICT_SE}, 6) AS ymax
            FROM plain p JOIN ranks r ON p.vocab_size = r.vocab_size AND p.model_info = r.model_info
            WHERE r.rank IN (1, 2, 3) AND metric = 'eval_samples_per_second' GROUP BY ALL""",
        **_PLAIN,
    ),
)
def size_rank_throughput(spark, folder):
    """The throughput tables of the three smallest sizes, in one pass."""
    ranked = report.size_ranked(_clean(spark, folder), views.NAMES)
    chosen = ranked.where(F.col("rank").isin(1.0, 2.0, 3.0) & (F.col("metric") == report.THROUGHPUT))
    table = stats.mean_and_error(chosen, ["rank", "model", "dataset", "metric", "group_data"])
    return rounded(table, "score_mean", "se", "ymin", "ymax")


_RANK_KEYS = ["rank", "model", "vocab_size", "dataset", "metric", "group_data"]
_RANKED = _PLAIN | {
    "ranked": """SELECT p.*, r.rank FROM plain p JOIN ranks r ON p.vocab_size = r.vocab_size AND p.model_info = r.model_info
        WHERE r.rank IN (1, 2, 3) AND metric = 'eval_mcc'"""
}


@query(
    "size_rank_boxes",
    sql(
        "SELECT b.*, t.test_score FROM ("
        + _BOX.format(keys=", ".join(_RANK_KEYS), source="(SELECT * FROM ranked WHERE evaluation_set = 'validation' AND score IS NOT NULL)")
        + f""") b LEFT JOIN (SELECT {", ".join(_RANK_KEYS)}, round({_STRICT_MEAN}, 6) AS test_score FROM ranked
              WHERE evaluation_set = 'test' GROUP BY ALL) t ON """
        + " AND ".join(f"b.{k} = t.{k}" for k in _RANK_KEYS),
        **_RANKED,
    ),
)
def size_rank_boxes(spark, folder):
    """Score boxes of the three smallest sizes per vocabulary, with the mean test score beside them."""
    ranked = report.size_ranked(_clean(spark, folder), views.NAMES)
    boxes = report.slice_boxes(ranked.where(F.col("rank").isin(1.0, 2.0, 3.0)), keys=_RANK_KEYS)
    return rounded(boxes, *_BOX_COLUMNS, "test_score")


@query(
    "throughput_se",
    sql(
        f"""SELECT model, dataset, round({_STRICT_MEAN}, 6) AS score_mean, round({_STRICT_SE}, 6) AS se
            FROM results WHERE metric = 'eval_samples_per_second' GROUP BY ALL"""
    ),
)
def throughput_se(spark, folder):
    rows = views.results(spark, folder).where(F.col("metric") == report.THROUGHPUT)
    table = stats.mean_and_error(rows, ["model", "dataset"])
    return rounded(table.drop("ymin", "ymax"), "score_mean", "se")


@query(
    "alias_join",
    sql(
        """SELECT coalesce(a.shown, d.lang) AS shown, count(*) AS n FROM documents d
           LEFT JOIN (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German')) a(lang, shown)
             ON d.lang = a.lang GROUP BY ALL"""
    ),
)
def alias_join(spark, folder):
    names = {"en": "English", "fr": "French", "de": "German"}
    rows = views.table(spark, folder, "documents").withColumn("shown", text.alias(F.col("lang"), names))
    return stats.group_counts(rows, ["shown"])


@query(
    "lineitem_box",
    """SELECT l_returnflag, count(*) AS n, round(any_value(b1), 6) AS q1, round(any_value(b2), 6) AS median,
       round(any_value(b3), 6) AS q3,
       round(min(l_extendedprice) FILTER (l_extendedprice BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)), 6) AS whisker_low,
       round(max(l_extendedprice) FILTER (l_extendedprice BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)), 6) AS whisker_high,
       count(*) FILTER (l_extendedprice NOT BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)) AS n_outliers
       FROM (SELECT *, quantile_cont(l_extendedprice, 0.25) OVER w AS b1, quantile_cont(l_extendedprice, 0.5) OVER w AS b2,
                    quantile_cont(l_extendedprice, 0.75) OVER w AS b3
             FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) GROUP BY ALL""",
)
def lineitem_box(spark, folder):
    """Box statistics with three groups over the largest table: the hot-group case."""
    rows = views.table(spark, folder, "lineitem")
    return rounded(stats.box_stats(rows, ["l_returnflag"], "l_extendedprice"), *_BOX_COLUMNS)


@query(
    "lineitem_mean_se",
    """SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS score_mean,
       round(stddev_samp(l_discount) / sqrt(count(*)), 6) AS se,
       round(avg(l_discount) - stddev_samp(l_discount) / sqrt(count(*)), 6) AS ymin,
       round(avg(l_discount) + stddev_samp(l_discount) / sqrt(count(*)), 6) AS ymax
       FROM lineitem GROUP BY ALL""",
)
def lineitem_mean_se(spark, folder):
    rows = views.table(spark, folder, "lineitem")
    table = stats.mean_and_error(rows, ["l_returnflag", "l_linestatus"], "l_discount")
    return rounded(table, "score_mean", "se", "ymin", "ymax")
