"""Projection, filters, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import fixed, text
from helixframe.operators import ordering, stats, tables
from helixframe.plans import views
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql

_WIDTH = 64


@query(
    "project_drop_rename",
    sql(
        """SELECT vec_id AS id, label AS labels, 'Mean' AS vec_type, 'Base' AS model_type,
                  len(embedding) AS width, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last,
                  md5(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',')) AS digest
           FROM embeddings"""
    ),
)
def project_drop_rename(spark, folder):
    """Wide vector columns and back: regex and positional selection, drop, rename, constants."""
    wide = tables.unpack_vector(views.table(spark, folder, "embeddings"), "embedding", _WIDTH)
    by_name = tables.pack_matching(wide, r"^v_\d+$").drop("extra")
    leading = by_name.select(*[F.get("vec", F.lit(i)).alias(str(i)) for i in range(_WIDTH)], "vec_id", "label")
    packed = tables.pack_leading(leading, _WIDTH).withColumnsRenamed({"vec_id": "id", "label": "labels"})
    tagged = tables.with_constants(packed, vec_type="Mean", model_type="Base")
    return rounded(
        tagged.select(
            "id",
            "labels",
            "vec_type",
            "model_type",
            F.size("vec").cast("bigint").alias("width"),
            F.get("vec", F.lit(0)).alias("first"),
            F.get("vec", F.lit(_WIDTH - 1)).alias("last"),
            F.md5(F.array_join(F.transform("vec", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",")).alias("digest"),
        ),
        "first",
        "last",
    )


@query(
    "value_map",
    """SELECT doc_id, CASE quality WHEN 0 THEN 'Chromosome' WHEN 1 THEN 'Plasmid' END AS origin,
       CASE 2 * quality + toxic WHEN 0 THEN 'Virus' WHEN 1 THEN 'Bacteria' WHEN 2 THEN 'Eukaryote' WHEN 3 THEN 'Archaea' END AS kingdom
       FROM labels""",
)
def value_map(spark, folder):
    rows = views.table(spark, folder, "labels").withColumn("code", F.col("quality") * 2 + F.col("toxic"))
    named = tables.map_codes(rows, "quality", fixed.PLASMID_LABELS, "origin")
    return tables.map_codes(named, "code", fixed.KINGDOM_LABELS, "kingdom").select("doc_id", "origin", "kingdom")


@query(
    "filters_in_notin",
    sql(
        f"""SELECT event_id, model, metric FROM results
           WHERE metric IN ('eval_mcc', 'eval_accuracy')
             AND model NOT IN ('{"', '".join(views.HEADS.values())}') AND dataset <> 'promoter_tata'
             AND model LIKE '%seqm%' AND model NOT LIKE '%esm%'
             AND score > 0 AND score < 0.5"""
    ),
)
def filters_in_notin(spark, folder):
    return (
        views.results(spark, folder)
        .where(
            tables.is_in("metric", ["eval_mcc", "eval_accuracy"])
            & tables.not_in("model", list(views.HEADS.values()))
            & (F.col("dataset") != "promoter_tata")
            & F.col("model").rlike("seqm")
            & ~F.col("model").rlike("esm")
            & tables.open_range("score", 0, 0.5)
        )
        .select("event_id", "model", "metric")
    )


@query(
    "ordered_factor",
    sql(
        """SELECT metric, (CASE metric WHEN 'eval_f1_score' THEN 1 WHEN 'eval_mcc' THEN 2 WHEN 'eval_accuracy' THEN 3 END)::INT AS ord,
                  count(*) AS n FROM results GROUP BY ALL ORDER BY ord"""
    ),
)
def ordered_factor(spark, folder):
    levels = ["eval_f1_score", "eval_mcc", "eval_accuracy"]
    rows = views.results(spark, folder).withColumn("ord", tables.level_order("metric", levels))
    return stats.group_counts(rows, ["metric", "ord"]).orderBy("ord")


@query("clamp", sql("SELECT event_id, round(CASE WHEN score < 0 THEN 0 ELSE score END, 6) AS score FROM results"))
def clamp(spark, folder):
    rows = views.results(spark, folder).select("event_id", "score")
    return rounded(rows.withColumn("score", tables.clamp_negative(F.col("score"))), "score")


@query(
    "safe_cast",
    sql("SELECT DISTINCT model, TRY_CAST(str_split(model, '_')[2] AS DOUBLE) AS number FROM results"),
)
def safe_cast(spark, folder):
    names = views.results(spark, folder).select("model").distinct()
    return names.withColumn("number", text.safe_double(text.nth_part(F.col("model"), "_", 1)))


@query(
    "highlight",
    sql("SELECT vec_id, model, token IN ('acgg', 'cagtaag', 'acccg') AS marked FROM tokens"),
)
def highlight(spark, folder):
    marked = tables.is_in("token", ["acgg", "cagtaag", "acccg"])
    return views.tokens(spark, folder).select("vec_id", "model", marked.alias("marked"))


@query(
    "pending_grid",
    """SELECT model, dataset FROM (SELECT DISTINCT p_brand AS model FROM part)
         CROSS JOIN (SELECT DISTINCT event_type AS dataset FROM events)
       EXCEPT SELECT DISTINCT p_brand, event_type FROM part JOIN events ON p_partkey = event_id WHERE p_size <= 3""",
)
def pending_grid(spark, folder):
    part, events = views.table(spark, folder, "part"), views.table(spark, folder, "events")
    models = part.select(F.col("p_brand").alias("model"))
    datasets = events.select(F.col("event_type").alias("dataset"))
    finished = part.where("p_size <= 3").join(events, part.p_partkey == events.event_id).select(
        F.col("p_brand").alias("model"), F.col("event_type").alias("dataset")
    )
    return tables.pending_runs(models, datasets, finished)


@query(
    "key_align",
    sql(
        """SELECT token, round(any_value(x) FILTER (model = 'base'), 6) AS base, round(any_value(x) FILTER (model = 'Ms'), 6) AS "Ms",
                  round(any_value(x) FILTER (model = 'Mp'), 6) AS "Mp", round(any_value(x) FILTER (model = 'Me'), 6) AS "Me"
           FROM (SELECT token, model, sum(x * (dim + 1)) AS x FROM token_cells GROUP BY ALL) GROUP BY token"""
    ),
)
def key_align(spark, folder):
    """One number per token, made of all elements of its vector, side by side for the variants."""
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    rows = views.tokens(spark, folder).select("token", "model", weighted.alias("x"))
    variants = ("base", "Ms", "Mp", "Me")
    parts = {m: rows.where(F.col("model") == m) for m in variants}
    return rounded(tables.align_by_key(parts, "token", "x"), *variants)


@query("peek_sorted", sql("SELECT event_id, model, round(score, 6) AS score FROM results ORDER BY score DESC NULLS LAST, event_id LIMIT 25"))
def peek_sorted(spark, folder):
    top = ordering.first_rows(views.results(spark, folder), 25, F.col("score").desc_nulls_last(), "event_id")
    return rounded(top.select("event_id", "model", "score"), "score")


@query(
    "distinct_counts",
    sql(
        """SELECT 'dataset' AS "column", count(DISTINCT dataset) AS n_distinct FROM results
           UNION ALL SELECT 'model', count(DISTINCT model) FROM results
           UNION ALL SELECT 'event_id', count(DISTINCT event_id) FROM results"""
    ),
)
def distinct_counts(spark, folder):
    return stats.distinct_counts(views.results(spark, folder), ["dataset", "model", "event_id"])


@query(
    "shape_report",
    "SELECT count(*) AS n_rows, min(len(embedding))::INT AS min_width, max(len(embedding))::INT AS max_width FROM embeddings",
)
def shape_report(spark, folder):
    return stats.shape(views.table(spark, folder, "embeddings"), "embedding")


@query(
    "label_index",
    sql("SELECT event_id, model, (dense_rank() OVER (ORDER BY model) - 1)::INT AS code FROM results"),
)
def label_index(spark, folder):
    return tables.label_codes(views.results(spark, folder).select("event_id", "model"), "model")


@query(
    "melt_scores",
    sql(
        """SELECT event_id, metric, "values" FROM (SELECT event_id, round(value, 6) AS raw, round(value / 3, 6) AS third,
               round(sqrt(value), 6) AS root FROM events)
           UNPIVOT INCLUDE NULLS ("values" FOR metric IN (raw, third, root))"""
    ),
)
def melt_scores(spark, folder):
    value = F.col("value")
    wide = views.table(spark, folder, "events").select(
        "event_id", value.alias("raw"), (value / 3).alias("third"), F.sqrt(value).alias("root")
    )
    return rounded(tables.wide_to_long(wide, ["event_id"], ["raw", "third", "root"]), "values")


@query(
    "metric_rows",
    """SELECT event_id, 'loss' AS metric, value AS score FROM events
       UNION ALL SELECT event_id, 'user', user_id::DOUBLE FROM events""",
)
def metric_rows(spark, folder):
    metrics = F.create_map(F.lit("loss"), F.col("value"), F.lit("user"), F.col("user_id").cast("double"))
    rows = views.table(spark, folder, "events").select("event_id", metrics.alias("metrics"))
    return tables.metrics_to_rows(rows, ["event_id"])


@query(
    "concat_rows",
    """SELECT doc_id AS id, lang AS tag, n_chars FROM documents
       UNION ALL SELECT vec_id, label::VARCHAR, NULL FROM embeddings""",
)
def concat_rows(spark, folder):
    docs = views.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag"), "n_chars")
    vecs = views.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("tag")
    )
    return tables.concat_rows(docs, vecs)


@query(
    "string_kit",
    sql(
        f"""SELECT event_id, concat_ws(' - ', model, dataset) AS facet, upper(model) AS upper_name, length(model)::INT AS name_length,
                  (dataset LIKE 'H%' OR dataset LIKE '%all') AS marked,
                  model || '_results_' || dataset AS run_name,
                  str_split('out/results/' || model || '_results_' || dataset || '.csv', '/')[-1] AS last_part,
                  model || '_results_' || dataset AS stem,
                  CASE WHEN model LIKE '%-at-base-nt' THEN '{views.LENDER}' ELSE model END AS source,
                  CASE WHEN score IS NOT NULL THEN printf('%.1f%%', score * 100) END AS pct,
                  CASE WHEN score IS NOT NULL THEN printf('%.3f', score) END AS shown, round(score, 1) + 0::DOUBLE AS one_digit,
                  round(exp(score), 6) AS e, round(pow(score, 2), 6) AS sq,
                  str_split(concat_ws('_', 'tok', evaluation_set), '_')[2] AS second
           FROM results"""
    ),
)
def string_kit(spark, folder):
    model, dataset, score = F.col("model"), F.col("dataset"), F.col("score")
    run_name = text.result_file_name(model, dataset)
    path = F.concat(F.lit("out/results/"), run_name, F.lit(".csv"))
    shown = lambda column: F.when(score.isNotNull(), column)
    return views.results(spark, folder).select(
        "event_id",
        F.concat_ws(" - ", model, dataset).alias("facet"),
        F.upper(model).alias("upper_name"),
        F.char_length(model).alias("name_length"),
        (dataset.startswith("H") | dataset.endswith("all")).alias("marked"),
        run_name.alias("run_name"),
        text.last_path_part(path).alias("last_part"),
        text.file_stem(path).alias("stem"),
        text.tokenizer_source(model, views.NAMES.loan_suffix, views.NAMES.lender).alias("source"),
        shown(text.percent(score, 1)).alias("pct"),
        shown(text.fixed_point(score, 3)).alias("shown"),
        F.round(score, 1).alias("one_digit"),
        F.round(F.exp(score), 6).alias("e"),
        F.round(F.pow(score, F.lit(2)), 6).alias("sq"),
        F.split_part(F.concat_ws("_", F.lit("tok"), "evaluation_set"), F.lit("_"), F.lit(2)).alias("second"),
    )


@query(
    "null_safe_join",
    sql(
        """SELECT model, r.number, count(*) AS n, any_value(m.size) AS size
           FROM (SELECT model, TRY_CAST(str_split(model, '_')[2] AS DOUBLE) AS number FROM results) r
           LEFT JOIN (SELECT number, count(*) AS size FROM (
                SELECT DISTINCT model, TRY_CAST(str_split(model, '_')[2] AS DOUBLE) AS number FROM results) GROUP BY number) m
             ON r.number IS NOT DISTINCT FROM m.number GROUP BY ALL"""
    ),
)
def null_safe_join(spark, folder):
    numbered = views.results(spark, folder).select(
        "model", text.safe_double(text.nth_part(F.col("model"), "_", 1)).alias("number")
    )
    sizes = stats.group_counts(numbered.distinct(), ["number"], "size")
    counted = stats.group_counts(numbered, ["model", "number"])
    return tables.left_join_nulls_match(counted, sizes, ["number"])
