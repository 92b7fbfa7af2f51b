"""Agreement of clusterings with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import clustering
from helixframe.plans import report, views
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql
from helixframe.session import shared_folder
from helixframe.sources import files

_TABLES = {
    "cells": "SELECT dataset, pred AS a, label AS b, count(*) AS n FROM preds GROUP BY ALL",
    "rows_": "SELECT dataset, a, sum(n)::BIGINT AS n FROM cells GROUP BY ALL",
    "cols_": "SELECT dataset, b, sum(n)::BIGINT AS n FROM cells GROUP BY ALL",
    "tot": "SELECT dataset, sum(n)::BIGINT AS total FROM cells GROUP BY ALL",
    "ent": """SELECT dataset, -sum(n / total * ln(n / total)) FILTER (side = 'a') AS ha,
        -sum(n / total * ln(n / total)) FILTER (side = 'b') AS hb, -sum(n / total * ln(n / total)) FILTER (side = 'ab') AS hab,
        sum(n * (n - 1) / 2) FILTER (side = 'a') AS pa, sum(n * (n - 1) / 2) FILTER (side = 'b') AS pb,
        sum(n * (n - 1) / 2) FILTER (side = 'ab') AS pab, any_value(total) AS total
        FROM (SELECT dataset, 'ab' AS side, n FROM cells UNION ALL SELECT dataset, 'a', n FROM rows_
              UNION ALL SELECT dataset, 'b', n FROM cols_) JOIN tot USING (dataset) GROUP BY dataset""",
    "emi": """SELECT dataset, sum(o / t * ln(t::DOUBLE * o / (x::DOUBLE * y)) * exp(
            lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1)
            - lgamma(o + 1) - lgamma(x - o + 1) - lgamma(y - o + 1) - lgamma(t - x - y + o + 1))) AS emi
        FROM (SELECT r.dataset, r.n AS x, c.n AS y, total AS t, unnest(range(greatest(1, r.n + c.n - total), least(r.n, c.n) + 1)) AS o
              FROM rows_ r JOIN cols_ c USING (dataset) JOIN tot USING (dataset)) GROUP BY dataset""",
    "agreed": """SELECT dataset, (pab - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)) AS ari,
        ((ha + hb - hab) - emi) / (greatest(ha, hb) - emi) AS ami, 1 - (ha + hb - hab) / greatest(ha, hb) AS nid,
        (ha + hb - hab) / greatest(ha, hb) AS nmi FROM ent JOIN emi USING (dataset)""",
}


def _agreed(spark, folder, **options):
    return clustering.agreement(views.preds(spark, folder), ["dataset"], "pred", "label", **options)


@query("ari", sql('SELECT dataset, round(ari, 6) AS "ARI" FROM agreed', **_TABLES))
def ari(spark, folder):
    return rounded(_agreed(spark, folder).select("dataset", "ARI"), "ARI")


@query("nmi_nid", sql('SELECT dataset, round(nmi, 6) AS "NMI", round(nid, 6) AS "NID" FROM agreed', **_TABLES))
def nmi_nid(spark, folder):
    return rounded(_agreed(spark, folder).select("dataset", "NMI", "NID"), "NMI", "NID")


@query("ami", sql('SELECT dataset, round(ami, 6) AS "AMI" FROM agreed', **_TABLES))
def ami(spark, folder):
    return rounded(_agreed(spark, folder).select("dataset", "AMI"), "AMI")


@query(
    "cluster_score_table",
    sql(
        """SELECT dataset AS categories, metric, round(CASE WHEN v < 0 THEN 0 ELSE v END, 6) AS "values", 'Tasks' AS dataset
           FROM (SELECT dataset, unnest(['ARI', 'AMI', 'NID', 'NMI']) AS metric, unnest([ari, ami, nid, nmi]) AS v FROM agreed)""",
        **_TABLES,
    ),
)
def cluster_score_table(spark, folder):
    return rounded(clustering.score_table(_agreed(spark, folder), "dataset", "Tasks"), "values")


@query(
    "cluster_score_tables",
    sql(
        """SELECT split_part(dataset, '|', 2) AS categories, metric, round(CASE WHEN v < 0 THEN 0 ELSE v END, 6) AS "values",
                  split_part(dataset, '|', 1) AS dataset
           FROM (SELECT dataset, unnest(['ARI', 'AMI', 'NID', 'NMI']) AS metric, unnest([ari, ami, nid, nmi]) AS v FROM agreed)""",
        **_TABLES
        | {
            "cells": """SELECT dataset, pred AS a, label AS b, count(*) AS n FROM (
                SELECT 'Tasks|' || dataset AS dataset, pred, label FROM preds
                UNION ALL SELECT 'Folds|' || fold, pred, label FROM folded WHERE dataset = 'class10') GROUP BY ALL"""
        },
    ),
)
def cluster_score_tables(spark, folder):
    """The scores of two datasets in one long table."""
    folds = views.folded(spark, folder).where("dataset = 'class10'").select(F.col("fold").cast("string").alias("key"), "pred", "label")
    tasks = views.preds(spark, folder).select(F.col("dataset").alias("key"), "pred", "label")
    agreed = {name: clustering.agreement(df, ["key"], "pred", "label") for name, df in (("Tasks", tasks), ("Folds", folds))}
    return rounded(clustering.score_tables(agreed, "key"), "values")


@query(
    "facet_groups",
    sql(
        """SELECT fine_tuned || ' - ' || vec_type AS facet_label,
                  CASE WHEN fine_tuned = 'Yes' THEN 'Fine-tuned' ELSE 'Base model' END AS fine_tuned,
                  count(*) AS n, count(DISTINCT "Label") AS n_labels FROM points GROUP BY ALL"""
    ),
)
def facet_groups(spark, folder):
    """Facets of plotted points, which come in as a file."""
    path = shared_folder(spark, "points")
    files.write_csv(views.points(spark, folder).select(schemas.UMAP_POINTS.names), path)
    rows = report.facets(files.read_table(spark, path, schemas.UMAP_POINTS))
    return rows.groupBy("facet_label", "fine_tuned").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Label").alias("n_labels")
    )


@query("kmeans_scores")
def kmeans_scores(spark, folder):
    """K-means per facet and its agreement with the labels."""
    rows = report.facets(views.points(spark, folder))
    clustered = clustering.kmeans_by_group(rows, "facet_label", ["UMAP1", "UMAP2"], "Label")
    scores = clustering.agreement(clustered, ["facet_label"], "cluster", "Label")
    return clustering.score_table(scores, "facet_label", "Vectors")


@query(
    "kmeans_fit",
    sql(
        """SELECT fine_tuned || ' - ' || vec_type AS facet_label, count(*) AS n, count(DISTINCT "Label") AS k,
                  count(*) AS n_nearest, 0.0::DOUBLE AS largest_shift FROM points GROUP BY ALL"""
    ),
)
def kmeans_fit(spark, folder):
    """What must hold of k-means: there are k clusters, each point's nearest mean is that of its cluster.

    Means are worked out anew from the clusters; ``largest_shift`` is the widest gap between a point's distance to the mean of
    its cluster and to the nearest mean, which is 0 if centres are means and points are where they belong.
    """
    rows = report.facets(views.points(spark, folder))
    clustered = clustering.kmeans_by_group(rows, "facet_label", ["UMAP1", "UMAP2"], "Label")
    means = clustered.groupBy("facet_label", "cluster").agg(F.avg("UMAP1").alias("x"), F.avg("UMAP2").alias("y"))
    of_group = means.groupBy("facet_label").agg(F.collect_set(F.struct("cluster", "x", "y")).alias("means"), F.count(F.lit(1)).alias("k"))
    away = lambda m: (F.col("UMAP1") - m["x"]) ** 2 + (F.col("UMAP2") - m["y"]) ** 2
    checked = clustered.join(of_group, "facet_label")
    own = F.element_at(F.filter("means", lambda m: m["cluster"] == F.col("cluster")), 1)
    checked = checked.select("facet_label", "k", (away(own) - F.array_min(F.transform("means", away))).alias("gap"))
    return checked.groupBy("facet_label").agg(
        F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.count_if(F.col("gap") <= 1e-9).alias("n_nearest"), F.round(F.max("gap"), 6).alias("largest_shift")
    )


@query("contingency", sql("SELECT dataset, pred AS a, label AS b, count(*) AS n FROM preds GROUP BY ALL"))
def contingency(spark, folder):
    return clustering.contingency(views.preds(spark, folder), ["dataset"], "pred", "label")
