"""Classification evaluation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.config import FoldOptions
from helixframe.functions.hashing import uniform
from helixframe.functions.vector import argmax, as_double, dot, fold_sum
from helixframe.operators import embedding, folds, metrics, probe, stats, tables
from helixframe.plans import views
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql, sql_rounded, sql_scores

SCORES = ["accuracy", "f1_score", "mcc"]


@query(
    "kfold_scores",
    sql(
        """SELECT dataset, metric, round(avg(score), 6) AS score_mean,
                  round(stddev_samp(score) / sqrt(count(*)), 6) AS se,
                  round(avg(score) - stddev_samp(score) / sqrt(count(*)), 6) AS ymin,
                  round(avg(score) + stddev_samp(score) / sqrt(count(*)), 6) AS ymax
           FROM (SELECT dataset, fold, unnest(['accuracy', 'f1_score', 'mcc']) AS metric,
                        unnest([accuracy, f1_score, mcc]) AS score FROM scores)
           GROUP BY dataset, metric""",
        **sql_scores("folded", "dataset, fold"),
    ),
)
def kfold_scores(spark, folder):
    """Scores per fold of each task, then mean and standard error over the folds."""
    bundle = metrics.evaluate(views.folded(spark, folder), ["dataset", "fold"])
    long = tables.wide_to_long(bundle, ["dataset", "fold"], SCORES, "metric", "score")
    return rounded(stats.mean_and_error(long, ["dataset", "metric"]), "score_mean", "se", "ymin", "ymax")


@query("kfold_sizes", sql("SELECT dataset, fold, count(*) AS n FROM folded GROUP BY ALL"))
def kfold_sizes(spark, folder):
    return stats.group_counts(views.folded(spark, folder), ["dataset", "fold"])


@query("kfold_assignment", sql("SELECT dataset, id, fold FROM folded"))
def kfold_assignment(spark, folder):
    return views.folded(spark, folder).select("dataset", "id", "fold")


@query(
    "fold_filter",
    sql(
        """SELECT 'train' AS part, dataset, label, count(*) AS n FROM folded WHERE fold <> 3 GROUP BY ALL
           UNION ALL SELECT 'validation', dataset, label, count(*) FROM folded WHERE fold = 3 GROUP BY ALL"""
    ),
)
def fold_filter(spark, folder):
    rows = views.folded(spark, folder)
    part = lambda df, name: stats.group_counts(df, ["dataset", "label"]).select(
        F.lit(name).alias("part"), "dataset", "label", "n"
    )
    return tables.concat_rows(
        part(folds.fold_train(rows, 3), "train"), part(folds.fold_validation(rows, 3), "validation")
    )


@query("confusion", sql("SELECT dataset, label, pred, count(*) AS n FROM preds GROUP BY ALL"))
def confusion(spark, folder):
    return metrics.confusion(views.preds(spark, folder), ["dataset"])


@query(
    "metrics_bundle",
    sql(f"SELECT dataset, {sql_rounded(*SCORES)} FROM scores", **sql_scores("preds", "dataset")),
)
def metrics_bundle(spark, folder):
    return rounded(metrics.evaluate(views.preds(spark, folder), ["dataset"]), *SCORES)


@query(
    "argmax_logits",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS pred FROM embeddings",
)
def argmax_logits(spark, folder):
    logits = views.table(spark, folder, "embeddings")
    return metrics.predict_from_logits(logits, "embedding").select("vec_id", "pred")


@query(
    "best_fold",
    sql(
        """SELECT dataset, fold, round(mcc, 6) AS mcc FROM (
               SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mcc DESC, fold) AS rn
               FROM scores WHERE mcc > 0) WHERE rn = 1""",
        **sql_scores("folded", "dataset, fold"),
    ),
)
def best_fold(spark, folder):
    bundle = metrics.evaluate(views.folded(spark, folder), ["dataset", "fold"])
    return rounded(metrics.best_fold(bundle, ["dataset"]), "mcc")


@query(
    "result_rows",
    sql(
        """SELECT 'stand_in' AS model, dataset,
                  CASE WHEN fold = 10 THEN 'test' ELSE 'validation' END AS evaluation_set, 'eval_' || metric AS metric,
                  round(score, 6) AS score
           FROM (SELECT dataset, fold, unnest(['accuracy', 'f1_score', 'mcc']) AS metric,
                        unnest([accuracy, f1_score, mcc]) AS score FROM scores)""",
        **sql_scores("folded", "dataset, fold"),
    ),
)
def result_rows(spark, folder):
    bundle = metrics.evaluate(views.folded(spark, folder), ["dataset", "fold"])
    model, dataset = F.lit("stand_in"), F.col("dataset")
    rows = tables.concat_rows(
        metrics.result_rows(folds.fold_train(bundle, 10), SCORES, "validation", model, dataset),
        metrics.result_rows(folds.fold_validation(bundle, 10), SCORES, "test", model, dataset),
    )
    return rounded(rows, "score")


@query("linear_probe")
def linear_probe(spark, folder):
    """Five folds of a linear classifier on the vectors, the best one on held-out rows."""
    return _vector_probe(spark, folder).results


def _vector_rows(spark, folder):
    rows = views.table(spark, folder, "embeddings").withColumn("vec", as_double(F.col("embedding")))
    return probe.vector_features(rows).select("vec_id", "label", "features"), uniform("test", 5, "vec_id") < 0.2


def _vector_probe(spark, folder):
    rows, held_out = _vector_rows(spark, folder)
    return probe.cross_validate(
        rows.where(~held_out), rows.where(held_out), "vec_id", "linear", "class10", FoldOptions(folds=5)
    )


@query("kmer_probe")
def kmer_probe(spark, folder):
    """The same flow on hashed k-mer counts of the labelled sequences."""
    tagged = views.seqs(spark, folder).join(
        views.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"
    )
    rows = probe.kmer_features(tagged, k=3, width=256).select("doc_id", "label", "features")
    held_out = uniform("test", 5, "doc_id") < 0.2
    found = probe.cross_validate(
        rows.where(~held_out), rows.where(held_out), "doc_id", "kmer3", "quality", FoldOptions(folds=3)
    )
    return found.results


@query("pca")
def pca(spark, folder):
    """Standardised vectors on four principal components."""
    rows = views.table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    scaled = embedding.standardise(rows)
    coords, _ = embedding.principal_components(scaled, "scaled", 4)
    return coords.select("vec_id", "label", *[F.get("pc", F.lit(i)).alias(f"pc{i + 1}") for i in range(4)])


@query("pca_explained")
def pca_explained(spark, folder):
    rows = views.table(spark, folder, "embeddings").select(F.col("embedding").alias("vec"))
    return embedding.principal_components(embedding.standardise(rows), "scaled", 4)[1]


_BY_TYPE = """SELECT vec_id, ['Mean', 'Max', 'CLS'][vec_id % 3 + 1] AS vec_type, unnest(range(64)) AS dim,
    unnest(embedding::DOUBLE[]) AS x FROM embeddings"""
_SCALED = """SELECT vec_id, vec_type, dim, CASE WHEN {sd}(x) OVER w = 0 THEN 0 ELSE (x - avg(x) OVER w) / {sd}(x) OVER w END AS z
    FROM cells WINDOW w AS (PARTITION BY vec_type, dim)"""


def _by_type(spark, folder):
    names = F.array(*[F.lit(n) for n in ("Mean", "Max", "CLS")])
    return views.table(spark, folder, "embeddings").select(
        "vec_id", F.get(names, (F.col("vec_id") % 3).cast("int")).alias("vec_type"), F.col("embedding").alias("vec")
    )


@query(
    "pca_lengths",
    sql(
        "SELECT vec_id, vec_type, round(sqrt(sum(z * z)), 5) AS length FROM scaled GROUP BY ALL",
        cells=_BY_TYPE,
        scaled=_SCALED.format(sd="stddev_pop"),
    ),
)
def pca_lengths(spark, folder):
    """Vectors on all 64 components of their group: a turn of the axes, so every vector keeps its length."""
    coords, _ = embedding.principal_components_by(_by_type(spark, folder), "vec", 64, "vec_type", sample_sd=False)
    length = F.sqrt(F.aggregate("pc", F.lit(0.0), lambda a, x: a + x * x))
    return coords.select("vec_id", "vec_type", F.round(length, 5).alias("length"))


@query(
    "pca_by_type",
    sql(
        """SELECT vec_type, count(DISTINCT vec_id) AS n, round(sum(z * z) / (count(DISTINCT vec_id) - 1), 5) AS total_variance,
                  0.0::DOUBLE AS largest_mean, 0.0::DOUBLE AS largest_covariance, 0::BIGINT AS not_falling, 0.0::DOUBLE AS ratio_error
           FROM scaled GROUP BY vec_type""",
        cells=_BY_TYPE,
        scaled=_SCALED.format(sd="stddev_samp"),
    ),
)
def pca_by_type(spark, folder):
    """What must hold of the components of each group.

    Their variances add up to the variance of the vectors and fall, each is its share of the
    whole, their means are 0, and so are the covariances of neighbours.
    """
    coords, explained = embedding.principal_components_by(_by_type(spark, folder), "vec", 64, "vec_type")
    cells = coords.select("vec_id", "vec_type", F.posexplode("pc").alias("dim", "x"), F.col("pc").alias("all"))
    along = cells.withColumn("next", F.get("all", F.col("dim") + 1)).groupBy("vec_type", "dim").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mean"),
        F.var_samp("x").alias("variance"),
        F.covar_samp("x", "next").alias("covariance"),
    )
    shares = explained.select("vec_type", (F.col("component") - 1).alias("dim"), "ratio")
    group = Window.partitionBy("vec_type")
    checked = along.join(shares, ["vec_type", "dim"]).withColumns(
        {
            "total": F.sum("variance").over(group),
            "before": F.lag("variance").over(group.orderBy("dim")),
        }
    )
    near_zero = lambda c: F.round(F.max(F.abs(c)), 6)
    return checked.groupBy("vec_type").agg(
        F.max("n").alias("n"),
        F.round(F.max("total"), 5).alias("total_variance"),
        near_zero(F.col("mean")).alias("largest_mean"),
        near_zero(F.coalesce("covariance", F.lit(0.0))).alias("largest_covariance"),
        F.count(F.when(F.col("variance") > F.col("before") + 1e-9, 1)).alias("not_falling"),
        near_zero(F.col("ratio") - F.col("variance") / F.col("total")).alias("ratio_error"),
    )


@query(
    "probe_folds",
    sql(
        f"""SELECT fold, label, count(*) AS n FROM (
               SELECT label, ntile(5) OVER (ORDER BY md5('fold:123:' || vec_id), vec_id)::INT AS fold
               FROM embeddings WHERE NOT {views.sql_uniform('test', 5, 'vec_id')} < 0.2) GROUP BY ALL"""
    ),
)
def probe_folds(spark, folder):
    """Each training row is predicted once, in its fold, by the model that has not seen it."""
    found = _vector_probe(spark, folder)
    return stats.group_counts(found.predictions, ["fold", "label"])


@query(
    "probe_fit",
    sql(
        """SELECT fold, count(*) AS n_predicted, (SELECT count(*) FROM parts) - count(*) AS n_trained, count(*) AS n_same, true AS at_optimum
           FROM parts GROUP BY fold""",
        parts=f"""SELECT ntile(5) OVER (ORDER BY md5('fold:123:' || vec_id), vec_id)::INT AS fold
                  FROM embeddings WHERE NOT {views.sql_uniform('test', 5, 'vec_id')} < 0.2""",
    ),
)
def probe_fit(spark, folder):
    """What must hold of the fitted folds: predictions follow from the weights, and the gradient of each fold's loss is 0.

    Both are worked out anew by column functions: scores of each row by the model of its fold, and for every fold the mean of
    (probability - label) x features over the rows of the others, with the penalty added.
    """
    rows, held_out = _vector_rows(spark, folder)
    reg, found = 1e-3, _vector_probe(spark, folder)
    models = [(k, [[float(v) for v in row] for row in m.weights], [float(v) for v in m.scale], m.labels) for k, m in found.models.items()]
    models = spark.createDataFrame(models, "model int, weights array<array<double>>, scale array<double>, labels array<int>")
    train = rows.where(~held_out).select("vec_id", "label", vector_to_array("features").alias("x"))
    folded = train.join(found.predictions.select("vec_id", "fold", "pred"), "vec_id")
    every = folded.withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(5)))).join(models, "model")
    scaled = F.concat(F.zip_with("x", "scale", lambda v, sd: v / sd), F.array(F.lit(1.0)))
    every = every.withColumn("z", scaled).withColumn("scores", F.transform("weights", lambda w: dot(F.col("z"), w)))
    own = every.where("model = fold").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count_if(F.get("labels", argmax(F.col("scores"))) == F.col("pred")).alias("n_same")
    )
    powers = F.transform("scores", lambda v: F.exp(v - F.array_max("scores")))
    others = every.where("model <> fold").withColumn("powers", powers)
    share = F.transform("powers", lambda v: v / fold_sum(F.col("powers")))
    errors = F.zip_with(share, "labels", lambda p, c: p - F.when(c == F.col("label"), 1.0).otherwise(0.0))
    parts = F.flatten(F.transform("errors", lambda e: F.transform("z", lambda v: e * v)))
    mean = others.withColumn("errors", errors).select("model", array_to_vector(parts).alias("g")).groupBy("model")
    mean = mean.agg(vector_to_array(Summarizer.mean(F.col("g"))).alias("g"), F.count(F.lit(1)).alias("n_trained")).join(models, "model")
    penalty = F.flatten(F.transform("weights", lambda w: F.concat(F.slice(w, F.lit(1), F.size(w) - 1), F.array(F.lit(0.0)))))
    largest = F.array_max(F.zip_with("g", penalty, lambda g, w: F.abs(g + reg * w)))
    return mean.select(F.col("model").alias("fold"), "n_trained", (largest < 1e-4).alias("at_optimum")).join(own, "fold")
