"""Pooling, standardising and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import embedding, pooling, tables
from helixframe.plans import report, views
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql
from helixframe.session import shared_folder
from helixframe.sources import files


def _cells(df, key: str, vec: str):
    return df.select(key, F.posexplode(vec).alias("dim", "value")).withColumns(
        {"dim": F.col("dim").cast("bigint"), "value": F.round("value", 6)}
    )


def _pooled(spark, folder, **options):
    return pooling.pool(views.hidden(spark, folder), **options)


_POOLED = """SELECT seq_id, dim, sum(x * mask) / greatest(sum(mask), 1) AS mean_v, max(x * mask) + 0::DOUBLE AS max_v,
    any_value(x) FILTER (pos = 0) AS cls_v FROM hidden_cells GROUP BY seq_id, dim"""


@query("pool_mean", sql("SELECT seq_id, dim, round(mean_v, 6) AS value FROM pooled", pooled=_POOLED))
def pool_mean(spark, folder):
    return _cells(_pooled(spark, folder), "seq_id", "mean_vec")


@query(
    "pool_mean_plain",
    sql(
        """SELECT seq_id, dim, round(CASE WHEN sum(mask) = 0 THEN 'NaN'::DOUBLE ELSE sum(x * mask) / sum(mask) END, 6) AS value
           FROM hidden_cells GROUP BY seq_id, dim"""
    ),
)
def pool_mean_plain(spark, folder):
    """Without the lower bound of one token: NaN for a sequence of padding."""
    return _cells(_pooled(spark, folder, empty_as_zero=False), "seq_id", "mean_vec")


@query("pool_max", sql("SELECT seq_id, dim, round(max_v, 6) AS value FROM pooled", pooled=_POOLED))
def pool_max(spark, folder):
    return _cells(_pooled(spark, folder), "seq_id", "max_vec")


@query(
    "pool_max_real",
    sql(
        """SELECT seq_id, dim, round(max(CASE WHEN mask = 1 THEN x ELSE '-Infinity'::DOUBLE END), 6) AS value
           FROM hidden_cells GROUP BY seq_id, dim HAVING max(mask) = 1"""
    ),
)
def pool_max_real(spark, folder):
    """Maximum over real tokens only, for sequences that have any."""
    pooled = _pooled(spark, folder, exclude_pad=True)
    return _cells(pooled.where(F.col("max_vec").isNotNull()), "seq_id", "max_vec")


@query("pool_cls", sql("SELECT seq_id, dim, round(cls_v, 6) AS value FROM pooled", pooled=_POOLED))
def pool_cls(spark, folder):
    return _cells(_pooled(spark, folder), "seq_id", "cls_vec")


@query(
    "pool_concat",
    sql(
        """SELECT seq_id, dim, round(cls_v, 6) AS value FROM pooled
           UNION ALL SELECT seq_id, 64 + dim, round(max_v, 6) FROM pooled
           UNION ALL SELECT seq_id, 128 + dim, round(mean_v, 6) FROM pooled""",
        pooled=_POOLED,
    ),
)
def pool_concat(spark, folder):
    return _cells(_pooled(spark, folder), "seq_id", "concat_vec")


@query(
    "labelled_vectors",
    sql(
        """SELECT p.seq_id, t.vec_type, 'Base' AS model_type, l.label, round(sum(CASE t.vec_type WHEN 'Mean' THEN mean_v
               WHEN 'Max' THEN max_v ELSE cls_v END), 5) AS total
           FROM pooled p JOIN (SELECT seq_id, max(label) AS label FROM hidden GROUP BY seq_id) l USING (seq_id)
           CROSS JOIN (VALUES ('Mean'), ('Max'), ('CLS')) t(vec_type) GROUP BY ALL""",
        pooled=_POOLED,
    ),
)
def labelled_vectors(spark, folder):
    labels = views.hidden(spark, folder).groupBy("seq_id").agg(F.max("label").alias("label"))
    long = pooling.labelled_vectors(_pooled(spark, folder), "Base", labels)
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5)
    return long.select("seq_id", "vec_type", "model_type", "label", total.alias("total"))


_CELLS = "SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings"


@query(
    "standardise",
    sql(
        """SELECT vec_id, dim, round(CASE WHEN stddev_pop(x) OVER w = 0 THEN 0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END, 6) AS value
           FROM cells WINDOW w AS (PARTITION BY dim)""",
        cells=_CELLS,
    ),
)
def standardise(spark, folder):
    rows = views.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return _cells(embedding.standardise(rows), "vec_id", "scaled")


@query(
    "standardise_by_label",
    sql(
        """SELECT vec_id, dim, round(CASE WHEN stddev_samp(x) OVER w = 0 THEN 0 ELSE (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 6) AS value
           FROM cells WINDOW w AS (PARTITION BY label, dim)""",
        cells=_CELLS,
    ),
)
def standardise_by_label(spark, folder):
    rows = views.table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return _cells(embedding.standardise(rows, by=["label"], sample_sd=True), "vec_id", "scaled")


_PAIRS = """SELECT a.token, a.model, sum((a.x - b.x) * (a.x - b.x)) AS d2, sum(a.x * b.x) AS ab,
    sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb
    FROM token_cells a JOIN token_cells b ON a.token = b.token AND a.dim = b.dim AND b.model = 'base'
    WHERE a.model <> 'base' GROUP BY ALL"""
_WIDE = """SELECT token, max(value) FILTER (model = 'Ms') AS "Ms", max(value) FILTER (model = 'Mp') AS "Mp",
    max(value) FILTER (model = 'Me') AS "Me" FROM ({long}) GROUP BY token"""
VARIANTS = ["Ms", "Mp", "Me"]


@query(
    "token_l2",
    sql(_WIDE.format(long="SELECT token, model, round(sqrt(d2), 6) AS value FROM pairs"), pairs=_PAIRS),
)
def token_l2(spark, folder):
    long = embedding.drift(views.tokens(spark, folder), "l2")
    return rounded(embedding.drift_wide(long, VARIANTS), *VARIANTS)


@query(
    "token_cosine",
    sql(
        _WIDE.format(long="SELECT token, model, round(ab / (sqrt(aa) * sqrt(bb)), 6) AS value FROM pairs"),
        pairs=_PAIRS,
    ),
)
def token_cosine(spark, folder):
    long = embedding.drift(views.tokens(spark, folder), "cosine")
    return rounded(embedding.drift_wide(long, VARIANTS), *VARIANTS)


_SHOWN = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in views.NAMES.variants.items()) + " END"


@query(
    "drift_long",
    sql(f"SELECT token, {_SHOWN} AS model, round(sqrt(d2), 6) AS value FROM pairs", pairs=_PAIRS),
)
def drift_long(spark, folder):
    wide = embedding.drift_wide(embedding.drift(views.tokens(spark, folder), "l2"), VARIANTS)
    return rounded(report.drift_long(wide, views.NAMES, ["token"]), "value")


_FENCE = "b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)"


@query(
    "drift_boxes",
    sql(
        f"""SELECT model, count(*) AS n, round(any_value(b1), 6) AS q1, round(any_value(b2), 6) AS median,
                  round(any_value(b3), 6) AS q3, round(min(v) FILTER (v BETWEEN {_FENCE}), 6) AS whisker_low,
                  round(max(v) FILTER (v BETWEEN {_FENCE}), 6) AS whisker_high,
                  count(*) FILTER (v NOT BETWEEN {_FENCE}) AS n_outliers
            FROM (SELECT {_SHOWN} AS model, v, quantile_cont(v, 0.25) OVER w AS b1, quantile_cont(v, 0.5) OVER w AS b2,
                         quantile_cont(v, 0.75) OVER w AS b3
                  FROM (SELECT model, round(sqrt(d2), 9) AS v FROM pairs) WINDOW w AS (PARTITION BY model)) GROUP BY ALL""",
        pairs=_PAIRS,
    ),
)
def drift_boxes(spark, folder):
    """Token drift written as a file and summed up from it."""
    long = embedding.drift(views.tokens(spark, folder), "l2")
    path = shared_folder(spark, "drift")
    drifted = embedding.drift_wide(rounded(long, "value", digits=9), VARIANTS)
    files.write_csv(drifted.select(schemas.TOKEN_DRIFT.names), path)
    wide = files.read_table(spark, path, schemas.TOKEN_DRIFT)
    return rounded(report.drift_boxes(wide, views.NAMES), "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "token_xy_lengths",
    sql(
        f"""SELECT token, length(token)::INT AS token_len, {_SHOWN} AS model,
                   (CASE model WHEN 'Me' THEN 1 WHEN 'Mp' THEN 2 WHEN 'Ms' THEN 3 WHEN 'base' THEN 4 END)::INT AS ord,
                   token IN ('aaagaa', 'gaagcga', 'gacgacca') AS marked, round(vec[1], 6) AS x, round(vec[2], 6) AS y
            FROM tokens WHERE token_length > 5 AND token_length < 9"""
    ),
)
def token_xy_lengths(spark, folder):
    """Token coordinates, through a file, for the token map."""
    path = shared_folder(spark, "token-xy")
    rows = views.tokens(spark, folder).where(tables.open_range("token_length", 5, 9)).select(
        F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"), "token", "model"
    )
    files.write_csv(rows, path)
    points = files.read_table(spark, path, schemas.TOKEN_XY)
    return rounded(report.token_map(points, views.NAMES), "x", "y")
