"""Training-log analytics in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.config import LogOptions
from helixframe.operators import trainlog
from helixframe.plans import flows, views
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql

ACCUMULATION = 4


@query(
    "loss_rollup",
    sql(
        """SELECT run, (small_step - 1) // 4 AS completed_steps, round(sum(loss / 4), 6) AS loss, max(small_step) AS small_step
           FROM log GROUP BY run, (small_step - 1) // 4 HAVING count(*) = 4"""
    ),
)
def loss_rollup(spark, folder):
    return rounded(trainlog.loss_rollup(views.log(spark, folder), ACCUMULATION), "loss")


@query("rank_mean", sql("SELECT run, (small_step - 1) // 4 AS step, round(avg(loss), 6) AS loss FROM log GROUP BY ALL"))
def rank_mean(spark, folder):
    """Records of four processes per step, averaged."""
    rows = views.log(spark, folder).withColumn("step", F.floor((F.col("small_step") - 1) / 4))
    return rounded(trainlog.mean_over_processes(rows), "loss")


_EVAL = """SELECT run, count(*) AS n_batches, round({mean}, 6) AS eval_loss, round(exp({mean}), 5) AS perplexity
    FROM (SELECT run, (small_step - 1) // 8 AS batch_id, avg(loss) AS m, count(*) AS c FROM log
          WHERE {cap} GROUP BY ALL) GROUP BY run"""


def _eval_rows(spark, folder):
    return views.log(spark, folder).withColumn("batch_id", F.floor((F.col("small_step") - 1) / 8))


@query("eval_loss_ppl", sql(_EVAL.format(mean="avg(m)", cap="true")))
def eval_loss_ppl(spark, folder):
    return _shown(trainlog.evaluation_loss(_eval_rows(spark, folder)))


@query("eval_loss_by_row", sql(_EVAL.format(mean="sum(m * c) / sum(c)", cap="true")))
def eval_loss_by_row(spark, folder):
    return _shown(trainlog.evaluation_loss(_eval_rows(spark, folder), row_weighted=True))


@query("eval_loss_capped", sql(_EVAL.format(mean="avg(m)", cap="(small_step - 1) // 8 <= 3")))
def eval_loss_capped(spark, folder):
    """Evaluation capped at three steps, which runs four batches."""
    return _shown(trainlog.evaluation_loss(_eval_rows(spark, folder), cap=3))


def _shown(df):
    return rounded(df, "eval_loss").withColumn("perplexity", F.round("perplexity", 5))


_STOPS = {
    "seen": """SELECT run, small_step, loss, max(loss) OVER (PARTITION BY run ORDER BY small_step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM log""",
    "gains": "SELECT *, CASE WHEN best IS NULL OR loss - best > 0.01 THEN small_step END AS gain FROM seen",
    "streaks": """SELECT *, small_step - max(gain) OVER (PARTITION BY run ORDER BY small_step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM gains""",
}


@query(
    "early_stop",
    sql(
        """SELECT run, count(*) AS evaluations, round(max(loss), 6) AS best,
                  min(small_step) FILTER (streak >= 5) AS stop_step FROM streaks GROUP BY run""",
        **_STOPS,
    ),
)
def early_stop(spark, folder):
    log = views.log(spark, folder, settled=True)
    return rounded(trainlog.early_stop(log, ["run"], "small_step", "loss", 5, 0.01), "best")


@query(
    "step_time",
    sql(
        """SELECT run, small_step, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY small_step)) / 1e6, 6) AS time_per_iteration
           FROM log"""
    ),
)
def step_time(spark, folder):
    timed = trainlog.step_times(views.log(spark, folder, settled=True), step="small_step")
    return rounded(timed.select("run", "small_step", "time_per_iteration"), "time_per_iteration")


@query(
    "counters",
    sql("SELECT run, small_step, small_step * 512 AS samples, (small_step - 1) // 4 AS completed_steps FROM log"),
)
def counters(spark, folder):
    rows = views.log(spark, folder).select("run", "small_step")
    return trainlog.with_counters(rows, 512, ACCUMULATION)


# Layers, width and vocabulary of the stand-in models, by run % 3.
_CONFIGS = [("small", 6, 384, 4096), ("base", 12, 768, 4096), ("wide", 12, 768, 65536)]


@query(
    "tflops",
    sql(
        """SELECT run, small_step, model, round(24.0::DOUBLE * 4 * 512 * 512 * n_layer * n_embd * n_embd
                  * (1 + 512 / (6.0::DOUBLE * n_embd) + vocab_size / (16.0::DOUBLE * n_layer * n_embd)) / ((loss + 0.001) * 4 * 1e12), 6) AS tflops
           FROM (SELECT *, ['small', 'base', 'wide'][run % 3 + 1] AS model FROM log)
           JOIN (VALUES ('small', 6, 384, 4096), ('base', 12, 768, 4096), ('wide', 12, 768, 65536))
                c(model, n_layer, n_embd, vocab_size) USING (model)"""
    ),
)
def tflops(spark, folder):
    """Throughput of every step; the loss (plus a millisecond) stands in for elapsed seconds."""
    names = F.array(*[F.lit(c[0]) for c in _CONFIGS])
    log = views.log(spark, folder).select(
        "run", "small_step", F.get(names, (F.col("run") % 3).cast("int")).alias("model"), (F.col("loss") + 0.001).alias("time_per_iteration")
    )
    configs = spark.createDataFrame(_CONFIGS, "model string, n_layer int, n_embd int, vocab_size int")
    timed = trainlog.with_tflops(log, configs, batch_size=512, max_length=512, processes=4)
    return rounded(timed.drop("time_per_iteration"), "tflops")


@query("checkpoint_steps", sql("SELECT run, small_step FROM log WHERE small_step % 10 = 0"))
def checkpoint_steps(spark, folder):
    """Steps at which a checkpoint falls due: every tenth."""
    return trainlog.checkpoint_steps(views.log(spark, folder), 10, "small_step").select("run", "small_step")


@query("resume_filter", sql("SELECT run, small_step FROM log WHERE small_step >= 20"))
def resume_filter(spark, folder):
    return trainlog.resume_from(views.log(spark, folder), 20, "small_step").select("run", "small_step")


@query(
    "latest_step",
    sql(
        """SELECT run, max_by('step_' || small_step, {'at': ts, 'name': 'step_' || small_step}) AS name,
                  max_by(small_step, {'at': ts, 'name': 'step_' || small_step}) AS step FROM log GROUP BY run"""
    ),
)
def latest_step(spark, folder):
    folders = views.log(spark, folder).select(
        "run", F.concat(F.lit("step_"), F.col("small_step")).alias("name"), F.col("ts").alias("created")
    )
    return trainlog.latest_checkpoint(folders, ["run"])


@query(
    "optimizer_log",
    sql(
        """SELECT s.run, s.model, s.completed_steps, s.small_step, s.small_step * 512 AS samples, round(s.loss, 6) AS loss,
                  round(t, 6) AS time_per_iteration,
                  round(24.0::DOUBLE * 4 * 2048 * 512 * n_layer * n_embd * n_embd
                  * (1 + 512 / (6.0::DOUBLE * n_embd) + vocab_size / (16.0::DOUBLE * n_layer * n_embd)) / (t * 4 * 1e12), 6) AS tflops,
                  (s.completed_steps + 1) % 5 = 0 AS checkpoint_due
           FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY small_step)) / 1e6 AS t
                 FROM (SELECT run, ['small', 'base', 'wide'][run % 3 + 1] AS model, (small_step - 1) // 4 AS completed_steps,
                              sum(loss / 4) AS loss, max(small_step) AS small_step, max(ts) AS ts
                       FROM log GROUP BY run, (small_step - 1) // 4 HAVING count(*) = 4)) s
           JOIN (VALUES ('small', 6, 384, 4096), ('base', 12, 768, 4096), ('wide', 12, 768, 65536))
                c(model, n_layer, n_embd, vocab_size) USING (model)"""
    ),
)
def optimizer_log(spark, folder):
    """The whole training log at optimizer-step level."""
    names = F.array(*[F.lit(c[0]) for c in _CONFIGS])
    log = views.log(spark, folder, settled=True).withColumn("model", F.get(names, (F.col("run") % 3).cast("int")))
    configs = spark.createDataFrame(_CONFIGS, "model string, n_layer int, n_embd int, vocab_size int")
    options = LogOptions(gradient_accumulation_steps=ACCUMULATION, save_checkpoint_steps=5)
    return rounded(flows.optimizer_log(log, configs, 512, options), "loss", "time_per_iteration", "tflops")
