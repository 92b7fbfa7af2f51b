"""Training-log analytics in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions.text import step_from_name
from helixframe.operators.ordering import BLOCK, cap_batches, int_block, previous_value, with_carry


def mean_over_processes(df: DataFrame, keys: Sequence[str] = ("run", "step"), value: str = "loss") -> DataFrame:
    """One value per step from those of all processes."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def loss_rollup(
    df: DataFrame,
    accumulation: int,
    run: str = "run",
    step: str = "small_step",
    loss: str = "loss",
    last: Sequence[str] = (),
) -> DataFrame:
    """Optimizer-step loss: the sum of loss / g over g micro-steps.

    Micro-steps count from 1. A last group that is not full is never flushed.
    Columns in ``last`` keep their value at the group's last micro-step.
    Grouping by (run, group) spreads even a single huge run.
    """
    group = F.floor((F.col(step) - 1) / accumulation).cast("bigint")
    return (
        df.groupBy(F.col(run), group.alias("completed_steps"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.col(loss) / accumulation).alias("loss"),
            F.max(step).alias(step),
            *[F.max_by(c, step).alias(c) for c in last],
        )
        .where(F.col("_n") == accumulation)
        .drop("_n")
    )


def perplexity(loss: Column) -> Column:
    """exp of the loss; a loss too large for a double gives infinity."""
    return F.exp(loss)


def evaluation_loss(
    df: DataFrame,
    keys: Sequence[str] = ("run",),
    batch: str = "batch_id",
    loss: str = "loss",
    cap: int = 0,
    row_weighted: bool = False,
) -> DataFrame:
    """Mean loss over evaluation batches with its perplexity.

    Every batch weighs the same, a short one included, unless ``row_weighted``.
    """
    capped = cap_batches(df, cap, batch)
    per_batch = capped.groupBy(*keys, batch).agg(
        F.avg(loss).alias("_mean"), F.count(F.lit(1)).cast("double").alias("_rows")
    )
    weight = F.col("_rows") if row_weighted else F.lit(1.0)
    mean = F.sum(F.col("_mean") * weight) / F.sum(weight)
    return (
        per_batch.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_batches"), mean.alias("eval_loss"))
        .withColumn("perplexity", perplexity(F.col("eval_loss")))
    )


def with_counters(df: DataFrame, samples_per_step: int, accumulation: int, small_step: str = "small_step") -> DataFrame:
    """Samples seen and optimizer steps done at each micro-step."""
    return df.withColumns(
        {
            "samples": F.col(small_step) * samples_per_step,
            "completed_steps": F.floor((F.col(small_step) - 1) / accumulation).cast("bigint"),
        }
    )


def step_times(
    df: DataFrame, run: str = "run", step: str = "step", ts: str = "ts", block_bits: int = 20
) -> DataFrame:
    """Seconds since the record before in the run, NULL for the first. Runs a job, see ``ordering.with_carry``."""
    out = previous_value(df, ts, step, [run], block_bits, "_before")
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    return out.withColumn("time_per_iteration", micros / 1e6).drop("_before")


def tflops(
    elapsed: Column,
    batch_size: Column,
    max_length: Column,
    n_layer: Column,
    n_embd: Column,
    vocab_size: Column,
    processes: Column,
    recompute: bool = True,
) -> Column:
    """Model TFLOP/s per process of one optimizer step.

    Equation 3 of "Efficient Large-Scale Language Model Training on GPU Clusters"
    (arXiv:2104.04473); ``batch_size`` is the global one, and activation
    recomputation costs one more forward pass. NULL where no time has passed.
    """
    passes = 4.0 if recompute else 3.0
    width = n_embd.cast("double")
    layers = n_layer.cast("double")
    tokens = batch_size.cast("double") * max_length
    attention = max_length / (6.0 * width)
    logits = vocab_size / (16.0 * layers * width)
    flops = 24.0 * passes * tokens * layers * width * width * (1.0 + attention + logits)
    return F.try_divide(flops, elapsed * processes * 1e12)


def with_tflops(
    log: DataFrame,
    model_config: DataFrame,
    batch_size: int,
    max_length: int,
    processes: int,
    recompute: bool = True,
    model: str = "model",
    elapsed: str = "time_per_iteration",
) -> DataFrame:
    """Add ``tflops`` from a model table (model, n_layer, n_embd, vocab_size)."""
    value = tflops(
        F.col(elapsed),
        F.lit(batch_size),
        F.lit(max_length),
        F.col("n_layer"),
        F.col("n_embd"),
        F.col("vocab_size"),
        F.lit(processes),
        recompute,
    )
    out = log.join(model_config.select(model, "n_layer", "n_embd", "vocab_size"), model, "left")
    return out.withColumn("tflops", value).drop("n_layer", "n_embd", "vocab_size")


def checkpoint_steps(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) % every == 0)


def resume_from(df: DataFrame, step_reached: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) >= step_reached)


def latest_checkpoint(df: DataFrame, keys: Sequence[str], name: str = "name", created: str = "created") -> DataFrame:
    """Name and step of the checkpoint folder created last."""
    return (
        df.where(F.col(name).contains("step"))
        .groupBy(*keys)
        .agg(F.max_by(name, F.struct(created, name)).alias(name))
        .withColumn("step", step_from_name(F.col(name)))
    )


def early_stop(
    df: DataFrame,
    keys: Sequence[str] = ("run",),
    step: str = "step",
    metric: str = "metric",
    patience: int = 5,
    threshold: float = 0.01,
    block_bits: int = 20,
) -> DataFrame:
    """Where each run would stop: its ``patience``-th evaluation in a row without a gain.

    An evaluation gains if it beats the best of all earlier ones by more than
    ``threshold``; the best itself moves on any improvement. The first one always
    gains. A NaN or NULL metric is never a gain and never moves the best. Runs that never stop have a NULL ``stop_step``.

    A run is worked on in blocks of steps. The best so far, the number of
    evaluations and the number of the last gain are carried from block to block. Runs two
    jobs, one per carried table; with the result the log is read three times.
    """
    keys = list(keys)
    real = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric)).alias(metric)
    base = df.select(*keys, step, real).withColumn(BLOCK, int_block(step, block_bits))
    ordered = Window.partitionBy(*keys, BLOCK).orderBy(step)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns(
        {"_local_best": F.max(metric).over(before), "_local_no": F.row_number().over(ordered)}
    )
    seen = with_carry(local, keys, {"_best": (F.max(metric), "max"), "_count": (F.count(F.lit(1)), "sum")})
    best = F.greatest("_local_best", "_best")
    gain = F.col(metric).isNotNull() & (best.isNull() | (F.col(metric) - best > threshold))
    numbered = seen.withColumn("_no", F.col("_local_no") + F.coalesce("_count", F.lit(0)))
    gains = numbered.withColumn("_gain", F.when(gain, F.col("_no"))).drop(
        "_local_best", "_best", "_local_no", "_count"
    )
    known = with_carry(
        gains.withColumn("_local_gain", F.max("_gain").over(upto)),
        keys,
        {"_earlier_gain": (F.max("_gain"), "max")},
    )
    streak = F.col("_no") - F.coalesce(F.greatest("_local_gain", "_earlier_gain"), F.lit(0))
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.max(metric).alias("best"),
        F.min(F.when(streak >= patience, F.col(step))).alias("stop_step"),
    )
