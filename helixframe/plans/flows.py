"""Whole flows composed from operators: training batches and the optimizer-step log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import CorpusOptions, LogOptions
from helixframe.operators import corpus, ordering, trainlog


def training_batches(
    chunks: DataFrame, key: str, options: CorpusOptions = CorpusOptions(), epoch: int = 0, k: int = 6
) -> DataFrame:
    """Shuffled, masked model inputs of fixed length with their batch number.

    The order is worked out on the keys alone, so sequences move once, in the join.
    """
    order = ordering.buffered_shuffle(
        chunks.select(key), key, options.effective_buffer(), options.seed
    ).withColumn("batch_id", F.floor(F.col("position") / options.train_batch_size).cast("bigint"))
    return _model_inputs(chunks.join(order, key), key, options, epoch, k)


def evaluation_batches(chunks: DataFrame, key: str, options: CorpusOptions = CorpusOptions(), k: int = 6) -> DataFrame:
    """Masked model inputs in table order, up to the evaluation cap."""
    batches = ordering.assign_batches(chunks.select(key), key, options.valid_batch_size)
    kept = ordering.cap_batches(batches, options.max_eval_steps)
    return _model_inputs(chunks.join(kept, key), key, options, 0, k)


def _model_inputs(chunks: DataFrame, key: str, options: CorpusOptions, epoch: int, k: int) -> DataFrame:
    """Tokenise, mask, and only then pad: padding is never masked, so it need not be looked at."""
    rows = corpus.mask_tokens(
        corpus.tokenise(chunks, k=k, max_length=options.max_length),
        key,
        corpus.kmer_vocab_size(k),
        options.mlm_probability,
        options.seed,
        epoch,
    )
    labels = corpus.padded(F.col("labels"), options.max_length, corpus.IGNORED_LABEL)
    return corpus.pad(rows.withColumn("labels", labels), options.max_length)


def optimizer_log(
    log: DataFrame, model_config: DataFrame, max_length: int, options: LogOptions = LogOptions()
) -> DataFrame:
    """One row per optimizer step: loss, samples seen, seconds, TFLOP/s, whether a checkpoint is due.

    ``log`` has (run, model, small_step, ts, loss), one row per process and micro-step; a
    micro-step's time is that of its slowest process. Seconds count from the optimizer step
    before. Two aggregations, no join of the log with itself. Runs a job (``step_times``).
    """
    g = options.gradient_accumulation_steps
    micro = log.groupBy("run", "small_step").agg(
        F.avg("loss").alias("loss"), F.max("ts").alias("ts"), F.max("model").alias("model")
    )
    timed = trainlog.step_times(trainlog.loss_rollup(micro, g, last=["ts", "model"]), step="small_step")
    per_micro = options.train_batch_size * options.processes
    rows = trainlog.with_tflops(timed, model_config, per_micro * g, max_length, options.processes)
    return rows.select(
        "run",
        "model",
        "completed_steps",
        "small_step",
        (F.col("small_step") * per_micro).alias("samples"),
        "loss",
        "time_per_iteration",
        "tflops",
        ((F.col("completed_steps") + 1) % options.save_checkpoint_steps == 0).alias("checkpoint_due"),
    )
