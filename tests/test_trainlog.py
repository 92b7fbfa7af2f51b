"""Training-log roll-up."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import trainlog


def brute_stop(metrics, patience, threshold):
    """Step number (from 1) of the stop, by walking through the evaluations."""
    best, waited = None, 0
    for i, m in enumerate(metrics, 1):
        waited = 0 if best is None or m - best > threshold else waited + 1
        best = m if best is None else max(best, m)
        if waited >= patience:
            return i
    return None


@pytest.mark.parametrize("bits", [1, 3, 20])
@pytest.mark.parametrize("patience,threshold", [(1, 0.0), (3, 0.01), (5, 0.1)])
def test_early_stop(spark, bits, patience, threshold):
    rnd = random.Random(patience)
    runs = {
        "rising": [i / 10 for i in range(40)],
        "flat": [1.0] * 40,
        "slow": [i * 0.005 for i in range(40)],
        "one": [0.3],
        "falling": [-i * 0.1 for i in range(20)],
        **{f"r{j}": [round(rnd.gauss(0, 1) + i * 0.05, 3) for i in range(60)] for j in range(8)},
    }
    # Steps are spread out and start anywhere, so blocks may be empty.
    rows = [(r, 7 * i + 3, m) for r, ms in runs.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "run string, step bigint, metric double").repartition(5)
    got = {r["run"]: r for r in trainlog.early_stop(df, ["run"], patience=patience, threshold=threshold, block_bits=bits).collect()}
    for run, ms in runs.items():
        number = brute_stop(ms, patience, threshold)
        assert got[run]["stop_step"] == (None if number is None else 7 * (number - 1) + 3), run
        assert (got[run]["evaluations"], got[run]["best"]) == (len(ms), max(ms))


def test_loss_rollup_leaves_out_the_open_group(spark):
    df = spark.createDataFrame([("a", s, float(s)) for s in range(1, 11)] + [("b", 1, 5.0)], "run string, small_step bigint, loss double")
    out = trainlog.loss_rollup(df, 4)
    assert sorted(tuple(r) for r in out.select("run", "completed_steps", "loss", "small_step").collect()) == [
        ("a", 0, 2.5, 4),
        ("a", 1, 6.5, 8),
    ]


def test_evaluation_loss(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 8.0), ("b", 0, 1000.0)], "run string, batch_id bigint, loss double")
    plain = {r["run"]: r for r in trainlog.evaluation_loss(df).collect()}
    assert plain["a"]["eval_loss"] == 5.0 and plain["a"]["perplexity"] == pytest.approx(math.exp(5))
    assert plain["b"]["perplexity"] == math.inf
    assert {r["run"]: r["eval_loss"] for r in trainlog.evaluation_loss(df, row_weighted=True).collect()}["a"] == 4.0
    many = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "run string, batch_id bigint, loss double")
    assert trainlog.evaluation_loss(many, cap=2).first()["n_batches"] == 3
    assert trainlog.evaluation_loss(many, cap=-1).first()["n_batches"] == 10


def test_step_times(spark):
    df = spark.sql("select 'a' run, id step, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*id) ts from range(5)")
    got = [r["time_per_iteration"] for r in trainlog.step_times(df, block_bits=1).orderBy("step").collect()]
    assert got == [None, 1.0, 3.0, 5.0, 7.0]


def test_tflops(spark):
    log = spark.createDataFrame([("m", 2.0), ("m", 0.0)], "model string, time_per_iteration double")
    config = spark.createDataFrame([("m", 12, 768, 4096)], "model string, n_layer int, n_embd int, vocab_size int")
    got = [r["tflops"] for r in trainlog.with_tflops(log, config, 1024, 512, 4).collect()]
    flops = 24 * 4 * 1024 * 512 * 12 * 768**2 * (1 + 512 / (6 * 768) + 4096 / (16 * 12 * 768))
    assert got == [pytest.approx(flops / (2 * 4 * 1e12)), None]
    cheap = trainlog.with_tflops(log, config, 1024, 512, 4, recompute=False).first()["tflops"]
    assert cheap == pytest.approx(flops / (2 * 4 * 1e12) * 3 / 4)


def test_latest_checkpoint(spark):
    df = spark.createDataFrame(
        [("a", "step_5", 1), ("a", "step_20", 3), ("a", "step_100", 2), ("a", "logs", 9), ("b", "epoch", 1)],
        "run string, name string, created int",
    )
    assert [tuple(r) for r in trainlog.latest_checkpoint(df, ["run"]).collect()] == [("a", "step_20", 20)]


def test_counters_and_filters(spark):
    df = spark.range(1, 9).select(F.col("id").alias("small_step"))
    got = [tuple(r) for r in trainlog.with_counters(df, 64, 4).orderBy("small_step").collect()]
    assert got[0] == (1, 64, 0) and got[3] == (4, 256, 0) and got[4] == (5, 320, 1)
    assert [r[0] for r in trainlog.checkpoint_steps(df, 4, "small_step").collect()] == [4, 8]
    assert [r[0] for r in trainlog.resume_from(df, 7, "small_step").collect()] == [7, 8]


def test_mean_over_processes(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 5.0)], "run string, step bigint, loss double")
    assert sorted(tuple(r) for r in trainlog.mean_over_processes(df).collect()) == [("a", 1, 2.0), ("a", 2, 5.0)]


def test_nan_is_never_a_gain(spark):
    nan = float("nan")
    runs = {"goes_on": [0.5, nan, 0.6, 0.7, 0.8, 0.9], "stops": [0.5, nan, 0.4, 0.4], "first": [nan, nan, nan], "late": [nan, 0.3]}
    rows = [(r, i, m) for r, ms in runs.items() for i, m in enumerate(ms, 1)]
    df = spark.createDataFrame(rows, "run string, step bigint, metric double")
    got = {r["run"]: (r["stop_step"], r["best"]) for r in trainlog.early_stop(df, patience=3, block_bits=1).collect()}
    assert got == {"goes_on": (None, 0.9), "stops": (4, 0.5), "first": (3, None), "late": (None, 0.3)}
