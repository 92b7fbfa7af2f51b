"""Streams give what the batch operators give, in any arrival order and across restarts."""

import datetime as dt
import random

import pytest

from helixframe.config import EarlyStopOptions
from helixframe.operators import corpus as batch_corpus
from helixframe.operators import trainlog
from helixframe.streaming import corpus, log, run


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    run.use_rocksdb(spark)


def arrivals(spark, rows, schema, folder, parts, seed=1):
    """Write rows in random order over several files, read one file per micro-batch."""
    rows = rows[:]
    random.Random(seed).shuffle(rows)
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_loss_rollup_across_batches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(r, s, rnd.random()) for r in ("a", "b") for s in range(1, 43)]
    schema = "run string, small_step bigint, loss double"
    stream = arrivals(spark, rows, schema, f"{tmp_path}/in", 4)
    done = run.materialise(log.loss_rollup_stream(stream, 4), "test-rollup")
    want = trainlog.loss_rollup(spark.createDataFrame(rows, schema), 4)
    columns = ["run", "completed_steps", "small_step"]
    a = {tuple(r[c] for c in columns): r["loss"] for r in done.collect()}
    b = {tuple(r[c] for c in columns): r["loss"] for r in want.collect()}
    assert done.count() == want.count() == 20
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("block", [4, 4096])
def test_early_stop_waits_for_missing_steps(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(log, "EVALUATIONS_PER_BLOCK", block)
    rnd = random.Random(3)
    nan = float("nan")
    holes = {"hole": [0.5, nan, 0.6, 0.7, 0.8, 0.9], "stuck": [0.5, nan, 0.4, 0.4, 0.4, 0.4], "none": [nan] * 6}
    runs = {**holes, "flat": [1.0] * 12, "rising": [float(i) for i in range(12)], **{f"r{i}": [rnd.random() + j * 0.02 for j in range(60)] for i in range(8)}}
    rows = [(r, i, m) for r, ms in runs.items() for i, m in enumerate(ms, 1)]
    repeated = rows + rows[::7]
    stream = arrivals(spark, repeated, "run string, eval_no bigint, metric double", f"{tmp_path}/in", 5)
    done = run.materialise(log.early_stop_stream(stream, EarlyStopOptions(4, 0.05)), "test-stop")
    table = spark.createDataFrame(rows, "run string, step bigint, metric double")
    stops = trainlog.early_stop(table, patience=4, threshold=0.05).where("stop_step is not null")
    assert {r["run"]: r["stop_no"] for r in done.collect()} == {r["run"]: r["stop_step"] for r in stops.collect()}
    assert done.count() == stops.count()


def test_tokenise_stream_resumes_without_repeats(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def write(first, last):
        rows = [("train", "a", "c", 0, 6, f"s{i}", "ACGTAC" * (i % 4)) for i in range(first, last)]
        df = spark.createDataFrame(rows, "split string, assembly_id string, assembly_accession string, start bigint, sequence_length int, seq_id string, sequence string")
        df.write.mode("append").csv(source, sep="\t", header=True)
        return df

    def go():
        run.append_available(corpus.tokenise_stream(corpus.read_chunk_stream(spark, source), max_length=8), out, checkpoint)

    one = write(0, 10)
    go()
    assert spark.read.parquet(out).count() == 10
    two = write(10, 25)
    go()
    go()
    done = spark.read.parquet(out)
    assert set(done.columns) == {"seq_id", "input_ids", "attention_mask"}
    want = batch_corpus.pad(batch_corpus.tokenise(one.union(two).select("seq_id", "sequence"), max_length=8), 8)
    key = lambda r: r["seq_id"]
    got = [tuple(r) for r in sorted(done.select("seq_id", "input_ids", "attention_mask").collect(), key=key)]
    assert got == [tuple(r) for r in sorted(want.select("seq_id", "input_ids", "attention_mask").collect(), key=key)]


def test_tokenise_stream_keeps_whole_texts(spark, tmp_path):
    stream = arrivals(spark, [("a", "ACGTAC" * 700), ("b", "ACG")], "seq_id string, sequence string", f"{tmp_path}/in", 1)
    sizes = lambda df, name: {r["seq_id"]: len(r["input_ids"]) for r in run.materialise(df, name).collect()}
    assert sizes(corpus.tokenise_stream(stream), "test-whole") == {"a": 702, "b": 5}
    assert sizes(corpus.tokenise_stream(stream, width=8), "test-wide") == {"a": 702, "b": 8}
    assert sizes(corpus.tokenise_stream(stream, max_length=512), "test-cut") == {"a": 512, "b": 512}


def timed_rows(rnd, n=400):
    start = dt.datetime(2024, 3, 1)
    return [(start + dt.timedelta(seconds=rnd.randint(0, 40_000)), rnd.choice(["a", "b", None]), rnd.choice([None, rnd.random()])) for _ in range(n)]


SCHEMA = "ts timestamp, kind string, value double"


def rolled(df):
    return {(r["start"], r["kind"]): (r["n"], r["total"] and round(r["total"], 9), r["least"], r["most"]) for r in df.collect()}


def test_event_time_rollup_is_the_batch_result_with_a_restart(spark, tmp_path):
    rnd = random.Random(6)
    rows = sorted(timed_rows(rnd), key=lambda r: r[0])
    late = [r for r in rows[:100] if rnd.random() < 0.2]  # hours behind when they come
    kept = [r for r in rows if r not in late]
    path, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    size = -(-len(kept) // 5)
    parts = [kept[i * size : (i + 1) * size] for i in range(5)] + [late, [(None, "a", 1.0)]]
    for some in (parts[:3], parts[3:]):
        for part in some:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        run.append_available(log.event_time_rollup(stream, ["kind"], "1 hour", "10 minutes"), out, checkpoint)
    got = spark.read.parquet(out)
    whole = rolled(log.event_time_rollup(spark.createDataFrame(kept, SCHEMA), ["kind"], delay=None))
    end = max(r[0] for r in kept) - dt.timedelta(minutes=10)
    closed = {k: v for k, v in whole.items() if k[0] + dt.timedelta(hours=1) <= end}
    assert len(closed) > 20 and rolled(got) == closed and got.count() == len(closed)  # each window once


def test_event_time_rollup_of_a_table_and_of_nothing(spark):
    rows = timed_rows(random.Random(7)) + [(None, "a", 1.0)]
    got = rolled(log.event_time_rollup(spark.createDataFrame(rows, SCHEMA), ["kind"], delay=None))
    want = {}
    for ts, kind, value in rows[:-1]:
        want.setdefault((ts.replace(minute=0, second=0), kind), []).append(value)
    real = {k: [v for v in vs if v is not None] for k, vs in want.items()}
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(v[1] == (round(sum(real[k]), 9) if real[k] else None) or abs(v[1] - sum(real[k])) < 1e-8 for k, v in got.items())
    assert log.event_time_rollup(spark.createDataFrame([], SCHEMA), ["kind"], delay=None).count() == 0


def test_one_hot_run_stops_where_the_batch_says(spark, tmp_path, monkeypatch):
    """A run of many blocks whose stop lies far in, beside a short one; blocks arrive in any order."""
    monkeypatch.setattr(log, "EVALUATIONS_PER_BLOCK", 50)
    rnd = random.Random(11)
    hot = [min(i, 700) * 0.1 + rnd.random() * 0.05 for i in range(1500)]
    rows = [("hot", i, m) for i, m in enumerate(hot, 1)] + [("short", i, 1.0) for i in range(1, 9)]
    stream = arrivals(spark, rows, "run string, eval_no bigint, metric double", f"{tmp_path}/in", 6)
    done = {r["run"]: (r["stop_no"], r["best"]) for r in run.materialise(log.early_stop_stream(stream, EarlyStopOptions(7, 0.06)), "test-hot").collect()}
    table = spark.createDataFrame(rows, "run string, step bigint, metric double")
    stops = {r["run"]: r["stop_step"] for r in trainlog.early_stop(table, patience=7, threshold=0.06).where("stop_step is not null").collect()}
    assert {k: v[0] for k, v in done.items()} == stops and stops["hot"] > 650
    assert done["hot"][1] == max(hot[: stops["hot"]])
