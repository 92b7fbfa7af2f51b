"""What keeps the cost of large tables in bounds: how rows are dealt, what moves, how often it is worked out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.operators import clustering, corpus, ordering
from helixframe.plans import views
from helixframe.sources import shards
from helixframe.streaming import log


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pieces(df):
    return len({r["_piece"] for r in df.withColumn("_piece", F.spark_partition_id()).collect()})


@pytest.fixture
def no_merging(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_batches_of_wide_rows_are_dealt_out(spark, no_merging):
    rows = spark.range(3000).withColumn("input_ids", F.array_repeat(F.lit(7), 50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the few rows of a test would be broadcast
    try:
        assert pieces(ordering.assign_batches(rows, "id", 16)) > 1
        assert pieces(ordering.assign_batches(rows, "id", 16, block_bits=20)) == 1  # as it was
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [3, 8, 20])
def test_small_blocks_of_sparse_ids_number_all_rows(spark, bits):
    ids = sorted({i * 7919 for i in range(-60, 60)} | {-(2**62), -1, 2**40 + 3, 2**61, 2**62 + 1})
    rows = ordering.assign_batches(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", 10, block_bits=bits)
    assert [r["batch_id"] for r in rows.orderBy("id").collect()] == [n // 10 for n in range(len(ids))]


def test_sequences_of_one_full_piece_are_dealt_out(spark, no_merging):
    """A row group is read by one task, however many pieces its file seems to have."""
    assert pieces(views.spread(spark.range(0, 8000, 1, 8).where("id < 1000"), "id")) > 1


def test_views_keep_other_letters(spark):
    texts = ["", "acgtACGT nN", "\u00e9\u4e00\U0001f600\x00\t-a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(views.letters(F.col("t")), views.nucleotides(F.col("t"))).collect()
    assert [r[0] for r in got] == ["", "ACGTACGTNNN", "NNNNNNA", None]
    assert [r[1] for r in got] == ["", "AGGTAGGTCC", "A", None]


def test_widths_of_batches_are_settled(spark):
    df = spark.createDataFrame([(i, "ACGTAC" * (i % 7) + "NA") for i in range(40)], "id bigint, sequence string")
    rows = corpus.tokenise_in_batches(df, "id", 16)
    assert "Window" not in plan_of(rows)
    assert all(r["n_tokens"] == r["id"] % 7 + 4 for r in rows.collect())


def test_mapped_ids_are_numbers_of_four_bytes(spark):
    rows = spark.createDataFrame([("ACGTACG\u00e9",), ("",), (None,)], "s string").select(corpus.kmer_ids_batched(F.col("s")).alias("i"))
    assert ", 250" in plan_of(rows)  # Arrow arrays, not lists of objects
    assert [r["i"] for r in rows.collect()] == [[5 + int("012301", 4), 5 + 4096 + 2, 1], [], None]


def test_masking_hashes_are_bound_once(spark):
    plan = plan_of(corpus.mask_tokens(spark.range(3).withColumn("input_ids", F.array(F.lit(2), F.lit(9))), "id", 4105))
    assert plan.count("md5(") == 1 and "element_at" not in plan


def test_shards_work_their_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(100).withColumn("x", counted("id"))
    assert shards.write_shards(rows, f"{tmp_path}/s", "id", 10).count() == 10
    assert seen.value == 100
    assert shards.read_shards(spark, f"{tmp_path}/s", rows).count() == 100


def test_nearest_centre_is_compiled_and_the_first_of_equals(spark):
    rng = np.random.default_rng(3)
    data = [([float(x) for x in p], [[0.0, 0.0], [2.0, 0.0], [1.0, 5.0]][: 1 + i % 3]) for i, p in enumerate(rng.integers(-3, 6, (200, 2)))]
    df = spark.createDataFrame(data, "p array<double>, c array<array<double>>")
    near = df.select("p", "c", clustering._nearest(F.col("p"), F.col("c"), 4, 2).alias("i"))
    assert "lambda" not in plan_of(near)
    for r in near.collect():
        assert r["i"] == int(np.argmin([(r["p"][0] - c[0]) ** 2 + (r["p"][1] - c[1]) ** 2 for c in r["c"]]))


class _Value:
    def __init__(self):
        self.kept, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value

    def clear(self):
        self.calls += 1
        self.kept = None


def test_a_call_of_the_rollup_reads_and_writes_state_once():
    state = _Value()
    handle = type("Handle", (), {"getValueState": lambda self, *a: state})()
    rollup = log._loss_rollup(4)
    rollup.init(handle)

    def call(steps):
        rows = pd.DataFrame({"small_step": steps, "loss": [float(s) if s != 6 else None for s in steps], "completed_steps": [(s - 1) // 4 for s in steps]})
        return [tuple(r) for out in rollup.handleInputRows((1, 0), iter([rows]), None) for r in out.itertuples(index=False)]

    assert call([1, 2, 3, 4, 5, 9, 13]) == [(1, 0, 2.5, 4)] and state.calls == 2
    assert call([6, 7, 8, 10]) == [(1, 1, 5.0, 8)] and state.calls == 4
    assert sorted(call([11, 12, 14, 15, 16])) == [(1, 2, 10.5, 12), (1, 3, 14.5, 16)] and state.kept is None
