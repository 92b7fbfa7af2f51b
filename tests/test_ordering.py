"""Row numbers, carries, batches, folds: compared with plain Python on small tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions.hashing import digest, unit, unit_below
from helixframe.operators import folds, ordering


def ids_table(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_row_index_over_sparse_and_negative_ids(spark, bits):
    rnd = random.Random(1)
    ids = [rnd.randrange(-(2**63), 2**63) for _ in range(300)] + list(range(50))
    out = ordering.row_index(ids_table(spark, ids), ["id"], ordering.int_block("id", bits), total="n")
    got = {r["id"]: (r["row_idx"], r["n"]) for r in out.collect()}
    assert got == {v: (i, len(ids)) for i, v in enumerate(sorted(ids))}


def test_row_index_per_key(spark):
    rows = [(("a" if i % 3 else "b"), i * 7) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id bigint")
    out = ordering.row_index(df, ["id"], ordering.int_block("id", 5), keys=["k"])
    for key in "ab":
        mine = sorted(v for k, v in rows if k == key)
        assert {r["id"]: r["row_idx"] for r in out.where(F.col("k") == key).collect()} == {v: i for i, v in enumerate(mine)}


def test_text_block_follows_text_order(spark):
    words = ["", "a", "ab", "abc", "abcd", "b", "ba", "zé", "é", "日本", "A", "Z"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    ordered = [r[0] for r in df.orderBy("w").collect()]
    bounds = ordering.text_bounds(df, "w", 5)
    blocks = {r[0]: r[1] for r in df.select("w", ordering.text_block(F.col("w"), bounds)).collect()}
    assert [blocks[w] for w in ordered] == sorted(blocks[w] for w in ordered) and len(set(blocks.values())) > 1


def test_text_blocks_stay_small_for_a_common_prefix(spark):
    df = spark.range(50_000).selectExpr("concat('GCF_', lpad(id, 9, '0'), '.1') as w")
    bounds = ordering.text_bounds(df, "w")
    sizes = [r["count"] for r in df.groupBy(ordering.text_block(F.col("w"), bounds).alias("b")).count().collect()]
    assert len(sizes) > 1000 and max(sizes) < 1000 and sum(sizes) == 50_000


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_previous_value_across_blocks(spark, bits):
    rnd = random.Random(2)
    rows = [(k, s, rnd.random() if rnd.random() > 0.2 else None) for k in "ab" for s in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, s bigint, v double")
    got = {(r["k"], r["s"]): r["previous"] for r in ordering.previous_value(df, "v", "s", ["k"], bits).collect()}
    want = {}
    for k in "ab":
        last = None
        for _, s, v in sorted(r for r in rows if r[0] == k):
            want[k, s], last = last, v
    assert got == want


def test_batches_drop_last_and_cap(spark):
    df = ids_table(spark, range(0, 230, 2))
    full = ordering.assign_batches(df, "id", 16, block_bits=4)
    assert {r["id"]: r["batch_id"] for r in full.collect()} == {v: i // 16 for i, v in enumerate(range(0, 230, 2))}
    kept = ordering.assign_batches(df, "id", 16, drop_last=True, block_bits=4)
    assert kept.count() == 112 and kept.agg(F.max("batch_id")).first()[0] == 6
    even = ordering.assign_batches(df, "id", 23, drop_last=True, block_bits=4)
    assert even.count() == 115
    assert ordering.cap_batches(full, 3).select("batch_id").distinct().count() == 4
    assert ordering.cap_batches(full, 0).count() == ordering.cap_batches(full, -1).count() == 115


def test_shuffles_are_permutations(spark):
    df = ids_table(spark, range(500))
    positions = [r["position"] for r in ordering.shuffled_index(df, "id", 7).orderBy("id").collect()]
    assert sorted(positions) == list(range(500)) and positions != list(range(500))
    again = [r["position"] for r in ordering.shuffled_index(df.repartition(5), "id", 7).orderBy("id").collect()]
    assert positions == again
    buffered = [r["position"] for r in ordering.buffered_shuffle(df, "id", 64, 7, block_bits=5).orderBy("id").collect()]
    assert sorted(buffered) == list(range(500))
    assert all(p // 64 == i // 64 for i, p in enumerate(buffered))


@settings(max_examples=8, deadline=None)
@given(n=st.integers(0, 60), k=st.integers(2, 12))
def test_fold_sizes(spark, n, k):
    out = folds.assign_folds(ids_table(spark, range(n)), "id", k, seed=3)
    sizes = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert [sizes.get(f, 0) for f in range(1, k + 1)] == [n // k + (f <= n % k) for f in range(1, k + 1)]


def test_folds_do_not_depend_on_partitioning(spark):
    df = ids_table(spark, range(400))
    one = {tuple(r) for r in folds.assign_folds(df.coalesce(1), "id").collect()}
    assert one == {tuple(r) for r in folds.assign_folds(df.repartition(9), "id").collect()}
    assert one != {tuple(r) for r in folds.assign_folds(df, "id", seed=4).collect()}


def test_train_and_validation_split_a_fold_table(spark):
    out = folds.assign_folds(ids_table(spark, range(97)), "id", 10)
    train, held = folds.fold_train(out, 2), folds.fold_validation(out, 2)
    assert train.count() + held.count() == 97 and train.join(held, "id").count() == 0


@pytest.mark.parametrize("bound", [0.0, 0.15, 0.5, 1.0])
def test_digit_comparison_is_the_number_comparison(spark, bound):
    h = digest("x", 1, "id")
    df = spark.range(500).select((unit(h) < bound).alias("a"), unit_below(h, bound).alias("b"))
    assert df.where("a <> b").count() == 0


def test_carry_over_groups_of_blocks(spark):
    """Steps so sparse that every row is a block and blocks fall into several groups of blocks."""
    steps = [i * (1 << 19) for i in range(40)]
    df = spark.createDataFrame([(k, s, f"{k}{s}") for k in "ab" for s in steps], "k string, s bigint, v string")
    got = {(r["k"], r["s"]): r["previous"] for r in ordering.previous_value(df, "v", "s", ["k"], 0).collect()}
    want = {(k, s): f"{k}{b}" if b is not None else None for k in "ab" for b, s in zip([None, *steps], steps)}
    assert got == want
