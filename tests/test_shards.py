"""Shards of equal size with a manifest."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from helixframe.session import shared_folder
from helixframe.sources import shards


def files_of(folder):
    path = folder.removeprefix("file:") + "/data"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def folder(spark):
    return shared_folder(spark, "test-shards")


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(i * 7, [rnd.randint(0, 9) for _ in range(i % 5)], None) for i in range(103)], "id bigint, input_ids array<int>, note string")


def test_shards_are_full_and_in_seeded_order(spark, rows, folder):
    manifest = {r["shard"]: r["n_rows"] for r in shards.write_shards(rows, folder, "id", 20, seed=4).collect()}
    assert manifest == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20, 5: 3}
    back = shards.read_shards(spark, folder, rows).collect()
    assert sorted(r["position"] for r in back) == list(range(103)) and all(r["shard"] == r["position"] // 20 for r in back)
    want = {r["id"]: r["input_ids"] for r in rows.collect()}
    assert {r["id"]: r["input_ids"] for r in back} == want
    assert len(files_of(folder)) == 6  # one file a shard
    order = [r["id"] for r in sorted(back, key=lambda r: r["position"])]
    assert order != sorted(order)


def test_a_rerun_writes_only_what_is_missing(spark, rows, folder):
    shards.write_shards(rows, folder, "id", 20)
    before = files_of(folder)
    shards.write_shards(rows.repartition(3), folder, "id", 20)
    assert files_of(folder) == before
    lost = [p for p in before if "shard=2" in p or "shard=5" in p]
    for path in lost:
        shutil.rmtree(os.path.dirname(path))
    manifest = shards.write_shards(rows, folder, "id", 20)
    after = files_of(folder)
    assert len(after) == 6 and {p: t for p, t in after.items() if p in before and p not in lost} == {p: t for p, t in before.items() if p not in lost}
    assert manifest.count() == 6 and shards.read_shards(spark, folder, rows).count() == 103


def test_a_shard_that_was_not_entered_is_written_again(spark, rows, folder):
    """What a run left that ended before the manifest: a folder with half a shard."""
    half = rows.limit(5).withColumns({"position": F.lit(0).cast("bigint"), "shard": F.lit(1).cast("bigint")})
    half.write.partitionBy("shard").parquet(f"{folder}/data")
    shards.write_shards(rows, folder, "id", 20)
    assert shards.read_shards(spark, folder, rows).count() == 103


def test_other_rows_are_refused(spark, rows, folder):
    shards.write_shards(rows, folder, "id", 20)
    for changed, size, seed in ((rows, 20, 9), (rows, 25, 1), (rows.withColumn("note", F.lit("x")), 20, 1)):
        with pytest.raises(ValueError, match="other rows"):
            shards.write_shards(changed, folder, "id", size, seed)


def test_no_rows_make_no_shards(spark, rows, folder):
    assert shards.write_shards(rows.limit(0), folder, "id").count() == 0
