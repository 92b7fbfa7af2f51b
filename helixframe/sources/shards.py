"""A tokenised corpus as shards of equal size in a seeded order, with a manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.ordering import shuffled_index
from helixframe.session import release, settle

_PER_TASK = 64
MANIFEST = "shard bigint, n_rows bigint, digest bigint"


def write_shards(rows: DataFrame, folder: str, key: str, rows_per_shard: int = 100_000, seed: int = 1) -> DataFrame:
    """Write ``rows`` to ``folder``, ``rows_per_shard`` to a shard (the last one holds the rest), and give the manifest back. Runs jobs.

    Rows go in the seeded order of their keys, which are unique and not NULL; ``position`` and ``shard`` are added to
    the columns, ``shard`` as the folder name. A shard is written by one task, whole, and then entered in the manifest with its
    row count and a digest of its rows. A rerun writes only shards the manifest does not have and leaves the
    others' files as they are; one that lost its folder is written again. A manifest made from other rows, another order or size is an error.
    """
    spark = rows.sparkSession
    # settled: the rows are worked out and moved once, not for the digests and again for the files
    placed = settle(shuffled_index(rows, key, seed).withColumn("shard", F.floor(F.col("position") / rows_per_shard).cast("bigint")))
    wanted = settle(_described(placed, rows.columns))
    there, written = read_manifest(spark, folder), _described(_read(spark, folder, placed), rows.columns)
    plan = wanted.alias("w").join(there.alias("m"), "shard", "full").join(written.alias("d"), "shard", "left")

    def as_wanted(side: str) -> Column:
        return F.col("w.n_rows").eqNullSafe(F.col(f"{side}.n_rows")) & F.col("w.digest").eqNullSafe(F.col(f"{side}.digest"))

    entered = F.col("m.n_rows").isNotNull()
    plan = plan.select("shard", (entered & ~as_wanted("m")).alias("other"), as_wanted("d").alias("done"), (~entered).alias("new"))
    plan = plan.collect()  # one row a shard
    if others := sorted(r["shard"] for r in plan if r["other"]):
        raise ValueError(f"{folder} holds shards of other rows: {others[:5]}")
    if missing := [(r["shard"],) for r in plan if not r["done"]]:
        some = spark.createDataFrame(missing, "shard bigint")
        part = placed.join(some, "shard", "left_semi")
        # the rows of a shard meet in one task, which sorts and writes them, as those of some other shards
        tasks = min(len(missing), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(missing) // _PER_TASK))
        part = part.repartition(tasks, "shard").sortWithinPartitions("shard", "position")
        part.write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/data")
    if fresh := [(r["shard"],) for r in plan if r["new"]]:
        entries = spark.createDataFrame(fresh, "shard bigint").join(wanted, "shard")
        entries.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    release(placed)
    return read_manifest(spark, folder)


def _described(placed: DataFrame, columns: list[str]) -> DataFrame:
    """(shard, n_rows, digest): the digest does not depend on the order of the rows in the file."""
    row = F.xxhash64("position", *[F.col(f"`{c}`") for c in columns])
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(row).alias("digest"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, n_rows, digest) of the finished shards; empty if there are none."""
    try:
        return spark.read.parquet(f"{folder}/manifest").select("shard", "n_rows", "digest")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], MANIFEST)


def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(f"{folder}/data")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def read_shards(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The rows of the shards that the manifest has, with ``position`` and ``shard``."""
    schema = like.select("*", F.lit(0).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("shard")).schema
    rows = spark.read.schema(schema).parquet(f"{folder}/data")
    return rows.join(read_manifest(spark, folder).select("shard"), "shard", "left_semi").select(*schema.names)
