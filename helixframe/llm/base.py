"""Small pieces the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import release, settle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that only a few texts at a time are unpacked into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows no model may learn from; a NULL id counts as not held out."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled documents of each class, held-out ones left out.

    The choice follows a hash of the id, so it does not depend on how the rows lie. NULL labels are
    passed over, ids with contradictory ones are not used. Runs no job by itself; the id list is bounded by
    2 x ``per_class`` rows whatever the size of the tables.
    """
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
        .where(F.col("_label") == F.col("_other"))
        .withColumn("_hash", F.xxhash64(F.lit("sample"), F.col("_id")))
        .select("_id", "_label", "_hash")
    )
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("_label") == value).orderBy("_hash", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(settle(picked), "_id").select("_id", "text", F.col("_label").alias("label"), "_hash")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex on an edge; the component is its smallest vertex.

    Labels move along the edges and then jump to the label of their label, so stars need two rounds
    and chains a logarithmic number. Each round is written to the shared folder: lineage stays short
    and a lost executor costs one round. Runs jobs.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = settle(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    last = labels = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        heard = (
            both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v")
            .groupBy("u")
            .agg(F.min("near").alias("near"))
        )
        hooked = labels.join(heard, "u").select("u", "label", F.least("label", "near").alias("to"))
        roots = labels.select(F.col("u").alias("to"), F.col("label").alias("root"))
        after = settle(
            hooked.join(roots, "to", "left").select(
                "u", F.least("to", F.coalesce("root", "to")).alias("label"), F.col("label").alias("was")
            )
        )
        moved = after.where("label <> was").limit(1).count()
        release(last)
        last, labels = after, after.select("u", "label")
        if not moved:
            release(both)
            return labels.select(F.col("u").alias("vertex"), F.col("label").alias("component"))
