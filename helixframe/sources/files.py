"""Batch readers and writers. Schemas are declared, never inferred.

CSV columns are found by the names in the header, in whatever order they come; a missing one is an
error, and so is a second file whose header differs from the first one's. A cell that does not parse as
its type is NULL, as is ``NA``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import schemas
from helixframe.operators.tables import pack_matching


def read_chunks(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType = schemas.GENOME_CHUNKS) -> DataFrame:
    """Tab-separated chunk files by split name, e.g. ``{"train": ..., "valid": ...}``.

    The split a row belongs to is that of its file, whatever the file's own column
    says. An empty field is an empty sequence.
    """
    parts = [
        _csv_by_name(spark, path, schema, sep="\t").withColumn("split", F.lit(name))
        for name, path in paths.items()
    ]
    return fill_sequences(reduce(lambda a, b: a.unionByName(b), parts))


def _csv_by_name(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, *more: Column, **options) -> DataFrame:
    """The schema's columns of headed CSV files, by name; ``more`` may use the file metadata. Reads a header."""
    raw = spark.read.csv(paths, header=True, enforceSchema=False, **options)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema], *more)


def _file_name() -> Column:
    """Name of the row's file or, for a part file, of the folder it lies in; decoded."""
    path = F.split(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "/")
    last = F.element_at(path, -1)
    return F.when(last.startswith("part-"), F.element_at(path, -2)).otherwise(last)


def fill_sequences(chunks: DataFrame, sequence: str = "sequence") -> DataFrame:
    return chunks.withColumn(sequence, F.coalesce(sequence, F.lit("")))


def read_split(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """One split of a named dataset; other partitions are not listed or read."""
    return spark.read.parquet(root).where((F.col("dataset") == dataset) & (F.col("split") == split))


def read_table(spark: SparkSession, path: str, schema: T.StructType, index: bool = False) -> DataFrame:
    """Comma-separated file with a header and ``NA`` for missing values.

    ``index`` says that a leading unnamed row-index column is to be dropped.
    """
    kept = T.StructType([f for f in schema if f.name != "_c0"])  # by name, so an index column needs no care
    return _csv_by_name(spark, path, kept, nullValue="NA")


def read_variants(
    spark: SparkSession, paths: str | Sequence[str], stem: str, schema: T.StructType, name: str = "model"
) -> DataFrame:
    """Same-shaped files tagged by what follows ``stem`` in the file name.

    ``<stem>.csv`` is the base, ``<stem>-Ms.csv`` the variant ``Ms``. Folders written
    by Spark work too: the tag is then taken from the folder.
    """
    tag = F.regexp_extract(_file_name(), rf"\Q{stem}\E(?:-([^./]+))?\.csv", 1)
    return _csv_by_name(spark, paths, schema, F.when(tag == "", "base").otherwise(tag).alias(name), nullValue="NA")


def read_vector_folder(spark: SparkSession, paths: str | Sequence[str], width: int) -> DataFrame:
    """Pooled-vector files: dataset and fine-tuning state come from the file's own name."""
    file = _file_name()
    tagged = _csv_by_name(
        spark,
        paths,
        T.StructType([f for f in schemas.vector_csv(width) if f.name != "_c0"]),
        F.when(file.contains("plasmid"), "plasmid").otherwise("four_kingdom").alias("dataset"),
        F.when(file.contains("fine"), "Yes").otherwise("No").alias("fine_tuned"),
        nullValue="NA",
    )
    return pack_matching(tagged, r"^v_\d+$")


RESULT_FILE = r"(?:^|[/=])(lora_32_8_)?([^/=]+)_results_([^/=]+?)\.csv"


def read_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All per-run result files as one table, with the method read from the file name."""
    path = F.col("_metadata.file_path")
    lora = F.regexp_extract(path, RESULT_FILE, 1) != ""
    method = F.when(lora, "LoRA").otherwise("full").alias("method")
    return _csv_by_name(spark, paths, schemas.RESULTS, method, nullValue="NA")


def finished_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The (model, dataset) pairs that have a result file; the files are listed, not read."""
    path = F.col("path")
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(
            F.regexp_extract(path, RESULT_FILE, 2).alias("model"),
            F.regexp_extract(path, RESULT_FILE, 3).alias("dataset"),
        )
        .distinct()
    )


def read_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One name per line. A last line without a line end counts as a line."""
    return spark.read.text(path).select(F.col("value").alias(name))


def normalise_methods(results: DataFrame, suffix: str = "-LoRA") -> DataFrame:
    """One model name and one method per run.

    Result files of adapter runs carry the suffix on some rows only, so validation
    and test rows of a run disagree. The method column decides; the suffix is
    taken off and put back on every row of an adapter run.
    """
    bare = F.regexp_replace("model", rf"\Q{suffix}\E$", "")
    return results.withColumn(
        "model", F.when(F.col("method") == "LoRA", F.concat(bare, F.lit(suffix))).otherwise(F.col("model"))
    )


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Write with a header and without an index, as a folder of part files; mode "append" adds files."""
    df.write.mode(mode).csv(path, header=True, sep=sep, nullValue="NA")


def write_named_csv(df: DataFrame, root: str, name: str) -> None:
    """One CSV file per value of the ``name`` column, all in one pass.

    A file is a folder ``<name>=<value>`` of part files; the readers here, which go by
    file paths, take ``<root>/*``.
    """
    df.write.mode("overwrite").partitionBy(name).csv(root, header=True, nullValue="NA")


def write_partitioned(
    df: DataFrame, path: str, *columns: str, rows_per_file: int = 0, rebalance: bool = False
) -> None:
    """Parquet with one folder per value; a rerun replaces only the folders it writes.

    As it is, rows go to files as the tasks hold them: no shuffle, but up to one file
    per task and value. ``rebalance`` shuffles rows into files of even size first;
    adaptive execution splits a value with a large share of the rows over many tasks.
    """
    if rebalance:
        df = df.hint("rebalance", *columns)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append log records."""
    df.write.mode("append").parquet(path)
