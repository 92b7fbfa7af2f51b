"""Corpus preparation as a stateless stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from helixframe import schemas
from helixframe.operators import corpus
from helixframe.sources.files import fill_sequences

CHUNK_METADATA = ["split", "assembly_id", "assembly_accession", "start", "sequence_length"]


def read_chunk_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = schemas.GENOME_CHUNKS,
    max_files: int = 1000,
) -> DataFrame:
    """New tab-separated chunk files of a folder, a bounded number per micro-batch.

    A file whose header differs from the schema's names fails the stream.
    """
    chunks = (
        spark.readStream.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    return fill_sequences(chunks)


def tokenise_stream(chunks: DataFrame, k: int = 6, max_length: int | None = None, width: int | None = None) -> DataFrame:
    """Token ids; the chunk's metadata columns are dropped.

    Sequences keep all their tokens unless ``max_length`` asks for a cut. Shorter ones are padded to ``width``,
    which is ``max_length`` if not given; with neither, nothing is padded.
    """
    tokens = corpus.tokenise(chunks, "sequence", k, max_length)
    width = max_length if width is None else width
    return (tokens if width is None else corpus.pad(tokens, width)).drop(*CHUNK_METADATA)
