"""Declared schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T

GENOME_CHUNKS = T.StructType(
    [
        T.StructField("split", T.StringType()),
        T.StructField("assembly_id", T.StringType()),
        T.StructField("assembly_accession", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("sequence_length", T.IntegerType()),
        T.StructField("seq_id", T.StringType()),
        T.StructField("sequence", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("evaluation_set", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

UMAP_POINTS = T.StructType(
    [
        T.StructField("UMAP1", T.DoubleType()),
        T.StructField("UMAP2", T.DoubleType()),
        T.StructField("Label", T.StringType()),
        T.StructField("vec_type", T.StringType()),
        T.StructField("fine_tuned", T.StringType()),
    ]
)

TOKEN_XY = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("token", T.StringType()),
        T.StructField("model", T.StringType()),
    ]
)

TOKEN_DRIFT = T.StructType(
    [
        T.StructField("Ms", T.DoubleType()),
        T.StructField("Mp", T.DoubleType()),
        T.StructField("Me", T.DoubleType()),
        T.StructField("token", T.StringType()),
    ]
)

TRAIN_LOG = T.StructType(
    [
        T.StructField("run", T.StringType(), False),
        T.StructField("step", T.LongType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def token_embedding_csv(width: int) -> T.StructType:
    """Layout of a token embedding file: ``width`` floats, then token and its length."""
    cells = [T.StructField(str(i), T.DoubleType()) for i in range(width)]
    return T.StructType(
        cells + [T.StructField("token", T.StringType()), T.StructField("token_length", T.IntegerType())]
    )


def vector_csv(width: int) -> T.StructType:
    """Layout of a pooled-vector file: row index, ``width`` floats, three tags."""
    cells = [T.StructField(f"v_{i}", T.DoubleType()) for i in range(width)]
    tags = [T.StructField(c, T.StringType()) for c in ("vec_type", "model_type", "label")]
    return T.StructType([T.StructField("_c0", T.LongType()), *cells, *tags])
