"""Running a stream to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.session import shared_folder

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, on local disk and in the checkpoint, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def append_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process all input there is, append the result to ``output``, and stop.

    The checkpoint records what was read and written: running again goes on from
    there and writes each row once.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def materialise(stream: DataFrame, purpose: str) -> DataFrame:
    """The finished output of a stream as a static table in the shared folder."""
    spark = stream.sparkSession
    output = shared_folder(spark, purpose)
    append_available(stream, output, shared_folder(spark, f"{purpose}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(output)
