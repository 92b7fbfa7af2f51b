"""Streams run to the end of their input; the finished output equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.config import EarlyStopOptions
from helixframe.plans import views
from helixframe.plans.queries.corpus import _CUT, _FRAMED, _PAD, _joined
from helixframe.plans.queries.files import chunk_rows
from helixframe.plans.queries.trainlog import ACCUMULATION, _STOPS
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql
from helixframe.session import shared_folder
from helixframe.sources import files
from helixframe.streaming import corpus, log, run


def _stream_of(spark, df, purpose: str):
    """The rows of a table as a file stream: written to the shared folder and read as it arrives."""
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def _sequence_stream(spark, folder):
    documents = views.table(spark, folder, "documents")
    # The name is a glob so that the stream takes a single file as well as a folder.
    stream = spark.readStream.schema(documents.schema).parquet(f"{folder}/documents.[p]arquet")
    return stream.select("doc_id", views.letters(F.col("text")).alias("sequence"))


@query(
    "stream_tokenise",
    sql(f"SELECT doc_id, array_to_string({_PAD.format(width=512)}, ',') AS input_ids FROM cut", **_CUT),
)
def stream_tokenise(spark, folder):
    """Model inputs of fixed length 512: longer texts are cut, as asked for here."""
    done = run.materialise(corpus.tokenise_stream(_sequence_stream(spark, folder), max_length=512), "tokenised")
    return done.select("doc_id", _joined("input_ids"))


@query(
    "stream_tokenise_whole",
    sql("SELECT doc_id, array_to_string(ids, ',') AS input_ids FROM framed", **_FRAMED),
)
def stream_tokenise_whole(spark, folder):
    """Token ids of whole texts."""
    done = run.materialise(corpus.tokenise_stream(_sequence_stream(spark, folder)), "tokenised")
    return done.select("doc_id", _joined("input_ids"))


@query(
    "stream_chunks",
    sql(
        """SELECT CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS split, lang AS assembly_accession,
                  doc_id::VARCHAR AS seq_id, length(sequence)::INT AS sequence_length, md5('N' || sequence) AS digest FROM seqs"""
    ),
)
def stream_chunks(spark, folder):
    """Chunk files as a stream that stops and goes on from its checkpoint when more files have come."""
    path, output, checkpoint = (shared_folder(spark, f"chunks-{part}") for part in ("in", "out", "checkpoint"))
    for remainder, split in ((0, "first"), (1, "second")):
        part = chunk_rows(spark, folder).where(F.col("seq_id").cast("bigint") % 2 == remainder)
        files.write_csv(part.withColumn("split", F.lit(split)), path, sep="\t", mode="append")
        stream = corpus.read_chunk_stream(spark, path)
        run.append_available(stream, output, checkpoint)
    done = spark.read.schema(stream.schema).parquet(output)
    return done.select("split", "assembly_accession", "seq_id", "sequence_length", F.md5("sequence").alias("digest"))


@query(
    "stream_loss_rollup",
    sql(
        """SELECT run, (small_step - 1) // 4 AS completed_steps, round(sum(loss / 4), 6) AS loss, max(small_step) AS small_step
           FROM log GROUP BY run, (small_step - 1) // 4 HAVING count(*) = 4"""
    ),
)
def stream_loss_rollup(spark, folder):
    run.use_rocksdb(spark)
    rows = views.log(spark, folder).select("run", "small_step", "loss")
    stream = _stream_of(spark, rows, "log-stream")
    return rounded(run.materialise(log.loss_rollup_stream(stream, ACCUMULATION), "rollup"), "loss")


@query(
    "stream_early_stop",
    sql(
        """SELECT run, stop_no, round(best, 6) AS best FROM (
               SELECT s.run, s.stop_no, max(l.loss) AS best FROM log l JOIN (
                   SELECT run, min(small_step) AS stop_no FROM streaks WHERE streak >= 5 GROUP BY run) s
               ON l.run = s.run AND l.small_step <= s.stop_no GROUP BY ALL)""",
        **_STOPS,
    ),
)
def stream_early_stop(spark, folder):
    run.use_rocksdb(spark)
    rows = views.log(spark, folder).select("run", F.col("small_step").alias("eval_no"), F.col("loss").alias("metric"))
    stream = _stream_of(spark, rows, "eval-stream")
    return rounded(run.materialise(log.early_stop_stream(stream, EarlyStopOptions(5, 0.01)), "stops"), "best")


_ARRIVALS = """SELECT *, CASE WHEN event_id % 17 = 0 AND ts < mid THEN 6 ELSE least(5, floor(6 * (epoch(ts) - low) / (high - low)))::INT END AS arrival
               FROM (SELECT event_id, ts, event_type, value, epoch(min(ts) OVER ()) AS low, epoch(max(ts) OVER ()) AS high,
                            min(ts) OVER () + (max(ts) OVER () - min(ts) OVER ()) / 3 AS mid FROM events)"""


@query(
    "stream_windowed_log",
    sql(
        """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n,
                  round(sum(value), 6) AS total, min(value) AS least, max(value) AS most
           FROM arrivals WHERE arrival < 6 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
           GROUP BY ALL""",
        arrivals=_ARRIVALS,
    ),
)
def stream_windowed_log(spark, folder):
    """Hourly figures of a log that arrives in seven parts, with a stop after the fourth.

    Every seventeenth event of the first third comes last of all, days late, and is dropped; hours that the
    watermark has not passed at the end are still open and not in the result.
    """
    events = views.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).head()
    at = F.col("ts").cast("double")
    part = F.least(F.lit(5), F.floor(6 * (at - low) / (high - low))).cast("int")
    arrival = F.when((F.col("event_id") % 17 == 0) & (at < low + (high - low) / 3), 6).otherwise(part)
    parts = events.withColumn("arrival", arrival)
    path, output, checkpoint = (shared_folder(spark, f"arrivals-{x}") for x in ("in", "out", "checkpoint"))
    for arrivals in (range(4), range(4, 7)):
        for n in arrivals:
            parts.where(F.col("arrival") == n).drop("arrival").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        rolled = log.event_time_rollup(stream, ["event_type"])
        run.append_available(rolled, output, checkpoint)
    done = spark.read.schema(rolled.schema).parquet(output)
    return rounded(done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")}), "total")
