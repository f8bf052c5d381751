"""Progress events and interaction logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

# The types of progress events that end a job.
TERMINAL = ("complete", "error", "cancelled")
PROGRESS = StructType([StructField("job_id", StringType()), StructField("seq", LongType()), StructField("type", StringType()), StructField("message", StringType()), StructField("ts", TimestampType())])
INTERACTION = StructType([StructField("ts", TimestampType()), StructField("job_id", StringType()), StructField("mode", StringType()), StructField("question", StringType()), StructField("no_suitable_note", BooleanType()), StructField("answer", StringType()), StructField("model", StringType())])


def progress_events(spark: SparkSession, folder: str, schema: StructType = PROGRESS) -> DataFrame:
    """Stream of the JSON lines that are appended to a folder; what was read is kept by the query's checkpoint, so no event is emitted twice."""
    return spark.readStream.schema(schema).json(folder)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, events, last_seq, state): running, or the terminal type that the job's last event has. Batch or stream (complete or update mode)."""
    last = F.max(F.struct("seq", "type"))
    found = events.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.count("*").alias("events"), last.alias("last"))
    return found.select("job_id", "events", F.col("last.seq").alias("last_seq"), F.when(F.col("last.type").isin(*TERMINAL), F.col("last.type")).otherwise("running").alias("state"))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, kind, n): events by time window and kind; those later than `late` are left out of a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, by a query that ends when it has read it.

    The state and the result are files in the folder, which all executors must see; the
    result of a later batch replaces that of an earlier one, and nothing is held by the driver.
    """
    spark, result = stream.sparkSession, f"{folder}/result"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(result)).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(result)
    except AnalysisException:  # no batch has come
        return spark.createDataFrame([], stream.schema)


def each_batch(stream: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each new batch of a stream to a function, once."""
    return stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
