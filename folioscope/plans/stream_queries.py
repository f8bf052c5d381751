"""The event table as a stream and as a batch, which must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tables import shared_folder, table
from folioscope.streaming import progress as Z


def event_states(spark: SparkSession, d: str) -> DataFrame:
    """Users as jobs: how many events each has, and whether the last one ended it (an error, or a purchase as completion)."""
    kind = F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("type"))
    return Z.job_states(rows)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type by day."""
    rows = Z.windowed_counts(table(spark, d, "events").filter("ts is not null"), "ts", "event_type", "1 day")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def streamed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type, counted by a stream over the files of the table."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("with_value"))
    return Z.run_available(stream, f"{shared_folder(spark)}/streamed_{uuid.uuid4().hex}")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """The number in each event's JSON, and whether the object holds exactly the key that it should."""
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.coalesce((F.size(keys) == 1) & F.array_contains(keys, "k"), F.lit(False)).alias("well_formed"))


QUERIES = {f.__name__: f for f in (event_states, event_windows, streamed_event_counts, event_props)}
ORACLES = {
    "event_states": """SELECT CAST(user_id AS VARCHAR) AS job_id, count(*) AS events, max(event_id) AS last_seq, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'running' END AS state FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "streamed_event_counts": "SELECT event_type, count(*) AS n, count(value) AS with_value FROM events GROUP BY 1",
    "event_props": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, coalesce(json_keys(props) = ['k'], false) AS well_formed FROM events",
}
