"""Streaming queries: ours, beside the reference's batch scoring of deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.plans.base import rounded
from driftloom.registry import query
from driftloom.sources.store import table
from driftloom.streaming import monitor


@query("s1_stream_monitor")
def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "embeddings").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/embeddings.parque[t]").filter("vec_id % 2 = 1")
    found = monitor.monitor(spark, d, stream)
    return found.select("n", rounded(found["centroid_distance"]).alias("centroid_distance"))


@query("s2_windowed_events", "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    found = monitor.windowed_counts(spark, spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))
    return found.select(found["start"].cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(found["v"], 4).alias("v"))
