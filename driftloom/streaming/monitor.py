"""A deployment monitor on streams: batches against a fixed reference bank, and windowed counts with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.vectors import as_double, dot, mean_vector, unit
from driftloom.sources.store import shared_folder, table

SIZE = 64


def reference_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(unit(as_double(F.col("embedding"))).alias("u"))
    return bank.agg(unit(mean_vector(F.col("u"), SIZE)).alias("reference"))


def monitor(spark: SparkSession, sf_dir: str, stream: DataFrame) -> DataFrame:
    """Scores of a stream of vectors by micro-batch: rows and distance of the batch's centroid from the reference's.

    Each batch writes a folder of its own number, so a batch that runs again after a failure replaces itself.
    """
    out = f"{shared_folder(spark)}/driftloom-monitor-{uuid.uuid4().hex}"
    reference = reference_centroid(spark, sf_dir)

    def score(batch: DataFrame, number: int) -> None:
        mine = batch.select(unit(as_double(F.col("embedding"))).alias("u")).agg(F.count("*").alias("n"), unit(mean_vector(F.col("u"), SIZE)).alias("c"))
        scored = mine.crossJoin(F.broadcast(reference)).filter("n > 0")  # one row each
        scored.select(F.lit(number).cast("long").alias("batch"), "n", (1 - dot(F.col("c"), F.col("reference"), SIZE)).alias("centroid_distance")).write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    run = stream.writeStream.foreachBatch(score).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("n long, centroid_distance double").parquet(f"{out}/batch=*")


def windowed_counts(spark: SparkSession, events: DataFrame, minutes: int = 60) -> DataFrame:
    """Counts and sums of events by tumbling window and type, with a watermark, after which a window's state goes.

    Each batch writes the windows it changed to a folder of its own number, so a batch that runs again replaces itself; of a
    window the last batch counts.
    """
    out = f"{shared_folder(spark)}/driftloom-windows-{uuid.uuid4().hex}"
    agg = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = agg.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    changed = spark.read.schema(T.StructType([*agg.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    last = changed.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "v"), "batch").alias("last"))
    return last.select(F.col("window.start").alias("start"), "event_type", "last.n", "last.v")


