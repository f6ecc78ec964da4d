"""Arriving headers: findings as they come, and counts of decisions by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import Profile
from ..operators import verify


def element_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Element files as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def findings_stream(arriving: DataFrame, output: str, checkpoint: str, profile: Profile = Profile()):
    """Write the findings of single elements as they arrive; what has arrived is done, and the query then ends."""
    found = verify.element_findings(arriving, profile)
    return found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decision_rate(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions by kind and time window; events (ts, decision) later than `late` are past counting."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "decision").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "decision", "n")
