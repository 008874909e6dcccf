"""The call log, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.operators.cost import with_defaults

LOG = "timestamp double, phase string, agent string, model string, agent_name string, input_tokens long, output_tokens long, cost double, latency_ms double, fallback_used boolean"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's records with defaults for what is missing; blank lines are skipped."""
    return with_defaults(spark.read.schema(LOG).json(path))


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.readStream.schema(LOG).json(path))


def running_costs(log: DataFrame) -> DataFrame:
    """phase, agent, calls, tokens, cost: for a stream in update or complete mode."""
    return log.groupBy("phase", "agent").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"))


def windowed_costs(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, phase, calls, cost over tumbling windows, with a watermark for late records."""
    timed = log.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))
