"""The driver's tables seen as logs. Bounds are put on the stored columns, so that they reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import SEGMENT, VERSION, as_log

SEGMENT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, as_of: int | None = None) -> DataFrame:
    """key = user, version = event + 1; an error event is a tombstone."""
    events = table(spark, sf_dir, "events")
    if as_of is not None:
        events = events.where(F.col("event_id") <= as_of - 1)
    return as_log(events, F.col("user_id"), F.col("event_id") + 1, F.col("event_type") == "error", "value", "props")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key = customer, version = order + 1; a finished order is a tombstone."""
    orders = table(spark, sf_dir, "orders")
    return as_log(orders, F.col("o_custkey"), F.col("o_orderkey") + 1, F.col("o_orderstatus") == "F", "o_totalprice")


def conversations_log(spark: SparkSession, sf_dir: str, as_of: int | None = None) -> DataFrame:
    """key = conversation, version = turn + 1."""
    turns = table(spark, sf_dir, "conversations")
    if as_of is not None:
        turns = turns.where(F.col("turn") <= as_of - 1)
    return as_log(turns, F.col("conv_id"), F.col("turn") + 1, F.lit(False), "role", "text")


def segmented(log: DataFrame) -> DataFrame:
    """The log as segments of a thousand versions each, counted from 1."""
    return log.withColumn(SEGMENT, (F.floor((F.col(VERSION) - 1) / SEGMENT_ROWS) + 1).cast("int"))


def latest(log: DataFrame) -> int:
    return log.agg(F.max(VERSION)).first()[0] or 0
