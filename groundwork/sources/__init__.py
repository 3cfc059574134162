"""Tables in, rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """Each record once, with the given columns: rows that repeat the key are one record delivered again."""
    row = F.max(F.struct(*columns)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def events_once(events: DataFrame) -> DataFrame:
    """Review events with their first sequence number, and the time of the review as milliseconds since 1970 (``at_ms``)."""
    first = F.min_by(F.struct("user_id", "card_id", "mode", "schedule_modified", "rating", "reviewed_at"), "seq").alias("e")
    out = events.where("id is not null").groupBy("id").agg(F.min("seq").alias("seq"), first).select("id", "seq", "e.*")
    return out.withColumn("at_ms", F.unix_millis(F.expr("try_cast(reviewed_at as timestamp)")))
