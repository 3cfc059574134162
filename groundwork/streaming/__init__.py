"""Streams: an extension, the batch operators of reviews over events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "21 days") -> DataFrame:
    """Reviews of each user and UTC day from a stream of review events: each id once, events up to ``late`` behind count.

    The review's own time carries the watermark; a redelivery within it is dropped by its id.
    """
    e = events.where("id is not null").withColumn("at", F.expr("try_cast(reviewed_at as timestamp)")).where("at is not null and schedule_modified = 1")
    e = e.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    counted = e.groupBy(F.window("at", "1 day"), "user_id").agg(F.count("*").alias("reviews"))
    return counted.select("user_id", F.col("window.start").alias("day"), "reviews")
