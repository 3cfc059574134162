"""Review logs: activity by day, counts, and the replay of spaced repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import half_up
from groundwork.sources import events_once

DAY_MS = 86_400_000


def daily_activity(events: DataFrame, cards: DataFrame) -> DataFrame:
    """(user_id, day, reviews, new_cards) for each user and UTC day (days since 1970) with a review that counts.

    Events of known cards that modify the schedule count; a card is new on the day of a user's first such event. The
    sums are made for each (user, card) first, so a user with many events is spread over tasks.
    """
    known = cards.where("id is not null").select(F.col("id").alias("card_id")).distinct()
    e = events_once(events).where("schedule_modified = 1 and at_ms is not null").join(known, "card_id", "left_semi")
    e = e.withColumn("day", F.floor(F.col("at_ms") / DAY_MS).cast("long"))
    days = e.groupBy("user_id", "card_id", "day").agg(F.count("*").alias("n"))
    first = F.min("day").over(Window.partitionBy("user_id", "card_id"))
    days = days.withColumn("new", (F.col("day") == first).cast("long"))
    return days.groupBy("user_id", "day").agg(F.sum("n").alias("reviews"), F.sum("new").alias("new_cards"))


def review_counts(events: DataFrame) -> DataFrame:
    """For each (user, card): reviews, those that modify the schedule, and the last of these."""
    e = events_once(events)
    counts = F.col("schedule_modified") == 1
    return e.groupBy("user_id", "card_id").agg(F.count("*").alias("review_count"), F.sum(F.when(counts, 1).otherwise(0)).cast("long").alias("schedule_review_count"), F.max(F.when(counts, F.col("at_ms"))).alias("last_scheduled_ms"))


def latest_review(events: DataFrame) -> DataFrame:
    """The last review of each (user, card): the latest by time, then by sequence number."""
    last = Window.partitionBy("user_id", "card_id").orderBy(F.desc_nulls_last("at_ms"), F.desc("seq"))
    return events_once(events).withColumn("_r", F.row_number().over(last)).where("_r = 1").select("user_id", "card_id", "seq", "rating", "at_ms")


def history(events: DataFrame, newest: int = 500) -> DataFrame:
    """The newest reviews of each user, ``newest`` at most."""
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("at_ms"), F.desc("seq"))
    return events_once(events).withColumn("position", F.row_number().over(order)).where(F.col("position") <= newest).select("user_id", F.col("position").cast("long").alias("position"), "seq", "card_id")


def step(state: Column, event: Column) -> Column:
    """One review's effect on (repetition, interval_days, ease_factor)."""
    rating = event["rating"]
    good = rating >= 3
    interval = F.when(~good, 1).when(state["repetition"] == 0, 1).when(state["repetition"] == 1, 6).otherwise(F.floor(state["interval_days"] * state["ease_factor"] + 0.5)).cast("long")
    q = 5 - rating
    ease = F.greatest(F.lit(1.3), state["ease_factor"] + (0.1 - q * (0.08 + q * 0.02)))
    return F.struct(F.when(good, state["repetition"] + 1).otherwise(0).cast("long").alias("repetition"), interval.alias("interval_days"), half_up(ease, 2).alias("ease_factor"), event["at_ms"].alias("last_ms"))


def replay(events: DataFrame) -> DataFrame:
    """The state of each (user, card) after its events in order of time and sequence; cramming that leaves the schedule and null ratings or times count for nothing."""
    e = events_once(events).where("schedule_modified = 1 and rating is not null and at_ms is not null")
    start = F.struct(F.lit(0).cast("long").alias("repetition"), F.lit(0).cast("long").alias("interval_days"), F.lit(2.5).alias("ease_factor"), F.lit(None).cast("long").alias("last_ms"))
    ordered = e.groupBy("user_id", "card_id").agg(F.array_sort(F.collect_list(F.struct("at_ms", "seq", "rating"))).alias("log"))
    state = ordered.select("user_id", "card_id", F.aggregate("log", start, step).alias("s"))
    return state.select("user_id", "card_id", "s.repetition", "s.interval_days", "s.ease_factor", (F.col("s.last_ms") + F.col("s.interval_days") * DAY_MS).alias("due_ms"))


def trailing_failures(events: DataFrame, seconds: int = 900) -> DataFrame:
    """For each error event the user's errors within the ``seconds`` up to it, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    near = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return events.where("event_type = 'error'").withColumn("at", at).select("event_id", "user_id", F.count("*").over(near).alias("failures"))


def all_counts(cards: DataFrame, events: DataFrame) -> DataFrame:
    """(card_id, review_count, schedule_review_count, last_scheduled_ms) of every card, reviewed or not, over all users."""
    known = cards.where("id is not null").select(F.col("id").alias("card_id")).distinct()
    c = review_counts(events).groupBy("card_id").agg(F.sum("review_count").alias("review_count"), F.sum("schedule_review_count").alias("schedule_review_count"), F.max("last_scheduled_ms").alias("last_scheduled_ms"))
    return known.join(c, "card_id", "left").select("card_id", F.coalesce("review_count", F.lit(0)).alias("review_count"), F.coalesce("schedule_review_count", F.lit(0)).alias("schedule_review_count"), "last_scheduled_ms")


def undone(events: DataFrame) -> DataFrame:
    """The states after the last review of each (user, card) is taken back, made by replaying the rest."""
    last = latest_review(events).select("seq")
    first = events_once(events).join(last, "seq", "left_semi").select("id")
    return replay(events.where("id is not null").join(first, "id", "left_anti"))


def next_review(states: DataFrame) -> DataFrame:
    """(user_id, card_id, text): how long until the next review, in days, from 30 on in months."""
    days = F.col("interval_days")
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))
    text = F.when(days < 30, some(days, "day")).otherwise(some(F.floor(days / 30 + 0.5), "mo"))
    return states.select("user_id", "card_id", text.alias("text"))
