"""What a learner has to study at a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.reviews import DAY_MS, daily_activity, replay
from groundwork.sources import events_once, once

#: Cards introduced and reviews made in a day at most.
NEW_LIMIT, REVIEW_LIMIT = 20, 200


def card_states(cards: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, card_id, state, due_ms, created_at) of each learner's cards: those they own and those they have reviewed.

    The state is suspended for a card without anything to ask, new without a review that counts, else due or later. A
    card whose due time isn't known is due.
    """
    c = once(cards, "owner_id", "created_at", "claim").withColumnRenamed("id", "card_id")
    reviewed = events_once(events).select("user_id", "card_id").where("user_id is not null and card_id is not null").distinct()
    own = c.select(F.col("owner_id").alias("user_id"), "card_id").where("user_id is not null")
    s = own.unionByName(reviewed).distinct().join(c.select("card_id", "created_at", "claim"), "card_id")
    s = s.join(replay(events).select("user_id", "card_id", "repetition", "due_ms"), ["user_id", "card_id"], "left")
    state = F.when(F.coalesce("claim", F.lit("")) == "", "suspended").when(F.col("repetition").isNull(), "new").when(F.coalesce("due_ms", F.lit(0)) <= now_ms, "due").otherwise("later")
    return s.select("user_id", "card_id", state.alias("state"), "due_ms", "created_at")


def rooms(cards: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, review_room, new_room): what the day of ``now_ms`` leaves; reviews count by event, introductions by card."""
    today = daily_activity(events, cards).where(F.col("day") == now_ms // DAY_MS)
    return today.select("user_id", F.greatest(F.lit(0), REVIEW_LIMIT - F.col("reviews")).alias("review_room"), F.greatest(F.lit(0), NEW_LIMIT - F.col("new_cards")).alias("new_room"))


def ranked(cards: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """The states with each card's rank in its class and whether the day has room for it."""
    due = F.when(F.col("state") == "due", F.coalesce("due_ms", F.lit(0)))
    order = Window.partitionBy("user_id", "state").orderBy(due, F.coalesce("created_at", F.lit("")), "card_id")
    room = F.when(F.col("state") == "due", F.coalesce("review_room", F.lit(REVIEW_LIMIT))).when(F.col("state") == "new", F.coalesce("new_room", F.lit(NEW_LIMIT))).otherwise(0)
    s = card_states(cards, events, now_ms).withColumn("rank", F.row_number().over(order)).join(rooms(cards, events, now_ms), "user_id", "left")
    return s.withColumn("admitted", F.col("rank") <= room)


def queue(cards: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, position, card_id, state): due cards by due time, then new ones by age, within the day's limits."""
    r = ranked(cards, events, now_ms).where("admitted")
    n_due = F.sum(F.when(F.col("state") == "due", 1).otherwise(0)).over(Window.partitionBy("user_id"))
    return r.select("user_id", (F.col("rank") + F.when(F.col("state") == "new", n_due).otherwise(0)).cast("long").alias("position"), "card_id", "state")


def cram(cards: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """(user_id, position, card_id): every card that isn't suspended: due ones, new ones, then the rest; no limits.

    Positions are ranks within a class behind the number of cards of the classes before it, so the sort is per class.
    """
    r = ranked(cards, events, now_ms).where("state <> 'suspended'")
    sizes = r.groupBy("user_id").agg(F.count_if(F.col("state") == "due").alias("_due"), F.count_if(F.col("state") == "new").alias("_new"))
    before = F.when(F.col("state") == "due", 0).when(F.col("state") == "new", F.col("_due")).otherwise(F.col("_due") + F.col("_new"))
    return r.join(sizes, "user_id").select("user_id", (F.col("rank") + before).cast("long").alias("position"), "card_id")


def counts(cards: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """For each learner: cards by state, those in today's queue, and those that the limits hold back."""
    r = ranked(cards, events, now_ms)
    n = lambda cond, name: F.count_if(cond).alias(name)
    state = lambda s: F.col("state") == s
    held = ~F.col("admitted")
    return r.groupBy("user_id").agg(n(F.col("admitted"), "eligible"), n(state("new"), "new"), n(state("due"), "due"), n(state("later"), "later"), n(state("suspended"), "suspended"), n(state("new") & held, "deferred_new"), n(state("due") & held, "deferred_review"))
