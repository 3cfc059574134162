"""Concepts by decision, proportions and their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import half_up
from groundwork.sources import once

Z = 1.96


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's 95 % interval, clamped and rounded to four places; [0, 1] for nothing."""
    s, m = successes.cast("double"), n.cast("double")
    p, z2 = s / m, Z * Z
    centre, spread = p + z2 / (2 * m), Z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    low = half_up(F.greatest(F.lit(0.0), (centre - spread) / (1 + z2 / m)), 4)
    high = half_up(F.least(F.lit(1.0), (centre + spread) / (1 + z2 / m)), 4)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def by_job(concepts: DataFrame) -> DataFrame:
    """For each job: concepts found and included, gaps, cards made, and the share included with its interval."""
    c = once(concepts, "job_id", "decision", "card_id")
    included = F.col("decision").startswith("included")
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)
    out = c.groupBy("job_id").agg(F.count("*").alias("found"), n(included, "included"), n(~included, "excluded"), n(F.col("card_id").isNotNull(), "created"), n(included & F.col("card_id").isNull(), "gaps"))
    share = half_up(F.col("included").cast("double") / F.col("found"), 4)
    low, high = wilson(F.col("included"), F.col("found"))
    return out.select("*", share.alias("share"), low.alias("low"), high.alias("high"))


def by_decision(concepts: DataFrame) -> DataFrame:
    """(provider, decision, n, first_label): how often each provider's concepts got a decision, and the first one's label."""
    c = once(concepts, "provider", "decision", "label", "created_at")
    return c.groupBy("provider", "decision").agg(F.count("*").alias("n"), F.min_by("label", F.struct("created_at", "id")).alias("first_label"))


def batches(concepts: DataFrame, most: int = 120, size: int = 10) -> DataFrame:
    """(concept_id, batch): the ``most`` most central included concepts of each job in batches of ``size``."""
    c = once(concepts, "job_id", "decision", "centrality", "ordinal").where("decision like 'included%'")
    order = Window.partitionBy("job_id").orderBy(F.desc_nulls_last("centrality"), F.asc_nulls_first("ordinal"), "id")
    c = c.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return c.select(F.col("id").alias("concept_id"), F.floor((F.col("_r") - 1) / size).cast("long").alias("batch"))
