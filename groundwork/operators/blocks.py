"""Pairs within groups of any size, met block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group, or members of a unit, that one block holds.
BLOCK = 256


def members_paired(pairs: DataFrame, members: DataFrame, units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ia, ib): the members (id, u) of each pair (a, b) of units; a pair of a unit with itself gives its members two by two.

    ``units`` (u, copies) says how many members a unit has, so that no task holds all members of a large one.
    """
    sized = units.select("u", F.ceil(F.col("copies") / block).cast("int").alias("blocks"))
    ua, ub = (sized.select(F.col("u").alias(x), F.col("blocks").alias(f"blocks_{x}")) for x in "ab")
    met = pairs.select("a", "b").join(ua, "a").join(ub, "b").withColumn("same", F.col("a") == F.col("b"))
    met = met.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
    met = met.withColumn("y", F.explode(F.sequence(F.when(F.col("same"), F.col("x")).otherwise(0), F.col("blocks_b") - 1)))
    placed = members.join(sized, "u").select("id", "u", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    left, right = (placed.select(F.col("id").alias(f"i{k}"), F.col("u").alias(k), F.col("block").alias(at)) for k, at in (("a", "x"), ("b", "y")))
    once = ~F.col("same") | (F.col("x") != F.col("y")) | (F.col("ia") < F.col("ib"))
    return met.select("a", "b", "x", "y", "same").join(left, ["a", "x"]).join(right, ["b", "y"]).where(once).select("ia", "ib")
