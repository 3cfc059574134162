"""What a store would refuse: orphans, repeated keys and values out of their set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    p = parent.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
    return child.where(F.col(column).isNotNull()).join(p, column, "left_anti")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def tally(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): how many rows each check finds."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()])
