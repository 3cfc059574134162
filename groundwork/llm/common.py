"""What the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.blocks import BLOCK, members_paired
from groundwork.session import cut_lineage

__all__ = ["BLOCK", "TOKENIZER_DIR", "cut_lineage", "members_paired", "pair", "pairs_within", "records", "table"]

#: Folder of the public tokenizers' files; a parameter of every operator that needs one.
TOKENIZER_DIR = os.environ.get("GROUNDWORK_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Each record once: rows that repeat ``key`` are one record delivered again.

    Rows without a key name no record and are left out. Should two deliveries differ, the greatest row counts, so
    that the choice doesn't depend on the order of the rows. The aggregate combines before its shuffle, so a key that
    holds many rows costs one row per input partition.
    """
    rest = [c for c in columns if c != key]
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def pair(left: str, right: str, as_left: str, as_right: str) -> list:
    """The two columns as a pair with the smaller id first."""
    return [F.least(F.col(left), F.col(right)).alias(as_left), F.greatest(F.col(left), F.col(right)).alias(as_right)]


def pairs_within(rows: DataFrame, key: str, item: str, block: int = BLOCK) -> DataFrame:
    """(key, a, b), a < b: every two items of a group, met in blocks, so that no task holds a large group."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1")
    full = rows.select(key, item).join(sizes, key).withColumn("_blocks", F.ceil(F.col("_m") / block).cast("int"))
    full = full.withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    full = full.select(key, item, "_block", F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"))
    a, b = full.alias("a"), full.alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    once = (F.col(f"a.{item}") < F.col(f"b.{item}")) & ((F.col("a._block") != F.col("b._block")) | (F.col("a._x") == F.col("a._y")))
    return a.join(b, same & once).select(F.col(f"a.{key}").alias(key), F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b"))
