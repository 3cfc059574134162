"""Problem 8: a mix of sources in which each source has its target share of all tokens.

Every document gets a random key, a hash of its id. Within a source the documents are ordered by that key, and the
prefix sum of their tokens is made in two levels, so that a source of any size is spread over ranges of the key,
whose number grows with the documents: the sums of the ranges, their running total, and the running total within a range. A source's budget is cut at
the document whose middle lies nearest to it; a budget of more than all its tokens repeats the source whole as often
as it fits and cuts the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import TOKENIZER_DIR, cut_lineage
from groundwork.llm.tokens import count_tokens

#: Ranges of the random key within a source at least, and documents of all in one range of a source at most, about.
FAN, IN_RANGE = 4096, 50_000


def fan_for(documents: int) -> int:
    """The number of ranges, a power of two, so that even a source of all documents has small ones."""
    return 1 << max(FAN.bit_length() - 1, math.ceil(math.log2(max(1, documents / IN_RANGE))))


def range_of(key: Column, fan: int = FAN) -> Column:
    """The range of the key, in the key's order."""
    return F.shiftright(key, 64 - fan.bit_length() + 1) + fan // 2


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """A row for each target source: its tokens, budget, whole epochs and the rest of the budget.

    Without ``total_tokens`` the mix is the largest that no source with tokens falls short of. With it, a source that
    can't fill its share within its repeats gives all it may.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(sizes, "source", "left").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    able = F.col("tokens") * F.col("max_repeats")
    most = F.lit(total_tokens).cast("double") if total_tokens is not None else F.coalesce(F.min(F.when((F.col("target_share") > 0) & (able > 0), able / F.col("target_share"))).over(Window.partitionBy()), F.lit(0.0))
    t = t.withColumn("budget", F.least(F.floor(F.col("target_share") * most + 1e-6).cast("long"), able))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 8, folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, times) and the report of its shares.

    A document of a source in ``targets`` is used ``times`` times, at most its source's ``max_repeats``. Null and empty
    texts hold no tokens and are never used; nor are documents whose source is null or isn't listed. Repeated rows
    are documents of their own. Equal keys are ordered by id. A source's tokens differ from its budget by at most
    half of one document. Tables without rows give an empty mix, and a report with zeros.
    """
    listed = targets.where(F.col("source").isNotNull()).select(F.col("source").alias("_listed")).distinct()
    own = documents.select("doc_id", "source", "text").join(listed, F.col("source") == F.col("_listed"), "left_semi")
    sized = count_tokens(own, ["doc_id", "source"], folder=folder).where(F.col("n_tokens") > 0)
    sized = cut_lineage(sized.withColumn("_key", F.xxhash64("doc_id", F.lit(seed))))
    sized = sized.withColumn("_range", range_of(F.col("_key"), fan_for(sized.count())))

    ranges = sized.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("source", "_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    budget = budgets(ranges.groupBy("source").agg(F.sum("_sum").alias("tokens")), targets, total_tokens)
    plan = offsets.join(budget.select("source", "epochs", "rest"), "source")

    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sized.withColumn("_to", F.sum("n_tokens").over(inside)).join(plan, ["source", "_range"])
    middle = F.col("_offset") + F.col("_to") - F.col("n_tokens") / 2
    times = F.col("epochs") + F.when(middle <= F.col("rest"), 1).otherwise(0)
    mix = at.select("doc_id", "source", "n_tokens", times.cast("int").alias("times")).where("times > 0")

    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("reached"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    share = F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(Window.partitionBy()), F.lit(0))
    report = budget.join(used, "source", "left").select("source", "target_share", F.col("tokens").alias("source_tokens"), F.col("budget").alias("budget_tokens"), F.coalesce("reached", F.lit(0)).alias("reached_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"))
    return mix, report.withColumn("reached_share", F.coalesce(share, F.lit(0.0)))
