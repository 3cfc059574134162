"""Greedy choices in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import cut_lineage


def first_kept(edges: DataFrame) -> DataFrame:
    """(later, first): for each row that is dropped, the earliest kept row it is dropped for.

    ``edges`` (first, later, rank) join a row with an earlier one that drops it if kept; ``rank`` orders the earlier
    ones. A row is kept unless an earlier kept row drops it. In each round those are kept that no undecided row comes
    before, and the rows they drop are settled; only the open edges are carried on, so there are as many rounds as the
    longest chain of decisions that hang on one another.
    """
    edges = cut_lineage(edges.select("first", "later", "rank").distinct())
    open_, dropped = edges, None
    while open_.limit(1).count():
        waiting = open_.select(F.col("later").alias("first")).distinct()
        kept = open_.join(waiting, "first", "left_anti").select("first").distinct()
        gone = open_.join(kept, "first", "left_semi").select("later").distinct()
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(kept, "first", "left_anti").join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "first"), "first", "left_anti")
        # rows that lost all edges to undecided ones before them are kept by what is left of the edges
        open_, dropped = cut_lineage(rest), cut_lineage(dropped)
    if dropped is None:
        return edges.select("later", "first").limit(0)
    by_kept = edges.join(dropped.select(F.col("later").alias("first")), "first", "left_anti").join(dropped, "later", "left_semi")
    return by_kept.groupBy("later").agg(F.min_by("first", F.struct("rank", "first")).alias("first"))
