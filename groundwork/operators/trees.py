"""Closures over parent-child edges, and the pages that sections of a tree keep for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import cut_lineage


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, depth) of every node with itself and all above it; edges (node, parent), a null parent is a root.

    Paths are doubled each round until none is new, so a tree of any depth takes as many rounds as the logarithm of
    its depth. Of several paths the shortest counts.
    """
    up = cut_lineage(edges.where("parent is not null and node is not null").select(F.col("parent").alias("ancestor"), "node", F.lit(1).cast("long").alias("depth")).distinct())
    known = up.count()
    while True:
        a, b = up.alias("a"), up.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(F.col("b.ancestor").alias("ancestor"), F.col("a.node").alias("node"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        up = cut_lineage(up.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        now = up.count()
        if now == known:
            break
        known = now
    own = edges.where("node is not null").select("node").distinct().select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("long").alias("depth"))
    return own.unionByName(up.where("ancestor <> node"))


def sizes(edges: DataFrame) -> DataFrame:
    """(ancestor, below, height): how many nodes hang under each node, and how deep."""
    return closure(edges).groupBy("ancestor").agg((F.count("*") - 1).alias("below"), F.max("depth").alias("height"))


def selected_sections(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id): the chosen sections (id) with all that hang under them; every section if none is chosen. Sections are (id, parent_id)."""
    below = closure(sections.select(F.col("id").alias("node"), F.col("parent_id").alias("parent")))
    some = chosen.where("id is not null").select(F.col("id").alias("ancestor")).distinct()
    # one row decides between the two
    any_chosen = some.limit(1).select(F.lit(True).alias("_some"))
    picked = below.join(some, "ancestor", "left_semi").select(F.col("node").alias("id")).distinct()
    every = sections.select("id").distinct().join(F.broadcast(any_chosen), F.lit(True), "left").where("_some is null").select("id")
    return picked.unionByName(every)


def own_pages(sections: DataFrame) -> DataFrame:
    """(id, page) of selected sections (id, parent_id, page_start, page_end): pages that no selected section under them claims.

    Sections left without a page give no row.
    """
    pages = sections.select("id", F.explode(F.when(F.col("page_end") >= F.col("page_start"), F.sequence("page_start", "page_end"))).alias("page"))
    under = closure(sections.select(F.col("id").alias("node"), F.col("parent_id").alias("parent"))).where("depth > 0")
    claimed = under.join(pages.withColumnRenamed("id", "node"), "node").select(F.col("ancestor").alias("id"), "page").distinct()
    return pages.join(claimed, ["id", "page"], "left_anti")
