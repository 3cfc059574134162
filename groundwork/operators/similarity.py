"""Exact set-similarity joins and the greedy choice of first statements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.operators.blocks import members_paired
from groundwork.operators.greedy import first_kept
from groundwork.session import cut_lineage

#: Decisions that pass the choice of first statements, and those that have others dropped.
PASSING = ("excluded_not_in_source", "excluded_out_of_scope")
INCLUDED = ("included_eligible", "included_central")
#: Words that make up at least 1 / COMMON of all words, at most COMMON of them, have their counts sent by the driver.
COMMON = 200_000


def rarest_words(sets: DataFrame, common: dict[int, int], threshold: float) -> DataFrame:
    """(u, n, bits, at, w) for sets (u, n, hashes): the words by which a set meets others, from ``at`` 0, the rarest, on.

    ``common`` has the counts of common words; all others come first, by hash. ``bits`` holds for each of 64 groups of
    words whether their number is odd, so two bitmaps differ in at most as many bits as the sets in words.
    """
    keys = np.array(sorted(common), np.int64)
    known = np.array([common[k] for k in keys.tolist()], np.int64)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n = batch["n"].to_numpy(np.int64)
            words, starts = np.concatenate(batch["hashes"].to_list()), np.cumsum(n) - n
            count = np.zeros(len(words), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                count = np.where(keys[at] == words, known[at], 0)
            bits = np.bitwise_xor.reduceat(np.uint64(1) << (words.view(np.uint64) & np.uint64(63)), starts).view(np.int64)
            words = words[np.lexsort((words, count, np.repeat(np.arange(len(n)), n)))]
            kept = n - np.ceil(n * (threshold / (2 - threshold)) - 1e-9).astype(np.int64) + 1
            yield pd.DataFrame({"u": batch["u"], "n": batch["n"], "bits": bits, "words": [words[x : x + k] for x, k in zip(starts, kept)]})

    made = sets.select("u", "n", "hashes").mapInPandas(ordered, "u binary, n int, bits long, words array<long>")
    return made.select("u", "n", "bits", F.posexplode("words").alias("at", "w"))


def met_pairs(heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets that share one of their rarest words (u, n, bits, at, w) and may have a similarity over ``threshold``.

    The smaller set shares at least ``threshold`` of its own words, so it is met by fewer of them than the larger one. At
    the first word that two sets share, what follows it in either bounds what they share in all. No pair is lost.
    """
    a, b = heads.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)).alias("a"), heads.alias("b")
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.u") < F.col("b.u")))
    both = F.col("a.n") + F.col("b.n")
    enough = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= both * (threshold / 2) - 1e-9
    alike = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) < both * (1 - threshold) + 1e-6
    return a.join(b, (F.col("a.w") == F.col("b.w")) & smaller & enough & alike).select(F.col("a.u").alias("a"), F.col("b.u").alias("b")).distinct()


def similar_pairs(texts: DataFrame, words: Column, threshold: float = 0.85, split: Column | None = None) -> DataFrame:
    """(id_a, id_b) of all texts (id, ...) whose word sets have a Dice similarity over ``threshold``.

    With ``split`` only texts that are equal in it are compared. Words are ordered by how rare they are; two sets over
    the threshold share one of their rarest, so only these are joined on (prefix filtering), with texts of one set
    taken together first. The result is complete. What is shuffled for a set is a few hashes of 8 bytes; pairs are sifted
    where they meet, and only those that may be similar are looked up.
    """
    group = F.coalesce((F.lit("") if split is None else split).cast("string"), F.lit(""))
    sets = texts.select("id", group.alias("g"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("words")).where("size(words) > 0")
    sets = sets.withColumn("n", F.size("words")).withColumn("text", F.array_join("words", "\0"))
    # words are made once, for the counts, the sets and their members
    sets = cut_lineage(sets.select("id", F.substring(F.unhex(F.sha2(F.concat_ws("\0", "g", "text"), 256)), 1, 16).alias("u"), "g", "n", "text"))
    split_again = F.split("text", "\0")
    hashes = F.transform(split_again, lambda w: F.xxhash64("g", w))
    total = sets.agg(F.sum("n").alias("n")).first().n or 0
    counts = sets.select(F.explode(hashes).alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    common = {r.w: r.k for r in counts.where((F.col("k") > 1) & (F.col("k") * COMMON >= total)).collect()}
    one = sets.groupBy("u").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.first("text").alias("text"))
    met = met_pairs(rarest_words(one.withColumn("hashes", hashes), common, threshold), threshold)
    left, right = (one.select(F.col("u").alias(x), F.col("text").alias(f"t{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    shared = F.size(F.array_intersect(F.split("ta", "\0"), F.split("tb", "\0")))
    pairs = met.join(left, "a").join(right, "b").where(2.0 * shared / (F.col("na") + F.col("nb")) > threshold).select("a", "b")
    copies = sets.groupBy("u").agg(F.count("*").alias("copies"))
    pairs = pairs.unionByName(copies.where("copies > 1").select(F.col("u").alias("a"), F.col("u").alias("b")))
    both = members_paired(pairs, sets.select("id", "u"), copies)
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def in_order(pairs: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Pairs (id_a, id_b) as edges (first, later, rank) by the order of ``rows`` (id, order)."""
    a, b = (rows.select(F.col("id").alias(f"id_{x}"), F.col(order).alias(f"o{x}")) for x in "ab")
    at = pairs.join(a, "id_a").join(b, "id_b")
    swap = F.struct(F.col("oa"), F.col("id_a")) > F.struct(F.col("ob"), F.col("id_b"))
    return at.select(F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("first"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("later"), F.when(swap, F.col("ob")).otherwise(F.col("oa")).alias("rank"))


def first_statements(rows: DataFrame, group: str, order: str, threshold: float = 0.9) -> DataFrame:
    """(id, kept_id) for rows (id, group, order, words): a row is dropped for the first kept row of its group that is as similar.

    Rows are similar by their words, and where there is a column ``kind`` only if that is the same; or by their
    ``label_words``, whatever their kind. With a column ``decision``, rows of a decision in ``PASSING`` are never
    dropped, and only rows of a decision in ``INCLUDED`` have others dropped for them. Compared with kept rows only,
    in order, so the result isn't that of connected components. Ids must be unique.
    """
    has = set(rows.columns)
    at = threshold - 1e-9
    kind = F.coalesce(F.col("kind"), F.lit("\1")) if "kind" in has else F.lit("")
    known = rows.where(F.col("words").isNotNull())
    pairs = similar_pairs(known, F.col("words"), at, F.concat_ws("\2", F.col(group).cast("string"), kind))
    if "label_words" in has:
        pairs = pairs.unionByName(similar_pairs(rows.where("label_words is not null"), F.col("label_words"), at, F.col(group))).distinct()
    edges = in_order(pairs, rows, order)
    if "decision" in has:
        dropping = rows.where(F.col("decision").isin(*INCLUDED)).select(F.col("id").alias("first"))
        droppable = rows.where(F.coalesce(~F.col("decision").isin(*PASSING), F.lit(True))).select(F.col("id").alias("later"))
        edges = edges.join(dropping, "first", "left_semi").join(droppable, "later", "left_semi")
    gone = first_kept(edges).select(F.col("later").alias("id"), F.col("first").alias("_to"))
    return rows.select("id").join(gone, "id", "left").select("id", F.coalesce("_to", "id").alias("kept_id"))
