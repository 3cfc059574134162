"""Problem 5: near-copies among texts, by a forest of prefix tries over MinHash signatures.

Texts with the same set of words are one class from the start. In each of ``TREES`` tries a class's signature is a
sequence of words, each the one that comes first in an exponential race whose rates grow with the word's rarity, so two
sets agree in a value with the probability of their weighted Jaccard similarity, and phrases that many texts share count
little. A class's prefix is cut at the first word that at most ``node`` classes hold, at latest at the depth of the
trie, which grows with the logarithm of the number of classes: a node that a rare word closes can't hold more classes
than that, however many there are in all. Classes of one node are candidates if the parity bitmaps of their words allow the
similarity, which loses no pair, and are verified exactly.

In how many tries each verified pair met tells how many pairs met in none (the Chao estimate over the pairs met once
and twice). While the recall so estimated is below its target, the prefixes are shortened: ``node`` grows and the depth
falls, down to a single word, where a pair over the threshold is missed in all tries with a probability below 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import BLOCK, cut_lineage, members_paired, pair, records

#: Tries; classes that a node closed by a rare word may hold at first; the estimated recall that is asked for.
TREES, NODE, RECALL = 16, 32, 0.9995
#: Words that make up at least 1 / COMMON of all words, at most COMMON of them, have their counts sent by the driver; those of all others are joined.
COMMON = 20_000


def word_set(text: Column) -> Column:
    """The hashes of the distinct lower-cased words, sorted; a word is a longest run of letters and digits."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform 64-bit values from hashes, another set for each salt."""
    z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def prefixes(sets: list[np.ndarray], counts: list[np.ndarray], texts: int, tree: int, node: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the key of its node in one trie, and whether a word that at most ``node`` texts hold closes it.

    ``counts`` says for each word how many of all ``texts`` hold it. The key depends on the prefix alone, so two sets with
    the same first words have the same key whatever else they hold.
    """
    key = np.full(len(sets), tree + 1, np.uint64)
    closed = np.zeros(len(sets), bool)
    active = np.arange(len(sets))
    for level in range(depth):
        sizes = np.array([len(sets[i]) for i in active])
        flat, count = np.concatenate([sets[i] for i in active]).view(np.uint64), np.concatenate([counts[i] for i in active])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = mixed(flat, tree * 1000 + level)
        race = -np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (np.log(max(texts, 1) / count) + 0.1)
        least = np.minimum.reduceat(race, starts)
        won = np.flatnonzero(race == np.repeat(least, sizes))
        first = np.full(len(active), len(flat))
        np.minimum.at(first, np.repeat(np.arange(len(active)), sizes)[won], won)
        key[active] = mixed(key[active] ^ flat[first], level)
        rare = count[first] <= node
        closed[active[rare]] = True
        active = active[~rare]
        if not len(active):
            break
    return key.view(np.int64), closed


def dice(a: str, b: str) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def candidates(classes: DataFrame, common: dict[int, int], texts: int, node: int, depth: int, threshold: float) -> DataFrame:
    """(a, b, hits), a < b: classes that share a node of some trie and that their bitmaps allow to be near-copies.

    A bitmap holds for each of 64 groups of words whether their number is odd, so two bitmaps differ in at most as many
    bits as the sets in words. Nodes that no rare word closes may be large; they are joined in blocks.
    """
    keys = np.array(sorted(common), np.int64)
    known = np.array([common[int(k)] for k in keys], np.int64)

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sets, counts = [np.asarray(s, np.int64) for s in batch["words"]], []
            for s, rare, times in zip(sets, batch["rare"], batch["times"]):
                count = np.ones(len(s), np.int64)
                for own, n in ((keys, known), (np.asarray(rare, np.int64), np.asarray(times, np.int64)) if rare is not None else (keys[:0], known[:0])):
                    if len(own):
                        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                        count = np.where(own[at] == s, n[at], count)
                counts.append(count)
            bits = np.array([np.bitwise_xor.reduce(np.uint64(1) << (s.view(np.uint64) & np.uint64(63))) for s in sets], np.uint64).view(np.int64)
            made = [prefixes(sets, counts, texts, tree, node, depth) for tree in range(TREES)]
            keys_of, closed = (list(np.stack(x, axis=1)) for x in zip(*made))
            yield pd.DataFrame({"u": batch["u"], "n": batch["n"].astype(np.int32), "bits": bits, "nodes": keys_of, "closed": closed})

    # the signatures are made once; they are read for closed nodes, open ones and the sizes of these
    signed = cut_lineage(classes.select("u", "n", "words", "rare", "times").mapInPandas(nodes, "u long, n int, bits long, nodes array<long>, closed array<boolean>"))
    at = signed.select("u", "n", "bits", F.explode(F.arrays_zip("nodes", "closed")).alias("t")).select("u", "n", "bits", F.col("t.nodes").alias("node"), F.col("t.closed").alias("closed"))
    plain = at.where("closed").select("node", "u", "n", "bits", F.lit(0).alias("block"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    open_ = at.where("not closed").drop("closed")
    sizes = open_.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    full = open_.join(sizes, "node").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    full = full.withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = plain.unionByName(full.select("node", "u", "n", "bits", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")))
    a, b = full.alias("a"), full.alias("b")
    same = (F.col("a.node") == F.col("b.node")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    # a pair of two blocks meets once: where its blocks differ in the task of both, else in the block's own task
    once = (F.col("a.u") < F.col("b.u")) & ((F.col("a.block") != F.col("b.block")) | (F.col("a.x") == F.col("a.y")))
    alike = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) < (F.col("a.n") + F.col("b.n")) * (1 - threshold) + 1e-6
    return a.join(b, same & once & alike).groupBy(F.col("a.u").alias("a"), F.col("b.u").alias("b")).agg(F.count("*").alias("hits"))


def estimated_recall(found: int, once: int, twice: int) -> float:
    """The share of all pairs that were found, if ``once`` of them met in one trie only and ``twice`` in two."""
    missed = once * max(once - 1, 0) / (2 * (twice + 1))
    return found / (found + missed) if found else 1.0


class Forest:
    """Near-copies of ``texts`` (id, text): pairs (a, b) of classes by number, the classes, their members, and the estimated recall."""

    def __init__(self, texts: DataFrame, threshold: float = 0.85, target: float = RECALL) -> None:
        sets = texts.select("id", word_set(F.col("text")).alias("words")).where("size(words) > 0")
        sets = sets.withColumn("k1", F.xxhash64("words")).withColumn("k2", F.xxhash64(F.lit(5), "words"))
        rows = sets.groupBy("k1", "k2").agg(F.min("id").alias("c"), F.count("*").alias("copies"), F.first("words").alias("words"))
        base = cut_lineage(rows.withColumn("u", F.monotonically_increasing_id()))
        self.classes = base.select("u", "c", "copies", "words", F.size("words").alias("n"))
        several = base.where("copies > 1").select("k1", "k2", "u")
        self.members = base.where("copies = 1").select(F.col("c").alias("id"), "u").unionByName(sets.select("id", "k1", "k2").join(several, ["k1", "k2"]).select("id", "u"))
        counts = self.classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("k"))
        totals = self.classes.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        self.texts = totals.texts
        common = {r.w: r.k for r in counts.where(F.col("k") * COMMON >= totals.words).collect()} if totals.words else {}
        # the rest have no hot word, so the join is even; words of one class only need no count
        rare = counts.where((F.col("k") > 1) & (F.col("k") * COMMON < totals.words))
        own = self.classes.select("u", F.explode("words").alias("w")).join(rare, "w").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("w", "k"))).alias("r"))
        self.counted = self.classes.join(own.select("u", F.col("r.w").alias("rare"), F.col("r.k").alias("times")), "u", "left")
        self.common, self.threshold, self.target = common, threshold, target
        self.recall = 1.0
        self.pairs = self._search()

    def _search(self) -> DataFrame:
        words = self.classes.select("u", "words")
        a, b = words.select(F.col("u").alias("a"), F.col("words").alias("wa")), words.select(F.col("u").alias("b"), F.col("words").alias("wb"))
        node, depth = NODE, 2 + math.ceil(math.log2(self.texts + 2) / 2)
        while True:
            met = candidates(self.counted, self.common, self.texts, node, depth, self.threshold)
            true = cut_lineage(met.join(a, "a").join(b, "b").where(dice("wa", "wb") > self.threshold).select("a", "b", "hits"))
            seen = true.agg(F.count("*").alias("found"), F.count_if(F.col("hits") == 1).alias("once"), F.count_if(F.col("hits") == 2).alias("twice")).first()
            self.recall = estimated_recall(seen.found, seen.once, seen.twice)
            if self.recall >= self.target or depth == 1:
                return true.select("a", "b")
            node, depth = node * 8, max(1, depth - 2)

    def card_pairs(self) -> DataFrame:
        """(a, b) of ids: every pair of near-copies, within classes and across them, block by block, so that no task holds all members of a hot class."""
        alone = self.classes.where("copies > 1").select(F.col("u").alias("a"), F.col("u").alias("b"))
        return members_paired(self.pairs.unionByName(alone), self.members, self.classes, BLOCK).select(*pair("ia", "ib", "a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the least node that each node of ``edges`` (a, b) is connected with.

    Alternating large and small stars; the edges are checkpointed each round and only their number of changes comes
    to the driver.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = cut_lineage(small)
        # every node once, and no centre that hangs on another: nothing more can change
        open_ = small.groupBy("u").count().where("count > 1").limit(1).count() or small.select("v").distinct().join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        e = small
        if not open_:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())


def claims(cards: DataFrame) -> DataFrame:
    return records(cards, ["id", "claim"]).select("id", F.col("claim").alias("text"))


def near_copies(cards: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(card_id_a, card_id_b): every pair of cards whose claims' word sets have a Dice similarity over ``threshold``.

    Repeated ids count once. Null claims and claims without a letter or digit are near no other. A claim that n cards
    share gives n (n - 1) / 2 rows; ``near_copy_classes`` and ``near_copy_groups`` tell the same by class.
    """
    return Forest(claims(cards), threshold).card_pairs().select(F.col("a").alias("card_id_a"), F.col("b").alias("card_id_b"))


def near_copy_classes(cards: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(class_id_a, class_id_b) of classes of equal word sets that are near-copies; a class is named by its least card id."""
    forest = Forest(claims(cards), threshold)
    a, b = (forest.classes.select(F.col("u").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    return forest.pairs.join(a, "a").join(b, "b").select(*pair("ca", "cb", "class_id_a", "class_id_b"))


def near_copy_groups(cards: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(card_id, class_id, group_id, group_size) of every card with a claim: near-copies of near-copies are one group."""
    forest = Forest(claims(cards), threshold)
    names = forest.classes.select("u", "c")
    edges = forest.pairs.join(names.select(F.col("u").alias("a"), F.col("c").alias("ca")), "a").join(names.select(F.col("u").alias("b"), F.col("c").alias("cb")), "b")
    groups = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    named = forest.classes.select("u", "c", "copies").join(groups, F.col("c") == F.col("node"), "left").select("u", F.col("c").alias("class_id"), F.coalesce("group", "c").alias("group_id"), "copies")
    sizes = named.groupBy("group_id").agg(F.sum("copies").alias("group_size"))
    out = forest.members.join(named.join(sizes, "group_id").drop("copies"), "u")
    return out.select(F.col("id").alias("card_id"), "class_id", "group_id", "group_size")
