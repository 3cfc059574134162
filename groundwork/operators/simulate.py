"""Sentences of sections as candidates for cards, without a model: their kind, key term, score and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import LEFT, RIGHT, SPACES, let
from groundwork.operators.pages import scope_words
from groundwork.sources import once

#: Words that make no term.
STOP_WORDS = "the a an and or but if then than that this these those of in on at to for with from by as is are was were be been being it its into over under between their there which when where while so such may can could would should not no only also both each other more most some any all because since thus hence therefore however rather about across after before during within without through via toward towards one two three they them his her he she we our you your has have had do does did will must very much many same".split()
#: Wording by which sentences are told apart; the first that is met decides.
DEFINES = "(?:is|are|was|were)[\\s]+(?:defined as|known as|called|termed|referred to as|composed of|characterized by|characterised by|the)"
MEASURES = "mV|ms|Hz|nm|µm|um|mm|cm|kDa|Da|mM|µM|uM|nM|pM|%|°C|percent|millivolts?|milliseconds?|seconds?|minutes?|hours?|hertz|nanometers?|micrometers?|millimeters?|centimeters?|millimolar|micromolar|nanomolar|picomolar|degrees?|daltons?|kilodaltons?"
CAUSES = "because|since|due to|owing to|as a result of|therefore|thus|hence"
WORKS_BY = "by|through|via|requires|enables|allows|mediates|depends on|relies on"
#: Words of a section below which it gives no card, cards of a section at most, and words that one card stands for.
LEAST_WORDS, MOST_CARDS, WORDS_PER_CARD = 40, 60, {"high-yield": 400, "comprehensive": 200}


def sentences(text: Column) -> Column:
    """Sentences of a text: a mark and a blank part them, but for a full stop behind a figure."""
    flat = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.filter(F.split(F.regexp_replace(flat, r"([!?]|(?:^|[^0-9])\.) ", "$1\n"), "\n"), lambda s: F.trim(s) != "")


def term_words(text: Column) -> Column:
    """Lower-cased words of four letters or more that make terms."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))


def kind_of(text: Column) -> Column:
    says = lambda words: text.rlike(f"(?i){LEFT}(?:{words}){RIGHT}")
    measured = text.rlike(rf"(?i){LEFT}[0-9]+(?:\.[0-9]+)?\s*(?:{MEASURES}|s{RIGHT})")
    return F.when(says(DEFINES) | measured, "definition").when(says(CAUSES), "causal").when(says(WORKS_BY), "mechanism").otherwise("general")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, overlaps left out; 0 for an empty term."""
    return F.when(term == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def key_term(text: Column) -> Column:
    """The longest run of three, two or one telling words that stands once in the sentence, the first of equals; null if there is none."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    stripped = F.transform(ws, lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    size = lambda t: F.length(F.replace(t, F.lit(" "), F.lit("")))

    def runs_of(bare: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(bare) - (n - 1))
        return F.when(F.size(bare) >= n, F.transform(starts, lambda i: F.slice(bare, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))

    def longest(bare: Column, low: Column) -> Column:
        every = F.concat(runs_of(bare, 3), runs_of(bare, 2), runs_of(bare, 1))
        telling = F.filter(every, lambda r: F.forall(r, lambda t: (F.length(t) >= 4) & ~F.lower(t).isin(STOP_WORDS)))
        terms = F.filter(F.transform(telling, lambda r: F.array_join(r, " ")), lambda t: occurrences(low, F.lower(t)) == 1)
        return F.aggregate(terms, F.lit(""), lambda best, t: F.when(size(t) > size(best), t).otherwise(best))

    return F.nullif(let(stripped, lambda bare: let(F.lower(text), lambda low: longest(bare, low))), F.lit(""))


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def tags(text: Column) -> Column:
    """The first three distinct telling words, with a capital."""
    return F.transform(F.slice(F.array_distinct(term_words(text)), 1, 3), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))


def cards_for(words: Column, mode: str) -> Column:
    """How many cards a section of so many words is asked for."""
    return F.when(words < LEAST_WORDS, 0).otherwise(F.least(F.lit(MOST_CARDS), F.greatest(F.lit(1), F.floor(words / WORDS_PER_CARD[mode] + 0.5)))).cast("int")


def candidates(scopes: DataFrame) -> DataFrame:
    """(section_id, page_number, sentence_no, sentence, strict, kind, key_term, score) of each section's distinct sentences.

    A sentence is strict with 8 to 70 words, three of them telling; with 5 to 90, two telling, it is a reserve. Of
    sentences with the same letters the first of the better sort counts.
    """
    s = once(scopes, "pages").where("pages is not null").select(F.col("id").alias("section_id"), F.explode("pages").alias("p")).where("p.text <> ''")
    rows = s.select("section_id", F.col("p.page_number").alias("page_number"), F.posexplode(sentences(F.col("p.text"))).alias("sentence_no", "sentence"))
    n, telling = F.size(F.split("sentence", r"\s+")), F.size(term_words(F.col("sentence")))
    strict = n.between(8, 70) & (telling >= 3)
    rows = rows.withColumn("strict", strict).where(strict | (n.between(5, 90) & (telling >= 2)))
    first = Window.partitionBy("section_id", fingerprint(F.col("sentence"))).orderBy(F.desc("strict"), F.asc_nulls_first("page_number"), "sentence_no", "sentence")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    rows = rows.withColumn("kind", kind_of(F.col("sentence"))).withColumn("key_term", key_term(F.col("sentence")))
    by_kind = F.when(F.col("kind") == "definition", 3.0).when(F.col("kind") == "causal", 2.8).when(F.col("kind") == "mechanism", 2.4).otherwise(1.0)
    return rows.select("section_id", "page_number", F.col("sentence_no").cast("long").alias("sentence_no"), "sentence", "strict", "kind", "key_term", (by_kind + F.when(F.col("key_term").isNotNull(), 1.0).otherwise(0.0)).alias("score"))


def chosen(scopes: DataFrame, mode: str = "comprehensive") -> DataFrame:
    """(section_id, position, sentence): the sentences of each section in the order of pages, on a page the best first, up to the section's number of cards."""
    target = scope_words(scopes).select("section_id", cards_for(F.col("n_words"), mode).alias("target"))
    order = Window.partitionBy("section_id").orderBy(F.asc_nulls_first("page_number"), F.desc("score"), F.desc("strict"), "sentence_no", "sentence")
    rows = candidates(scopes).withColumn("position", F.row_number().over(order).cast("long")).join(target, "section_id")
    return rows.where(F.col("position") <= F.col("target")).select("section_id", "position", "sentence")
