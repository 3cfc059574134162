"""Concepts checked against their source: decisions, formats, coverage and the calls they are asked in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import CAUSAL_CUE, DEFINITION_CUE, collapse, has_mechanism, has_quantity, has_words
from groundwork.operators.grounding import SHORTEST
from groundwork.operators.pages import collapsed_pages
from groundwork.sources import once

#: Fixed value: centrality from which a concept is central.
CENTRAL = 0.55


def decisions(concepts: DataFrame, scopes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(concept_id, decision, page_index, centrality) of concepts with a label.

    A section that isn't stored is out of scope. An excerpt of eight letters or more that stands on its page letter by
    letter is included; so is one that stands on exactly one other page of its section, whose number it then gets.
    """
    c = once(concepts, "label", "centrality", "section_id", "page_index", "source_excerpt", "source_block_id").where(collapse(F.col("label")) != "")
    c = c.select(F.col("id").alias("concept_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("centrality"))).alias("centrality"), "section_id", "page_index", "source_block_id", collapse(F.col("source_excerpt")).alias("excerpt"))
    s = once(scopes, "document_version_id", "page_start", "page_end").withColumnRenamed("id", "section_id").withColumn("stored", F.lit(True))
    b = once(blocks, "document_version_id").select(F.col("id").alias("source_block_id"), F.col("document_version_id").alias("own_version"))
    c = c.join(s, "section_id", "left").join(b, "source_block_id", "left").withColumn("version", F.coalesce("document_version_id", "own_version"))
    pages = collapsed_pages(blocks).select(F.col("document_version_id").alias("version"), "page_index", "page")
    able = F.length(F.coalesce("excerpt", F.lit(""))) >= SHORTEST
    at = c.join(pages, ["version", "page_index"], "left").withColumn("there", F.coalesce(able & F.col("page").contains(F.col("excerpt")), F.lit(False))).drop("page")
    outside = F.col("section_id").isNotNull() & F.col("stored").isNull()
    lost = at.where(~outside & ~F.col("there") & able & F.col("stored")).select("concept_id", "version", "excerpt", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_index"))
    elsewhere = lost.join(pages, ["version", "page_index"]).where(F.col("page").contains(F.col("excerpt"))).groupBy("concept_id").agg(F.count("*").alias("n"), F.min("page_index").alias("moved")).where("n = 1").select("concept_id", "moved")
    out = at.join(elsewhere, "concept_id", "left")
    decision = F.when(outside, "excluded_out_of_scope").when(F.col("there") | F.col("moved").isNotNull(), "included_eligible").otherwise("excluded_not_in_source")
    return out.select("concept_id", decision.alias("decision"), F.when(~outside & ~F.col("there"), F.coalesce("moved", "page_index")).otherwise(F.col("page_index")).alias("page_index"), "centrality")


def high_yield(decided: DataFrame) -> DataFrame:
    """The decisions where only central concepts are wanted."""
    included = F.col("decision") == "included_eligible"
    central = F.when(included & (F.coalesce("centrality", F.lit(0.0)) < CENTRAL), "excluded_secondary_high_yield").when(included, "included_central").otherwise(F.col("decision"))
    return decided.select("concept_id", central.alias("decision"))


def formats(concepts: DataFrame) -> DataFrame:
    """(concept_id, format, reason): cloze for quantities and definitions if a span can be deleted, else question and answer; wording goes before kind."""
    c = once(concepts, "kind", "source_excerpt").select(F.col("id").alias("concept_id"), "kind", F.coalesce("source_excerpt", F.lit("")).alias("text"))
    flat = collapse(F.col("text"))
    deletable = (F.size(F.filter(F.split(flat, r"\s+"), lambda w: w != "")) >= 4) & (F.length(flat) >= 3)
    cloze = lambda reason: F.when(deletable, f"cloze {reason}").otherwise("qa fallback_relational")
    told = (
        F.when(has_quantity(F.col("text")), cloze("content_cues_quantity"))
        .when(has_words(F.col("text"), DEFINITION_CUE), cloze("content_cues_definition"))
        .when(has_words(F.col("text"), CAUSAL_CUE), F.lit("qa content_cues_causal"))
        .when(has_mechanism(F.col("text")), F.lit("qa content_cues_mechanism"))
        .when(F.col("kind").isin("quantity", "definition"), F.when(deletable, F.concat(F.lit("cloze concept_"), F.col("kind"))).otherwise("qa fallback_relational"))
        .when(F.col("kind").isin("causal", "mechanism"), F.concat(F.lit("qa concept_"), F.col("kind")))
        .otherwise("qa concept_relational")
    )
    return c.select("concept_id", F.substring_index(told, " ", 1).alias("format"), F.substring_index(told, " ", -1).alias("reason"))


def call_batches(scopes: DataFrame, limit: int = 60_000) -> DataFrame:
    """(section_id, batch): each version's scopes in their order, packed greedily into calls of at most ``limit`` characters.

    A scope is never split, one over the limit is a call of its own, and scopes without text are in none.
    """
    s = once(scopes, "document_version_id", "page_start", "pages").where("pages is not null and document_version_id is not null")
    size = F.aggregate(F.filter("pages", lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != ""), F.lit(0), lambda n, p: n + F.length(p["text"]))
    s = s.withColumn("size", size).where("size > 0")
    listed = s.groupBy("document_version_id").agg(F.array_sort(F.collect_list(F.struct("page_start", "id", "size"))).alias("scopes"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<struct<id:string,batch:int>>").alias("out"))

    def add(acc, x):
        full = (acc["used"] > 0) & (acc["used"] + x["size"] > limit)
        batch = acc["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(full, x["size"]).otherwise(acc["used"] + x["size"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), batch.alias("batch")))).alias("out"))

    return listed.select(F.explode(F.aggregate("scopes", start, add, lambda a: a["out"])).alias("b")).select(F.col("b.id").alias("section_id"), "b.batch")
