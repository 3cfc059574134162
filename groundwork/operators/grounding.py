"""Excerpts and the pages they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import collapse
from groundwork.operators.pages import collapsed_pages
from groundwork.sources import once

SHORTEST = 8


def cited_page(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(concept_id, verdict, span_start): where an excerpt stands, letter by letter, in its block.

    verdict is no_excerpt, too_short, block_missing, not_in_block or in_block; span_start counts from 0.
    """
    c = once(concepts, "source_excerpt", "source_block_id").select(F.col("id").alias("concept_id"), collapse(F.col("source_excerpt")).alias("excerpt"), F.col("source_block_id").alias("block_id"))
    b = once(blocks, "normalized_text").select(F.col("id").alias("block_id"), F.lit(True).alias("stored"), collapse(F.col("normalized_text")).alias("page"))
    at = F.coalesce(F.instr(F.coalesce("page", F.lit("")), F.col("excerpt")), F.lit(0))
    verdict = F.when(F.coalesce("excerpt", F.lit("")) == "", "no_excerpt").when(F.length("excerpt") < SHORTEST, "too_short").when(F.col("stored").isNull(), "block_missing").when(at == 0, "not_in_block").otherwise("in_block")
    return c.join(b, "block_id", "left").select("concept_id", verdict.alias("verdict"), F.when(verdict == "in_block", at - 1).cast("long").alias("span_start"))


def unique_page(concepts: DataFrame, scopes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(concept_id, page_index): excerpts of eight letters or more that stand on exactly one page of their section's range."""
    c = once(concepts, "source_excerpt", "section_id").select(F.col("id").alias("concept_id"), collapse(F.col("source_excerpt")).alias("excerpt"), "section_id").where(F.length("excerpt") >= SHORTEST)
    s = once(scopes, "document_version_id", "page_start", "page_end").select(F.col("id").alias("section_id"), "document_version_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_index"))
    found = c.join(s, "section_id").join(collapsed_pages(blocks), ["document_version_id", "page_index"]).where(F.col("page").contains(F.col("excerpt")))
    return found.groupBy("concept_id").agg(F.count("*").alias("n"), F.min("page_index").alias("page_index")).where("n = 1").select("concept_id", "page_index")


def repaired_page(concepts: DataFrame, scopes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(concept_id, page_index): excerpts that don't stand in their block but on exactly one page of their section's range."""
    lost = cited_page(concepts, blocks).where("verdict in ('not_in_block', 'block_missing')").select(F.col("concept_id").alias("id"))
    return unique_page(concepts.join(lost, "id", "left_semi"), scopes, blocks)


def violations(concepts: DataFrame, scopes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(concept_id, page_index, code) of each citation whose page isn't stored or doesn't hold the excerpt; one of an unknown section has no page."""
    c = once(concepts, "source_excerpt", "section_id", "page_index").select(F.col("id").alias("concept_id"), collapse(F.col("source_excerpt")).alias("excerpt"), "section_id", "page_index").where("excerpt <> ''")
    s = once(scopes, "document_version_id").select(F.col("id").alias("section_id"), "document_version_id")
    at = c.join(s, "section_id", "left").join(collapsed_pages(blocks), ["document_version_id", "page_index"], "left")
    code = F.when(F.col("page").isNull(), "page_missing").when(~F.col("page").contains(F.col("excerpt")), "excerpt_not_on_page")
    return at.select("concept_id", "page_index", code.alias("code")).where("code is not null")


def located(concepts: DataFrame, scopes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(concept_id, block_id, span_start, span_end): where an excerpt stands on its page, and the first block that holds it whole."""
    c = once(concepts, "source_excerpt", "section_id", "page_index").select(F.col("id").alias("concept_id"), collapse(F.col("source_excerpt")).alias("excerpt"), "section_id", "page_index").where("excerpt <> ''")
    s = once(scopes, "document_version_id").select(F.col("id").alias("section_id"), "document_version_id")
    at = c.join(s, "section_id").join(collapsed_pages(blocks), ["document_version_id", "page_index"]).where(F.col("page").contains(F.col("excerpt"))).withColumn("span_start", (F.instr("page", F.col("excerpt")) - 1).cast("long"))
    b = once(blocks, "document_version_id", "page_index", "ordinal", "normalized_text").select(F.col("id").alias("block_id"), "document_version_id", "page_index", "ordinal", collapse(F.col("normalized_text")).alias("text"))
    holds = at.join(b, ["document_version_id", "page_index"]).where(F.col("text").contains(F.col("excerpt"))).groupBy("concept_id").agg(F.min_by("block_id", F.struct("ordinal", "block_id")).alias("block_id"))
    return at.join(holds, "concept_id", "left").select("concept_id", "block_id", "span_start", (F.col("span_start") + F.length("excerpt")).alias("span_end"))
