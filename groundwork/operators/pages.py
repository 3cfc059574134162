"""Stored pages: their text, kinds and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import SPACES, collapse, word_count
from groundwork.sources import once

COLUMNS = ("document_version_id", "page_index", "page_label", "ordinal", "kind", "raw_text", "normalized_text", "text_source", "ocr_status", "ocr_confidence")


def page_text(blocks: DataFrame) -> DataFrame:
    """A page's blocks joined in their order: raw texts by line breaks, normalised ones by blanks; null texts left out."""
    b = once(blocks, "document_version_id", "page_index", "ordinal", "raw_text", "normalized_text")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "id", "raw_text", "normalized_text"))).alias("parts")
    pages = b.groupBy("document_version_id", "page_index").agg(parts)
    join = lambda c, sep: F.array_join(F.filter(F.col(f"parts.{c}"), lambda t: t.isNotNull()), sep)
    return pages.select("document_version_id", "page_index", join("raw_text", "\n").alias("raw_text"), join("normalized_text", " ").alias("normalized_text"))


def page_kinds(blocks: DataFrame) -> DataFrame:
    """For each version: blocks by kind, readable ones, scanned ones, and pages by what they hold as a whole."""
    b = once(blocks, *COLUMNS)
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)
    # text wins over the label; readable kinds keep theirs
    worded = F.coalesce("normalized_text", F.lit("")) != ""
    kind = F.when(F.col("kind").isin("text", "ocr-text"), F.col("kind")).when(worded, "text").otherwise(F.coalesce("kind", F.lit("blank")))
    b = b.withColumn("kind", kind)
    page = b.groupBy("document_version_id", "page_index").agg(F.bool_or(F.col("kind").isin("text", "ocr-text")).alias("text"), F.bool_or(F.col("kind") == "image-only").alias("image"), F.count("*").alias("n"), count(F.col("kind") == "text", "b_text"), count(F.col("kind") == "ocr-text", "b_ocr"), count(F.col("kind") == "image-only", "b_image"), count(F.col("kind") == "blank", "b_blank"))
    return page.groupBy("document_version_id").agg(
        F.sum("n").alias("blocks"), (F.sum("b_text") + F.sum("b_ocr")).alias("text_blocks"), F.sum("b_ocr").alias("ocr_blocks"), F.sum("b_image").alias("image_blocks"), F.sum("b_blank").alias("blank_blocks"),
        F.count("*").alias("pages"), count(F.col("text"), "text_pages"), count(~F.col("text") & F.col("image"), "unextracted_pages"), count(~F.col("text") & ~F.col("image"), "blank_pages"),
    )


def report_differences(reports: DataFrame, blocks: DataFrame) -> DataFrame:
    """Read reports beside what is stored: pages by content and scanned pages, with whether they agree."""
    stored = page_kinds(blocks).select("document_version_id", "text_pages", "blank_pages", "unextracted_pages", "pages")
    b = once(blocks, "document_version_id", "page_index", "text_source")
    ocr = b.where("text_source = 'ocr'").groupBy("document_version_id").agg(F.count_distinct("page_index").alias("stored_ocr"))
    r = reports.select("document_version_id", F.col("text_pages").alias("said_text"), F.col("ocr_pages").alias("said_ocr"), F.size(F.array_distinct(F.coalesce("ocr_readers", F.array().cast("array<string>")))).cast("long").alias("readers")).distinct()
    out = r.join(stored, "document_version_id", "left").join(ocr, "document_version_id", "left")
    return out.select("document_version_id", F.col("said_text").cast("long").alias("said_text"), F.coalesce("text_pages", F.lit(0)).alias("stored_text"), F.col("said_ocr").cast("long").alias("said_ocr"), F.coalesce("stored_ocr", F.lit(0)).alias("stored_ocr"), "readers", (F.coalesce("said_ocr", F.lit(-1)) == F.coalesce("stored_ocr", F.lit(0))).alias("ocr_agrees"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """The paragraphs of texts, between empty lines, with their words; blanks at the ends of lines and paragraphs are cut, and blank ones are none."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    rows = documents.select("doc_id", F.posexplode(F.split(text, r"\n{2,}")).alias("part", "paragraph"))
    cut = F.regexp_replace(F.regexp_replace("paragraph", r"(?m)[ \t]+$", ""), rf"^{SPACES}|{SPACES}$", "")
    rows = rows.withColumn("paragraph", cut).where("paragraph <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")).cast("long")
    return rows.select("doc_id", number.alias("paragraph_no"), F.length("paragraph").cast("long").alias("n_chars"), word_count(F.col("paragraph")).cast("long").alias("n_words"))


def scope_words(scopes: DataFrame) -> DataFrame:
    """Words and pages of each section scope; scopes without pages count zero."""
    s = once(scopes, "document_version_id", "pages")
    words = F.aggregate(F.coalesce("pages", F.array().cast("array<struct<page_number:int,text:string>>")), F.lit(0), lambda n, p: n + word_count(p["text"]))
    return s.select(F.col("id").alias("section_id"), F.coalesce(F.size(F.coalesce("pages", F.array().cast("array<struct<page_number:int,text:string>>"))), F.lit(0)).cast("long").alias("pages"), words.cast("long").alias("n_words"))


def pack(scopes: DataFrame, limit: int) -> DataFrame:
    """(section_id, page_number, batch): pages packed greedily in order into batches of at most ``limit`` characters; a page is never split."""
    s = once(scopes, "pages").where("pages is not null").select("id", F.array_sort(F.filter("pages", lambda p: p.isNotNull())).alias("pages"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<struct<page_number:int,batch:int>>").alias("out"))

    def add(acc, p):
        size = F.length(F.coalesce(p["text"], F.lit("")))
        full = (acc["used"] > 0) & (acc["used"] + size > limit)
        batch = acc["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(full, size).otherwise(acc["used"] + size).alias("used"), F.concat(acc["out"], F.array(F.struct(p["page_number"].alias("page_number"), batch.alias("batch")))).alias("out"))

    packed = s.select("id", F.explode(F.aggregate("pages", start, add, lambda a: a["out"])).alias("p"))
    return packed.select(F.col("id").alias("section_id"), "p.page_number", "p.batch")


def collapsed_pages(blocks: DataFrame) -> DataFrame:
    return page_text(blocks).select("document_version_id", "page_index", collapse(F.col("normalized_text")).alias("page"))
