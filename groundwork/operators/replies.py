"""Model replies: the JSON in them and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.sources import once

CONCEPTS = "struct<concepts:array<struct<label:string,kind:string,centrality:double,pageNumber:double,sourceExcerpt:string,sectionId:string>>>"
CARDS = "struct<cards:array<struct<conceptId:string,format:string,question:string,answer:string,clozeText:string,clozeDeletions:array<string>,explanation:string,tags:array<string>>>>"
SUPPORT = "struct<supported:boolean,issues:array<string>>"
PAGE = "struct<text:string,confidence:double,notes:string>"
#: Kinds of concepts.
KINDS = ("definition", "quantity", "causal", "mechanism", "relational")


def json_of(replies: DataFrame) -> DataFrame:
    """(id, phase, json): a reply's JSON object: the reply without its outer code fence if that parses, else from its first opening to its last closing brace."""
    r = once(replies, "phase", "text")
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?i)^\s*```(?:json)?", ""), r"```\s*$", ""))
    whole = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare)
    return r.select("id", "phase", F.coalesce(whole, F.regexp_extract(bare, r"(?s)(\{.*\})", 1)).alias("json"))


def concept_rows(replies: DataFrame) -> DataFrame:
    """(reply_id, position, label, kind, centrality): the concepts in replies that parse; centrality clamped to 0..1.

    An entry without a label, an excerpt, a known kind, a number for its centrality or its page is left out.
    """
    parsed = json_of(replies).where("phase = 'concepts' and json <> ''").select("id", F.from_json("json", CONCEPTS).alias("j"))
    text = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rows = parsed.select("id", F.posexplode("j.concepts").alias("position", "c"))
    rows = rows.where(text("c.label").between(1, 300) & text("c.sourceExcerpt").between(1, 4000) & F.col("c.kind").isin(*KINDS) & F.col("c.centrality").isNotNull() & F.col("c.pageNumber").isNotNull())
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c.centrality")))
    return rows.select(F.col("id").alias("reply_id"), F.col("position").cast("long").alias("position"), F.trim("c.label").alias("label"), "c.kind", clamped.alias("centrality"))


def card_rows(replies: DataFrame) -> DataFrame:
    """(reply_id, position, concept_id, format, question, answer, cloze_text, deletions, tags): the cards in replies that parse; at most 10 deletions and 12 tags."""
    parsed = json_of(replies).where("phase = 'cards' and json <> ''").select("id", F.from_json("json", CARDS).alias("j"))
    rows = parsed.select("id", F.posexplode("j.cards").alias("position", "c"))
    fits = lambda c, most: F.col(c).isNull() | (F.col(c) == "") | F.length(F.trim(c)).between(1, most)
    rows = rows.where(F.length(F.trim("c.conceptId")).between(1, 200) & F.col("c.format").isin("qa", "cloze") & fits("c.question", 4000) & fits("c.answer", 4000) & fits("c.clozeText", 4000) & fits("c.explanation", 2000))
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = lambda c, n: F.size(F.slice(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, n)).cast("long")
    return rows.select(F.col("id").alias("reply_id"), F.col("position").cast("long").alias("position"), F.trim("c.conceptId").alias("concept_id"), "c.format", given("c.question").alias("question"), given("c.answer").alias("answer"), given("c.clozeText").alias("cloze_text"), first("c.clozeDeletions", 10).alias("deletions"), first("c.tags", 12).alias("tags"))


def support_answers(replies: DataFrame) -> DataFrame:
    """(reply_id, supported, issues): verdicts in replies that parse and say whether; at most 8 issues of 200 letters."""
    parsed = json_of(replies).where("phase = 'support' and json <> ''").select("id", F.from_json("json", SUPPORT).alias("j")).where("j.supported is not null")
    issues = F.transform(F.slice(F.filter(F.coalesce("j.issues", F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, 8), lambda x: F.substring(x, 1, 200))
    return parsed.select(F.col("id").alias("reply_id"), "j.supported", issues.alias("issues"))


def page_readings(replies: DataFrame) -> DataFrame:
    """(reply_id, text, confidence): page readings in replies that parse and have a text of at most 100,000 letters; confidence clamped to 0..1 or null."""
    parsed = json_of(replies).where("phase = 'page_ocr' and json <> ''").select("id", F.from_json("json", PAGE).alias("j")).where("j.text is not null and length(j.text) <= 100000")
    text = F.regexp_replace(F.replace("j.text", F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")
    return parsed.select(F.col("id").alias("reply_id"), text.alias("text"), F.when(F.col("j.confidence").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("j.confidence")))).alias("confidence"))


def sizes(replies: DataFrame) -> DataFrame:
    """Replies of each provider and phase: how many, without text, and the sums of their tokens."""
    r = once(replies, "provider", "phase", "text", "input_tokens", "output_tokens")
    empty = F.sum(F.when(F.coalesce("text", F.lit("")) == "", 1).otherwise(0)).cast("long")
    return r.groupBy("provider", "phase").agg(F.count("*").alias("replies"), empty.alias("empty"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
