"""Whole queries over tables, made of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import NEGATION, content_words, has_words, missing_quantities, plain_words, quantities, quantity_values, significant_terms
from groundwork.operators import cards, checks, coverage, documents, evaluation, grounding, ingest, inventory, pages, replies, reviews, similarity, simulate, study, support, trees
from groundwork.operators.greedy import first_kept
from groundwork.plans.sql import SQL as FIRST_SQL
from groundwork.plans.sql_checks import SQL as CHECK_SQL
from groundwork.sources import once, table

__all__ = ["QUERIES", "SQL"]

SQL = {**FIRST_SQL, **CHECK_SQL}
#: The point in time at which the study queries ask: noon of 15 March 2026, UTC, in milliseconds.
NOW_MS = 1_773_576_000_000


def over(names: str, made: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that gives the named tables to an operator."""
    return lambda spark, folder: made(*(table(spark, folder, n) for n in names.split()))


def first_concepts(concepts: DataFrame) -> DataFrame:
    rows = once(concepts, "job_id", "ordinal", "label", "kind", "decision", "source_excerpt")
    words = lambda c: F.array_distinct(plain_words(F.col(c)))
    rows = rows.select("id", "job_id", "ordinal", "kind", "decision", words("label").alias("label_words"), words("source_excerpt").alias("words"))
    return similarity.first_statements(rows.where("job_id is not null"), "job_id", "ordinal").select(F.col("id").alias("concept_id"), "kept_id")


def terms(documents_: DataFrame) -> DataFrame:
    words = documents_.select(F.explode(significant_terms(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("documents"))


def stated_quantities(concepts: DataFrame) -> DataFrame:
    q = once(concepts, "source_excerpt").select("id", F.explode(quantities(F.col("source_excerpt"))).alias("quantity"))
    return q.groupBy("quantity").agg(F.count_distinct("id").alias("concepts"))


def places(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    part = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = region.select(part("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    edges = edges.unionByName(nation.select(part("n", "n_nationkey").alias("node"), part("r", "n_regionkey").alias("parent")))
    return trees.sizes(edges.unionByName(supplier.select(part("s", "s_suppkey").alias("node"), part("n", "s_nationkey").alias("parent"))))


def constraints(versions: DataFrame, blocks: DataFrame, scopes: DataFrame, concepts: DataFrame, cards_: DataFrame, events: DataFrame) -> DataFrame:
    return checks.tally({
        "block_without_version": checks.orphans(blocks, "document_version_id", versions),
        "scope_without_version": checks.orphans(scopes, "document_version_id", versions),
        "concept_without_block": checks.orphans(concepts, "source_block_id", blocks),
        "card_without_concept": checks.orphans(cards_, "concept_id", concepts),
        "event_without_card": checks.orphans(events, "card_id", cards_),
        "block_repeated": checks.repeated(blocks, "id"),
        "card_repeated": checks.repeated(cards_, "id"),
        "event_repeated": checks.repeated(events, "id"),
        "block_kind": checks.outside(blocks, "kind", ["text", "ocr-text", "image-only", "blank"]),
        "card_format": checks.outside(cards_, "format", ["qa", "cloze"]),
        "event_rating": events.where("rating is not null and rating not between 0 and 5"),
        "scan_source": blocks.where("(kind = 'ocr-text') <> (text_source = 'ocr')"),
    })


def distinct_cards(cards_: DataFrame) -> DataFrame:
    """(card_id, kept_id): within a deck a card is dropped for the first kept one that says the same: like words, the same polarity and quantities."""
    c = once(cards_, "deck_id", "created_at", "question", "cloze_text").where("deck_id is not null")
    said = F.coalesce("question", "cloze_text", F.lit(""))
    c = c.select("id", "deck_id", F.coalesce("created_at", F.lit("")).alias("created_at"), said.alias("said"))
    pairs = similarity.similar_pairs(c, content_words(F.col("said")), 0.85, F.col("deck_id"))
    a, b = (c.select(F.col("id").alias(f"id_{x}"), has_words(F.col("said"), NEGATION).alias(f"n{x}"), quantity_values(F.col("said")).alias(f"q{x}")) for x in "ab")
    same = (F.col("na") == F.col("nb")) & (F.size(missing_quantities(F.col("qa"), F.col("qb"))) == 0) & (F.size(missing_quantities(F.col("qb"), F.col("qa"))) == 0)
    alike = pairs.join(a, "id_a").join(b, "id_b").where(same).select("id_a", "id_b")
    gone = first_kept(similarity.in_order(alike, c, "created_at")).select(F.col("later").alias("id"), F.col("first").alias("to"))
    return c.select("id").join(gone, "id", "left").select(F.col("id").alias("card_id"), F.coalesce("to", "id").alias("kept_id"))


def chunk_pages(reports: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, page): pages of a version's chunks that no stored section within the chunk claims, and the sections' own pages."""
    chunks = ingest.page_chunks(reports).select(F.concat_ws("#", "document_version_id", F.col("chunk_no").cast("string")).alias("id"), "document_version_id", "page_start", "page_end")
    s = once(scopes, "document_version_id", "page_start", "page_end").select("id", "document_version_id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))
    c = chunks.select(F.col("id").alias("parent_id"), F.col("document_version_id").alias("v"), F.col("page_start").alias("a"), F.col("page_end").alias("b"))
    under = s.join(c, (F.col("document_version_id") == F.col("v")) & (F.col("page_start") >= F.col("a")) & (F.col("page_end") <= F.col("b")), "left").select("id", "parent_id", "page_start", "page_end")
    return trees.own_pages(chunks.select("id", F.lit(None).cast("string").alias("parent_id"), "page_start", "page_end").unionByName(under))


def run_metrics(cards_: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """The metrics of each job, with the text comparison's verdicts for a reviewer's: contradicted cards are unsupported, reversed ones critical."""
    v = support.card_support(cards_, concepts, blocks).select("card_id", (F.col("verdict") != "contradicted").alias("supported"), (F.col("codes") == "negation_mismatch").alias("critical"))
    return evaluation.metrics(concepts, v)


def similar_claims(cards_: DataFrame) -> DataFrame:
    texts = once(cards_, "claim").where("claim is not null")
    return similarity.similar_pairs(texts, content_words(F.col("claim"))).select("id_a", "id_b")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "study_daily_activity": over("review_events cards", reviews.daily_activity),
    "study_review_counts": over("review_events", reviews.review_counts),
    "study_latest_review": over("review_events", reviews.latest_review),
    "study_history": over("review_events", reviews.history),
    "study_replay": over("review_events", reviews.replay),
    "events_trailing_failures": over("events", reviews.trailing_failures),
    "page_text": over("source_blocks", pages.page_text),
    "page_kinds": over("source_blocks", pages.page_kinds),
    "read_report_differences": over("read_reports source_blocks", pages.report_differences),
    "document_paragraphs": over("documents", pages.paragraphs),
    "scope_words": over("section_scopes", pages.scope_words),
    "scope_batches": over("section_scopes", lambda s: pages.pack(s, 6000)),
    "latest_versions": over("document_versions", documents.latest_versions),
    "file_formats": over("read_reports", documents.formats),
    "concept_cited_page": over("generation_concepts source_blocks", grounding.cited_page),
    "concept_repaired_page": over("generation_concepts section_scopes source_blocks", grounding.repaired_page),
    "citation_violations": over("generation_concepts section_scopes source_blocks", grounding.violations),
    "concept_quantities": over("generation_concepts", stated_quantities),
    "concept_first_statements": over("generation_concepts", first_concepts),
    "coverage_by_job": over("generation_concepts", coverage.by_job),
    "coverage_by_decision": over("generation_concepts", coverage.by_decision),
    "concept_batches": over("generation_concepts", coverage.batches),
    "reply_concepts": over("chat_responses", replies.concept_rows),
    "reply_sizes": over("chat_responses", replies.sizes),
    "card_claims": over("cards", cards.claims),
    "card_structure": over("cards generation_concepts", cards.structure),
    "card_similar_claims": over("cards", similar_claims),
    "card_export_lines": over("cards generation_concepts", cards.export_lines),
    "card_export_bundle": over("cards", cards.export_bundle),
    "card_stored_shapes": over("cards", cards.stored_shapes),
    "card_support": over("cards generation_concepts source_blocks", support.card_support),
    "card_grounding": over("cards generation_concepts", support.grounding),
    "card_distinct": over("cards", distinct_cards),
    "run_metrics": over("cards generation_concepts source_blocks", run_metrics),
    "quality_gates": over("cards generation_concepts source_blocks", lambda c, g, b: evaluation.gates(run_metrics(c, g, b))),
    "study_all_counts": over("cards review_events", reviews.all_counts),
    "study_undone": over("review_events", reviews.undone),
    "study_next_review": over("review_events", lambda e: reviews.next_review(reviews.replay(e))),
    "study_queue": over("cards review_events", lambda c, e: study.queue(c, e, NOW_MS)),
    "study_cram": over("cards review_events", lambda c, e: study.cram(c, e, NOW_MS)),
    "study_counts": over("cards review_events", lambda c, e: study.counts(c, e, NOW_MS)),
    "card_first_evidence": over("cards generation_concepts", evaluation.first_evidence),
    "card_sections": over("cards section_scopes", evaluation.card_sections),
    "card_review_template": over("cards generation_concepts source_blocks", evaluation.review_template),
    "latest_jobs": over("generation_concepts", evaluation.latest_jobs),
    "withheld_concepts": over("generation_concepts", evaluation.withheld),
    "section_candidates": over("section_scopes", simulate.candidates),
    "section_choice": over("section_scopes", simulate.chosen),
    "concept_decisions": over("generation_concepts section_scopes source_blocks", inventory.decisions),
    "concept_central": over("generation_concepts section_scopes source_blocks", lambda c, s, b: inventory.high_yield(inventory.decisions(c, s, b))),
    "concept_formats": over("generation_concepts", inventory.formats),
    "concept_unique_page": over("generation_concepts section_scopes source_blocks", grounding.unique_page),
    "concept_located": over("generation_concepts section_scopes source_blocks", grounding.located),
    "scope_calls": over("section_scopes", inventory.call_batches),
    "chunk_pages": over("read_reports section_scopes", chunk_pages),
    "version_chunks": over("read_reports", ingest.page_chunks),
    "document_pages": over("documents", ingest.text_pages),
    "document_sections": over("documents", ingest.text_sections),
    "block_neighbours": over("source_blocks", ingest.neighbours),
    "empty_pages": over("source_blocks", ingest.empty_pages),
    "reply_cards": over("chat_responses", replies.card_rows),
    "reply_support": over("chat_responses", replies.support_answers),
    "reply_pages": over("chat_responses", replies.page_readings),
    "card_export_rows": over("cards", cards.export_cards),
    "card_operation_keys": over("cards", cards.operation_keys),
    "deck_totals": over("cards", cards.deck_totals),
    "document_terms": over("documents", terms),
    "place_tree": over("region nation supplier", places),
    "constraints": over("document_versions source_blocks section_scopes generation_concepts cards review_events", constraints),
}
