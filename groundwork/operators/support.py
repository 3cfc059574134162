"""Whether the passage that a card cites supports what it claims, as far as text comparison can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import ABSOLUTE, FUNCTION_WORDS, MODALITY, NEGATION, cloze_parts, cloze_restored, collapse, content_words, has_condition, has_words, let, missing_quantities, quantity_values, sentence_pieces, trimmed, word_dice
from groundwork.operators.pages import collapsed_pages
from groundwork.sources import once

#: Similarity from which a claim restates a sentence, so that opposite polarity is a contradiction.
RESTATED = 0.6


def claim_for(format_: str, question: str, answer: str, cloze_text: str) -> Column:
    """What a card says in one line: question, blank, answer, or the cloze text restored."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.when(F.col(format_) == "cloze", cloze_restored(text(cloze_text))).otherwise(collapse(F.concat_ws(" ", text(question), text(answer))))


def cite(rows: DataFrame) -> DataFrame:
    """Rows (page, excerpt), both collapsed, with where the excerpt stands on the page, case aside: ``c``, a struct (at, sentences, context), null if it doesn't.

    ``sentences`` are those the span touches, at its ends too; ``context`` is the page's own text from one sentence
    before them to one behind. Each step is a column of its own, so that none is made twice.
    """
    start = F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("all"))

    def add(acc, piece):
        text = F.rtrim(piece)
        return F.struct((acc["to"] + F.length(piece)).alias("to"), F.concat(acc["all"], F.array(F.struct(text.alias("text"), acc["to"].alias("start"), (acc["to"] + F.length(text)).alias("end")))).alias("all"))

    r = rows.withColumn("_at", F.when(F.col("excerpt") != "", F.nullif(F.instr(F.lower("page"), F.lower("excerpt")), F.lit(0)) - 1))
    r = r.withColumn("_spans", F.when(F.col("_at").isNotNull(), F.aggregate(sentence_pieces(F.col("page")), start, add, lambda acc: acc["all"])))
    until = F.col("_at") + F.length("excerpt")
    r = r.withColumn("_hit", F.transform("_spans", lambda s: (s["start"] <= until) & (s["end"] >= F.col("_at"))))
    r = r.withColumn("_first", F.array_position("_hit", True).cast("int")).withColumn("_count", F.size(F.filter("_hit", lambda h: h)))
    begin = F.element_at("_spans", F.greatest(F.col("_first") - 1, F.lit(1)))["start"]
    end = F.element_at("_spans", F.least(F.col("_first") + F.col("_count"), F.size("_spans")))["end"]
    sentences = F.transform(F.slice("_spans", F.col("_first"), F.col("_count")), lambda s: s["text"])
    found = F.struct(F.col("_at").cast("long").alias("at"), sentences.alias("sentences"), F.col("page").substr(begin + 1, end - begin).alias("context"))
    return r.withColumn("c", F.when(F.col("_at").isNotNull(), found)).drop("_at", "_spans", "_hit", "_first", "_count")


def assess(rows: DataFrame) -> DataFrame:
    """(id, verdict, codes, resolved, span_start, span_end, context) of rows (id, claim, excerpt, page), all collapsed.

    The first that holds decides ``contradicted``: an empty claim; an excerpt that isn't on the page; a quantity that
    the page doesn't state; the claim restating a cited sentence with the opposite polarity. Else the verdict is
    ``inconclusive``, with codes of what a judge should look at.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = rows.select("id", text("claim").alias("claim"), text("excerpt").alias("excerpt"), text("page").alias("page"))
    r = cite(r).withColumn("said", F.coalesce(F.array_join("c.sentences", " "), F.lit("")))
    r = r.withColumn("q", quantity_values(F.col("claim"))).withColumn("w", content_words(F.col("claim")))
    r = r.withColumn("outside", F.size(missing_quantities(F.col("q"), quantity_values(F.col("said")))) > 0)
    # the page is read for quantities only where the cited sentences lack one
    r = r.withColumn("nowhere", F.when(F.col("outside"), F.size(missing_quantities(F.col("q"), quantity_values(F.col("page")))) > 0).otherwise(False))
    r = r.withColumn("negated", has_words(F.col("claim"), NEGATION)).withColumn("polarity", F.transform("c.sentences", lambda s: has_words(s, NEGATION)))
    outside, nowhere, negated = F.col("outside"), F.col("nowhere"), F.col("negated")
    closest = F.coalesce(F.array_max(F.transform("c.sentences", lambda s: word_dice(content_words(s), F.col("w")))), F.lit(0.0))
    opposite = (~negated & F.forall("polarity", lambda p: p)) | (negated & F.forall("polarity", lambda p: ~p))
    reversed_ = opposite & (closest >= RESTATED)
    strange = let(F.array_union(content_words(F.col("said")), F.array(*map(F.lit, FUNCTION_WORDS))), lambda known: F.size(F.filter("w", lambda t: ~F.array_contains(known, t))))
    notes = [
        (outside, "quantity_outside_citation"),
        (has_words(F.col("claim"), ABSOLUTE) & has_words(F.col("said"), MODALITY), "modality_overstated"),
        (has_condition(F.col("said")) & ~has_condition(F.col("claim")), "condition_dropped"),
        (strange > F.greatest(F.lit(3.0), F.size("w") * 0.2), "term_not_in_source"),
    ]
    against = F.when(F.col("claim") == "", "claim_empty").when(F.col("c").isNull(), "citation_not_in_source").when(nowhere, "quantity_mismatch").when(reversed_, "negation_mismatch")
    r = r.withColumn("against", against).withColumn("notes", F.filter(F.array(*[F.when(cond, code) for cond, code in notes]), lambda x: x.isNotNull()))
    verdict = F.when(F.col("against").isNotNull(), "contradicted").otherwise("inconclusive")
    codes = F.when(F.col("against").isNotNull(), F.col("against")).otherwise(F.array_join("notes", ","))
    return r.select("id", verdict.alias("verdict"), codes.alias("codes"), F.col("c").isNotNull().alias("resolved"), F.col("c.at").alias("span_start"), (F.col("c.at") + F.length("excerpt")).alias("span_end"), F.coalesce("c.context", F.lit("")).alias("context"))


def card_citations(cards: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, claim, excerpt, page) of cards with a concept: the claim in one line, the excerpt, and the page that is cited."""
    c = once(cards, "document_version_id", "format", "question", "answer", "cloze_text", "concept_id").where("concept_id is not null")
    g = once(concepts, "source_excerpt", "page_index").select(F.col("id").alias("concept_id"), collapse(F.col("source_excerpt")).alias("excerpt"), "page_index")
    at = c.join(g, "concept_id").join(collapsed_pages(blocks), ["document_version_id", "page_index"], "left")
    return at.select("id", claim_for("format", "question", "answer", "cloze_text").alias("claim"), "excerpt", "page")


def card_support(cards: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(card_id, verdict, codes, resolved, span_start, span_end, context) of every card with a concept."""
    return assess(card_citations(cards, concepts, blocks)).withColumnRenamed("id", "card_id")


def combined(assessed: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, supported, codes): the assessment beside a judge's answers (id, supported, issues).

    What is contradicted stays so; without an answer nothing is supported; a judge's issues replace the codes.
    """
    j = judged.groupBy("id").agg(F.max(F.struct("supported", "issues")).alias("j"))
    r = assessed.select("id", "verdict", "codes").join(j, "id", "left")
    given = F.array_join(F.coalesce("j.issues", F.array().cast("array<string>")), ",")
    codes = (
        F.when(F.col("verdict") == "contradicted", F.col("codes"))
        .when(F.col("j").isNull(), F.concat_ws(",", F.nullif("codes", F.lit("")), F.lit("semantic_validation_missing")))
        .when(F.col("j.supported"), F.col("codes"))
        .otherwise(F.when(given != "", given).otherwise("model_reported_unsupported"))
    )
    return r.select("id", ((F.col("verdict") != "contradicted") & F.coalesce(F.col("j.supported"), F.lit(False))).alias("supported"), codes.alias("codes"))


def grounding(cards: DataFrame, concepts: DataFrame) -> DataFrame:
    """(card_id, codes, is_valid, score): a card's form and words against the excerpt of its concept.

    The score is 1 less 0.4 for each error and 0.15 for each warning, at least 0; a deletion that the excerpt lacks is
    one warning each.
    """
    c = once(cards, "format", "question", "answer", "cloze_text", "concept_id")
    e = once(concepts, "source_excerpt").select(F.col("id").alias("concept_id"), F.lower(collapse(F.col("source_excerpt"))).alias("excerpt"))
    j = c.join(e, "concept_id", "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    qa, cloze = F.col("format") == "qa", F.col("format") == "cloze"
    text = lambda col: F.coalesce(F.col(col), F.lit(""))
    terms = content_words(text("answer"))
    matched = F.size(F.filter(terms, lambda t: F.col("excerpt").contains(t)))
    absent = qa & (text("answer") != "") & (F.size(terms) >= 3) & (matched < 0.3 * F.size(terms))
    tagged = text("cloze_text").contains("{{c1::")
    deletions = cloze_parts(text("cloze_text"))
    lost = F.filter(deletions, lambda d: (d != "") & ~F.col("excerpt").contains(F.lower(d)))
    errors = [(qa & (F.length(trimmed(text("question"))) < 5), "question_missing"), (qa & (F.length(trimmed(text("answer"))) < 2), "answer_missing"), (cloze & ~tagged, "cloze_tag_missing"), (cloze & tagged & (F.size(deletions) == 0), "cloze_unparsable")]
    chosen = lambda checks: F.filter(F.array(*[F.when(cond, code) for cond, code in checks]), lambda x: x.isNotNull())
    bad = chosen(errors)
    warned = F.concat(chosen([(absent, "answer_terms_absent")]), F.when(cloze & tagged, F.transform(lost, lambda d: F.lit("cloze_not_verbatim"))).otherwise(F.array().cast("array<string>")))
    score = F.greatest(F.lit(0.0), 1 - (F.size(bad) * 0.4 + F.size(warned) * 0.15))
    return j.select(F.col("id").alias("card_id"), F.array_join(F.concat(bad, warned), ",").alias("codes"), (F.size(bad) == 0).alias("is_valid"), F.round(score, 4).alias("score"))
