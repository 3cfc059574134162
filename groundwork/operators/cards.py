"""Cards: claims, deletions, structure and the rows of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import ABSOLUTE, MODALITY, NEGATION, cloze_as_claim, cloze_parts, cloze_restored, collapse, has_words, missing_quantities, quantity_values, trimmed
from groundwork.sources import once

COLUMNS = ("deck_id", "section_id", "format", "question", "answer", "cloze_text", "cloze_deletions", "explanation", "tags", "claim", "concept_id")
STRINGS = "array<string>"


def claim_of() -> Column:
    """Question, line break, answer (empty parts left out), or the cloze text with its deletions written back."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.when(F.col("format") == "cloze", cloze_as_claim(F.col("cloze_text"))).otherwise(F.concat_ws("\n", part("question"), part("answer")))


def claims(cards: DataFrame) -> DataFrame:
    """(card_id, claim, as_stored): the claim made anew, and whether the stored one equals it."""
    c = once(cards, *COLUMNS).withColumn("made", claim_of())
    return c.select(F.col("id").alias("card_id"), F.col("made").alias("claim"), F.col("claim").eqNullSafe(F.nullif("made", F.lit(""))).alias("as_stored"))


def structure(cards: DataFrame, concepts: DataFrame) -> DataFrame:
    """(card_id, code) of what is wrong with a card's form, against the excerpt of its concept."""
    c = once(cards, *COLUMNS)
    e = once(concepts, "source_excerpt").select(F.col("id").alias("concept_id"), collapse(F.col("source_excerpt")).alias("excerpt"))
    j = c.join(e, "concept_id", "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    j = j.select("id", "format", "excerpt", "cloze_deletions", *[F.coalesce(collapse(F.col(x)), F.lit("")).alias(x) for x in ("question", "answer", "cloze_text")])
    qa, cloze, answer, excerpt = F.col("format") == "qa", F.col("format") == "cloze", F.col("answer"), F.col("excerpt")
    answered = qa & (answer != "")
    tagged = F.col("cloze_text").contains("{{c1::")
    declared = F.transform(F.coalesce(F.from_json("cloze_deletions", STRINGS), F.array().cast(STRINGS)), lambda d: collapse(d))
    checks = [
        (qa & (F.length("question") < 5), "question_missing"),
        (qa & (F.length("answer") < 2), "answer_missing"),
        (answered & (F.size(missing_quantities(quantity_values(answer), quantity_values(excerpt))) > 0), "quantity_mismatch"),
        (answered & (has_words(answer, NEGATION) != has_words(excerpt, NEGATION)), "negation_mismatch"),
        (answered & has_words(answer, ABSOLUTE) & has_words(excerpt, MODALITY), "modality_overstated"),
        (cloze & ~tagged, "cloze_tag_missing"),
        (cloze & tagged & (F.size(cloze_parts(F.col("cloze_text"))) == 0), "cloze_unparsable"),
        (cloze & tagged & ~F.lower(excerpt).contains(F.lower(cloze_restored(F.col("cloze_text")))), "cloze_not_verbatim"),
        (cloze & tagged & (F.size(F.array_except(declared, cloze_parts(F.col("cloze_text")))) > 0), "cloze_declaration_mismatch"),
    ]
    codes = F.filter(F.array(*[F.when(cond, code) for cond, code in checks]), lambda x: x.isNotNull())
    return j.select(F.col("id").alias("card_id"), F.explode(codes).alias("code"))


#: The columns of an export and the lines before its rows.
HEADERS = ("#separator:Tab", "#html:true", "#tags column:5", "#deck:", "#columns:Front\tBack\tSourceExcerpt\tPageNumber\tTags")


def tag_list() -> Column:
    return F.coalesce(F.from_json("tags", STRINGS), F.array().cast(STRINGS))


def export_lines(cards: DataFrame, concepts: DataFrame) -> DataFrame:
    """(deck_id, position, line): a deck's header lines from -5 on, then from 1 on a line for each card, by id.

    A line has front, back with its note, the cited excerpt, page and section, and tags, parted by tabs; within a field
    tabs become four blanks and line breaks <br>.
    """
    safe = lambda c: F.replace(F.replace(c, F.lit("\t"), F.lit("    ")), F.lit("\n"), F.lit("<br>"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = once(cards, *COLUMNS).where("deck_id is not null")
    g = once(concepts, "source_excerpt", "page_index", "section_title").withColumnRenamed("id", "concept_id")
    c = c.join(g, "concept_id", "left")
    cloze = F.col("format") == "cloze"
    note = F.when(text("explanation") != "", F.concat(F.lit("<small><i>Note: "), F.col("explanation"), F.lit("</i></small>"))).otherwise("")
    back = F.when(cloze, note).otherwise(F.concat(text("answer"), F.when(note != "", F.concat(F.lit("<br><br>"), note)).otherwise("")))
    page = F.concat(F.lit("Page "), F.coalesce(F.col("page_index").cast("string"), F.lit("")), F.lit(" ("), text("section_title"), F.lit(")"))
    tags = F.array_join(F.transform(tag_list(), lambda t: F.regexp_replace(t, r"\s+", "_")), " ")
    line = F.concat_ws("\t", safe(F.when(cloze, text("cloze_text")).otherwise(text("question"))), safe(back), safe(F.concat(F.lit("<blockquote>"), text("source_excerpt"), F.lit("</blockquote>"))), page, tags)
    position = F.row_number().over(Window.partitionBy("deck_id").orderBy("id")).cast("long")
    rows = c.select("deck_id", position.alias("position"), line.alias("line"))
    title = F.regexp_replace("deck_id", r"[^A-Za-z0-9_\s-]", "")
    heads = F.array(*[F.struct(F.lit(n - 5).cast("long").alias("position"), (F.concat(F.lit(h), title) if h == "#deck:" else F.lit(h)).alias("line")) for n, h in enumerate(HEADERS)])
    return c.select("deck_id").distinct().select("deck_id", F.explode(heads).alias("h")).select("deck_id", "h.position", "h.line").unionByName(rows)


def export_bundle(cards: DataFrame) -> DataFrame:
    """(deck_id, card_count, bundle): a deck's cards as one JSON line each, without a row that holds the whole deck."""
    c = once(cards, *COLUMNS).where("deck_id is not null")
    n = c.groupBy("deck_id").agg(F.count("*").alias("card_count"))
    bundle = F.to_json(F.struct("id", "format", "question", "answer", "cloze_text", "explanation"), {"ignoreNullFields": "false"})
    return c.join(n, "deck_id").select("deck_id", "card_count", F.col("id").alias("card_id"), bundle.alias("bundle"))


def export_cards(cards: DataFrame, created_s: int = 1_750_000_000) -> DataFrame:
    """(deck_id, card_id, note_id, row_id, ord, due, checksum, tag_cell): the rows of a deck's package.

    Notes are numbered from the time of export in milliseconds, by id; a note gives a row for each distinct deletion
    number above 0, or one, numbered after all notes. The checksum is the first eight hex digits of the front's SHA-1,
    tags of markup stripped, as a number.
    """
    c = once(cards, *COLUMNS).where("deck_id is not null")
    cloze = F.col("format") == "cloze"
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    front = F.when(cloze, F.regexp_replace(text("cloze_text"), r"\{\{c[0-9]+::(.*?)\}\}", "$1")).otherwise(text("question"))
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text("cloze_text"), F.lit(r"\{\{c([0-9]+)::"), F.lit(1)), lambda x: x.cast("long"))))
    ords = F.when(cloze, F.transform(F.filter(numbers, lambda x: x > 0), lambda x: x - 1)).otherwise(F.array(F.lit(0).cast("long")))
    tags = F.filter(F.transform(tag_list(), lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"\s+", "_"), r"[\x00-\x1f\x7f]", "")), lambda t: t != "")
    cell = F.when(F.size(tags) == 0, "").otherwise(F.concat(F.lit(" "), F.array_join(tags, " "), F.lit(" ")))
    in_deck = Window.partitionBy("deck_id")
    n = c.select("deck_id", "id", (F.row_number().over(in_deck.orderBy("id")) - 1).alias("due"), F.count("*").over(in_deck).alias("notes"), ords.alias("ords"), F.conv(F.substring(F.sha1(F.regexp_replace(front, "<[^>]+>", "")), 1, 8), 16, 10).cast("long").alias("checksum"), cell.alias("tag_cell"))
    before = F.coalesce(F.sum(F.size("ords")).over(in_deck.orderBy("due").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("before", before).select("*", F.posexplode("ords").alias("k", "ord"))
    base = created_s * 1000
    return n.select("deck_id", F.col("id").alias("card_id"), (base + F.col("due") + 1).cast("long").alias("note_id"), (base + F.col("notes") + F.col("before") + F.col("k") + 1).cast("long").alias("row_id"), "ord", F.col("due").cast("long").alias("due"), "checksum", "tag_cell")


def stored_shapes(cards: DataFrame) -> DataFrame:
    """(card_id, code): stored cards that can't be shown again."""
    c = once(cards, *COLUMNS)
    blank = lambda x: trimmed(F.coalesce(F.col(x), F.lit(""))) == ""
    qa = F.col("format") == "qa"
    codes = [(qa & blank("question"), "question_missing"), (qa & blank("answer"), "answer_missing"), (~qa & ~F.coalesce(F.col("cloze_text"), F.lit("")).contains("{{c1::"), "cloze_deletion_missing"), (~qa & (F.size(F.coalesce(F.from_json("cloze_deletions", STRINGS), F.array().cast(STRINGS))) == 0), "cloze_deletions_not_recorded")]
    return c.select(F.col("id").alias("card_id"), F.explode(F.filter(F.array(*[F.when(cond, code) for cond, code in codes]), lambda x: x.isNotNull())).alias("code"))


def deck_totals(cards: DataFrame) -> DataFrame:
    """For each deck: cards, cloze cards, sections and distinct tags."""
    c = once(cards, *COLUMNS)
    tags = F.explode_outer(F.from_json("tags", STRINGS))
    t = c.select("deck_id", tags.alias("tag")).groupBy("deck_id").agg(F.count_distinct("tag").alias("tags"))
    n = c.groupBy("deck_id").agg(F.count("*").alias("cards"), F.sum(F.when(F.col("format") == "cloze", 1).otherwise(0)).cast("long").alias("cloze_cards"), F.count_distinct("section_id").alias("sections"))
    return n.join(t, n.deck_id.eqNullSafe(t.deck_id)).drop(t.deck_id)


def operation_keys(cards: DataFrame) -> DataFrame:
    """(card_id, key): the first 40 hex digits of a SHA-256 over parts joined by a zero byte."""
    return once(cards, *COLUMNS).select(F.col("id").alias("card_id"), F.substring(F.sha2(F.concat_ws("\u0000", F.col("deck_id"), F.col("id"), F.coalesce("claim", F.lit(""))), 256), 1, 40).alias("key"))
