"""Runs measured against what they stored and what reviewers said of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import half_up
from groundwork.operators.coverage import wilson
from groundwork.operators.support import card_citations
from groundwork.sources import once

#: Shares that a run is asked for.
SUPPORTED, COVERED = 0.98, 0.9


def metrics(concepts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """For each job: eligible and included concepts, cards, reviewed, unsupported and critical ones; verdicts are (card_id, supported, critical)."""
    c = once(concepts, "job_id", "decision", "card_id").where("job_id is not null")
    v = verdicts.groupBy("card_id").agg(F.max(F.struct("supported", "critical")).alias("v")).select("card_id", "v.supported", F.coalesce("v.critical", F.lit(False)).alias("critical"))
    eligible = F.col("decision").isin("included_central", "included_eligible")
    c = c.join(v, "card_id", "left")
    n = lambda cond, name: F.count_if(cond).alias(name)
    with_card = F.col("card_id").isNotNull()
    return c.groupBy("job_id").agg(n(eligible, "eligible"), n(eligible & with_card, "included"), F.count_distinct("card_id").alias("cards"), n(F.col("supported").isNotNull(), "reviewed"), n(~F.col("supported"), "unsupported"), n(F.col("critical"), "critical"))


def gates(measured: DataFrame) -> DataFrame:
    """(job_id, gate, status, numerator, denominator, value, low, high) of three gates; without a denominator a gate is unmet, which isn't failed."""
    m = measured
    parts = [
        ("supported_claims", F.col("reviewed") - F.col("unsupported"), F.col("reviewed"), SUPPORTED),
        ("comprehensive_coverage", F.col("included"), F.col("eligible"), COVERED),
        ("critical_errors", F.col("critical"), F.col("reviewed"), None),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("gate"), k.cast("long").alias("numerator"), n.cast("long").alias("denominator"), F.lit(target).cast("double").alias("target")) for name, k, n, target in parts])
    g = m.select("job_id", F.explode(rows).alias("g")).select("job_id", "g.*")
    value = F.when(F.col("denominator") > 0, half_up(F.col("numerator") / F.col("denominator"), 4))
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    g = g.withColumn("value", value)
    met = F.when(F.col("target").isNull(), F.col("numerator") == 0).otherwise(F.col("value") >= F.col("target"))
    status = F.when(F.col("denominator") == 0, "unmet").when(met, "pass").otherwise("fail")
    measured_ = F.col("denominator") > 0
    interval = measured_ & F.col("target").isNotNull()
    return g.select("job_id", "gate", status.alias("status"), F.when(measured_, F.col("numerator")).alias("numerator"), F.when(measured_, F.col("denominator")).alias("denominator"), "value", F.when(interval, low).alias("low"), F.when(interval, high).alias("high"))


def unknown_verdicts(verdicts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(card_id): cards that verdicts name and no run holds."""
    known = once(concepts, "card_id").where("card_id is not null").select("card_id").distinct()
    return verdicts.where("card_id is not null").select("card_id").distinct().join(known, "card_id", "left_anti")


VERDICTS = "struct<verdicts:array<struct<cardId:string,supported:boolean,critical:boolean,reviewer:string,note:string>>>"


def review_file(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (file, card_id, supported, critical) of review files (file, text), and problems (file, position, problem).

    A file with any problem gives no verdict: text that isn't JSON or has no list, entries without a card or without
    ``supported``, a card reviewed twice, a claim both supported and critical.
    """
    f = files.select("file", F.from_json("text", VERDICTS).alias("j"))
    broken = f.where("j.verdicts is null").select("file", F.lit(-1).cast("long").alias("position"), F.lit("no list of verdicts").alias("problem"))
    rows = f.select("file", F.posexplode("j.verdicts").alias("position", "v")).select("file", F.col("position").cast("long").alias("position"), F.nullif("v.cardId", F.lit("")).alias("card_id"), "v.supported", F.coalesce("v.critical", F.lit(False)).alias("critical"))
    valid = F.col("card_id").isNotNull() & F.col("supported").isNotNull()
    again = F.row_number().over(Window.partitionBy("file", "card_id", valid).orderBy("position")) > 1
    problem = F.when(F.col("card_id").isNull(), "no card").when(F.col("supported").isNull(), "not stated whether supported").when(again, "reviewed twice").when(F.col("supported") & F.col("critical"), "both supported and critical")
    rows = rows.withColumn("problem", problem)
    problems = broken.unionByName(rows.where("problem is not null").select("file", "position", "problem"))
    return rows.join(problems.select("file").distinct(), "file", "left_anti").select("file", "card_id", "supported", "critical"), problems


def review_template(cards: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(card_id, line): for each card with a concept a JSON line with its claim, excerpt and page, and a verdict left null."""
    c = card_citations(cards, concepts, blocks)
    line = F.to_json(F.struct(F.col("id").alias("cardId"), F.lit(None).cast("boolean").alias("supported"), "claim", "excerpt", F.col("page").alias("pageText")), {"ignoreNullFields": "false"})
    return c.select(F.col("id").alias("card_id"), line.alias("line"))


def latest_jobs(concepts: DataFrame, most: int = 20) -> DataFrame:
    """(job_id, position, last, concepts): the jobs with the newest concepts, ``most`` at most."""
    c = once(concepts, "job_id", "created_at").where("job_id is not null").groupBy("job_id").agg(F.max("created_at").alias("last"), F.count("*").alias("concepts"))
    top = c.orderBy(F.desc_nulls_last("last"), "job_id").limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("last"), "job_id")).cast("long")).select("job_id", "position", "last", "concepts")


def withheld(concepts: DataFrame) -> DataFrame:
    """(job_id, decision, n, first_detail): concepts of a job that gave no card, by decision, with the first one's reason."""
    c = once(concepts, "job_id", "decision", "decision_detail", "card_id", "ordinal").where("job_id is not null and card_id is null")
    return c.groupBy("job_id", "decision").agg(F.count("*").alias("n"), F.min_by("decision_detail", F.struct("ordinal", "id")).alias("first_detail"))


def first_evidence(cards: DataFrame, concepts: DataFrame) -> DataFrame:
    """(card_id, concept_id, page_index, section_title) of every card: the first concept that names it, by page, order and id; null without one."""
    c = cards.where("id is not null").select(F.col("id").alias("card_id")).distinct()
    g = once(concepts, "card_id", "page_index", "ordinal", "section_title").where("card_id is not null")
    first = g.groupBy("card_id").agg(F.min_by(F.struct("id", "page_index", "section_title"), F.struct("page_index", "ordinal", "id")).alias("e"))
    return c.join(first, "card_id", "left").select("card_id", F.col("e.id").alias("concept_id"), "e.page_index", "e.section_title")


def card_sections(cards: DataFrame, scopes: DataFrame) -> DataFrame:
    """(card_id, section_id, title, page_start, page_end) of every card, with null where its section isn't stored."""
    c = once(cards, "section_id").withColumnRenamed("id", "card_id")
    s = once(scopes, "title", "page_start", "page_end").withColumnRenamed("id", "section_id")
    return c.join(s, "section_id", "left").select("card_id", "section_id", "title", "page_start", "page_end")
