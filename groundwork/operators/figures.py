"""Pictures beside the evidence they may support, and their names in exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import significant_terms

#: Pictures of a card at most.
PER_CARD = 3


def supporting(figures: DataFrame, evidence: DataFrame) -> DataFrame:
    """(evidence_id, figure_id, rank) of pictures (id, page_index, kind, name, caption, context, page_anchored) for evidence (id, page_index, excerpt).

    A picture supports evidence of its own page if it is a scan; if its words share a term with the excerpt, or two
    where the page has several pictures; or if both are alone on the page and share none. The first three by name count.
    """
    f = figures.where("page_anchored and page_index is not null").select(F.col("id").alias("figure_id"), "page_index", "kind", "name", significant_terms(F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.coalesce("context", F.lit("")))).alias("terms"))
    e = evidence.where("page_index is not null").select(F.col("id").alias("evidence_id"), "page_index", significant_terms(F.coalesce("excerpt", F.lit(""))).alias("asked"))
    # counts by page first, so that the join carries them along
    f = f.join(f.groupBy("page_index").agg(F.count("*").alias("figures")), "page_index")
    e = e.join(e.groupBy("page_index").agg(F.count("*").alias("evidences")), "page_index")
    shared = F.size(F.array_intersect("terms", "asked"))
    holds = (F.col("kind") == "scan") | (shared >= F.when(F.col("figures") > 1, 2).otherwise(1)) | ((shared == 0) & (F.col("figures") == 1) & (F.col("evidences") == 1))
    rank = F.row_number().over(Window.partitionBy("evidence_id").orderBy("name", "figure_id"))
    return f.join(e, "page_index").where(holds).withColumn("rank", rank).where(F.col("rank") <= PER_CARD).select("evidence_id", "figure_id", "rank")


def export_names(media: DataFrame) -> DataFrame:
    """(id, file_name, reason): a picture's name in a package, a clean stem with eight digits of its bytes' SHA-1; null with the reason if it can't go in."""
    kinds = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp"}
    ending = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("content_type")]
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("name", F.lit("")), r"^.*[\\/]", ""), r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]", "_")
    stem = F.coalesce(F.nullif(F.substring(stem, 1, 60), F.lit("")), F.lit("figure"))
    empty = F.coalesce(F.length("bytes"), F.lit(0)) == 0
    reason = F.when(ending.isNull(), "type").when(empty, "no bytes")
    return media.select("id", F.when(reason.isNull(), F.concat(stem, F.lit("-"), F.substring(F.sha1("bytes"), 1, 8), ending)).alias("file_name"), reason.alias("reason"))


def scan_plan(pages: DataFrame, media: DataFrame, pages_at_most: int = 8, image_bytes: int = 3 << 20, run_bytes: int = 9 << 20) -> DataFrame:
    """(block_id, page_index, media_id, verdict) of unread pages (version_id, block_id, page_index) with their largest picture (version_id, media_id, page_index, size).

    In the order of pages a picture is planned unless it alone, or with those planned, is too large, or enough pages
    are planned; a page that doesn't fit is passed over and later ones still may. A version's unread pages are listed
    in one row of a few numbers each.
    """
    largest = Window.partitionBy("block_id").orderBy(F.desc_nulls_last("size"), "media_id")
    p = pages.join(media.where("size is not null"), ["version_id", "page_index"], "left").withColumn("_r", F.row_number().over(largest)).where("_r = 1")
    listed = p.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "block_id", "media_id", "size"))).alias("rows"))
    kind = "array<struct<block_id:string,page_index:int,media_id:string,verdict:string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("out"))

    def add(acc, x):
        size = x["size"].cast("long")
        verdict = F.when(x["media_id"].isNull(), "unavailable").when(size > image_bytes, "byte_limit").when(acc["n"] >= pages_at_most, "page_limit").when(acc["used"] + size > run_bytes, "byte_limit").otherwise("planned")
        taken = verdict == "planned"
        row = F.struct(x["block_id"].alias("block_id"), x["page_index"].alias("page_index"), x["media_id"].alias("media_id"), verdict.alias("verdict"))
        return F.struct((acc["n"] + F.when(taken, 1).otherwise(0)).alias("n"), (acc["used"] + F.when(taken, size).otherwise(F.lit(0).cast("long"))).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    return listed.select(F.explode(F.aggregate("rows", start, add, lambda a: a["out"])).alias("r")).select("r.*")
