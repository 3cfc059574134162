"""Document versions: the latest, and their formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.sources import once

#: Extensions by format, and groups of those that can't be read.
FORMATS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image"}
REFUSED = {"legacy office": ["doc", "ppt", "xls", "odt", "odp", "ods"], "e-book": ["epub", "mobi", "azw3"], "image not stored": ["tif", "tiff", "heic", "heif", "svg"], "other container": ["rtf", "pages", "key", "zip", "html", "htm"]}


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row of each document's highest version; ties go to the later, then the greater id."""
    v = once(versions, "document_id", "owner_id", "name", "version", "page_count", "created_at")
    last = Window.partitionBy("document_id").orderBy(F.desc("version"), F.desc("created_at"), F.desc("id"))
    rows = v.withColumn("_r", F.row_number().over(last)).withColumn("versions", F.count("*").over(Window.partitionBy("document_id")))
    return rows.where("_r = 1").select("document_id", F.col("id").alias("version_id"), F.col("version").cast("long").alias("version"), F.lower(F.trim("name")).alias("name"), "versions")


def formats(reports: DataFrame) -> DataFrame:
    """(document_version_id, extension, detected, refused, agrees): the format that a file's name tells."""
    name = F.lower(F.trim("file_name"))
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    refused = F.create_map(*[F.lit(x) for g, xs in REFUSED.items() for e in xs for x in (e, g)])
    out = reports.select("document_version_id", "format", extension.alias("extension")).distinct()
    return out.select("document_version_id", "extension", F.try_element_at(known, F.col("extension")).alias("detected"), F.try_element_at(refused, F.col("extension")).alias("refused"), F.try_element_at(known, F.col("extension")).eqNullSafe(F.col("format")).alias("agrees"))
