"""Uploaded files as pages, sections and pictures: text, Markdown, word-processor files, slides and images.

Each file is a row of Spark's ``binaryFile`` source and is read whole in one task, over Arrow batches. Zipped formats
are read with the standard library's archive and XML readers.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.documents import FORMATS, REFUSED
from groundwork.operators.ingest import Block, chunk_sections, heading_sections, markdown_blocks, paged, plain_blocks, split_long

#: Names of heading styles before their number, in several languages.
HEADING_STYLES = re.compile(r"(?:heading|titre|überschrift|uberschrift|título|titulo|titolo|заголовок|nagłówek|naglowek|rubrik)\s*([1-9])$", re.IGNORECASE)
#: What a caption begins with.
CAPTION = re.compile(r"\s*(?:fig(?:ure)?\.?|tbl\.?|table|plate|exhibit|chart|diagram|scheme|image)\s*[.:]?\s*(?:\d|[ivxlcdm]+\b)", re.IGNORECASE)
#: Pictures kept of one file at most, bytes of one, and of all.
MEDIA_COUNT, MEDIA_BYTES, MEDIA_TOTAL = 40, 4 << 20, 8 << 20
#: Blocks to either side that make up a picture's context, and its longest length.
CONTEXT_BLOCKS, CONTEXT_CHARS = 2, 600
#: Types of pictures by extension.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "emf": "image/emf", "wmf": "image/wmf"}


@dataclass
class Source:
    """What was read of a file; ``problem`` says why nothing was."""

    format: str | None = None
    pages: list[tuple[str, str]] = field(default_factory=list)  # (text, kind)
    sections: list[tuple] = field(default_factory=list)
    media: list[dict] = field(default_factory=list)
    pagination: str | None = None
    skipped: int = 0
    problem: str | None = None


def extension(name: str) -> str:
    """The lower-cased extension; a name that begins with its only stop has none."""
    stem, dot, last = name.strip().lower().rpartition(".")
    return last if dot and stem else ""


def image_type(data: bytes) -> str | None:
    """The type of a picture by how its bytes begin, whatever its name."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "image/png"
    if data.startswith(b"\xff\xd8\xff"):
        return "image/jpeg"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "image/gif"
    if len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return "image/bmp" if len(data) >= 14 and data[:2] == b"BM" else None


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


class Package:
    """A zipped file's parts."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def relations(self, part: str, kind: str) -> dict[str, str]:
        """Parts that ``part`` refers to by id, of one kind; addresses outside the file are left out."""
        folder, base = posixpath.split(part)
        name = f"{folder}/_rels/{base}.rels"
        if name not in self.names:
            return {}
        out = {}
        for r in self.xml(name):
            target = r.get("Target") or ""
            if (r.get("Type") or "").lower().endswith(f"/{kind}") and target and "://" not in target:
                out[r.get("Id") or ""] = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
        return out

    def media(self, folder: str) -> tuple[dict[str, bytes], int]:
        """Pictures by name within the limits of count and bytes, and how many were left out; later ones that fit are still taken."""
        kept: dict[str, bytes] = {}
        skipped = total = 0
        for info in self.zip.infolist():
            if not info.filename.startswith(folder) or info.is_dir():
                continue
            if len(kept) >= MEDIA_COUNT or info.file_size > MEDIA_BYTES or total + info.file_size > MEDIA_TOTAL:
                skipped += 1
                continue
            kept[info.filename] = self.zip.read(info)
            total += info.file_size
        return kept, skipped


def picture(path: str, data: bytes, page: int, **more: str | None) -> dict:
    name = posixpath.basename(path)
    return {"page_number": page, "name": name, "content_type": TYPES.get(extension(name), "application/octet-stream"), "size": len(data), "caption": None, "context": None, **more}


def heading_level(paragraph: ElementTree.Element) -> int:
    """1 to 6 by the paragraph's style name, else by its outline level; 0 for body text."""
    marks = {local(x.tag): (attribute(x, "val") or "").strip() for x in paragraph.iter() if local(x.tag) in ("pStyle", "outlineLvl")}
    style = marks.get("pStyle", "")
    if style.lower() == "title":
        return 1
    if named := HEADING_STYLES.match(style):
        return min(int(named[1]), 6)
    outline = marks.get("outlineLvl", "")
    return min(int(outline) + 1, 6) if outline.isdigit() and int(outline) <= 8 else 0


def word_paragraphs(body: ElementTree.Element) -> list[tuple[Block | None, list[str], bool]]:
    """(block, ids of pictures, whether a page ends here) of each paragraph, those in tables included."""
    out = []
    for p in body.iter():
        if local(p.tag) != "p":
            continue
        text, ids, ends = "", [], False
        for x in p.iter():
            tag = local(x.tag)
            if tag == "t":
                text += x.text or ""
            elif tag == "tab" and attribute(x, "pos") is None:
                text += "\t"
            elif tag == "br" and attribute(x, "type") is None:
                text += "\n"
            elif tag == "lastRenderedPageBreak" or tag == "br" and attribute(x, "type") == "page":
                ends = True
            elif tag == "blip" and (link := attribute(x, "embed")):
                ids.append(link)
        text = re.sub(r"[ \t]+$", "", text, flags=re.MULTILINE).strip()
        out.append((Block(text, heading_level(p)) if text or ids else None, ids, ends))
    return out


def read_word(data: bytes) -> Source:
    package = Package(data)
    if "word/document.xml" not in package.names:
        return Source("docx", problem="no document part")
    segments: list[list[Block]] = [[]]
    linked: dict[int, list[str]] = {}
    for block, ids, ends in word_paragraphs(package.xml("word/document.xml")):
        if block is not None:
            segments[-1].append(block)
            if ids:
                linked[id(block)] = ids
        if ends:
            segments.append([])
    pages, pagination = paged([split_long(s) for s in segments], stated=len(segments) > 1)
    flat = [(n, b) for n, page in enumerate(pages, 1) for b in page]
    relations = package.relations("word/document.xml", "image")
    found, skipped = package.media("word/media/")
    media, used = [], set()
    for i, (page, block) in enumerate(flat):
        for link in linked.get(id(block), ()):
            path = relations.get(link)
            if path in found and path not in used:
                used.add(path)
                near = [flat[k][1].text for k in (i + 1, i - 1) if 0 <= k < len(flat) and CAPTION.match(flat[k][1].text)]
                around = [b.text for k, (p, b) in enumerate(flat) if 0 < abs(k - i) <= CONTEXT_BLOCKS and p == page and b.text.strip()]
                context = " ".join(t.strip() for t in around)
                media.append(picture(path, found[path], page, caption=near[0].strip() if near else None, context=(context[:CONTEXT_CHARS] + "…" if len(context) > CONTEXT_CHARS else context) or None))
    media += [picture(path, d, 0) for path, d in found.items() if path not in used]
    anchored = {m["page_number"] for m in media}
    texts = ["\n\n".join(b.text for b in page if b.text) for page in pages]
    kinds = ["text" if t.strip() else "image-only" if n in anchored else "blank" for n, t in enumerate(texts, 1)]
    return Source("docx", list(zip(texts, kinds)), heading_sections(pages) or chunk_sections([0] * len(pages)), media, pagination, skipped)


def slide_paragraphs(node: ElementTree.Element) -> list[str]:
    out = []
    for p in node.iter():
        if local(p.tag) == "p":
            out.append("".join((x.text or "") if local(x.tag) == "t" else "\n" if local(x.tag) == "br" else "" for x in p.iter()))
    return out


def slide_title(slide: ElementTree.Element) -> str:
    """The text of the title's placeholder, else of the first shape with text."""
    shapes = [x for x in slide.iter() if local(x.tag) == "sp"]
    titled = [s for s in shapes if any(local(x.tag) == "ph" and x.get("type") in ("title", "ctrTitle") for x in s.iter())]
    return next((t for s in titled[:1] + shapes if (t := " ".join(slide_paragraphs(s)).strip())), "")


def slide_body(slide: ElementTree.Element, title: str) -> str:
    """A line for each paragraph that isn't the title, then one for each cell of tables."""
    lines = [t for s in slide.iter() if local(s.tag) == "sp" for p in slide_paragraphs(s) if (t := p.strip()) and t != title]
    return "\n".join(lines + [t for c in slide.iter() if local(c.tag) == "tc" and (t := " ".join(slide_paragraphs(c)).strip())])


def read_slides(data: bytes) -> Source:
    package = Package(data)
    parts = sorted((int(m[1]), m[0]) for n in package.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if not parts:
        return Source("pptx", problem="no slides")
    found, skipped = package.media("ppt/media/")
    out, used, labels = Source("pptx", pagination="explicit", skipped=skipped), set(), []
    for page, (_, part) in enumerate(parts, 1):
        slide = package.xml(part)
        title = slide_title(slide)
        notes = [n for n in package.relations(part, "notesslide").values() if n in package.names]
        said = "\n".join(t for n in notes[:1] for p in slide_paragraphs(package.xml(n)) if (t := p.strip()) and not t.isdigit())
        text = "\n\n".join(t for t in (title, slide_body(slide, title), said) if t)
        mine = [p for p in package.relations(part, "image").values() if p in found and p not in used]
        used.update(mine)
        out.media += [picture(p, found[p], page, context=text[:CONTEXT_CHARS] or None) for p in mine]
        out.pages.append((text, "text" if text.strip() else "image-only" if mine else "blank"))
        labels.append(title or text.strip().split("\n")[0])
    out.media += [picture(p, d, 0) for p, d in found.items() if p not in used]
    for no, parent, _, level, a, b in chunk_sections([0] * len(parts)):
        span = f"Slide {a}" if a == b else f"Slides {a}–{b}"
        out.sections.append((no, parent, f"{labels[a - 1]} ({span})" if labels[a - 1] else span, level, a, b))
    return out


def read_text(data: bytes, markdown: bool) -> Source:
    blocks = split_long((markdown_blocks if markdown else plain_blocks)(data.decode("utf-8-sig", "replace")))
    pages, pagination = paged([blocks], stated=False)
    texts = ["\n\n".join(b.text for b in page) for page in pages]
    return Source("markdown" if markdown else "text", [(t, "text" if t.strip() else "blank") for t in texts], heading_sections(pages) or chunk_sections([0] * len(pages)), pagination=pagination)


def read_file(name: str, data: bytes) -> Source:
    """A file by the format that its extension names; pictures by their bytes."""
    ext = extension(name)
    kind = FORMATS.get(ext)
    try:
        if kind == "docx":
            return read_word(data)
        if kind == "pptx":
            return read_slides(data)
        if kind in ("text", "markdown"):
            return read_text(data, kind == "markdown")
        if kind == "image" or ext == "bmp":
            if (seen := image_type(data)) is None:
                return Source("image", problem="not a picture")
            return Source("image", [("", "image-only")], chunk_sections([0]), [picture(name, data, 1, content_type=seen)], "explicit")
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
        return Source(kind, problem=type(e).__name__)
    refused = next((group for group, some in REFUSED.items() if ext in some), None)
    return Source(problem=refused or ("pages need a rendering engine" if kind == "pdf" else "unknown format"))


PAGES = "path string, format string, pagination string, problem string, page_number int, kind string, text string"
SECTIONS = "path string, section_no long, parent_no long, title string, level long, page_start long, page_end long"
MEDIA = "path string, page_number int, name string, content_type string, size long, caption string, context string"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def _rows(df: DataFrame, schema: str, made) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *row) for path, data in zip(batch["path"], batch["content"]) for row in made(read_file(posixpath.basename(path), bytes(data if data is not None else b"")))]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int64" for c in ("parent_no", "page_number") if c in columns})

    return df.mapInPandas(read, schema)


def file_pages(df: DataFrame) -> DataFrame:
    """The pages of files (path, content); a file that can't be read gives one row with its problem and no page."""
    return _rows(df, PAGES, lambda s: [(s.format, s.pagination, s.problem, n, kind, text) for n, (text, kind) in enumerate(s.pages, 1)] or [(s.format, None, s.problem, None, None, None)])


def file_sections(df: DataFrame) -> DataFrame:
    return _rows(df, SECTIONS, lambda s: s.sections)


def file_media(df: DataFrame) -> DataFrame:
    """Pictures of files with their page; 0 for those that no page shows."""
    return _rows(df, MEDIA, lambda s: [(m["page_number"], m["name"], m["content_type"], m["size"], m["caption"], m["context"]) for m in s.media])


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, version, sha256, text) of a folder of prompt files named ``name.vN.md``; others have version null."""
    df = spark.read.text(folder, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    version = F.nullif(F.regexp_extract(base, r"\.v([0-9]+)\.[^.]+$", 1), F.lit("")).cast("int")
    return df.select(F.regexp_replace(base, r"(?:\.v[0-9]+)?\.[^.]+$", "").alias("name"), version.alias("version"), F.sha2("text", 256).alias("sha256"), "text")
