"""Text and Markdown sources as pages and a tree of sections.

A document is one row; its lines are folded one after the other, so each is read in Python, over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import word_count
from groundwork.sources import once

#: Characters of a page where a format has none of its own, and sections of a document without headings.
PAGE_CHARS, CHUNKS = 2_500, 6
FENCE = re.compile(r"\s*(```+|~~~+)")
ATX = re.compile(r"(#{1,6})\s+(.*\S)\s*$")
SETEXT = re.compile(r"(=+|-{2,})\s*$")


@dataclass
class Block:
    text: str
    level: int = 0  # of a heading; 0: a paragraph


def plain_blocks(text: str) -> list[Block]:
    """Paragraphs between empty lines; blanks at the ends of lines are cut."""
    parts = re.split(r"\n{2,}", re.sub(r"\r\n?", "\n", text))
    return [Block(t) for p in parts if (t := re.sub(r"[ \t]+$", "", p, flags=re.MULTILINE).strip())]


def markdown_blocks(text: str) -> list[Block]:
    """Headings, marked by signs before or a line below them, and paragraphs; fenced code is never read for headings."""
    blocks: list[Block] = []
    held: list[str] = []
    fence = ""

    def close() -> None:
        if joined := "\n".join(held).strip():
            blocks.append(Block(joined))
        held.clear()

    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        if mark := FENCE.match(line):
            fence = mark[1][0] if not fence else "" if mark[1][0] == fence else fence
            held.append(line)
        elif not fence and (atx := ATX.match(line)):
            close()
            blocks.append(Block(atx[2], len(atx[1])))
        elif not fence and (under := SETEXT.match(line)) and held and held[-1].strip():
            held.pop()
            # what stands above the underlined line is the title
            title = "\n".join(held).strip()
            held.clear()
            if title:
                blocks.append(Block(title, 1 if under[1][0] == "=" else 2))
        elif not line.strip():
            close()
        else:
            held.append(line)
    close()
    return blocks


def split_long(blocks: list[Block], most: int = PAGE_CHARS) -> list[Block]:
    """Paragraphs over ``most`` characters cut between lines; headings and single lines stay whole."""
    out: list[Block] = []
    for b in blocks:
        if b.level or len(b.text) <= most:
            out.append(b)
            continue
        part: list[str] = []
        used = 0
        for line in b.text.split("\n"):
            if used and used + len(line) + 1 > most:
                out.append(Block("\n".join(part)))
                part, used = [], 0
            part.append(line)
            used += len(line) + 1
        out.append(Block("\n".join(part)))
    return out


def paged(segments: list[list[Block]], most: int = PAGE_CHARS, stated: bool | None = None) -> tuple[list[list[Block]], str]:
    """The blocks of each page, and whether pages are explicit, virtual or mixed.

    A segment is a stated page; one over ``most`` characters is packed greedily into several. Empty stated pages at
    either end don't count. Lengths leave out what parts blocks.
    """
    stated = len(segments) > 1 if stated is None else stated
    used = list(segments)
    while stated and used and not used[0]:
        used.pop(0)
    while stated and used and not used[-1]:
        used.pop()
    pages: list[list[Block]] = []
    divided = False
    for segment in used or [[]]:
        if sum(len(b.text) for b in segment) <= most:
            pages.append(list(segment))
            continue
        divided = True
        page: list[Block] = []
        size = 0
        for b in segment:
            if size and size + len(b.text) > most:
                pages.append(page)
                page, size = [], 0
            page.append(b)
            size += len(b.text)
        pages.append(page)
    return pages, "virtual" if not stated else "mixed" if divided else "explicit"


def heading_sections(pages: list[list[Block]]) -> list[tuple]:
    """(section_no, parent_no, title, level, page_start, page_end): a section ends where the next of its level or above begins, before that page if it can."""
    heads = [(n, b) for n, page in enumerate(pages, 1) for b in page if b.level]
    out, stack = [], []
    for i, (page, b) in enumerate(heads):
        after = next((p for p, x in heads[i + 1 :] if x.level <= b.level), None)
        end = len(pages) if after is None else max(after - 1, page)
        while stack and stack[-1][1] >= b.level:
            stack.pop()
        out.append((i + 1, stack[-1][0] if stack else None, b.text.strip() or f"Section {i + 1}", min(max(b.level, 1), 6), page, max(page, end)))
        stack.append((i + 1, b.level))
    return out


def chunk_sections(words: list[int], chunks: int = CHUNKS) -> list[tuple]:
    """Sections of equal numbers of pages, about ``chunks`` of them."""
    step = max(1, -(-len(words) // chunks))
    return [(k + 1, None, f"Page {a}" if a == (b := min(a + step - 1, len(words))) else f"Pages {a}–{b}", 1, a, b) for k, a in enumerate(range(1, len(words) + 1, step))]


def read_source(text: str | None, markdown: bool) -> tuple[list[list[Block]], list[tuple]]:
    """Pages and sections of a text; one without any has one blank page."""
    pages, _ = paged([split_long((markdown_blocks if markdown else plain_blocks)(text or ""))], stated=False)
    words = [sum(len(b.text.split()) for b in page) for page in pages]
    return pages, heading_sections(pages) or chunk_sections(words)


def text_pages(documents: DataFrame, markdown: bool = False) -> DataFrame:
    """(doc_id, page_number, blocks, n_chars, n_words, kind) of each document's pages; null and empty texts give one blank page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                for n, page in enumerate(read_source(text, markdown)[0], 1):
                    whole = "\n\n".join(b.text for b in page)
                    rows.append((key, n, len(page), len(whole), len(whole.split()), "text" if whole.strip() else "blank"))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "blocks", "n_chars", "n_words", "kind"])

    return documents.select("doc_id", "text").mapInPandas(read, "doc_id long, page_number long, blocks long, n_chars long, n_words long, kind string")


def text_sections(documents: DataFrame, markdown: bool = True) -> DataFrame:
    """(doc_id, section_no, parent_no, title, level, page_start, page_end) of each document's sections, by its headings or in chunks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *s) for key, text in zip(batch["doc_id"], batch["text"]) for s in read_source(text, markdown)[1]]
            made = pd.DataFrame(rows, columns=["doc_id", "section_no", "parent_no", "title", "level", "page_start", "page_end"])
            yield made.astype({"parent_no": "Int64"})

    return documents.select("doc_id", "text").mapInPandas(read, "doc_id long, section_no long, parent_no long, title string, level long, page_start long, page_end long")


def page_chunks(reports: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """(document_version_id, chunk_no, page_start, page_end): a version's pages in about ``chunks`` equal runs."""
    r = reports.where("page_count > 0").groupBy("document_version_id").agg(F.max("page_count").cast("long").alias("pages"))
    step = F.greatest(F.lit(1), F.ceil(F.col("pages") / chunks)).cast("long")
    r = r.select("document_version_id", "pages", step.alias("step")).select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("pages"), F.col("step"))).alias("k", "page_start"))
    return r.select("document_version_id", (F.col("k") + 1).cast("long").alias("chunk_no"), "page_start", F.least(F.col("page_start") + F.col("step") - 1, F.col("pages")).alias("page_end"))


def neighbours(blocks: DataFrame, reach: int = 2, most: int = 600) -> DataFrame:
    """(id, context): the text of up to ``reach`` blocks before and behind each block of its page, cut to ``most`` characters."""
    b = once(blocks, "document_version_id", "page_index", "ordinal", "normalized_text")
    page = Window.partitionBy("document_version_id", "page_index").orderBy("ordinal", "id")
    parts = [F.lag("normalized_text", k).over(page) for k in range(reach, 0, -1)] + [F.lead("normalized_text", k).over(page) for k in range(1, reach + 1)]
    return b.select("id", F.substring(F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in parts]), 1, most).alias("context"))


def empty_pages(blocks: DataFrame) -> DataFrame:
    """(document_version_id, page_index) of pages none of whose blocks has a word."""
    b = once(blocks, "document_version_id", "page_index", "normalized_text")
    pages = b.groupBy("document_version_id", "page_index").agg(F.max(word_count(F.coalesce("normalized_text", F.lit("")))).alias("words"))
    return pages.where("words = 0").select("document_version_id", "page_index")
