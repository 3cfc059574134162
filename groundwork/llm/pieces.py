"""Problem 2: items over a size limit as pieces under it.

A cut is a position in the item's text; the next piece begins ``overlap`` characters before it. Every position is
joined to its successor, the farthest legal cut: the farthest one at the strongest kind of pause within the second
half of what the next piece may hold. Then the successor tables are squared again and again, and each squaring doubles
the number of cuts known from the start, so all greedy cuts of an item, and of a batch's items together, come out
after as many vector steps as the logarithm of the cuts of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import records

#: Characters of the items whose tables are squared together, which bounds their memory.
TOGETHER = 4_000_000
#: From the strongest: what ends where a piece may end.
KINDS = ("page", "paragraph", "sentence", "word", "letter")
PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*")
SENTENCE = regex.compile(r"(?:[.!?…]+[\p{Pe}\p{Pf}\p{Pi}\"']*(?:\[\d+\])?\s+|[。！？｡]+[\p{Pe}\p{Pf}\p{Pi}]*|[।۔؟]+\s*|\n)")
WORD = regex.compile(r"\s+")
#: Marks that belong to the letter before them, and joiners.
CLINGS = regex.compile(r"[\p{M}‌‍️\U0001f3fb-\U0001f3ff]|(?<=‍).", regex.DOTALL)


def ends(found: regex.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in found.finditer(text)), np.int64)


def pauses(text: str, joins: list[int]) -> list[np.ndarray]:
    """The sorted positions of each kind of pause, the strongest kind first; the last holds all where no letter is torn."""
    letter = np.ones(len(text) + 1, bool)
    if not text.isascii():
        letter[np.fromiter((m.start() for m in CLINGS.finditer(text)), np.int64)] = False
    return [np.array(joins, np.int64), ends(PARAGRAPH, text), ends(SENTENCE, text), ends(WORD, text), np.flatnonzero(letter)]


def successors(n: int, levels: list[np.ndarray], limit: int, overlap: int) -> tuple[np.ndarray, int]:
    """The successor of each position 0..n as a cut, and the first cut."""
    start = np.concatenate([np.arange(n + 1), [overlap]])  # the last stands for the beginning, where nothing is shared
    high = np.minimum(start - overlap + limit, n)
    low = np.maximum(start - overlap + limit // 2, start)
    low[-1] = limit // 2
    after = high.copy()
    settled = high >= n
    for level in levels:
        if len(level):
            at = level[np.maximum(np.searchsorted(level, high, "right") - 1, 0)]
            take = ~settled & (at > low) & (at <= high)
            after[take] = at[take]
            settled |= take
    return after[:-1], int(after[-1])


def all_cuts(items: list[tuple[str, list[int], int, int]]) -> list[np.ndarray]:
    """The cuts of each (text, joins, limit, overlap), from the first to the text's end."""
    tables, base, firsts = [], 0, []
    for text, joins, limit, overlap in items:
        after, first = successors(len(text), pauses(text, joins), limit, overlap)
        tables.append(after + base)
        firsts.append(first + base)
        base += len(after)
    jump = np.concatenate(tables)
    known = np.zeros(base, bool)
    known[firsts] = True
    frontier = np.array(firsts, np.int64)
    while True:
        reached = np.unique(jump[frontier])
        new = reached[~known[reached]]
        if not len(new):
            break
        known[new] = True
        frontier = np.concatenate([frontier, new])
        jump = jump[jump]
    out, base = [], 0
    for after in tables:
        out.append(np.flatnonzero(known[base : base + len(after)]))
        base += len(after)
    return out


def pieces_of(items: list[tuple[str, list[int], int, int]]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind of pause at the end) of the pieces of each item."""
    out = []
    for (text, joins, _, overlap), cuts in zip(items, all_cuts(items)):
        levels, mine, start = pauses(text, joins), [], 0
        for cut in cuts.tolist():
            kind = "end" if cut == len(text) else next((k for k, level in zip(KINDS, levels) if len(level) and (i := int(np.searchsorted(level, cut))) < len(level) and level[i] == cut), "letter")
            mine.append((start, cut, kind))
            start = cut - overlap
        out.append(mine)
    return out


def portions(sizes: list[int]) -> list[slice]:
    """Runs of items that are cut together: as many as hold ``TOGETHER`` characters, one at least."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > TOGETHER:
            out.append(slice(start, i))
            start, total = i, 0
        total += n
    return [*out, slice(start, len(sizes))] if sizes else []


def split_scopes(scopes: DataFrame, limits: DataFrame, only_oversized: bool = True, with_text: bool = True) -> DataFrame:
    """The pieces of every scope and every page over its limit.

    Columns section_id, page_number (0: the whole scope), piece_no from 1, char_start, char_end, pause (what ends
    there), text. A scope's text is its pages' texts in the order of their numbers, one after the other with nothing
    put between, so its length is the sum of theirs; page ends are its strongest pauses. Neighbouring pieces share
    exactly the limit's overlap (at most one less than the limit), and no piece is longer than the limit. A null text
    counts as empty, null pages and empty arrays give no row, pages without a number come last and keep null.
    With ``only_oversized=False`` an item within its limit is one piece. Repeated ids count once; scopes without an id
    name no record. A kind without a limit (missing, null or below 1) isn't split.
    """
    # two rows at most, whatever else the table of limits holds
    used = limits.where(F.col("item_kind").isin("scope", "page")).groupBy("item_kind").agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    known = {r.item_kind: (r.max_chars, r.overlap_chars or 0) for r in used.collect()}
    limit = {k: (m, max(0, min(o, m - 1))) for k, (m, o) in known.items() if m is not None and m >= 1}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: list[tuple] = []
            items: list[tuple[str, list[int], int, int]] = []
            for section, pages in zip(batch["id"], batch["pages"]):
                if pages is None:
                    continue
                rows = [(None if p["page_number"] is None or pd.isna(p["page_number"]) else int(p["page_number"]), p["text"] or "") for p in pages if p is not None]
                rows.sort(key=lambda x: (x[0] is None, x[0] or 0))
                if "scope" in limit and rows:
                    lengths = np.cumsum([len(t) for _, t in rows])
                    keys.append((section, 0))
                    items.append(("".join(t for _, t in rows), sorted({int(x) for x in lengths[:-1]} - {0}), *limit["scope"]))
                if "page" in limit:
                    for number, text in rows:
                        keys.append((section, number))
                        items.append((text, [], *limit["page"]))
            over = [i for i, (text, _, most, _) in enumerate(items) if len(text) > most]
            cut = {}
            for some in portions([len(items[i][0]) for i in over]):
                cut.update(zip(over[some], pieces_of([items[i] for i in over[some]])))
            out = []
            for i, (section, number) in enumerate(keys):
                text = items[i][0]
                if i not in cut and only_oversized:
                    continue
                for k, (a, b, kind) in enumerate(cut.get(i) or [(0, len(text), "end")]):
                    out.append((section, number, k + 1, a, b, kind, text[a:b] if with_text else None))
            made = pd.DataFrame(out, columns=["section_id", "page_number", "piece_no", "char_start", "char_end", "pause", "text"])
            yield made.astype({"page_number": "Int32", "piece_no": "int32", "char_start": "int32", "char_end": "int32"})

    once = records(scopes, ["id", "pages"])
    return once.mapInPandas(work, "section_id string, page_number int, piece_no int, char_start int, char_end int, pause string, text string")


def oversized(scopes: DataFrame, limits: DataFrame) -> DataFrame:
    """(section_id, page_number) of what was cut."""
    return split_scopes(scopes, limits, with_text=False).where("piece_no = 2").select("section_id", "page_number").distinct()


def rejoined(text_pieces: list[tuple[int, int, str]]) -> str:
    """The item's text from its (start, end, text) in order."""
    out = ""
    for start, _, text in text_pieces:
        out = out[:start] + text
    return out
