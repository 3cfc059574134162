"""Problem 3: texts that stop before their end, and how often each source stops.

Lengths come first. For each source and kind of record, the hazard of a length is the share of the texts of at least
that length that end there; a window over the lengths gives the hazard of its neighbours, a Poisson tail says how
likely the excess is, and the false-discovery procedure keeps the lengths at which the source cuts. Then the endings:
an open JSON reply, a broken character or a mark put after the cut tell alone; an excerpt is looked up on its page,
where a sentence, heading or list item ends there or doesn't; any other text is read for its last sentence. At a
significant length an ending without a closing sign is cut even where it looks like a heading or list item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut_lineage, records
from groundwork.llm.looks import skeleton
from groundwork.llm.pairs import NO_END
from groundwork.llm.sentences import BEFORE_MORE, CLOSERS, TERMINATORS, Knowledge, Splitter, key_of

#: Lengths to either side that a length is compared with, and the rate of false discoveries among significant lengths.
NEIGHBOURS, FALSE_RATE = 12, 0.01

MARKS = regex.compile(r"\s*(?:\[\s?(?:\.{2,}|…)\s?\]|\(\s?(?:\.{2,}|…)\s?\)|<(?:cut|truncated)>|\[(?:cut|truncated|continued)\]|…+|\.{3,}|(?<=\p{L})[-‐¬])\s*$", regex.IGNORECASE)
JSON_START = regex.compile(r"(?=[{\[]\s*[\"{\[\]}]|\[\s*-?\d+(?:\.\d+)?\s*,)")
LAST_WORD = regex.compile(r"([\p{L}\p{M}.]+)\.$")
ITEM = regex.compile(r"\s*(?:[-*•‣◦]|\(?\d{1,3}[.)])\s+\S")
CLOSED = r"""[.!?。！？}\]`"”»]\s*$"""
OPEN_PAIRS = {"(": ")", "«": "»", "「": "」", "『": "』", "（": "）"}


def json_left_open(text: str) -> bool | None:
    """Whether the first JSON in ``text`` is open at its end; None if it holds none, or only whole JSON."""
    m = JSON_START.search(text)
    if m is None:
        return None
    depth, quoted, i = 0, False, m.end()
    token = regex.compile(r'\\.?|["{}\[\]]', regex.DOTALL)
    for t in token.finditer(text, i):
        ch = t.group()
        if ch == '"':
            quoted = not quoted
        elif quoted or ch[0] == "\\":
            continue
        elif ch in "{[":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                rest = text[t.end() :].strip().removeprefix("```").strip()
                return None if not rest else unfinished(rest)
    return True


def left_open(text: str) -> bool:
    """Whether speech or brackets that ``text`` opens stay open."""
    low, left, right = (text.count(ch) for ch in "„“”")
    curly = low > left + right if low else left > right
    return curly or text.count('"') % 2 == 1 or any(text.count(a) > text.count(b) for a, b in OPEN_PAIRS.items())


def heading(text: str) -> bool:
    """Whether a text is no more than a few words that can be a heading: no sign in or behind it, and no word that leads on."""
    ws = text.split()
    return 0 < len(ws) <= 3 and ws[0][0].isupper() and ws[-1][-1].isalnum() and ws[-1].lower() not in NO_END and not any(ch in TERMINATORS for ch in text)


def unfinished(text: str) -> bool:
    """Whether the last sentence of a text without a page stops before its end."""
    if heading(text):
        return False
    text = text.rstrip()
    if text.endswith("�") or MARKS.search(text):
        return True
    units = Splitter().units(text)
    if not units:
        return False
    a, b, whole = units[-1]
    last = text[a:b]
    if whole:
        others = [len(text[x:y].split()) for x, y, w in units[:-1] if w]
        return left_open(last) or bool(others) and len(last.split()) < min(others) and last[-1] not in TERMINATORS
    core = last.rstrip(CLOSERS)
    core = regex.sub(r"(?:\[\d+\])+$", "", core).rstrip(CLOSERS) or core
    if not core or core[-1] not in TERMINATORS:
        return True
    if left_open(last.split("\n\n")[-1]):
        return True
    word = LAST_WORD.search(core)
    return bool(word) and key_of(word.group(1)) in BEFORE_MORE and len(word.group(1)) < 7


def ends_whole(text: str) -> bool:
    """Whether the last unit of ``text`` is a heading or list item, whose end has no closing sign to tell it."""
    units = Splitter().units(text.rstrip())
    return bool(units) and units[-1][2]


def solid(text: str) -> int:
    return len(text) - sum(ch.isspace() for ch in text)


def on_page(excerpt: str, page: str) -> bool | None:
    """Whether ``excerpt`` stops within a sentence, heading or list item of ``page``; None if it isn't found there."""
    page, e = skeleton(page), skeleton(excerpt).strip()
    flat = regex.sub(r"\s+", " ", page)
    e = regex.sub(r"\s+", " ", e)
    bare = MARKS.sub("", e)
    tries = [e] if e == bare else [e, bare]
    tries += [bare[-n:] for n in (60, 40, 25) if n < len(bare)]
    for tail in tries:
        at = flat.find(tail) if len(tail) > 3 else -1
        if at < 0:
            continue
        ends = {solid(page[:b]) for _, b in Splitter().split(page)}
        while at >= 0:
            stop = at + len(tail)
            if solid(flat[:stop]) in ends:
                return False
            at = flat.find(tail, at + 1)
        return True
    return None


def certain(text: str) -> bool:
    """Whether an excerpt ends so plainly with a whole sentence that its page needn't be asked."""
    core = text.rstrip(CLOSERS)
    return bool(regex.search(r"\p{L}{4,}[.!?]$", core)) and core == text and not left_open(text) and key_of(regex.search(r"(\p{L}+)[.!?]$", core).group(1)) not in BEFORE_MORE


def goes_no_further(text: str, page: str) -> bool:
    """Whether an excerpt that plainly ends a sentence stands on its page as it is and nothing of the sentence follows there."""
    if not certain(text):
        return False
    flat, core = " ".join(page.split()), " ".join(text.split())
    at = flat.find(core)
    return at >= 0 and not flat[at + len(core) : at + len(core) + 1].strip()


def poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) of a Poisson variable."""
    if n <= 0:
        return 1.0
    mean = max(mean, 1e-9)
    term = math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
    total, k = 0.0, n
    while term > total * 1e-12 and k < n + 10_000:
        total += term
        k += 1
        term *= mean / k
    return min(1.0, total)


def significant_lengths(lengths: DataFrame) -> DataFrame:
    """(record_kind, provider, n_chars, n, hazard, neighbour_hazard, p_value) of the lengths at which a source cuts."""
    ends = lengths.groupBy("record_kind", "provider", "n_chars").agg(F.count("*").alias("n"))
    source = ["record_kind", "provider"]
    by_length = Window.partitionBy(*source).orderBy("n_chars")
    ends = ends.withColumn("risk", F.sum("n").over(by_length.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    near = by_length.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    # lengths without a text have nobody that ended, but as many at risk as the next length; the mean over the window stands for them
    ends = ends.withColumn("_others", F.sum("n").over(near) - F.col("n")).withColumn("_risk", F.avg("risk").over(near) * (2 * NEIGHBOURS))
    spread = F.greatest(F.lit(1.0), F.coalesce(F.pow(F.stddev_pop("n").over(by_length.rowsBetween(1, NEIGHBOURS)), 2) / F.avg("n").over(by_length.rowsBetween(1, NEIGHBOURS)), F.lit(1.0)), F.coalesce(F.pow(F.stddev_pop("n").over(by_length.rowsBetween(-NEIGHBOURS, -1)), 2) / F.avg("n").over(by_length.rowsBetween(-NEIGHBOURS, -1)), F.lit(1.0)))
    ends = ends.withColumn("spread", spread)  # neighbours that vary more than chance would have them make a test less sure
    ends = ends.withColumn("hazard", F.col("n") / F.col("risk")).withColumn("neighbour_hazard", (F.col("_others") + 0.5) / (F.col("_risk") + 1))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mean = batch["neighbour_hazard"] * batch["risk"]
            yield batch.assign(p_value=[poisson_tail(int(n / s), float(m / s)) for n, m, s in zip(batch["n"], mean, batch["spread"])]).drop(columns=["risk", "spread"])

    tested = ends.select(*source, "n_chars", "n", "hazard", "neighbour_hazard", "risk", "spread").mapInPandas(tails, "record_kind string, provider string, n_chars int, n long, hazard double, neighbour_hazard double, p_value double")
    by_p = Window.partitionBy(*source).orderBy("p_value", "n_chars")
    ranked = tested.withColumn("_rank", F.row_number().over(by_p)).withColumn("_tests", F.count("*").over(Window.partitionBy(*source)))
    passes = F.when(F.col("p_value") <= FALSE_RATE * F.col("_rank") / F.col("_tests"), F.col("_rank"))
    ranked = ranked.withColumn("_last", F.max(passes).over(Window.partitionBy(*source)))
    return ranked.where((F.col("_rank") <= F.col("_last")) & (F.col("n") >= 3)).drop("_rank", "_tests", "_last")


def judge(replies: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(record_kind, record_id, provider, n_chars, at_cut_length, is_cut) of every reply and excerpt.

    Repeated ids count once. A null or empty text is never cut, nor is one of blanks. A null provider is a source of
    its own. An excerpt whose block is null, missing or holds no such passage is judged by its own ending.
    """
    r = records(replies, ["id", "provider", "text"]).select(F.lit("reply").alias("record_kind"), F.col("id").alias("record_id"), "provider", "text", F.lit(None).cast("string").alias("block"))
    c = records(concepts, ["id", "provider", "source_excerpt", "source_block_id"]).select(F.lit("concept").alias("record_kind"), F.col("id").alias("record_id"), "provider", F.col("source_excerpt").alias("text"), F.col("source_block_id").alias("block"))
    texts = cut_lineage(r.unionByName(c).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0))).withColumn("provider", F.coalesce("provider", F.lit(""))))
    # a reply that ends with a closing sign is no evidence of a cut: whole JSON replies of one form share lengths too
    open_end = (F.col("record_kind") == "concept") | ~F.col("text").rlike(CLOSED)
    lengths = significant_lengths(texts.where(F.col("n_chars") > 0).where(open_end).select("record_kind", "provider", "n_chars"))
    texts = texts.join(lengths.select("record_kind", "provider", "n_chars", F.lit(True).alias("_at")), ["record_kind", "provider", "n_chars"], "left").withColumn("at_cut_length", F.coalesce("_at", F.lit(False))).drop("_at")

    asks = (F.col("record_kind") == "concept") & F.col("block").isNotNull() & (F.col("n_chars") > 0)
    b = records(blocks, ["id", "raw_text"]).where("raw_text <> ''").select(F.col("id").alias("block"), F.col("raw_text").alias("page"))
    asked = texts.where(asks).join(b, "block", "left")
    rest = texts.where(~asks).withColumn("page", F.lit(None).cast("string"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, text, page, at in zip(batch["record_kind"], batch["text"], batch["page"], batch["at_cut_length"]):
                if text is None or not text.strip():
                    out.append(False)
                    continue
                cut = None
                if kind == "reply":
                    cut = json_left_open(text.strip())
                    if cut is None and JSON_START.search(text):
                        cut = False
                elif page is not None:
                    cut = True if text.rstrip().endswith("�") else False if goes_no_further(text, page) else on_page(text, page)
                if cut is None:
                    cut = not certain(text) and unfinished(text)
                    closed = regex.sub(r"(?:\[\d+\])+$", "", text.rstrip()).rstrip(CLOSERS)[-1:] in tuple(TERMINATORS)
                    if not cut and at and not closed and (kind == "concept" or heading(text) or ends_whole(text)):
                        cut = True
                out.append(bool(cut))
            yield batch[["record_kind", "record_id", "provider", "n_chars", "at_cut_length"]].assign(is_cut=out)

    columns = ["record_kind", "record_id", "provider", "n_chars", "at_cut_length", "text", "page"]
    return asked.select(*columns).unionByName(rest.select(*columns)).mapInPandas(decide, "record_kind string, record_id string, provider string, n_chars int, at_cut_length boolean, is_cut boolean")


def cut_records(replies: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    return judge(replies, concepts, blocks).where("is_cut").select("record_kind", "record_id")


def cut_rates(replies: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """How often each source cuts: records with text, cut ones, their rate, and cut ones at significant lengths."""
    judged = judge(replies, concepts, blocks).where("n_chars > 0")
    out = judged.groupBy("record_kind", "provider").agg(F.count("*").alias("n_records"), F.sum(F.col("is_cut").cast("long")).alias("n_cut"), F.sum((F.col("is_cut") & F.col("at_cut_length")).cast("long")).alias("n_cut_at_length"))
    return out.withColumn("cut_rate", F.col("n_cut") / F.col("n_records"))
