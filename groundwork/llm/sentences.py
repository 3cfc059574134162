"""Problem 9: the sentences of documents in any language and layout.

A document's lines are read first: blank lines, headings, list items and deliberate line breaks end a unit, a break
put in by a line width doesn't. Within a unit, marks of the script end a sentence unless they stand in speech or in
brackets. What a full stop after a word means is settled from the document itself: an abbreviation is a word that also
stands before a lower-case word, a figure or a comma with its stop, and a capital word is a common one if it also
occurs in lower case. Where a document doesn't tell, counts over all documents do, and last the fixed words below.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that a name or figure follows, and such as may end a sentence; lower case, blanks left out.
BEFORE_MORE = frozenset("abb abs anm approx bd bros bspw bzw ca cf chap d.h dept dr eds e.g eq ex fig figs gov hr hrsg i.e inkl jh kap m mlle mme mr mrs ms nr no nos p pp pág págs prof sect sr sra st tab vgl vol vols vs z.b cp cfr env р рис см стр табл гл ред проф им тов ул д с डॉ प्रो श्री د ص أ".split())
MAY_END = frozenset("a.m al co corp etc ff inc jr ltd p.m sr u.a usf usw т.д т.п др г гг вв н.э и.т.д a.d b.c u.s".split())
#: Words before a German ordinal number.
DETERMINERS = frozenset("am im das der die den dem des vom zum zur beim ab seit bis".split())

TERMINATORS = ".!?…。！？｡।॥؟۔"
OPENERS = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›"}
BRACKETS = "(（[【"
CLOSERS = "”»」』)）]】›“\"'’"
CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}\p{Arabic}\p{Hebrew}\p{Bengali}\p{Tamil}\p{Hangul}]")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}]")
JAPANESE_GOES_ON = "とがはをにものでやへか"
SIGNS = regex.compile("[" + "".join(regex.escape(ch) for ch in sorted({*OPENERS, *CLOSERS, '"'} - set("'’"))) + "]")
END = regex.compile(r"[.!?…。！？｡।॥؟۔]+")
REFERENCE = regex.compile(r"(?:\[\d+(?:[,–-]\s?\d+)*\]|[¹²³⁴⁵⁶⁷⁸⁹⁰]+(?=\s|$))")
MARK = regex.compile(r"\s*(?:([-*•‣◦▪●·])|\(?(\d{1,3})[.)]|\(?([a-z])\))[^\S\n]+(?=\S)")
#: A word with its inner stops, read backwards from the stop behind it, and what follows a stop within such a word.
DOTTED = regex.compile(r"(?r)((?:(?<![\p{L}\p{M}])\p{L}\p{M}*\.[^\S\n]?)*)([\p{L}\p{M}]+)")
INNER = regex.compile(r"[^\S\n]?[\p{L}\p{M}]+\.")
WORD = regex.compile(r"[\p{L}\p{M}]+")
BEHIND = regex.compile(r"\s*")
#: Characters of the longest abbreviation, its inner stops and blanks included.
LONGEST = 16
ORDINAL = regex.compile(r"(\p{L}+)\s+(\d{1,3})$")
FIGURE_END = regex.compile(r"\d\s?$")
THAI = regex.compile(r"\p{Thai}")
LEAD = regex.compile(r"[\"“„«(\[¿¡‘'\s]*")
WHOLE_WORD = regex.compile(r"[^ \t]*")
INNER_CAPITAL = regex.compile(r"(?<=[\p{L},]\s)\p{Lu}[\p{L}\p{M}]+")
BACK = regex.compile(r"(?<![\p{L}\p{M}\p{N}])((?:\p{L}\p{M}*\.[^\S\n]?)*[\p{L}\p{M}]+)$")
THAI_BREAK = regex.compile(r"(?<=[\p{Thai}ๆฯ])[^\S\n]+(?=\p{Thai})|(?<=[\p{Thai}ๆฯ])\s*\n\s*(?=\p{Thai})")
LINE = regex.compile(r"[^\r\n  \x0b\x0c\x85]+|[\r\n  \x0b\x0c\x85]")


@dataclass
class Knowledge:
    """What all documents tell: abbreviations (True: may end a sentence) and words that are common in lower case."""

    abbreviations: dict[str, bool] = field(default_factory=dict)
    common: frozenset[str] = frozenset()


def key_of(token: str) -> str:
    return "".join(token.split()).lower()


def first_word(text: str, at: int) -> str:
    m = WORD.match(text, at)
    return m.group() if m else ""


def count_cases(text: str, words: Counter) -> None:
    """Adds how often each word is written in lower case (w, 0), and with a capital within a sentence (w, 1)."""
    for w, n in Counter(WORD.findall(text)).items():
        if w[0].islower():
            words[w, 0] += n
    for w, n in Counter(INNER_CAPITAL.findall(text)).items():
        words[w.lower(), 1] += n


def count_dots(text: str, dots: Counter, follows: Counter) -> None:
    """Adds how often each word with a full stop has more of its sentence (w, 0) or a word (w, 1) behind it, and which word."""
    stop = text.find(".")
    while stop >= 0:
        m, at, stop = DOTTED.match(text, 0, stop), stop + 1, text.find(".", stop + 1)
        if m is None or m.end() - m.start() > LONGEST or len(m.group(2)) == 1 and INNER.match(text, at):
            continue
        after = BEHIND.match(text, at).end()
        if after == len(text):
            continue
        ch, spaced = text[after], after > at
        w = key_of(m.group())
        if ch in ",;:)" or spaced and (ch.islower() or ch.isdigit() and "\n" not in text[at:after]):
            dots[w, 0] += 1
        elif spaced and ch.isalpha():
            dots[w, 1] += 1
            follows[w, first_word(text, after).lower()] += 1


class Evidence:
    """What a document itself tells; each count is made when it is first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def words(self) -> Counter:
        return Counter(WORD.findall(self.text))

    @cached_property
    def capitals(self) -> Counter:
        return Counter(w.lower() for w in INNER_CAPITAL.findall(self.text))

    @cached_property
    def own(self) -> set[str]:
        """Words that have more of their sentence behind their full stop at least as often as not."""
        dots: Counter = Counter()
        count_dots(self.text, dots, Counter())
        return {w for (w, kind), n in dots.items() if kind == 0 and n >= dots[w, 1]}

    def common(self, word: str) -> bool:
        """Whether ``word``, in lower case, is no name here: written so at least as often as with a capital within a sentence."""
        n = self.words[word]
        return n > 0 and word[0].islower() and n >= self.capitals[word]


class Splitter:
    def __init__(self, known: Knowledge | None = None) -> None:
        self.known = known or Knowledge()

    # lines

    def units(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, whole): stretches that no sentence crosses; whole ones, such as list items, are a sentence."""
        lines = [(m.start(), m.end()) for m in LINE.finditer(text) if not m.group()[0] in "\r\n  \x0b\x0c\x85"]
        rows = []
        for a, b in lines:
            s = text[a:b]
            core = s.strip()
            if core:
                a += len(s) - len(s.lstrip())
                rows.append((a, a + len(core), core))
        width = max((len(c) for _, _, c in rows), default=0)
        wrapped = 25 <= width <= 110
        out: list[list] = []
        number, item = 0, False
        for n, (a, b, core) in enumerate(rows):
            blank = n > 0 and text.count("\n", rows[n - 1][1], a) + text.count("\r\r", rows[n - 1][1], a) + text.count(" ", rows[n - 1][1], a) > 1
            if blank:
                number, item = (number, item) if MARK.match(text[a:b]) else (0, False)
            soft = n > 0 and not blank and self.soft(text, rows[n - 1][2], core, width, wrapped)
            m = MARK.match(text[a:b])
            marked = False
            if m:
                if m.group(1):
                    marked = not soft or item
                else:
                    value = int(m.group(2)) if m.group(2) else ord(m.group(3)) - 96
                    second = MARK.match(text, rows[n + 1][0]) if n + 1 < len(rows) else None
                    marked = number > 0 and value == number + 1 or value == 1 and (item or not soft or bool(second and second.group(2) == "2"))
                    number = value if marked else number
            if marked:
                item = True
                out.append([a, b, True])
            elif soft and out:
                out[-1][1] = b
            else:
                item = False
                out.append([a, b, False])
        return [tuple(u) for u in out]

    @staticmethod
    def soft(text: str, line: str, after: str, width: int, wrapped: bool) -> bool:
        """Whether the line was broken only because the next word didn't fit."""
        if not wrapped:
            return False
        if UNSPACED.match(after) and UNSPACED.match(line[-1]):
            return len(line) + 1 > width - 1
        if after[0].islower() and line[-1] not in TERMINATORS or line.rfind("(") > line.rfind(")") and ")" in after:
            return True
        return len(line) + 1 + len(WHOLE_WORD.match(after).group()) > width

    # sentences

    def spans(self, s: str) -> list[tuple[int, int]]:
        """Speech and brackets that close within ``s``, outermost only."""
        stack: list[tuple[int, str]] = []
        found: list[tuple[int, int]] = []
        for m in SIGNS.finditer(s):
            i, ch = m.start(), m.group()
            if ch in CLOSERS and (k := next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][1]), None)) is not None and not (ch == '"' and i and s[i - 1].isspace()):
                found.append((stack[k][0], i))
                del stack[k:]
            elif ch in OPENERS:
                stack.append((i, OPENERS[ch]))
            elif ch == '"' and (i == 0 or s[i - 1].isspace() or s[i - 1] in "([（“«—–:"):
                stack.append((i, '"'))
        found.sort()
        outer: list[tuple[int, int]] = []
        for a, b in found:
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
        return outer

    def abbreviation(self, w: str) -> bool | None:
        """None: no abbreviation; else whether it may end a sentence. ``w`` may join letters, as in z.b; else its last part tells."""
        if "." in w and not (w in self.known.abbreviations or w in MAY_END or w in BEFORE_MORE or w in self.here.own):
            return self.abbreviation(w.rpartition(".")[2])
        if w in self.here.own and w not in self.known.abbreviations and w not in MAY_END and w not in BEFORE_MORE:
            return False
        if w in self.known.abbreviations:
            return self.known.abbreviations[w] or w in MAY_END
        if w in MAY_END:
            return True
        return False if w in BEFORE_MORE else None

    def stops(self, s: str, at: int, after: int) -> bool:
        """Whether the full stop before ``after`` ends a sentence; what follows starts with a capital or has no case."""
        token = BACK.search(s[max(0, at - 40) : at])
        nxt = s[after:].lstrip()
        word = first_word(nxt, 0)
        if token is None:
            digits = ORDINAL.search(s[max(0, at - 30) : at])
            return not (digits and digits.group(1).lower() in DETERMINERS and word[:1].isupper() and s[at : at + 1] == ".")
        raw, w = token.group(1), key_of(token.group(1))
        if len(raw) <= 2 and w not in MAY_END and raw.islower() and FIGURE_END.search(s[max(0, at - 40) : at][: token.start()]):
            return True  # a unit of measure
        letters = raw.replace(".", " ").split()
        common = word.lower() in self.known.common or self.here.common(word.lower())
        if len(letters[-1]) == 1 and letters[-1].isupper() and w not in self.known.abbreviations and w not in MAY_END:
            if len(word) == 1 and nxt[1:2] == ".":
                return False
            return common and len(letters) == 1
        if len(raw) == 1 and len(word) == 1 and nxt[1:2] == ".":
            return False
        kind = self.abbreviation(w)
        if kind is None:
            return True
        if CASELESS.match(raw[-1]):
            return False
        return common or kind

    def sentences(self, s: str) -> list[int]:
        """The ends of sentences within a unit's text, its own end included."""
        spans = self.spans(s)
        out: list[int] = []
        start = 0
        if not s.isascii() and THAI.search(s) and len(THAI.findall(s)) * 2 > sum(ch.isalpha() for ch in s):
            out = [m.start() for m in THAI_BREAK.finditer(s) if not any(a <= m.start() <= b for a, b in spans)]
        i = 0
        while True:
            m = END.search(s, i)
            if spans and (m is None or spans[0][0] < m.start()):
                a, b = spans.pop(0)
                if b < i:
                    continue
                end = self.absorb(s, b + 1)
                lead = s[start:a].strip()
                closed = b > a and (s[a + 1 : b].rstrip()[-1:] or " ") in TERMINATORS
                if closed and self.ends_after_span(s, lead, s[a], end):
                    out.append(end)
                    start = end
                i = max(b + 1, i)
                continue
            if m is None:
                break
            end = self.absorb(s, m.end())
            if self.ends_here(s, m, end):
                out.append(end)
                start = end
            i = max(end, i + 1)
        return sorted({*[e for e in out if s[e:].strip()], len(s)})

    @staticmethod
    def absorb(s: str, at: int) -> int:
        """Behind closing marks and references that belong to what ends at ``at``."""
        while at < len(s):
            r = REFERENCE.match(s, at)
            if r:
                at = r.end()
            elif s[at] in CLOSERS and not (s[at] in "“\"'’" and at + 1 < len(s) and s[at + 1].isalnum()):
                at += 1
            elif s[at + 1 : at + 2] == "»" and s[at] in "\u0020\u00a0\u202f":
                at += 2
            else:
                break
        return at

    def ends_after_span(self, s: str, lead: str, opener: str, end: int) -> bool:
        rest = s[end:]
        nxt = rest.lstrip()
        if not nxt:
            return False
        if opener in BRACKETS:
            return not lead and (rest[0].isspace() or bool(CASELESS.match(nxt)))
        if nxt[0] in ",;:—–-)]" or nxt[0].islower() or nxt[0] in TERMINATORS or nxt[0] in "，、；：":
            return False
        if CASELESS.match(nxt[0]) or UNSPACED.match(nxt[0]):
            if nxt[0] in JAPANESE_GOES_ON and "ぁ" <= nxt[0] <= "ゟ":
                return False
            return bool(lead)
        if not lead:
            return rest[0].isspace()
        return rest[0].isspace() or nxt[0] in OPENERS

    def ends_here(self, s: str, m: regex.Match, end: int) -> bool:
        rest = s[end:]
        nxt = rest.lstrip()
        if not nxt:
            return False
        run = m.group()
        if run[-1] in "。！？｡।॥":
            return True
        if not rest[0].isspace():
            if run[-1] in "؟۔":
                return True
            return run[-1] in "!?…" and (bool(UNSPACED.match(nxt[0])) or (nxt[0] in OPENERS and bool(UNSPACED.match(s[m.start() - 1 : m.start()] or " "))))
        if nxt[0].islower() or nxt[0] in ",;:)]»”":
            return False
        if nxt[0] in "—–-" and run != ".":
            return False
        if nxt[0] in "—–" and nxt[1:2].isspace() and nxt[2:].lstrip()[:1].islower():
            return False
        if run == "." and end == m.end():
            lead = LEAD.match(nxt).end()
            if nxt[lead : lead + 1].isdigit() and (t := BACK.search(s[max(0, m.start() - 40) : m.start()])) and self.abbreviation(key_of(t.group(1))) is False:
                return False
            if nxt[lead : lead + 1].islower():
                return False
            return self.stops(s, m.start(), end + len(rest) - len(nxt) + lead)
        return True

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every sentence of ``text``, without white space at either end."""
        self.here = Evidence(text)
        out = []
        for a, b, whole in self.units(text):
            start = a
            for end in [b - a] if whole else self.sentences(text[a:b]):
                piece = text[start : a + end]
                core = piece.strip()
                if core:
                    at = start + len(piece) - len(piece.lstrip())
                    out.append((at, at + len(core)))
                start = a + end
        return out


#: A word counts as known from the corpus if it makes up a share of at least 1 / RARE of what is counted, so that at
#: most RARE words are known, whatever the size of the corpus.
RARE = 200_000


def learn(documents: DataFrame, text: str = "text") -> Knowledge:
    """Abbreviations and common words from the counts of all documents; at most ``RARE`` of each come to the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, dots, follows = Counter(), Counter(), Counter()
            texts = "\0".join(t for t in batch["_text"] if t)  # no evidence reaches over that sign
            count_cases(texts, words)
            count_dots(texts, dots, follows)
            rows = [("w", w, None, k, n) for (w, k), n in words.items()] + [("d", w, None, k, n) for (w, k), n in dots.items()] + [("f", w, v, 0, n) for (w, v), n in follows.items()]
            yield pd.DataFrame(rows, columns=["what", "word", "next", "kind", "n"])

    counts = documents.select(F.col(text).cast("string").alias("_text")).mapInPandas(counted, "what string, word string, next string, kind int, n long")
    counts = counts.groupBy("what", "word", "next", "kind").agg(F.sum("n").alias("n")).persist()
    total = counts.where("what = 'w'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_case = counts.where("what = 'w'").groupBy("word").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("lower"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("upper"))
    common = by_case.where((F.col("lower") > F.col("upper")) & (F.col("lower") * RARE >= total))
    words = frozenset(r.word for r in common.select("word").collect())
    dots = counts.where("what = 'd'").groupBy("word").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("capital"))
    all_dots = dots.agg(F.coalesce(F.sum(F.col("inner") + F.col("capital")), F.lit(0))).first()[0]
    starts = counts.where("what = 'f'").join(common.select(F.col("word").alias("next")), "next").groupBy("word").agg(F.sum("n").alias("common"))
    dots = dots.join(starts, "word", "left").fillna(0, ["common"])
    # before a capital word a true sentence end has a common word about as often as any sentence
    chosen = dots.where((F.col("inner") >= 3) & (F.col("inner") >= 0.1 * (F.col("inner") + F.col("capital"))) & ((F.col("inner") + F.col("capital")) * RARE >= all_dots))
    abbreviations = {r.word: r.capital > 0 and r.common >= 0.3 * r.capital for r in chosen.collect()}
    counts.unpersist()
    return Knowledge(abbreviations, words)


def split_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, known: Knowledge | None = None) -> DataFrame:
    """One row (key, char_start, char_end, sentence) for each sentence; offsets count code points, the end is exclusive.

    Null, empty and blank texts give no row, tables without rows none. Repeated rows are split each. A text without any
    mark is one sentence. Columns other than the two named are not read.
    """
    known = learn(documents, text) if known is None else known
    kind = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(known)
        for batch in batches:
            out = [(k, a, b, t[a:b] if with_text else None) for k, t in zip(batch["_key"], batch["_text"]) if t for a, b in splitter.split(t)]
            yield pd.DataFrame(out, columns=[key, "char_start", "char_end", "sentence"])

    return documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInPandas(split, f"`{key}` {kind}, char_start int, char_end int, sentence string")
