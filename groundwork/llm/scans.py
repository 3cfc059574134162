"""Problem 6: text of scanned pages as continuous, correctly spelt paragraphs.

Page furniture goes first: title lines that come back at the top or foot of a document's pages, and lines that hold a
page number. Then words that go on in the next line are joined, with or without their hyphen, as the corpus writes
them. A word that the corpus doesn't know is looked up in tries of the corpus vocabulary, those that hold the words
with its own beginning or end: each trie is walked together with the word's Levenshtein automaton, kept as one bit mask for each number of errors and extended by the confusions
of scanners in which two letters stand for one, so every word within reach is found. Candidates are ranked by the
confusion, by the neighbouring words and by frequency.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import cut_lineage, records
from groundwork.llm.looks import skeleton

#: Errors of a scanner within a word; words of the vocabulary in one trie and words looked up in it, on average.
ERRORS, TRIE, LOOKED_UP = 1, 40_000, 6_000
#: Words that make up at least 1 / FREQUENT of all words, at most FREQUENT of them, are told to the readers of tokens.
FREQUENT = 20_000
#: The share of all words that a word of two, or of three letters must have to be what a scanner meant.
SHARE_OF_SHORT = {2: 1 / 2_000, 3: 1 / 20_000}
#: Pages of a document on which an edge line must stand to be its running header.
HEADER_PAGES = 2

#: Letters that a scanner takes for one another, as read: meant.
ONE_FOR_ONE = {"c": "eo", "e": "c", "o": "0ca", "0": "o", "1": "li", "l": "1it", "i": "lj", "!": "li", "|": "li", "5": "s", "s": "5", "8": "b", "6": "b", "9": "gq", "q": "g", "2": "z", "h": "b", "b": "h", "f": "t", "t": "f", "u": "nv", "n": "u", "v": "u", "a": "o", "$": "s", "@": "a", "€": "c", "y": "v"}
TWO_FOR_ONE = {"rn": "m", "vv": "w", "cl": "d", "ii": "u", "li": "h", "nn": "m", "ri": "n", "tl": "d", "lc": "k", "ni": "m", "in": "m", "iu": "m", "ll": "u", "ci": "a", "fi": "h"}
ONE_FOR_TWO = {"m": "rn", "w": "vv", "d": "cl", "u": "ii", "h": "li"}
#: Words before which a hyphen stays open, as in pre- and post-.
SUSPENDED = frozenset("and or und oder bzw sowie bis et ou y e o u to nor als".split())

SIGN = "-¬‐‑\xad"
BREAK = regex.compile(r"([\p{L}\p{M}\p{N}!|$'’][\p{L}\p{M}\p{N}!|$'’-]*?)([-¬‐‑\xad])\s*$")
HEAD = regex.compile(r"^\s*([\p{L}\p{M}\p{N}!|$'’]+(?:-[\p{L}\p{M}\p{N}!|$'’]+)*)")
NUMBER_LINE = regex.compile(r"^[\s\-–—\[(|.·]*(?:(?:page|p|pag|seite|s|página|pág|стр)\.?\s*)?(?:\d{1,5}|[ivxlc]{1,8}|[IVXLC]{1,8}|[0-9lOIo]{1,4})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?[\s\-–—\])|·]*$")
EDGE_NUMBER = regex.compile(r"^[\W\d]*(?:(?:page|seite|página)\b)?[\W\d]*\s+|\s+(?:(?:page|seite|página)\b)?[\W\d]*$|^[ivxlc]+\s{2,}|\s{2,}[ivxlc]+$", regex.IGNORECASE)
TOKEN = regex.compile(r"\S+")
#: Names of files and the like, and figures with a unit.
COMPOUND = regex.compile(r"\p{L}[./@:\\]\p{L}|\d[./@:\\]\p{L}|\p{L}[./@:\\]\d|//|<\|")
UNIT = regex.compile(r"\d+\p{L}{1,3}")
#: A figure that a scanner may have read for the first letter of a word.
LED = regex.compile(r"[015]\p{Ll}{2,3}(?<!st|th|nd|rd)")
REFERENCE = regex.compile(r"\[\d+\]\W*$")
#: How words are elided before another.
ELIDED = r"^(?:[cdjlmnst]|qu)['’](\p{L}{3,})$"
WHOLE_OF_ELIDED = regex.compile(ELIDED)
TRIM = "\"“”„«»()[]{}.,;:?…–—‘’*•"
#: The signs that a scanner puts within or beside a word.
ODD = "!|$@€"


def folded(line: str) -> str:
    """A line with numbers, case, blanks and the confusions of scanners taken away; equal for a title and its misreadings."""
    s = line
    for _ in range(2):
        s = EDGE_NUMBER.sub("", s)
    s = regex.sub(r"[\s\W]+", "", skeleton(s).lower().replace("!", "l").replace("|", "l").replace("$", "s"))
    for read, meant in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u")):
        s = s.replace(read, meant)
    return s.translate(str.maketrans("0158694ci", "olsbgpael"))


def word_of(token: str) -> str:
    """A token without the marks around it."""
    s = REFERENCE.sub("", token).strip(TRIM)
    while s and s[-1] in "!?" and len(s) > 1:
        s = s[:-1].rstrip(TRIM)
    return s


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, native, scanned): how often each word, hyphenated and elided ones whole and in parts, stands in native and in scanned text."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = {True: Counter(), False: Counter()}
            for text, source in zip(batch["raw_text"], batch["text_source"]):
                raw[source == "ocr"].update(skeleton(text).lower().split())
            native, scanned = Counter(), Counter()
            for ocr, into in ((False, native), (True, scanned)):
                for token, n in raw[ocr].items():
                    w = word_of(token)
                    if w and w[0] not in SIGN and w[-1] not in SIGN and any(ch.isalpha() for ch in w):
                        into[w] += n
                        if "-" in w:
                            for part in filter(None, w.split("-")):
                                into[part] += n
                        elif m := WHOLE_OF_ELIDED.match(w):
                            into[m.group(1)] += n
            words = list(native | scanned)
            yield pd.DataFrame({"word": words, "native": [native[w] for w in words], "scanned": [scanned[w] for w in words]})

    counts = blocks.where("raw_text <> ''").select("raw_text", "text_source").mapInPandas(counted, "word string, native long, scanned long")
    return counts.groupBy("word").agg(F.sum("native").alias("native"), F.sum("scanned").alias("scanned"))


class Automaton:
    """The Levenshtein automaton of a word: a bit i in the mask of e errors means that i letters are read with e errors."""

    def __init__(self, word: str, errors: int) -> None:
        self.word, self.errors = word, errors
        self.letter: dict[str, int] = {}
        self.two: dict[str, int] = {}
        self.split: dict[tuple[str, str], int] = {}
        for i, ch in enumerate(word):
            self.letter[ch] = self.letter.get(ch, 0) | 1 << i
            pair = word[i : i + 2]
            if pair in TWO_FOR_ONE:
                self.two[TWO_FOR_ONE[pair]] = self.two.get(TWO_FOR_ONE[pair], 0) | 1 << i
            if ch in ONE_FOR_TWO:
                a, b = ONE_FOR_TWO[ch]
                self.split[a, b] = self.split.get((a, b), 0) | 1 << i
        self.full = (1 << len(word) + 1) - 1
        self.accept = 1 << len(word)
        start = [1]
        for _ in range(errors):
            start.append(start[-1] | start[-1] << 1)
        self.start = tuple(start)

    def step(self, state: tuple[int, ...], ch: str, before: tuple[int, ...] | None, last: str) -> tuple[int, ...]:
        """The state after ``ch``; ``before`` is the state before ``last``, for a letter read for two."""
        own, two = self.letter.get(ch, 0), self.two.get(ch, 0)
        out = [(state[0] & own) << 1]
        pending = self.split.get((last, ch), 0) if before is not None else 0
        for e in range(1, self.errors + 1):
            low = state[e - 1]
            r = (state[e] & own) << 1 | low | low << 1 | out[e - 1] << 1 | (low & two) << 2
            if pending:
                r |= (before[e - 1] & pending) << 1
            out.append(r & self.full)
        return tuple(out)


def make_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


def within(trie: dict, word: str, errors: int = ERRORS) -> list[str]:
    """All words of the trie that the automaton of ``word`` accepts."""
    a, out = Automaton(word, errors), []
    stack = [(trie, a.start, None, "")]
    while stack:
        node, state, before, last = stack.pop()
        for ch, child in node.items():
            if ch == "":
                if state[-1] & a.accept:
                    out.append(child)
                continue
            nxt = a.step(state, ch, before, last)
            if nxt[-1] or a.split and any(ch == x for x, _ in a.split):
                stack.append((child, nxt, state, ch))
    return out


def confusion(read: str, meant: str) -> int:
    """0: a scanner's usual confusion; 1: a letter for another, or one too many; 2: a letter lost."""
    i = 0
    while i < min(len(read), len(meant)) and read[i] == meant[i]:
        i += 1
    j = 0
    while j < min(len(read), len(meant)) - i and read[-1 - j] == meant[-1 - j]:
        j += 1
    a, b = read[i : len(read) - j], meant[i : len(meant) - j]
    if len(a) == len(b) == 1:
        return 0 if b in ONE_FOR_ONE.get(a, "") else 1
    if not b:
        return 0 if a in "'’!|.,-" else 1
    near = read[max(0, i - 1) : len(read) - j + 1]
    if any(x in near and read.replace(x, y, 1) == meant or meant in {read[:k] + y + read[k + 2 :] for k in range(len(read)) if read[k : k + 2] == x} for x, y in TWO_FOR_ONE.items()):
        return 0
    if any(read[:k] + y + read[k + 1 :] == meant for x, y in ONE_FOR_TWO.items() for k in range(len(read)) if read[k] == x):
        return 0
    return 1 if len(a) > len(b) else 2


def furniture(scans: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(id, line_no, noise) of running headers and page numbers; only the first and last two lines with text of a block are asked."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, version, page, text in zip(batch["id"], batch["document_version_id"], batch["page_index"], batch["raw_text"]):
                lines = [(n, ln) for n, ln in enumerate(text.split("\n"), 1) if ln.strip()]
                outer = {n for n, _ in lines[:1] + lines[-1:]}
                numbers = [n for n, ln in lines if n in outer and NUMBER_LINE.match(ln)]
                if numbers:
                    inner = [x for x in lines if x[0] not in numbers]
                    outer |= {n for n, _ in inner[:1] + inner[-1:]}
                for n, ln in lines:
                    if n in outer:
                        key = folded(ln)
                        number = n in numbers
                        if number or key and not regex.search(r"[.!?;:,]\s*$", ln):
                            out.append((block, version, page, n, None if number else key, None))
                # a number next to an edge line is the page's if that line turns out to be a header
                for (near, _), (n, ln) in [(lines[0], lines[1]), (lines[-1], lines[-2])] if len(lines) > 2 else []:
                    if near not in numbers and n not in outer and NUMBER_LINE.match(ln):
                        out.append((block, version, page, n, None, near))
            yield pd.DataFrame(out, columns=["id", "version", "page", "line_no", "key", "near"]).astype({"near": "Int32"})

    at = scans.select("id", "document_version_id", "page_index", "raw_text").mapInPandas(edges, "id string, version string, page int, line_no int, key string, near int")
    at = cut_lineage(at)
    numbers = at.where("key is null and near is null").select("id", "line_no", F.lit("page_number").alias("noise"))
    titled = at.where("key is not null")
    keys = titled.groupBy("version", "key").agg((F.count_distinct("page") >= HEADER_PAGES).alias("often"))
    often = keys.where("often").select("version", "key")
    # a title read wrongly in several places is still near one of its document's headers; such are compared by their lengths
    reach = F.greatest(F.lit(2), F.floor(F.length("header") / 6).cast("int"))
    header = often.withColumnRenamed("key", "header").where(F.length("header") >= 6).withColumn("reach", reach).withColumn("size", F.explode(F.expr("sequence(length(header) - reach, length(header) + reach)")))
    rare = keys.where("not often").select("version", "key", F.length("key").alias("size"))
    near = rare.join(header, ["version", "size"]).where(F.levenshtein("key", "header") <= F.col("reach")).select("version", "key").distinct()
    headers = titled.join(often.unionByName(near), ["version", "key"]).select("id", "line_no", F.lit("running_header").alias("noise"))
    beside = at.where("near is not null").join(headers.select("id", F.col("line_no").alias("near")), ["id", "near"], "left_semi").select("id", "line_no", F.lit("page_number").alias("noise"))
    return headers.unionByName(numbers).unionByName(beside).distinct()


class Reading:
    """What is known of the scanned blocks: their lines, words and the candidates for words that the corpus doesn't know."""

    def __init__(self, blocks: DataFrame) -> None:
        once = cut_lineage(records(blocks, ["id", "document_version_id", "page_index", "raw_text", "text_source"]).where("raw_text <> ''"))
        self.scans = once.where("text_source = 'ocr'")
        self.words = cut_lineage(vocabulary(once))
        self.furniture = cut_lineage(furniture(self.scans))
        lines = self.furniture.groupBy("id").agg(F.collect_set("line_no").alias("skip"))
        self.marked = self.scans.join(lines, "id", "left").select("id", "raw_text", "skip")
        self.total = self.words.agg(F.coalesce(F.sum(F.col("native") + F.col("scanned")), F.lit(0)).alias("n")).first().n
        self.tokens = cut_lineage(self._tokens())
        self._look_up()

    def _tokens(self) -> DataFrame:
        # words that native text has in plenty need no look-up; they are the hot keys of every join by word
        frequent = frozenset(r.word for r in self.words.where((F.col("native") > 0) & (F.col("native") * FREQUENT >= self.total)).select("word").collect())

        def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for block, text, skip in zip(batch["id"], batch["raw_text"], batch["skip"]):
                    out += [(block, *t, not t[3] and t[2] in frequent) for t in block_tokens(text, set() if skip is None else set(skip))]
                yield pd.DataFrame(out, columns=["id", "line_no", "at", "word", "sign", "cut_at", "hyphened", "previous", "following", "known"])

        return self.marked.mapInPandas(tokens, "id string, line_no int, at int, word string, sign string, cut_at int, hyphened string, previous string, following string, known boolean")

    def _look_up(self) -> None:
        w = self.words.select("word", "native", "scanned")
        # splits first: how the corpus writes the word, asked once for each form
        s = self.tokens.where("sign <> ''")
        left, right = F.substring_index("hyphened", "-", 1), F.substring_index("hyphened", "-", -1)
        forms = s.select("word", "hyphened").distinct().withColumn("q", F.explode(F.array(F.struct(F.lit("j").alias("k"), F.col("word").alias("w")), F.struct(F.lit("h").alias("k"), F.col("hyphened").alias("w")), F.struct(F.lit("l").alias("k"), left.alias("w")), F.struct(F.lit("r").alias("k"), right.alias("w")))))
        asked = forms.select("word", "hyphened", "q.k", "q.w").join(w.select(F.col("word").alias("w"), "native"), "w", "left")
        pick = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("native"))), F.lit(0)).alias(k)
        written = asked.groupBy("word", "hyphened").agg(pick("j"), pick("h"), pick("l"), pick("r"))
        split = s.join(written, ["word", "hyphened"])
        own_hyphen = (F.col("h") > F.col("j")) | ((F.col("h") == 0) & (F.col("j") == 0) & F.col("sign").isin("-", "‐", "‑") & (F.col("l") > 1) & (F.col("r") > 1) & (F.length(left) > 2) & (F.length(right) > 2))
        self.splits = cut_lineage(split.withColumn("noise", F.when(own_hyphen, "split_compound").otherwise("split_word")))
        joined = self.splits.select("id", "line_no", "at", F.when(F.col("noise") == "split_word", F.col("word")).otherwise(F.col("hyphened")).alias("word"), F.lit(True).alias("joined"), F.when(F.col("noise") == "split_word", F.col("cut_at")).otherwise(F.col("cut_at") + 1).alias("cut_at"), "previous", "following")
        plain = self.tokens.where("sign = '' and not known").select("id", "line_no", "at", "word", F.lit(False).alias("joined"), "cut_at", "previous", "following")
        every = joined.unionByName(plain)
        # a hyphened or elided word that the corpus doesn't know is asked by its parts
        new = every.select("word").distinct().join(w.where("native > 0").select("word"), "word", "left_anti")
        parts = new.withColumn("part", F.explode(F.array_union(F.split("word", "-"), F.array(F.regexp_extract("word", ELIDED, 1))))).where("length(part) > 1")
        parts = parts.join(w.select(F.col("word").alias("part"), F.col("native").alias("pn"), F.col("scanned").alias("ps")), "part", "left").fillna(0, ["pn", "ps"])
        parts = parts.where("pn = 0").select("word", "part", "ps").distinct()
        self.unknown = cut_lineage(every.join(parts, "word"))
        queries = parts.groupBy("part").agg(F.max("ps").alias("times"))
        able = w.where(r"(native > 0 or scanned > 2) and length(word) > 1 and word rlike '^[\\p{L}\\p{M}]+$'")
        n_words, n_queries = able.count(), queries.count()
        tries = max(1, -(-2 * n_words // TRIE), -(-6 * n_queries // LOOKED_UP))
        total = self.total
        # two words that differ in one place of at most two letters share their beginning or end, each just under half of the word
        half = F.expr("int((size - 1) / 2)")
        place = lambda word: F.array(F.struct(F.lit(0).alias("side"), F.expr(f"substring({word}, 1, half)").alias("share")), F.struct(F.lit(1).alias("side"), F.expr(f"substring({word}, length({word}) - half + 1, half)").alias("share")))
        trie_of = F.pmod(F.xxhash64("size", "p.side", "p.share"), F.lit(tries)).cast("int").alias("trie")
        a = able.withColumn("size", F.length("word")).withColumn("half", half).withColumn("p", F.explode(place("word"))).select(trie_of, "word", "native", "scanned").distinct()
        q = queries.withColumn("size", F.explode(F.expr("sequence(length(part) - 1, length(part) + 1)"))).withColumn("half", half).withColumn("p", F.explode(place("part"))).select(trie_of, "part", "times").distinct()

        def found(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            trie = make_trie(words["word"].tolist())
            n = dict(zip(words["word"], zip(words["native"], words["scanned"])))
            out = []
            for part, times in zip(asked["part"], asked["times"]):
                for v in within(trie, part):
                    native, scanned = n[v]
                    cost = confusion(part, v)
                    if v != part and (native > 0 or scanned >= 4 * max(times, 1)) and plausible(part, v, cost, native + scanned, times, total):
                        out.append((part, v, cost, native + scanned))
            return pd.DataFrame(out, columns=["part", "meant", "cost", "n"])

        made = a.groupBy("trie").cogroup(q.groupBy("trie")).applyInPandas(found, "part string, meant string, cost int, n long")
        self.candidates = cut_lineage(made.distinct())
        self._rank()

    def _rank(self) -> None:
        """The best candidate of each occurrence; where several of one cost compete, the neighbouring words count first."""
        several = self.candidates.groupBy("part").agg(F.count("*").alias("k"), F.min("cost").alias("least"))
        close = self.candidates.join(several, "part").where("cost = least")
        near = self.unknown.join(close, "part").select("id", "line_no", "at", "part", "meant", "cost", "n", "k", "previous", "following")
        asked = near.where("k > 1").select(F.explode(F.array(F.struct(F.col("previous").alias("x"), F.col("meant").alias("y")), F.struct(F.col("meant").alias("x"), F.col("following").alias("y")))).alias("b")).select("b.x", "b.y").where("x <> '' and y <> ''").distinct()

        # neighbours are counted over all words of all scanned pages
        together = self.tokens.where("previous <> ''").groupBy(F.col("previous").alias("x"), F.col("word").alias("y")).agg(F.count("*").alias("m")).join(asked, ["x", "y"], "left_semi")
        before = together.select(F.col("x").alias("previous"), F.col("y").alias("meant"), F.col("m").alias("mb"))
        after = together.select(F.col("x").alias("meant"), F.col("y").alias("following"), F.col("m").alias("ma"))
        scored = near.join(before, ["previous", "meant"], "left").join(after, ["meant", "following"], "left").fillna(0, ["mb", "ma"])
        best = Window.partitionBy("id", "line_no", "at", "part").orderBy("cost", F.desc(F.col("mb") + F.col("ma")), F.desc("n"), "meant")
        self.best = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("id", "line_no", "at", "part", "meant")

    def misread(self) -> DataFrame:
        """(id, line_no, at, word, part, meant, joined, on_line): misread words and what they were."""
        told = self.unknown.join(self.best, ["id", "line_no", "at", "part"])
        # a word that goes on in the next line lies where its wrong letter lies
        wrong = F.expr("coalesce(array_position(transform(sequence(1, length(part)), i -> substring(part, i, 1) <> substring(meant, i, 1)), true), 1)").cast("int")
        where = F.instr(F.col("word"), F.col("part"))
        line = F.when(F.col("joined") & ((where + wrong - 1) > F.col("cut_at")), F.col("line_no") + 1).otherwise(F.col("line_no"))
        return told.select("id", "line_no", "at", "word", "part", "meant", "joined", line.alias("on_line"))


def plausible(read: str, meant: str, cost: int, n: int, times: int, total: int) -> bool:
    """Whether a candidate is near enough, and common enough beside the ``times`` of what was read; the shorter, the more so."""
    if abs(len(read) - len(meant)) > 1 and cost:
        return False
    if len(read) < 4:
        return cost == 0 and len(meant) > 1 and n >= SHARE_OF_SHORT[min(len(meant), 3)] * total and n >= 10 * times
    if cost == 0:
        return True
    if cost == 1:
        return (len(read) >= 5 or not read.isalpha()) and n >= 2 * times
    return len(read) >= 6 and n >= 5 * times


def block_tokens(text: str, skip: set[int]) -> list[tuple]:
    """(line_no, at, word, sign, cut_at, hyphened, previous, following) of the words outside ``skip``.

    ``sign`` is empty but for a word that goes on in the next line; such a word is given joined, and with its hyphen.
    """
    lines = text.split("\n")
    out: list[list] = []
    taken = 0
    for n, line in enumerate(lines, 1):
        if n in skip or not line.strip():
            taken = 0
            continue
        line = skeleton(line) if not line.isascii() else line
        start, taken = taken, 0
        end = len(line)
        split = None
        m = BREAK.search(lines[n - 1] if line == lines[n - 1] else line) or (BREAK.search(lines[n - 1]) if "\xad" in lines[n - 1] else None)
        if m and n < len(lines) and n + 1 not in skip and lines[n].strip():
            after = HEAD.match(skeleton(lines[n]))
            left = m.group(1).lstrip(SIGN)
            if after and any(ch.isalpha() for ch in left) and any(ch.isalpha() for ch in after.group(1)) and not (m.group(2) == "-" and after.group(1).lower() in SUSPENDED):
                split = (left, m.group(2), after.group(1))
                end = m.start(1) + (len(m.group(1)) - len(left))
                taken = after.end()
        for t in TOKEN.finditer(line, start, end):
            raw = t.group()
            if raw.isalpha():
                out.append([n, t.start(), raw.lower(), "", 0, ""])
                continue
            w = word_of(raw)
            if not w.isalpha() and COMPOUND.search(raw):
                continue
            if "'" in raw and raw.rstrip(".,;:?)”\"").endswith("'") and w and not raw.startswith("'"):
                w = raw.strip(TRIM.replace("’", ""))
            if w.isalpha() or any(ch.isalpha() for ch in w) and (LED.fullmatch(w) or not UNIT.fullmatch(w)):
                out.append([n, t.start(), w.lower(), "", 0, ""])
        if split:
            left, sign, right = split
            out.append([n, end, (left + right).lower(), sign, len(left), f"{left}-{right}".lower()])
    previous = ""
    for k, row in enumerate(out):
        row += [previous, out[k + 1][2] if k + 1 < len(out) else ""]
        previous = row[2]
    return [tuple(r) for r in out]


def scan_noise(blocks: DataFrame) -> DataFrame:
    """(block_id, line_no, noise) of every scanned block: see the module. Lines count from 1, empty ones too.

    Repeated ids count once. Null and empty texts and blocks that aren't scanned give no row; without native text the
    vocabulary is what the scans themselves hold more than twice.
    """
    r = Reading(blocks)
    splits = r.splits.select("id", "line_no", "noise")
    misread = r.misread().select("id", F.col("on_line").alias("line_no"), F.lit("misread").alias("noise"))
    return r.furniture.unionByName(splits).unionByName(misread).distinct().select(F.col("id").alias("block_id"), "line_no", "noise")


def replaced(text: str, part: str, meant: str, start: int) -> str:
    """``text`` with the first ``part`` from ``start`` on as ``meant``, in the case it is written in."""
    i = text.lower().find(part, start)
    if i < 0 or text[i : i + len(part)].lower() != part:
        return text
    old = text[i : i + len(part)]
    return text[:i] + (meant.upper() if old.isupper() and len(old) > 1 else meant.capitalize() if old[0].isupper() else meant) + text[i + len(part) :]


def repaired_text(text: str, skip: set[int], splits: dict[int, str], words: dict[tuple[int, int, bool], list[tuple[str, str]]]) -> str:
    """A block's paragraphs, each in one line, one empty line between them.

    ``words`` has the misread parts of words by (line, place, whether the word goes on in the next line); such a word is
    put right when its two halves are joined.
    """
    lines, paragraphs, now, glue = text.split("\n"), [], "", None
    for n, line in enumerate(lines, 1):
        if n in skip:
            continue
        if not line.strip():
            if now:
                paragraphs.append(now)
            now, glue = "", None
            continue
        line = skeleton(line) if not line.isascii() else line
        for (_, at, _), swaps in sorted(((k, v) for k, v in words.items() if k[0] == n and not k[2]), reverse=True):
            for part, meant in swaps:
                line = replaced(line, part, meant, max(0, at))
        core = line.strip()
        if n in splits:
            core = core.rstrip(SIGN + " ")
            core += "-" if splits[n] == "split_compound" else ""
        if glue is None:
            now += " " + core if now else core
        else:
            start = now.rfind(" ") + 1
            now += core
            for (k, _, joined), swaps in words.items():
                if joined and k == glue:
                    for part, meant in swaps:
                        now = replaced(now, part, meant, start)
        glue = n if n in splits else None
    if now:
        paragraphs.append(now)
    return "\n\n".join(paragraphs)


def repaired_pages(blocks: DataFrame) -> DataFrame:
    """(block_id, text) of every scanned block: furniture gone, words joined and put right, lines reflowed."""
    r = Reading(blocks)
    splits = r.splits.groupBy("id").agg(F.collect_list(F.struct("line_no", "noise")).alias("splits"))
    words = r.misread().groupBy("id").agg(F.collect_list(F.struct("line_no", "at", "joined", "part", "meant")).alias("words"))
    at = r.marked.join(splits, "id", "left").join(words, "id", "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, skip, split, word in zip(batch["raw_text"], batch["skip"], batch["splits"], batch["words"]):
                swaps: dict[tuple[int, int, bool], list[tuple[str, str]]] = {}
                for x in word if word is not None else ():
                    swaps.setdefault((x["line_no"], x["at"], x["joined"]), []).append((x["part"], x["meant"]))
                out.append(repaired_text(text, set() if skip is None else set(skip), {x["line_no"]: x["noise"] for x in split} if split is not None else {}, swaps))
            yield pd.DataFrame({"block_id": batch["id"], "text": out})

    return at.mapInPandas(repair, "block_id string, text string")
