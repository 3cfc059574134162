"""Problem 1: texts that a reader sees as the same in one form, in which they compare as equal.

Two steps. The first needs only the text: invisible characters go, accents are composed, full-width forms, ligatures,
hyphens and single spaces become the plain ones. The second is script-aware: a token whose letters come from more than
one script gets its dominant script, the one of the letters that have no look-alike in the other; its other letters
are replaced by look-alikes of that script if the result is a word of the corpus, that is, occurs somewhere in one
script or results from tokens of two texts. A token made only of look-alikes of another script than its text counts as
mixed too. Case, visible accents, superscripts and digits stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import cut_lineage, members_paired, pair, pairs_within, records

#: Letters of other scripts that look like a Latin one (Unicode's confusables), by script.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈҮӀԌԜԚ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJYIGWQ"))
GREEK = dict(zip("οονρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "oovpucjABEZHIKMNOPTYXCJ"))
ARMENIAN = dict(zip("օսոհցզքՕՍԼՏ", "ounhgqpOULS"))
TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN}
FROM_LATIN = {"Cyrillic": {v: k for k, v in CYRILLIC.items()}, "Greek": {v: k for k, v in GREEK.items()}, "Armenian": {v: k for k, v in ARMENIAN.items()}}
#: Latin signs that look like a letter, and signs that look like another sign.
SIGNS = {"ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "–", "ʼ": "’", "․": ".", "∶": ":", "∕": "/", "⁄": "/", "ǃ": "!", "µ": "μ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m"}
WIDE = {chr(n): chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F)}
#: Format characters that can be seen.
SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\U000e0100-\U000e01ef]")
SPACE = regex.compile(r"[\p{Zs}\t\x85  ]")
WIDE_RUN = regex.compile(r"[！-～]+")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}　-〿]")
TOKEN = regex.compile(r"[\p{L}\p{M}]+")
FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}]")
SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Cyrillic", "Greek", "Armenian")}
SIGN_TABLE = str.maketrans(SIGNS)
#: What the first step changes, but for letters that aren't composed; most texts hold none of it.
TOUCHED = frozenset(chr(n) for n in range(9, sys.maxunicode + 1) if n not in (10, 11, 12, 13, 32) and not 0xD800 <= n < 0xE000 and (chr(n) in SIGNS or chr(n) in WIDE or n == 9 or n > 0x7F and (unicodedata.category(chr(n)) in ("Cf", "Zs") or INVISIBLE.match(chr(n)) or SPACE.match(chr(n)))))


def narrow(m: regex.Match) -> str:
    """Full-width letters and digits always, signs unless they stand in text that is wide by nature."""
    s, text = m.group(), m.string
    near = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
    if not any(ch.isalnum() for ch in s) and CJK.search(near):
        return s
    return "".join(ch if CJK.search(near) and not ch.isalnum() else WIDE[ch] for ch in s)


def drop(m: regex.Match) -> str:
    ch, text = m.group(), m.string
    if ord(ch) in SEEN:
        return ch
    if ch == "‍" and unicodedata.category(text[m.start() - 1 : m.start()] or " ") in ("So", "Sk", "Mn") and unicodedata.category(text[m.end() : m.end() + 1] or " ") == "So":
        return ch
    return ""


def plain(text: str) -> str:
    """The first step, on one text."""
    if text.isascii():
        return text.replace("\t", " ")
    if TOUCHED.isdisjoint(text) and unicodedata.is_normalized("NFC", text):
        return text
    text = INVISIBLE.sub(drop, text)
    text = SPACE.sub(" ", unicodedata.normalize("NFC", text)).translate(SIGN_TABLE)
    return WIDE_RUN.sub(narrow, text)


def swap(token: str, table: dict[str, str], own: regex.Pattern) -> str | None:
    """``token`` with its letters of other scripts replaced, None if one has no look-alike."""
    out = []
    for ch in unicodedata.normalize("NFD", token):
        if unicodedata.category(ch)[0] == "L" and not own.match(ch):
            if ch not in table:
                return None
            ch = table[ch]
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def repaired(token: str, text_script: str) -> str | None:
    """What ``token`` becomes if the corpus knows it, None for a token that isn't mixed."""
    letters = [ch for ch in unicodedata.normalize("NFD", token) if unicodedata.category(ch)[0] == "L"]
    count, alone = Counter(), Counter()
    for ch in letters:
        script = next((name for name, p in SCRIPTS.items() if p.match(ch)), "")
        count[script] += 1
        if not (ch in TO_LATIN if script != "Latin" else any(ch in t for t in FROM_LATIN.values())):
            alone[script] += 1
    if len(count) == 1:
        script = next(iter(count))
        if script in ("Latin", "") or alone[script] or text_script != "Latin":
            return None
        return swap(token, TO_LATIN, SCRIPTS["Latin"])
    if "" in count:
        return None
    dominant = max(count, key=lambda s: (alone[s], s == text_script, count[s], s))
    if dominant == "Latin":
        return swap(token, TO_LATIN, SCRIPTS["Latin"])
    return swap(token, FROM_LATIN[dominant], SCRIPTS[dominant])


def script_of(text: str) -> str:
    sizes = {name: len(p.findall(text)) for name, p in SCRIPTS.items()}
    return max(sizes, key=lambda n: (sizes[n], n == "Latin"))


def mixed_tokens(text: str) -> dict[str, str]:
    """The mixed tokens of a text and what each would become."""
    if not FOREIGN.search(text):
        return {}
    script, out = script_of(text), {}
    for token in {t for t in TOKEN.findall(text) if FOREIGN.search(t)}:
        r = repaired(token, script)
        if r is not None and r != token:
            out[token] = r
    return out


def skeleton(text: str) -> str:
    """A text with every mixed token repaired, without asking the corpus; for finding a passage again."""
    text = plain(text)
    mixed = mixed_tokens(text)
    return TOKEN.sub(lambda m: mixed.get(m.group(), m.group()), text) if mixed else text


def one_form(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text as given, look): each row's text in the one form; ``look`` is null where it equals the text.

    Null text gives a null look, an empty one stays empty. Rows may repeat. Other columns are dropped.
    """
    kind = texts.schema[key].dataType.simpleString()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            looks, olds, news = [], [], []
            for t in batch["_text"]:
                p = None if t is None else plain(t)
                mixed = mixed_tokens(p) if p else {}
                looks.append(None if p is None or p == t else p)
                olds.append(list(mixed) or None)
                news.append(list(mixed.values()) or None)
            yield pd.DataFrame({"_key": batch["_key"], "_text": batch["_text"], "_plain": pd.Series(looks, dtype=object), "_old": pd.Series(olds, dtype=object), "_new": pd.Series(news, dtype=object)})

    one = cut_lineage(texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInPandas(first, f"_key {kind}, _text string, _plain string, _old array<string>, _new array<string>"))
    mixed = one.where("_old is not null").select("_key", F.explode(F.arrays_zip("_old", "_new")).alias("t")).select("_key", F.col("t._old").alias("token"), F.col("t._new").alias("word"))
    wanted = mixed.groupBy("token", "word").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"))
    by_word = wanted.groupBy("word").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    words = one.select(F.explode(F.split(F.coalesce("_plain", "_text"), r"[^\p{L}\p{M}]+")).alias("word")).join(by_word.select("word"), "word", "left_semi").distinct()
    sure = words.unionByName(by_word.where("_a <> _b").select("word")).distinct()
    swaps = mixed.join(wanted.join(sure, "word", "left_semi").select("token", "word"), ["token", "word"])
    swaps = swaps.groupBy("_key").agg(F.collect_set(F.struct("token", "word")).alias("_swaps"))
    changed = one.where("_old is not null").select("_key", "_text", F.coalesce("_plain", "_text").alias("_plain")).join(swaps, "_key", "left")

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            looks = []
            for t, p, s in zip(batch["_text"], batch["_plain"], batch["_swaps"]):
                known = {x["token"]: x["word"] for x in s} if s is not None else {}
                p = TOKEN.sub(lambda m: known.get(m.group(), m.group()), p) if known else p
                looks.append(None if p == t else p)
            yield pd.DataFrame({"_key": batch["_key"], "_text": batch["_text"], "_plain": pd.Series(looks, dtype=object)})

    done = one.where("_old is null").select("_key", "_text", "_plain").unionByName(changed.mapInPandas(second, f"_key {kind}, _text string, _plain string"))
    return done.select(F.col("_key").alias(key), F.col("_text").alias("text"), F.col("_plain").alias("look"))


def same_look(blocks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(a_id, b_id): a block and a concept whose excerpt only looks like a passage of it; two blocks that only look the same.

    Repeated ids count once. Null or empty texts, excerpts without a block, and texts with nothing to be seen give no
    row. Blocks of one look are grouped by their exact text first, so that copies of one text are never compared.
    """
    b = records(blocks, ["id", "normalized_text"]).where("normalized_text <> ''").select("id", F.col("normalized_text").alias("text"), F.lit(None).cast("string").alias("of"))
    c = records(concepts, ["id", "source_excerpt", "source_block_id"]).where("source_excerpt <> '' and source_block_id is not null")
    c = c.select("id", F.col("source_excerpt").alias("text"), F.col("source_block_id").alias("of"))
    both = b.unionByName(c).select(F.struct("id", "of").alias("key"), "text")
    looks = cut_lineage(one_form(both, "key", "text").select("key.id", "key.of", "text", "look"))
    blocks_, excerpts = looks.where("of is null").drop("of"), looks.where("of is not null")

    seen = F.coalesce("look", "text")
    passages = excerpts.select(F.col("id").alias("c"), "of", F.col("text").alias("ct"), seen.alias("cl")).where("trim(cl) <> ''").join(blocks_.select(F.col("id").alias("of"), "text", "look"), "of")
    passages = passages.where(~F.col("text").contains(F.col("ct")) & seen.contains(F.col("cl"))).select(*pair("of", "c", "a_id", "b_id"))

    twins = members_paired(*_twin_texts(blocks_)).select(*pair("ia", "ib", "a_id", "b_id"))
    return passages.unionByName(twins).distinct()


def _twin_texts(looks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of different texts of one look, the members (id, u) of such texts, and these with their copies."""
    seen = F.coalesce("look", "text")
    texts = looks.where(F.trim(seen) != "").select("id", F.sha2(seen, 256).alias("l"), F.concat_ws(":", F.sha2(seen, 256), F.sha2("text", 256)).alias("u"))
    classes = texts.groupBy("l", "u").agg(F.count("*").alias("copies"))
    several = classes.groupBy("l").agg(F.count("*").alias("k")).where("k > 1").select("l")
    units = classes.join(several, "l", "left_semi")
    return pairs_within(units, "l", "u"), texts.join(several, "l", "left_semi").select("id", "u"), units.select("u", "copies")


def look_classes(blocks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(block_id, look_id, text_id, texts, links) of every block whose look several different texts have.

    ``look_id`` and ``text_id`` are the least block ids of the look and of the exact text, ``texts`` counts the look's
    different texts, ``links`` the blocks that look the same and have another text.
    """
    b = records(blocks, ["id", "normalized_text"]).where("normalized_text <> ''").select("id", F.col("normalized_text").alias("text"), F.lit(None).cast("string").alias("of"))
    c = records(concepts, ["id", "source_excerpt"]).where("source_excerpt <> ''").select("id", F.col("source_excerpt").alias("text"), F.lit("").alias("of"))
    looks = one_form(b.unionByName(c).select(F.struct("id", "of").alias("key"), "text"), "key", "text").select("key.id", "key.of", "text", "look").where("of is null")
    _, members, units = _twin_texts(cut_lineage(looks))
    named = members.groupBy("u").agg(F.min("id").alias("text_id")).join(units, "u").withColumn("l", F.substring_index("u", ":", 1))
    whole = named.groupBy("l").agg(F.min("text_id").alias("look_id"), F.count("*").alias("texts"), F.sum("copies").alias("blocks"))
    return members.join(named.join(whole, "l"), "u").select(F.col("id").alias("block_id"), "look_id", "text_id", "texts", (F.col("blocks") - F.col("copies")).alias("links"))


def corpus_in_one_form(blocks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(kind, id, look) of every block and excerpt, each record once."""
    b = records(blocks, ["id", "normalized_text"]).select(F.struct(F.lit("block").alias("kind"), "id").alias("key"), F.col("normalized_text").alias("text"))
    c = records(concepts, ["id", "source_excerpt"]).select(F.struct(F.lit("concept").alias("kind"), "id").alias("key"), F.col("source_excerpt").alias("text"))
    return one_form(b.unionByName(c), "key", "text").select("key.kind", "key.id", F.coalesce("look", "text").alias("look"))
