"""Problem 4: prompt and response pairs whose second part is unusable.

The parts are aligned as word sequences. A copy is found by the containment of the response's shingles in the prompt
and by their longest common subsequence; a refusal by the alignment of the response with templates of refusals, in
order and close together, outside speech. Language comes from scripts and function words. What stops short is read
from its ending; where the ending could be a short answer's, the corpus tells how answers that begin alike end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import cut_lineage, records
from groundwork.llm.looks import plain
from groundwork.llm.sentences import CLOSERS

#: Words of the shingles, the share of them that a copy has from the prompt, and the share of the prompt that it says again.
SHINGLE, CONTAINED, SAID_AGAIN = 3, 0.95, 0.8

#: What stands where an answer should, as words.
NOTHING = frozenset(["", "a", "answer", "na", "n a", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "todo", "to do", "no answer", "not available", "not applicable", "no response", "no data", "empty", "blank", "missing", "undefined", "placeholder", "xxx", "xx", "pending", "to be added", "to be done", "to be determined", "to follow", "answer here", "answer missing", "see above", "see below", "keine", "keine antwort", "keine angabe", "k a", "aucune", "aucune réponse", "sans réponse", "néant", "sin respuesta", "ninguna", "ninguno", "antwort", "réponse", "respuesta", "lorem ipsum"])
#: Templates of refusals as words, / between words that may stand for one another, * up to three words, ~ up to eight.
REFUSALS = """
i cannot help/answer/provide/comply/assist/write/give/say/discuss/do/fulfil/fulfill/generate/create/complete/respond/share/verify/comment/support/tell|i could not answer/help|cannot help with that/this
i am unable to|i am not able/allowed/permitted/comfortable|i will not be able|i will not answer/help/write/do|i must/have/need ~ decline|i decline/refuse to|i would rather not|i prefer not to|i do not feel able|unable to comply/answer/assist/help/provide/process/fulfil/respond/verify
i do not have ~ enough information/material/context|i do not have enough/access|i do not know enough|not enough information to
my guidelines/policy/policies/instructions/programming/rules do/does/forbid not/it/this/that|against my guidelines/policy/policies/rules/programming/instructions|as a language model|as an ai/assistant i|i am only/just a/an ~ model/assistant/ai
outside/beyond/not * what/something i can|outside the scope of what i|request cannot be|question/answer cannot be answered/given|no answer can/is be/possible
sorry i cannot/will|sorry but i|i am sorry but/that/i|my apologies but/i|sorry no answer|i apologize/apologise but/that/i
es tut mir leid|tut mir leid ~ nicht/keine/kein|ich kann/darf/möchte/könnte ~ nicht/keine/kein/keinen ~ helfen/weiterhelfen/beantworten/antworten/sagen/geben/erfüllen/liefern/bereitstellen/erstellen/nachkommen/eingehen
kann/darf/möchte ich ~ nicht/keine/kein/keinen ~ helfen/weiterhelfen/beantworten/antworten/sagen/geben/erfüllen/liefern/bereitstellen/erstellen/nachkommen/eingehen
ich bin nicht in der lage|mir ist/es ~ nicht möglich|als sprachmodell ~ ich|als ki ~ ich
il m'est impossible|je ne peux/puis/saurais pas/répondre/rien|je ne suis pas en mesure|je suis désolé/désolée|je regrette mais|je suis incapable de|je refuse de|en tant que modèle|je n'ai pas assez|impossible de vous aider|je préfère ne pas
lo siento|no puedo ayudar/responder/contestar/proporcionar/cumplir/opinar/decir|no me es ~ posible|me es imposible|no estoy en condiciones|no soy capaz de|no estoy autorizado|como modelo de lenguaje|prefiero no responder/contestar|no dispongo de ~ información|no tengo suficiente ~ información
извините|не могу ответить/помочь|к сожалению я не|对不起|抱歉|无法回答|申し訳|お答えできません
"""
#: Each template as (most words between, words of the place), by its first words.
REFUSAL_STARTS: dict[str, list[list[tuple[int, frozenset[str]]]]] = {}
for _template in REFUSALS.replace("\n", "|").strip("|").split("|"):
    _gap, _places = 1, []
    for _word in _template.split():
        if _word in "*~":
            _gap = {"*": 3, "~": 8}[_word]
        else:
            _places.append((_gap, frozenset(_word.split("/"))))
            _gap = 1
    for _word in _places[0][1] if _places else ():
        REFUSAL_STARTS.setdefault(_word, []).append(_places)

#: Function words of languages in Latin letters.
FUNCTION_WORDS = {lang: frozenset(words.split()) for lang, words in {
    "en": "the of and to in is was were are that it its they them with for by at from this these those which when without before after only has had have be been being not as an than then no would could should will can may must such there their into once on or if but he she his her we you your our what where why how who whose does did do between both each any some more most very also while until since because about over under through during",
    "de": "der die das und ist wird werden wurde wurden den dem des ein eine einen einem einer eines nicht mit für auf von zu im am er sie es sich auch ohne dass daß wie als nach nur wenn weil da war waren hat haben hatte um bei aus durch zwischen an vom zum zur sein seine seinen seinem seiner ihr ihre ihren oder aber denn doch warum wofür wo wer was welche welcher welches man kann können so viel mehr noch schon sehr über unter vor bis seit gegen diese dieser dieses kein keine jede jeder",
    "fr": "à le la les un une des du de et est sont dans que qui il elle ils elles on nous vous je se par pour sur pas avec après avant sans seulement ce cet cette ces son sa ses leur leurs au aux a ont été était étaient être avoir plus moins où ne en y comme mais ou donc car ni si quoi quel quelle lequel combien selon entre sous vers chez près très aussi même tout tous toute toutes dont lorsque quand parce",
    "es": "a el la los las un una unos unas de del y e es son en que quien se por para con sin después antes más menos no al lo le les su sus como pero o u fue fueron era eran está están ser sido también aunque solo sobre muy porque cuando donde cuál cuánto qué cerca según entre hasta desde hacia ya si ni este esta estos estas ese esa esto otro otra cada todo todos toda todas hay ha han",
    "it": "a il lo gli i un uno una di del della dello dei degli delle e è sono in nel nella che chi si per con senza dopo prima più meno non al alla le suo sua loro come ma o fu era erano anche solo su sul sulla perché quando dove quale quanto tra fra ha hanno questo questa",
    "pt": "a o os as um uma uns umas de do da e é são em no na que quem se por para com sem depois antes mais menos não ao à seu sua como mas ou foi era eram também só sobre muito porque quando onde qual quanto dos das entre até desde já este esta isso tem têm há",
    "nl": "de het een en is zijn was van in dat die op te met voor niet aan er om ook als bij maar uit door naar dan nog werd wordt worden alleen hij ze zij dit deze wat waar wie hoe waarom welke kan kunnen heeft hebben over onder tussen tot geen",
}.items()}
SCRIPT_LANGUAGES = [("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("ko", regex.compile(r"\p{Hangul}")), ("ru", regex.compile(r"\p{Cyrillic}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("th", regex.compile(r"\p{Thai}")), ("el", regex.compile(r"\p{Greek}")), ("he", regex.compile(r"\p{Hebrew}"))]
#: Fixed value: how a prompt asks for another language.
ASKS_FOR_LANGUAGE = regex.compile(r"\b(?:translat\w*|übersetz\w*|tradui\w*|traduc\w*|(?:in|into|auf|ins|en|al|im)\s+(?:the\s+)?(?:english|german|french|spanish|russian|chinese|japanese|italian|latin|deutsch\w*|englisch\w*|französisch\w*|spanisch\w*|russisch\w*|chinesisch\w*|japanisch\w*|français|anglais|allemand|espagnol|russe|chinois|japonais|inglés|alemán|francés|español|ruso|chino|japonés))\b", regex.IGNORECASE)
#: Fixed value: words on which no answer ends.
NO_END = frozenset("the a an of to and or in with by for from at as that which who when where because since than into its their his her is are was were be been but so if on between der die das den dem des und oder mit von zu im ein eine einen einem einer dass weil wenn für auf nach bei als durch um le la les un une des du de et ou que qui dans pour par sur avec en au aux el los las una y o del con para por se su al lo como".split())

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.,]\p{N}+)*")
#: Contractions and what they stand for, in the order in which they are written out.
CONTRACTED = (("can't", "cannot"), ("can not", "cannot"), ("won't", "will not"), ("n't", " not"), ("i'm", "i am"), ("i'd", "i would"), ("i've", "i have"))
SPOKEN_WORD = regex.compile(r"\p{Han}+|[\p{Hiragana}\p{Katakana}\p{Han}]+|[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}]+)?")
MARKUP = regex.compile(r"\{\{c\d+::(.*?)(?:::[^{}]*)?\}\}", regex.DOTALL)
QUOTED = regex.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|「[^」]*」")
LABEL = regex.compile(r"^\s*(?:q|a|question|answer|frage|antwort|réponse|pregunta|respuesta|prompt|response)\s*[:.)]\s*", regex.IGNORECASE)
CUT_MARK = regex.compile(r"(?:\[\s?(?:\.{2,}|…)\s?\]|…|\.{2,}|[-–—‐¬]|[,;:(]|�)\s*$")
TERMINAL = tuple(".!?。！？।؟")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, row by row as bits of an integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def shingles(ws: list[str]) -> list[tuple[str, ...]]:
    return [tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))]


def copies(first: list[str], second: list[str]) -> bool:
    """Whether ``second`` says all of ``first`` again, once or more, and nothing more."""
    if not first or not second or len(second) < len(first) * SAID_AGAIN:
        return False
    ring = {s for s in shingles(first + first[: SHINGLE - 1])} | set(shingles(first))
    inside = sum(s in ring for s in shingles(second)) / len(shingles(second))
    more = sum((Counter(second) - Counter({w: n * len(second) for w, n in Counter(first).items()})).values())
    return inside >= CONTAINED and more == 0 and common_subsequence(first, second[: len(first) + 2]) >= SAID_AGAIN * len(first)


def refuses(text: str) -> bool:
    """Whether a template of a refusal aligns with ``text`` outside speech: a word for each of its places, in order and close together."""
    said = QUOTED.sub(" ", text).replace("’", "'").lower()
    for short, full in CONTRACTED:
        said = said.replace(short, full)
    ws = SPOKEN_WORD.findall(said)

    def fits(at: int, places: list[tuple[int, frozenset[str]]]) -> bool:
        if not places:
            return True
        gap, any_of = places[0]
        return any(ws[k] in any_of and fits(k, places[1:]) for k in range(at + 1, min(at + 2 + gap, len(ws))))

    return any(fits(i, places[1:]) for i, w in enumerate(ws) for places in REFUSAL_STARTS.get(w, ()) if len(places) > 1 or i == 0)


def language(text: str, without: frozenset[str] = frozenset()) -> tuple[str, int, int]:
    """(language, hits, hits of the next) of a text; "" where nothing tells."""
    letters = sum(ch.isalpha() for ch in text)
    for lang, p in SCRIPT_LANGUAGES:
        if letters and len(p.findall(text)) * (5 if lang == "ja" else 3) > letters:
            return lang, 99, 0
    ws = [w for w in words(text) if w not in without]
    hits = sorted(((sum(w in known for w in ws), lang) for lang, known in FUNCTION_WORDS.items()), reverse=True)
    return (hits[0][1] if hits[0][0] else "", hits[0][0], hits[1][0])


def other_language(first: str, second: str) -> bool:
    if ASKS_FOR_LANGUAGE.search(first):
        return False
    a, n, m = language(first)
    b, k, j = language(second)
    if not a or not b or a == b:
        return False
    if k == 99 or n == 99:
        return True
    own = sum(w in FUNCTION_WORDS[a] for w in words(second))
    return n > m and k > j and k >= 2 and (k > own + 1 or k > own and n > m + 1)


def opening(text: str) -> str:
    """The first two words of a response; whether many share them is left to the corpus."""
    return " ".join(words(text)[:2])


def ends_open(second: str) -> str:
    """'cut', 'whole', or 'unsure' where a response without a closing sign may be a short answer."""
    text = second.strip()
    core = text.rstrip(CLOSERS + " ")
    ws = words(core)
    if CUT_MARK.search(text) and len(ws) > 1:
        return "cut"
    if core.endswith(TERMINAL):
        return "whole"
    if not ws:
        return "whole"
    if regex.search(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]$", core):
        return "whole"
    if ws[-1] in NO_END and len(ws) > 1 and core[-len(ws[-1]) :].islower():
        return "cut"
    if text.count("(") > text.count(")") or text.count("“") > text.count("”") and "„" not in text or text.count("«") > text.count("»"):
        return "cut"
    if regex.search(r"\p{L}{3,}[.!?]\s+\p{Lu}", core) or len(ws) >= 6 and regex.search(r"[,;]\s", core):
        return "cut"
    return "unsure" if len(ws) > 2 else "whole"


def defect_of(first: str | None, second: str | None) -> str:
    """The defect that a pair's own words show: its name, 'unsure' for an ending the corpus has to tell, or ''."""
    second = "" if second is None else plain(second).strip()
    first = "" if first is None else plain(first)
    bare = LABEL.sub("", second)
    ws = words(bare)
    if " ".join(ws) in NOTHING or not ws and not regex.search(r"[\p{So}\p{Sm}\p{Sc}∞]", second):
        return "empty_answer"
    if copies(words(LABEL.sub("", MARKUP.sub(r"\1", first))), words(MARKUP.sub(r"\1", bare))) or copies(words(first), words(bare)):
        return "copies_question"
    if refuses(second):
        return "refusal"
    if other_language(MARKUP.sub(r"\1", first), second):
        return "other_language"
    end = ends_open(second)
    return "truncated_answer" if end == "cut" else "unsure" if end == "unsure" else ""


def defective_pairs(cards: DataFrame) -> DataFrame:
    """(card_id, defect) of each card whose second part is unusable.

    A cloze card pairs cloze_text with explanation, any other question with answer. A missing first part copies
    nothing and has no language. Repeated ids count once, rows without an id are no cards. Very long parts are aligned
    whole.
    """
    c = records(cards, ["id", "format", "question", "answer", "cloze_text", "explanation"])
    cloze = F.col("format").eqNullSafe("cloze")
    parts = c.select("id", F.when(cloze, F.col("cloze_text")).otherwise(F.col("question")).alias("first"), F.when(cloze, F.col("explanation")).otherwise(F.col("answer")).alias("second"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for card, first, second in zip(batch["id"], batch["first"], batch["second"]):
                ws = words(second or "")
                out.append((card, defect_of(first, second), opening(second or ""), len(ws), bool(second) and second.rstrip().rstrip(CLOSERS).endswith(TERMINAL)))
            yield pd.DataFrame(out, columns=["card_id", "defect", "_opening", "_n", "_closed"])

    seen = cut_lineage(parts.mapInPandas(look, "card_id string, defect string, _opening string, _n int, _closed boolean"))
    # how long the whole answers with an opening are: those with a closing sign, and those without by number of words
    unsure = seen.where("defect = 'unsure'")
    lengths = unsure.groupBy("_opening", "_n").agg(F.count("*").alias("_open"))
    closed = seen.where("_closed and defect = ''").groupBy("_opening").agg(F.count("*").alias("_whole"))
    told = unsure.join(lengths, ["_opening", "_n"]).join(closed, "_opening", "left").fillna(0, ["_whole"])
    # an answer without a sign that a share of its like also has is a form of its own; a rare one among closed ones is cut
    rare = (F.col("_open") * 10 < F.col("_whole")) | ((F.col("_whole") == 0) & (F.col("_n") >= 9)) | (F.col("_n") >= 14)
    cut = told.where(rare).select("card_id", F.lit("truncated_answer").alias("defect"))
    return seen.where("defect not in ('', 'unsure')").select("card_id", "defect").unionByName(cut)
