"""Column expressions over text; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s   -     　﻿]+"
#: ASCII word boundaries, as in the patterns' home dialect; Java's own take accented letters for word letters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Words that negate, hedge or generalise a statement.
NEGATION = "not|never|no|without|cannot|can't|doesn't|don't|didn't|isn't|aren't|wasn't|weren't|fails? to|failed to|nor|neither|rather than|instead of|prevents?|inhibits?|blocks?|suppresses?"
MODALITY = "may|might|could|can|suggests?|suggested|associated with|appears? to|is thought to|is believed to|tends? to|often|sometimes|generally|typically|usually"
ABSOLUTE = "always|never|all|every|invariably|without exception|exclusively"
#: What limits a statement, and what it is limited to.
CONDITION = "in|at|under|for|within|during|among|when|if|only|except|unless|above|below|over|under|prior to|following"
CONDITION_OF = "neurons?|cells?|humans?|patients?|mammals?|organisms?|species|conditions?|temperatures?|pH|concentrations?|adults?|children|males?|females?|vitro|vivo|rest"
#: Words that don't count as a claim's own terms.
FUNCTION_WORDS = "what which when where why how according source passage following does the and for with from that this these those its has have was were are is been being into than then they them their there about because since given stated described term value".split()
#: Words that tell no figure from another.
STOP_TERMS = "about above after again also among another because been before being below between both cannot could does doing during each either else even every figure from further have having here however into itself just like made many might more most much must neither number only other over same shall should shown shows since some such than that their them then there these they this those through thus under upon used using very was were what when where which while will with within without would".split()
#: Wording that decides a card's format.
DEFINITION_CUE = r"(?:is|are|was|were)\s+(?:defined as|known as|called|termed|referred to as|composed of|characterised by|characterized by)"
CAUSAL_CUE = "because|since|due to|owing to|as a result of|therefore|thus|hence|leads to|results in|prevents"
MECHANISM_CUE = "requires|enables|allows|mediates|depends on|relies on|consists of|comprises"
MECHANISM_LEAD = "by|through|via"
#: A cloze deletion with an optional hint.
CLOZE = r"\{\{c[0-9]+::([^{}]*?)(?:::[^{}]*?)?\}\}"
#: Units behind a number.
UNITS = "%|mV|ms|Hz|kHz|nm|µm|um|mm|cm|km|kDa|Da|mM|µM|uM|nM|pM|mg|µg|ug|kg|mL|L|°C|K|years?|months?|days?|weeks?|s|min|h|percent|millivolts?|milliseconds?|seconds?|minutes?|hours?|hertz|nanometers?|micrometers?|millimeters?|centimeters?|millimolar|micromolar|nanomolar|picomolar|degrees?|daltons?|kilodaltons?|milligrams?|micrograms?|millilit(?:er|re)s?|lit(?:er|re)s?|kelvin"
#: A unit ends at a word boundary; behind a percent sign there is one only before a word letter.
QUANTITY = rf"(?i)(-?[0-9]+(?:[.,][0-9]+)?)\s*(%(?=[A-Za-z0-9_])|(?:{UNITS[2:]}){RIGHT})"


def collapse(text: Column) -> Column:
    """Every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")


def has_words(text: Column, words: str) -> Column:
    return text.rlike(f"(?i){LEFT}(?:{words}){RIGHT}")


def content_words(text: Column) -> Column:
    """Lower-case words of three letters or more; stops and hyphens stay on them."""
    parts = F.split(F.regexp_replace(F.lower(collapse(text)), r"[^a-z0-9\s.-]", " "), r"\s+")
    return F.filter(parts, lambda w: F.length(w) > 2)


def plain_words(text: Column) -> Column:
    """Lower-case words of any length; hyphens stay on them."""
    parts = F.split(F.regexp_replace(F.lower(collapse(text)), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.filter(parts, lambda w: F.length(w) > 0)


def significant_terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, four characters or more, that tell something."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 3) & ~w.isin(STOP_TERMS))
    return F.array_distinct(words)


def quantities(text: Column) -> Column:
    """Numbers with their units as written, value:unit, decimal comma as a point."""
    found = F.regexp_extract_all(collapse(text), F.lit(QUANTITY), F.lit(0))
    value = lambda q: F.replace(F.regexp_extract(q, QUANTITY, 1), F.lit(","), F.lit("."))
    return F.transform(found, lambda q: F.concat(value(q), F.lit(":"), F.lower(F.regexp_extract(q, QUANTITY, 2))))


def quantity_values(text: Column) -> Column:
    """Quantities as (value, unit)."""
    return F.transform(quantities(text), lambda q: F.struct(F.substring_index(q, ":", 1).cast("double").alias("value"), F.substring_index(q, ":", -1).alias("unit")))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is evaluated once however often it is used, within lambdas too."""
    return F.element_at(F.transform(F.array(x), use), 1)


def missing_quantities(claim: Column, source: Column) -> Column:
    """Of two arrays of (value, unit): those of ``claim`` that equal none of ``source``; 5.0 equals 5."""
    return let(source, lambda known: F.filter(claim, lambda x: ~F.exists(known, lambda y: (F.abs(y["value"] - x["value"]) < 1e-9) & (y["unit"] == x["unit"]))))


def has_mechanism(text: Column) -> Column:
    """Whether a mechanism is told: one of its words, or a leading word, a blank and a word letter."""
    return text.rlike(f"(?i){LEFT}(?:(?:{MECHANISM_LEAD}) (?=[A-Za-z0-9_])|(?:{MECHANISM_CUE}){RIGHT})")


def has_condition(text: Column) -> Column:
    return text.rlike(f"(?i){LEFT}(?:{CONDITION}){RIGHT}[^,.;]{{0,60}}?{LEFT}(?:{CONDITION_OF}){RIGHT}")


def has_quantity(text: Column) -> Column:
    """Whether a number with a unit stands in the text; calendar units are none here."""
    units = UNITS[2:].replace("|years?|months?|days?|weeks?", "")
    return text.rlike(rf"(?i){LEFT}[0-9]+(?:[.,][0-9]+)?\s*(?:%(?=[A-Za-z0-9_])|(?:{units}){RIGHT})")


def sentence_pieces(text: Column) -> Column:
    """A collapsed text's sentences as they follow one another, each with the blank behind it; a decimal point ends one too."""
    return F.regexp_extract_all(text, F.lit(r"(?:\S[^.!?]*[.!?]+|\S[^.!?]*$) ?"), F.lit(0))


def word_dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice of two arrays of words as sets; 0 if either is empty."""
    share = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: share(x, y)))


def word_count(text: Column) -> Column:
    clean = collapse(text)
    return F.when(F.coalesce(clean, F.lit("")) == "", 0).otherwise(F.size(F.split(clean, " ")))


def cloze_deletions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{\{c[0-9]+::(.*?)(?:::[^}]*)?\}\}"), F.lit(1))


def cloze_as_claim(text: Column) -> Column:
    return F.regexp_replace(text, r"\{\{c[0-9]+::(.*?)(?:::[^}]*)?\}\}", "$1")


def cloze_parts(text: Column) -> Column:
    """The collapsed deletions of a cloze text, as its checks read them: without braces inside."""
    return F.transform(F.regexp_extract_all(text, F.lit(CLOZE), F.lit(1)), lambda d: collapse(d))


def cloze_restored(text: Column) -> Column:
    """A cloze text with its deletions written back, collapsed."""
    return collapse(F.regexp_replace(text, CLOZE, "$1"))


def half_up(x: Column, digits: int) -> Column:
    """Rounded, halves towards plus infinity, on the binary product."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
