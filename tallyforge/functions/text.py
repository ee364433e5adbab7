"""Name and text expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how filers word the return of a contribution.
REFUND_MEMO = r"(return|rtn|refund)[^a-z]+(of[^a-z]+)?(over-?contrib|contrib)"
# Fixed value: what follows a candidate's name in a committee's name.
OFFICE_SUFFIX = r"(?i)\bFOR\s+(?:SENATE|ASSEMBLY|SUPERIOR|COURT|STATE)\s+[0-9]{4}\b"


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def joined_name(last: Column, first: Column) -> Column:
    """"last first" without outer spaces, null when nothing is there."""
    return blank_to_null(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.coalesce(first, F.lit(""))))


def canonical_name(c: Column) -> Column:
    """Letters only, upper case, words in order of the alphabet; '' for null."""
    words = F.split(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z ]", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def trigrams(c: Column) -> Column:
    """The set of letter triples of a text's words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets as a float; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)).cast("float")


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def _literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def starts_word(c: Column, text: str) -> Column:
    """Whether text begins at the start of some word, whatever the case; its signs have no special meaning."""
    return c.rlike("(?iU)\\b(?=\\w)" + _literal(text)) if text and text[0].isalnum() else c.rlike("(?iU)" + _literal(text))


def has_all_words(c: Column, text: str) -> Column:
    """Whether every word of text is a whole word of c, in any order and case."""
    found = F.lit(True)
    for w in name_tokens(text):
        found = found & c.rlike("(?iU)\\b" + _literal(w) + "\\b")
    return found


def name_tokens(text: str) -> list[str]:
    """Upper-case words of a search text; an apostrophe between letters belongs to its word, other signs part words."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() or ch == "'" else " " for ch in text.upper())
    return [w for w in (part.strip("'") for part in kept.split()) if w]


def name_parts(text: str) -> tuple[str, str]:
    """(last, first) of "Last, First ..." or "First ... Last", first being one word; '' where there is none."""
    last, comma, first = text.partition(",")
    words = text.split()
    if not comma:
        last, first = (words[-1], words[0]) if len(words) > 1 else (text, "")
    return last.strip(), (first.split() or [""])[0]


def person_predicate(last: Column, first: Column, text: str) -> Column:
    """Whether two name fields hold a person, in whichever way they were filled.

    Surname and given name stand at word starts in the two fields, either way round, or
    both in one text made of the fields: surname then given name, or given name, any
    further names, surname. A surname alone is looked for in both fields. Words are met
    at their starts, so that "Varn" is not found in "Ovarns". Never null.
    """
    surname, given = name_parts(text)
    yes = lambda c: F.coalesce(c, F.lit(False))
    if not (surname and given):
        one = surname or given
        return yes(starts_word(last, one)) | yes(starts_word(first, one))
    s, g = _literal(surname), _literal(given)
    both = F.trim(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.coalesce(first, F.lit(""))))
    found = yes(starts_word(last, surname) & starts_word(first, given)) | yes(starts_word(last, given) & starts_word(first, surname))
    return found | both.rlike(rf"(?iU)\b{s}\b[\s,.]+{g}") | both.rlike(rf"(?iU)\b{g}\b[\s,.]+(?:[^\s,.]+[\s,.]+)*{s}\b")


def candidate_tokens(c: Column) -> Column:
    """The distinct words of a candidate's name without "for <office> <year>" behind it."""
    core = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), OFFICE_SUFFIX, " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(core), "[^A-Z0-9]+", " "), " "), lambda w: w != "")))


def display_name(last: Column, *rest: Column) -> Column:
    """"Last, First Middle Suffix" from the parts that are not blank; '' when none is."""
    tail = F.concat_ws(" ", *[blank_to_null(c) for c in rest])
    return F.concat_ws(", ", blank_to_null(last), F.when(tail != "", tail))


def is_refund_memo(c: Column) -> Column:
    """Memo texts that call a payment the return of a contribution."""
    return F.lower(F.trim(c)).rlike(REFUND_MEMO)


def is_returned_contribution(c: Column) -> Column:
    return F.lower(c).rlike("contrib") & F.lower(c).rlike("refund|return")
