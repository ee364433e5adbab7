"""Key forms, blank values and the integer form of alphanumeric keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words a placeholder table may hold before it is refused as a literal list.
MAX_PLACEHOLDERS = 10_000


def key_form(c: Column) -> Column:
    """Upper-case A-Z and 0-9 of an id; null where nothing or no digit is left."""
    k = F.regexp_replace(F.upper(c.cast("string")), "[^A-Z0-9]", "")
    return F.when(k.rlike("[0-9]"), k)


def run_domain(key: Column) -> Column:
    """What stands before the trailing digits of a key, and how many digits there are.

    With run_number it is an exact, reversible form of the key: two keys are equal
    if and only if domain and number are.
    """
    return F.concat(F.regexp_extract(key, r"^(.*?)([0-9]{0,18})$", 1), F.lit("#"), F.length(F.regexp_extract(key, r"([0-9]{0,18})$", 1)).cast("string"))


def run_number(key: Column) -> Column:
    """The trailing digits (18 at most) of a key as a long; -1 where there are none."""
    digits = F.regexp_extract(key, r"([0-9]{0,18})$", 1)
    return F.when(digits == "", F.lit(-1).cast("long")).otherwise(digits.try_cast("long"))


def placeholder_list(words: DataFrame, column: str = "word") -> list[str]:
    """The words that stand for "no value", trimmed and upper-cased.

    The table is small and fixed; more than MAX_PLACEHOLDERS rows are an error
    rather than a silent large literal.
    """
    rows = words.select(F.upper(F.trim(F.col(column))).alias("w")).where("w is not null").distinct().limit(MAX_PLACEHOLDERS + 1).collect()
    if len(rows) > MAX_PLACEHOLDERS:
        raise ValueError(f"more than {MAX_PLACEHOLDERS} placeholder words")
    return sorted(r["w"] for r in rows)


def is_blank(c: Column, dtype: str, placeholders: list[str]) -> Column:
    """True for null and, in text, for values without letter or digit or in placeholders."""
    if dtype != "string":
        return c.isNull()
    t = F.coalesce(c, F.lit(""))
    blank = ~t.rlike(r"[\p{L}\p{N}]")
    return blank | F.upper(F.trim(t)).isin(placeholders) if placeholders else blank
