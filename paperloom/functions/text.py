"""Text functions as Column expressions; what Spark lacks (NFKC, case folding) as Pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as Python's str.isspace() has it, ligatures and what they expand to,
# stop words of related-work terms, titles that are placeholders.
SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was were with all you need".split()
TITLE_PLACEHOLDERS = ["untitled", "untitled document", "unknown", "unknown title", "error"]
BIDI_CONTROLS = r"[\x{202a}-\x{202e}\x{2066}-\x{2069}]"


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.btrim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def expand_ligatures(text: Column) -> Column:
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def solid_chars(text: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.char_length(F.regexp_replace(text, SPACE_CLASS, ""))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def distinct_terms(text: Column, at_most: int, exclude: Column | None = None) -> Column:
    """First occurrences of terms of up to 80 characters that aren't stop words, nor in `exclude`."""
    keep = F.array_distinct(F.filter(terms(text), lambda t: (F.char_length(t) <= 80) & ~t.isin(STOP_WORDS)))
    return F.slice(F.array_except(keep, exclude) if exclude is not None else keep, 1, at_most)


def safe_title(text: Column, limit: int = 500) -> Column:
    """Control and other C characters read as spaces; collapsed, cut, null if nothing is left."""
    return F.nullif(F.left(collapse(F.regexp_replace(text, r"\p{C}", " ")), F.lit(limit)), F.lit(""))


def has_unsafe_unicode(text: Column) -> Column:
    """Control characters (but line ends and tabs) or directional overrides."""
    return text.rlike(r"[\p{Cc}\p{Cs}&&[^\r\n\t]]") | text.rlike(BIDI_CONTROLS)


def usable_title(title: Column) -> Column:
    return F.coalesce(F.char_length(title).between(1, 1000) & ~F.lower(title).isin(TITLE_PLACEHOLDERS) & title.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def cut_at_space(text: Column, limit: int) -> Column:
    """At most `limit` characters; a longer text goes back to its last space (nothing if it has none)."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.regexp_extract(F.left(text, F.lit(limit)), r"(?s)^(.*) [^ ]*$", 1))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def filename_title(name: pd.Series) -> pd.Series:
    """A file name for display: no folders, no .pdf, separators as spaces, NFKC, printable, at most 200 characters."""

    def clean(n: str) -> str | None:
        n = n.rstrip("/").rsplit("/", 1)[-1]
        n = n[:-4] if n.lower().endswith(".pdf") else n
        n = unicodedata.normalize("NFKC", n.replace("_", " ").replace("-", " "))
        return " ".join("".join(c for c in n if c.isprintable()).split())[:200] or None

    return name.map(clean, na_action="ignore")
