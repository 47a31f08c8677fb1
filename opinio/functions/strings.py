"""String expression helpers (all JVM-side except NFKD)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters kept by the reference's word cleaning (letters with
# German umlauts and sharp s; the digit variant adds 0-9).
WORD_CHARS = "A-Za-züäößÄÖÜ"
WORD_CHARS_DIGITS = "A-Za-z0-9üäößÄÖÜ"
# The same sets as Java regex classes for Spark: "not a word character" is
# written as the intersection \W && [^umlauts] plus '_' (and 0-9 when digits
# are dropped). It removes exactly the characters [^A-Za-z0-9...] removes
# (checked over every code point up to U+3000), but Java matches it ~10x
# faster than a negated class of ranges, which dominated text cleaning.
_UMLAUTS = "üäößÄÖÜ"


def non_word_class(digits: bool, keep_ws: bool) -> str:
    """Java regex for one run of characters outside the word set (and
    outside whitespace when ``keep_ws``)."""
    inner = "\\W&&\\S" if keep_ws else "\\W"
    extra = "_" if digits else "_0-9"
    return f"[{extra}[{inner}&&[^{_UMLAUTS}]]]+"


# Python str.strip() whitespace restricted to the ASCII set both engines share.
_WS = "[\\t\\n\\x0B\\f\\r ]"

# Umlaut digraph replacements of the corpus preprocessing.
UMLAUT_DIGRAPHS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"),
                   ("Ü", "Ue"), ("ß", "ss")]


def strip_ws(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_WS}+|{_WS}+$", "")


def blank_controls(s: Column) -> Column:
    """Newline and tab become blanks."""
    return F.translate(s, "\n\t", "  ")


def normalise_blanks(s: Column, strip: bool = True) -> Column:
    """W12 (blank part): ``\\n``/``\\t`` -> blank, then strip (the Welt
    variant does not strip)."""
    t = blank_controls(s)
    return strip_ws(t) if strip else t


@F.pandas_udf(T.StringType())
def _nfkd_rows(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def nfkd(s: Column | str) -> Column:
    """W12 (unicode part): NFKD normalisation; no Spark builtin exists, so an
    Arrow-batched pandas UDF (vectorised ``str.normalize``). ASCII texts are normal
    already and don't go to Python."""
    s = F.col(s) if isinstance(s, str) else s
    return F.coalesce(_nfkd_rows(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)


def clean_word(token: Column, digits: bool = False) -> Column:
    """Remove every character outside the word set, then lower-case."""
    return F.lower(F.regexp_replace(token, non_word_class(digits, keep_ws=False), ""))


def clean_text(text: Column, digits: bool = False) -> Column:
    """Whole-text form of ``clean_word``: characters outside the word set are
    removed except whitespace, then lower-cased, in one pass per text.
    Splitting the result on whitespace yields the cleaned tokens at the same
    boundaries; tokens made only of removed characters disappear instead of
    becoming empty strings."""
    return F.lower(F.regexp_replace(text, non_word_class(digits, keep_ws=True), ""))


def clean_tokens(text: Column, digits: bool = False) -> Column:
    """Non-empty cleaned tokens of a text (see ``clean_text``)."""
    return F.filter(F.split(clean_text(text, digits), r"\s+"), lambda t: t != "")


def umlaut_digraphs(s: Column) -> Column:
    out = s
    for a, b in UMLAUT_DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def remove_nul(s: Column) -> Column:
    """Drop NUL characters from comment bodies."""
    return F.replace(s, F.lit("\u0000"), F.lit(""))
