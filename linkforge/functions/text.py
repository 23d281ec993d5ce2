"""Cleaning of product names, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import STOP_WORDS


def clean(text: Column, remove_stop_words: bool = True, case_sensitive: bool = False, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower case, without punctuation and stop words, blanks made single. A null is an empty name.

    Punctuation is everything but letters, digits, underscores and blanks of any script, and leaves no gap.
    """
    out = F.coalesce(text.cast("string"), F.lit(""))
    if not case_sensitive:
        out = F.lower(out)
    out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", "")
    if remove_stop_words:
        tokens = F.filter(F.split(out, r"(?U)\s+"), lambda w: ~w.isin(*stop_words))
        out = F.array_join(tokens, " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def combine(parts: Sequence[Column]) -> Column:
    """Cleaned parts joined by single blanks; empty without parts."""
    if len(parts) == 1:
        return parts[0]  # clean already
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"(?U)\s+", " ")) if parts else F.lit("")


def terms(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased word runs of two characters or more, repeats included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def tokens(text: Column) -> Column:
    """Distinct blank-separated tokens, none of them empty."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
