"""Blending of the single scores into a confidence from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blend(tfidf: Column, fuzzy: Column, gtin: Column, size: Column, w_tfidf: float, w_fuzzy: float, w_gtin: float, w_size: float) -> Column:
    """Text scores by their shares of the text weight; half barcode where a barcode score is above 0; then size; at most 100.

    Without text weight the barcode score stands alone. A missing size counts as 0 and so lowers the result.
    """
    text_weight = w_tfidf + w_fuzzy
    a, b = (w_tfidf / text_weight, w_fuzzy / text_weight) if text_weight else (0.5, 0.5)
    text = tfidf * F.lit(a) + fuzzy * F.lit(b)
    if w_gtin > 0 and not text_weight:
        base = gtin
    elif not w_gtin and text_weight:
        base = text
    else:
        base = F.when(gtin > 0, text * 0.5 + gtin * 0.5).otherwise(text)
    if w_size > 0:
        base = base * F.lit(1.0 - w_size) + size * F.lit(w_size)
    return F.least(base, F.lit(100.0))


def additive(tfidf: Column, fuzzy: Column, size: Column, w_tfidf: float, w_fuzzy: float, w_size: float) -> Column:
    """The plain weighted mean of three scores, weights scaled to sum 1."""
    total = (w_tfidf + w_fuzzy + w_size) or 1.0
    return tfidf * F.lit(w_tfidf / total) + fuzzy * F.lit(w_fuzzy / total) + size * F.lit(w_size / total)


def text_bound(w_tfidf: float, w_fuzzy: float, w_gtin: float, w_size: float) -> float:
    """What a pair without a shared token and without a shared barcode stays below, whatever its size."""
    text_weight = w_tfidf + w_fuzzy
    best = 100.0 * (w_fuzzy / text_weight if text_weight else 0.5)
    return min(100.0, best * (1 - w_size) + 100.0 * w_size)


def _shares(w_tfidf: float, w_fuzzy: float) -> tuple[float, float]:
    total = w_tfidf + w_fuzzy
    return (w_tfidf / total, w_fuzzy / total) if total else (0.5, 0.5)


def _least_text(threshold: float, w_size: float) -> float:
    """The text score that a pair without a shared barcode needs at a perfect size."""
    return (threshold - 100.0 * w_size) / (1.0 - w_size) if w_size < 1 else 0.0


def least_cosine(threshold: float, w_tfidf: float, w_fuzzy: float, w_size: float) -> float:
    """The tfidf score that such a pair needs at a perfect fuzzy ratio and size; 0 or less if none."""
    a, b = _shares(w_tfidf, w_fuzzy)
    return (_least_text(threshold, w_size) - 100.0 * b) / a if a else 0.0


def least_fuzzy(threshold: float, w_tfidf: float, w_fuzzy: float, w_size: float) -> float:
    """The fuzzy ratio that such a pair needs without a shared term, at a perfect size; 0 or less if none."""
    b = _shares(w_tfidf, w_fuzzy)[1]
    return _least_text(threshold, w_size) / b if b else 0.0


def least_size(threshold: float, w_tfidf: float, w_fuzzy: float, w_size: float) -> float:
    """The size score that such a pair needs without a shared term, at a perfect fuzzy ratio; 0 or less if none."""
    b = _shares(w_tfidf, w_fuzzy)[1]
    return (threshold - 100.0 * b * (1.0 - w_size)) / w_size if w_size else 0.0
