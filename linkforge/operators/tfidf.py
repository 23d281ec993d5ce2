"""TF-IDF vectors in long form and as arrays, and their cosine.

A vocabulary is fitted to all texts together; weights are term counts times ln((1 + n) / (1 + df)) + 1, scaled
to unit length. Texts come once each, with the number of rows that have them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from ..functions.words import ENGLISH


def weights(texts: DataFrame, text: str = "text", rows: str = "rows", stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """(text, term, weight, df) for each distinct text with a term. `rows` holds how many documents have the text, df how many the term."""
    found = texts.select(text, rows, F.explode(terms(F.col(text), stop_words)).alias("term")).groupBy(text, rows, "term").agg(F.count("*").alias("tf"))
    seen = found.groupBy("term").agg(F.sum(rows).alias("df"))
    total = texts.agg(F.sum(rows)).scalar()
    idf = seen.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "df")
    raw = found.join(idf, "term").select(text, "term", (F.col("tf") * F.col("idf")).alias("w"), "df")
    norm = raw.groupBy(text).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, text).select(text, "term", (F.col("w") / F.col("norm")).alias("weight"), "df")


def vectors(weighted: DataFrame, text: str = "text") -> DataFrame:
    """(text, vector, by_rarity): the terms of a text as arrays of (term, weight), by term, and of (df, term, weight), rare ones first."""
    return weighted.groupBy(text).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("vector"), F.array_sort(F.collect_list(F.struct("df", "term", "weight"))).alias("by_rarity"))


def prefix(by_rarity: Column, cosine: float) -> Column:
    """The rare terms of a unit vector without which no cosine of `cosine` (0 to 1) can be reached.

    What is left out has a norm below it, and so has its product with any unit vector. Two texts with such a cosine
    share one of the terms that both keep, the rarest that they share at all.
    """
    rest = lambda i: F.aggregate(F.slice(by_rarity, i + 1, F.size(by_rarity)), F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"])
    return F.transform(F.filter(by_rarity, lambda x, i: rest(i) >= F.lit(cosine * cosine)), lambda x: x["term"])


def cosine(a: Column, b: Column) -> Column:
    """100 times the dot product of two vectors; 0 where either is null."""
    other = F.map_from_entries(b)
    dot = F.aggregate(a, F.lit(0.0), lambda s, x: s + x["weight"] * F.coalesce(F.try_element_at(other, x["term"]), F.lit(0.0)))
    return F.coalesce(dot * 100.0, F.lit(0.0))
