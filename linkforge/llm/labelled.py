"""Labelled documents, all of them or bounded samples, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from: a third of all ids, by checksum. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, _label) of all ids that are not held out. A null label or id is ignored; of several labels of an id the greatest counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(_id, _label, _text) of at most `per_class` documents of each class, in hash order, and how many ids each class has.

    Only labels of ids that are not held out are read. A null label or id is ignored; of several labels of an id the
    greatest counts, and of several texts the least; a null text is empty. The chosen ids are bounded, so they are
    broadcast to the scan of the texts.
    """
    known = known_labels(labels, label_col, id_col)
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return own.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")), counts
