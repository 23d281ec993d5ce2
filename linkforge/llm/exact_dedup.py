"""Exact deduplication by progressive refinement, in DataFrame operations only.

Three steps narrow the candidates: the length of the normalised text, then, for rows whose length others have, length with a
hash of a prefix, then a SHA-256 of the whole text, which is computed only for rows whose (length, prefix) others have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .bitmaps import bit_filter, fitting, marked, may_be_in

#: Characters that do not count when texts are compared: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without BLANKS; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None, prefix_chars: int = 64, most_bits: int = 27) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, full_hash and, if named, a digest column.

    Texts are equal when they are identical without BLANKS. Of equal texts the one with the most code points
    before normalising stays, then the smallest id; a null id comes after all others. full_hash is null where
    length and prefix already prove a text to be unique. Null texts are empty texts, and all empty texts form
    one group. Rows that repeat both the id and the code point count of the kept row are that row again, and
    count as kept. An empty table gives an empty result; other columns of `docs` are ignored.

    digest: name of a column with the SHA-256 of every normalised text, unique ones too; it is then the full hash as well.
    most_bits: bitmaps of surviving lengths and prefixes have at most 2 ** most_bits bits, whatever the size of the
    input; that bounds their broadcast. One that fills up lets more rows through than needed, and results stay the same.
    """
    text = normalised(F.col(f"`{text_col}`"))
    narrow = cut(docs.select(F.length(text).cast("long").alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")))
    lengths = narrow.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_lk", F.xxhash64("_len"))
    bits = fitting(narrow.count(), most_bits)
    rest = may_be_in(narrow.withColumn("_lk", F.xxhash64("_len")), "_lk", bit_filter(lengths, "_lk", bits), bits)
    prefixes = rest.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_pk", F.xxhash64("_len", "_prefix"))
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_points"), text.alias("_text"))
    own = own.withColumn("_pk", F.xxhash64(F.length("_text").cast("long"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    rows = marked(own, "_pk", bit_filter(prefixes, "_pk", bits), bits)
    full = F.sha2(F.col("_text").cast("binary"), 256)
    if digest:
        # Taken in full or not at all, so that the hash is made once for both columns.
        made = [full.alias("_digest"), F.nullif(F.substring(full, F.lit(1), F.when(F.col("_may"), F.lit(64)).otherwise(F.lit(0))), F.lit("")).alias("_hash")]
    else:
        made = [F.when(F.col("_may"), full).alias("_hash")]
    rows = rows.select("_id", "_points", F.length("_text").alias("_len"), *made)
    # The best of a group: most code points, then the smallest id, nulls last. min_by a struct combines map-side.
    groups = (
        rows.where("_hash is not null")
        .groupBy("_len", "_hash")
        .agg(
            F.count("*").alias("_size"),
            F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"))).alias("_best"),
        )
        .where("_size > 1")
        .select(F.col("_hash").alias("_key"), "_size", "_best")
    )
    # Rows without a full hash get keys of their own, so that nulls do not meet in one partition.
    key = F.coalesce("_hash", F.concat(F.lit("-"), F.col("_id").cast("string")), F.lit("-"))
    out = rows.withColumn("_key", key).join(groups, "_key", "left")
    best = F.col("_best")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(best.isNull(), F.col("_id")).otherwise(best["i"]).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (best.isNull() | (F.col("_id").eqNullSafe(best["i"]) & (-F.col("_points") == best["p"]))).alias("kept"),
        F.col("_hash").alias("full_hash"),
        *([F.col("_digest").alias(digest)] if digest else []),
    )
