"""Line deduplication: a suffix array over line IDs by distributed prefix doubling, in DataFrame operations only.

A document is the sequence of its non-blank lines. Lines that stand anywhere else have a place, a number in one sequence of
all documents in order, and a suffix is what begins at a place and ends with its document. Suffixes that begin with the
same h lines are one class, an interval of the suffix array whose common prefixes have h lines at least; the
rank of a class is its first place. Ranks for h lines at two places, h apart, name the 2h lines from the first on, so each
round looks up the rank h lines ahead, gives every pair of ranks a rank of its own and keeps the classes that have
more than one place. Rounds end when none has.

A suffix that is not the first of its class begins a copy. The longest such interval tells where the copy comes
from; copies that lie inside others are left out, and copies of neighbouring places from neighbouring places make up
a maximal run. Later runs are deleted. A line of enough words is a passage by itself and needs no neighbour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, discard, written
from .bitmaps import bit_filter, fitting, marked
from .exact_dedup import BLANKS

WORD = r"[^\x20\x09-\x0D]+"
#: A line of so many words is a passage: a later copy of it goes even alone.
MIN_WORDS = 50
COUNTS = ("n_lines", "n_removed_lines", "n_runs", "longest_run")


#: Matches once in every line that is not blank, from its first character that is no blank on.
FILLED = r"[^\x20\x09-\x0D][^\n]*"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _long(x: Column, min_words: int | None) -> Column:
    """Whether x has min_words words. Most lines are too short for that, and need no count."""
    if min_words is None:
        return F.lit(False)
    return F.when(F.length(x) >= 2 * min_words - 1, F.regexp_count(x, F.lit(WORD)) >= min_words).otherwise(F.lit(False))


def repeated_suffixes(docs: DataFrame, id_col: str, text_col: str, min_words: int | None) -> tuple[DataFrame, DataFrame]:
    """(_doc, _pos, _long, _rank) of the lines that repeat, and (_doc, _id, _th) of their documents.

    Documents sort by id, null last, then by hash of the text. _pos counts on from _doc, its document's first place, and
    between two documents a number is left out, so that places of two of them never follow one another.
    """
    text = F.col(f"`{text_col}`")
    lines = F.posexplode(F.filter(_lines(text), lambda x: _trimmed(x) != ""))
    lines = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"), lines.alias("_j", "_x")).withColumn("_x", _trimmed(F.col("_x")))
    # A row for each line, with a hash of 16 bytes for its name. Read twice, so written once.
    lines = written(lines.select("_id", "_th", "_j", _long(F.col("_x"), min_words).alias("_long"), F.unhex(F.md5("_x")).alias("_rank")), "lines")
    # Written, so that both sides of the join are exchanged as they are and a hot line's rows can be split.
    again = cut(lines.groupBy("_rank").agg(F.count("*").alias("_n")).where("_n > 1").select("_rank"))
    found = cut(lines.join(again, "_rank"))
    discard(lines)
    sizes = found.groupBy("_id", "_th").agg((F.max("_j") + 2).cast("long").alias("_size"))
    order = [F.col("_id").asc_nulls_last(), F.col("_th")]
    # Sorted parts of the table and their sums give running sums without a single task for all.
    parts = cut(sizes.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.sum("_size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(until(Window.orderBy("_part"))), F.lit(0)))
    inside = F.coalesce(F.sum("_size").over(until(Window.partitionBy("_part").orderBy(*order))), F.lit(0))
    numbered = cut(parts.withColumn("_in", inside).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_in")).alias("_doc"), "_id", "_th"))
    same = found["_id"].eqNullSafe(numbered["_id"]) & (found["_th"] == numbered["_th"])
    return cut(found.join(numbered, same).select("_doc", (F.col("_doc") + F.col("_j")).alias("_pos"), "_long", "_rank")), numbered


def _ranked(suffixes: DataFrame, *names: str) -> DataFrame:
    """The suffixes whose names another place has too, with the first such place as _rank."""
    classes = suffixes.groupBy(*names).agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last")).where("_first <> _last")
    return suffixes.join(cut(classes.select(*names, "_first")), list(names)).select("_doc", "_pos", F.col("_first").alias("_rank"))


def suffix_classes(suffixes: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """(h, suffixes that share their first h lines with another, with their ranks) for h up to min_lines, then doubling.

    Each level is written, and holds fewer suffixes than the one before.
    """
    length, level = 1, suffixes if min_lines > 1 else cut(_ranked(suffixes, "_rank"))
    out = [(length, level)]
    while not level.isEmpty():
        apart = min_lines - length if length < min_lines < 2 * length else length
        ahead = Window.partitionBy("_doc").orderBy("_pos").rangeBetween(apart, apart)
        pairs = cut(level.withColumn("_next", F.first("_rank").over(ahead)).where("_next is not null"))
        length, level = length + apart, cut(_ranked(pairs, "_rank", "_next"))
        out.append((length, level))
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(_id, _th, _runs) of documents with lines to delete: an array of (start, stop), the non-blank lines counted from 0."""
    suffixes, numbered = repeated_suffixes(docs, id_col, text_col, min_words)
    levels = [(length, level) for length, level in suffix_classes(suffixes, min_lines) if length >= min_lines]
    if min_lines > 1:
        levels.append((1, _ranked(suffixes.where("_long"), "_rank")))
    copies = reduce(DataFrame.unionByName, [level.where("_rank <> _pos").withColumn("_end", F.col("_pos") + length) for length, level in levels])
    order = Window.partitionBy("_doc").orderBy("_pos", F.desc("_end"))
    # A copy is inside another where an earlier one reaches as far.
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("_reach", reach).where("_reach is null or _end > _reach")
    shift = F.col("_rank") - F.col("_pos")
    goes_on = (F.lag(shift).over(order) == shift) & (F.lag("_end").over(order) >= F.col("_pos"))
    copies = copies.withColumn("_new", F.when(goes_on, 0).otherwise(1))
    copies = copies.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = copies.groupBy("_doc", "_run").agg(F.min("_pos").alias("start"), F.max("_end").alias("stop"))
    number = lambda c: (F.col(c) - F.col("_doc")).cast("int").alias(c)
    runs = runs.groupBy("_doc").agg(F.sort_array(F.collect_list(F.struct(number("start"), number("stop")))).alias("_runs"))
    return runs.join(numbered, "_doc").select("_id", "_th", "_runs")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int | None = MIN_WORDS, counts: bool = True, length_col: str | None = None, keep_emptied: bool = True) -> DataFrame:
    """The rows of `docs` with all their columns, with new text and, if asked for, with COUNTS.

    Lines end at line feeds and are equal when they are after BLANKS are stripped from both ends. Blank lines belong
    to no run and always stay. Of equal runs of at least min_lines lines the first stays, by id (null last), hash
    of the text and line; every line of a later copy goes, also within one document. So does a later copy of a
    single line of at least min_words words; None leaves single lines alone. A document that is nothing but later copies
    becomes empty or, without keep_emptied, goes; one that had no words before stays in any case. Rows with the same id and text are the same document and are treated alike. A null text stays null with 0 lines. An
    empty table gives an empty result. n_runs counts maximal runs that went, and longest_run the lines of the longest one.
    Columns of `docs` may have any name; counts take the place of columns of their names. length_col, where `docs` has it,
    is set to the length of the texts that change.
    """
    gone = cut(repeated_runs(docs, id_col, text_col, min_lines, min_words).withColumn("_rk", F.xxhash64("_id", "_th")))
    bits = fitting(gone.count())
    # The whole row travels as one column, so that its columns' names cannot clash with those used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("_doc"), F.col(f"`{id_col}`").alias("_own_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_own_th"))
    # Only documents that may have runs move: a bitmap of bounded size keeps most of the others out of the join.
    whole = marked(whole.withColumn("_own_rk", F.xxhash64("_own_id", "_own_th")), "_own_rk", bit_filter(gone, "_rk", bits), bits)
    same = (F.col("_own_rk") == gone["_rk"]) & F.col("_own_id").eqNullSafe(gone["_id"]) & (F.col("_own_th") == gone["_th"])
    moved = whole.where("_may").join(gone, same, "left").select("_doc", "_runs")
    doc, runs = F.col("_doc"), F.col("_runs")
    lines = _lines(doc[text_col])
    at = F.filter(F.transform(lines, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["stop"] - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(covered, lambda j: F.get(at, j)))
    rebuilt = F.when(runs.isNull(), doc[text_col]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    moved = moved.withColumn("_text", rebuilt)
    if not keep_emptied:
        moved = moved.where(runs.isNull() | (F.size(covered) < F.size(at)))
    out = moved.unionByName(whole.where("not _may").select("_doc", F.lit(None).cast(gone.schema["_runs"].dataType).alias("_runs"), doc[text_col].alias("_text")))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("_text").alias(c))
        elif c == length_col:
            columns.append(F.when(runs.isNull(), doc[c]).otherwise(F.length("_text").cast(docs.schema[c].dataType)).alias(c))
        elif not counts or c not in COUNTS:
            columns.append(doc[c].alias(c))
    if counts:
        length = F.transform(runs, lambda r: r["stop"] - r["start"])
        filled = F.coalesce(F.regexp_count(doc[text_col], F.lit(FILLED)), F.lit(0))
        removed = F.when(runs.isNull(), F.lit(0)).otherwise(F.size(covered))
        made = (filled, removed, F.when(runs.isNull(), F.lit(0)).otherwise(F.size(runs)), F.coalesce(F.array_max(length), F.lit(0)))
        columns += [x.cast("long").alias(name) for x, name in zip(made, COUNTS)]
    return out.select(*columns)
