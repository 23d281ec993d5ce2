"""Mixing sources to target weights.

The words of each source form one stream, cut into blocks of fixed length. Output shards draw how many of their
slots go to each source from a multinomial, on the condition that all shards together meet the sources' quotas: what
a range of shards has is split between its halves, down to single shards, so that any task can draw any shard by itself.
The slots of a source are numbered through all shards, and a pseudorandom permutation of the source's block
numbers, another for each pass over the source, says which block a slot holds. Blocks are joined to the documents
they came from by (source, block).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .textbytes import arrow_batches, mix, tidy

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Shards that a mix is drawn in at least, where it has so many slots.
LEAST_SHARDS = 8
#: Slots that one task draws, give or take a shard.
TASK_SLOTS = 1 << 18
#: The library draws hypergeometric numbers of fewer things than this.
_MOST_DRAWN = 10**9


def water_fill(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above `most` times its size; what is above is shared again by weight."""
    target = [0.0] * len(sizes)
    left, free = float(sum(sizes)), list(range(len(sizes)))
    while free:
        level = left / sum(weights[i] for i in free)
        full = [i for i in free if level * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at the given indices: a Feistel network, walked until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    x = index.astype(U64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> U64(half), x[todo] & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mix(right + U64((seed * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        x[todo] = (left << U64(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def split_draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among n of all, drawn without putting back."""
    total = int(counts.sum())
    if total < _MOST_DRAWN:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    # So many that each kind's number is as good as independent of the others; what is then over or short is moved.
    drawn = rng.binomial(counts, n / total)
    short = n - int(drawn.sum())
    room = counts - drawn if short > 0 else drawn
    moved = np.minimum(room, abs(short) * (room / room.sum())).astype(np.int64)
    for i in np.argsort(-room, kind="stable"):
        moved[i] += min(room[i] - moved[i], abs(short) - moved.sum())
    return drawn + (moved if short > 0 else -moved)


def shard_draw(shard: int, shards: int, shard_slots: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each source its first slot number in a shard and how many slots it has there. The last shard may be smaller."""
    have, first = quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = split_draw(have, (middle - low) * shard_slots, np.random.default_rng([seed, low, high]))
        if shard < middle:
            have, high = left, middle
        else:
            have, first, low = have - left, first + left, middle
    return first, have


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text).alias("_th"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
    )


def plan(sources: list[tuple[str, int]], block_words: int, weights=(1.0, 2.0, 3.0), most: float = 3.0) -> list[tuple[str, int, float, int, int]]:
    """(source, size, target, blocks, slots) of each source, in code point order with null last."""
    sources = sorted(sources, key=lambda s: (s[0] == "n", s[0]))
    target = water_fill([size for _, size in sources], [weights[i % len(weights)] for i in range(len(sources))], most)
    out = []
    for (name, size), aim in zip(sources, target):
        blocks = -(-size // block_words)
        slots = min(int(most * blocks), round(aim / size * blocks)) if size else 0
        out.append((name, size, aim, blocks, slots))
    return out


def placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, block_words: int, seed: int, shard_slots: int, rows_per_bucket: int | None, weights=(1.0, 2.0, 3.0), most: float = 3.0):
    """Sized rows with their offsets in the source's stream, the plan, and the slots: (_source, _block, _pass, _shard)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = cut(sized(docs, id_col, source_col, text_col))
    per_source = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    sources = plan([(r["_source"], r["size"]) for r in per_source], block_words, weights, most)
    # Running offsets in two levels: buckets within a source, rows within a bucket. A hot source has many buckets.
    # By default both levels grow alike with the table.
    n_rows = sum(r["n"] for r in per_source)
    buckets = max(1, -(-n_rows // (rows_per_bucket or max(1000, math.isqrt(n_rows)))))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_th"), F.lit(buckets)))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_id", "_th", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_source", "_bucket"])
    rows = rows.withColumn("_off", F.col("_start") + F.col("_in")).drop("_start", "_in", "_bucket")

    live = [s for s in sources if s[4]]
    quotas = np.array([s[4] for s in live], np.int64)
    total = int(quotas.sum())
    # A small mix has smaller shards, so that it is drawn in several at every size.
    shard_slots = max(1, min(shard_slots, total // LEAST_SHARDS))
    shards = -(-total // shard_slots)

    @tidy
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                for source, (first, n) in enumerate(zip(*(x.tolist() for x in shard_draw(shard, shards, shard_slots, quotas, seed)))):
                    name, _, _, blocks, _ = live[source]
                    slot = np.arange(first, first + n)
                    turn = slot // blocks
                    block = np.empty(n, np.int64)
                    for t in np.unique(turn):
                        block[turn == t] = permuted(slot[turn == t] % blocks, blocks, (seed * 1_000_003 + source) * 64 + int(t))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(block), pa.array(turn), pa.array(np.full(n, shard))], names=["_source", "_block", "_pass", "_shard"])

    slot_rows = spark.range(0, shards, 1, max(1, min(shards, -(-total // TASK_SLOTS)))).mapInArrow(slots, "_source string, _block long, _pass long, _shard long")
    return rows, sources, slot_rows


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document has words in, with the range of its own words there."""
    b = block_words
    return rows.where("_size > 0").selectExpr("*", f"explode(sequence(_off div {b}, (_off + _size - 1) div {b})) as _block").selectExpr(
        "*", f"greatest(_block * {b} - _off, 0L) as _from", f"least((_block + 1) * {b} - _off, _size) as _to"
    )


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = 64, seed: int = 11, shard_slots: int = 1 << 16, rows_per_bucket: int | None = None) -> DataFrame:
    """For each row of `docs`: id, size, source_size, target, taken.

    Sizes count words; a null text has none. Sources sort by code point with null, which is a source too, last; they
    weigh 1, 2, 3, repeating. The mix holds as many words as all documents do. No target is above 3 times its
    source's size. Every pass over a source holds each block at most once, and there are at most 3 passes, so no
    document is taken more than 3 times. taken is near the target to within two blocks a source. Reruns agree, as
    all draws are seeded. Rows without words take part with taken 0; rows that repeat an id are rows of their own;
    an empty table gives an empty result; other columns are ignored.
    The table of sources, a row for each, is held on the driver; rows, blocks and slots are not.
    """
    rows, sources, slots = placed(docs, id_col, source_col, text_col, block_words, seed, shard_slots, rows_per_bucket)
    uses = slots.groupBy("_source", "_block").agg(F.count("*").alias("_uses"))
    taken = (
        _pieces(rows, block_words)
        .join(uses.hint("merge"), ["_source", "_block"], "left")  # Spark takes the size of uses for that of the draws
        .groupBy("_source", "_off", "_id", "_size")
        .agg(F.sum((F.col("_to") - F.col("_from")) * F.coalesce("_uses", F.lit(0))).alias("taken"))
    )
    every = taken.unionByName(rows.where("_size = 0").selectExpr("_source", "_off", "_id", "_size", "0L as taken"))
    return _with_targets(every, sources, id_col)


def _with_targets(every: DataFrame, sources: list, id_col: str) -> DataFrame:
    table = every.sparkSession.createDataFrame([(s[0], s[1], s[2]) for s in sources], "_source string, source_size long, target double")
    return every.join(table, "_source").selectExpr(f"_id as `{id_col}`", "_size as size", "source_size", "target", "taken")


def mix_texts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = 64, seed: int = 11, shard_slots: int = 1 << 16, rows_per_bucket: int | None = None, length_col: str | None = "n_chars") -> DataFrame:
    """The mix itself, in the columns of `docs`: a row for each document and pass that takes words of it.

    Its text holds the taken words in their order and with the characters between them; where words in between
    were not taken there is a line break. length_col, where `docs` has it, is set to the length of the new text.
    A null or empty text has no words and so no row. Rows that repeat an id and text are taken one by one, and return
    with the columns of one of them. Columns may have any name. An empty table gives an empty result. Reruns agree.
    """
    rows, _, slots = placed(docs, id_col, source_col, text_col, block_words, seed, shard_slots, rows_per_bucket)
    nth = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_off"))
    cuts = (
        _pieces(rows.withColumn("_nth", nth), block_words)
        .join(slots.hint("merge"), ["_source", "_block"])  # Spark takes the size of slots for that of the draws
        .groupBy("_id", "_th", "_nth", "_pass")
        .agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("_cuts"))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("_row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(id_col).alias("_id"))
    # Rows that repeat an id and text are one here; cuts has each of them by _nth.
    whole = whole.groupBy("_id", "_th").agg(F.first("_row").alias("_doc"))
    inside = [F.col("_doc")[c].alias(f"_k{i}") for i, c in enumerate(docs.columns)]
    joined = whole.join(cuts, whole["_id"].eqNullSafe(cuts["_id"]) & (whole["_th"] == cuts["_th"])).select(*inside, cuts["_cuts"])
    names = [f"_k{i}" for i in range(len(docs.columns))]
    schema = joined.select(*names).schema
    at = docs.columns.index(text_col)
    long_at = docs.columns.index(length_col) if length_col in docs.columns else None
    word = re.compile(WORD)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, found in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                spans = [m.span() for m in word.finditer(text)]
                merged: list[list[int]] = []
                for c in found:
                    if merged and merged[-1][1] == c["_from"]:
                        merged[-1][1] = c["_to"]
                    else:
                        merged.append([c["_from"], c["_to"]])
                texts.append("\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in merged))
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if long_at is not None:
                columns[long_at] = pa.array([len(t) for t in texts], columns[long_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
