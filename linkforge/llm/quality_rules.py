"""Quality rules on compression: zstandard ratios of whole documents and of fixed chunks, held to bands by length.

Chunks cover a text that is longer than one: where bytes remain, a last chunk ends at the text's end.

Repetitive text compresses far better than prose of its length, noise far worse, and so do tables and text strewn with
symbols, by a little. A longer text always compresses better, so each class of lengths has a band of its own. The
bands come from the corpus: quartiles of the ratios of its distinct texts, widened by a multiple of their distance, so that
no fixed share of the documents is lost. A class in which some text or its near copies prevail would have too
narrow a band; so none is narrower than the line between its neighbours. Classes of few texts fall back on fixed, wide bands.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .textbytes import arrow_batches, pieces, tidy

#: (bytes up to, least ratio, greatest ratio): the band of a text by its length, where the corpus has too few to tell.
BANDS = ((200, 0.0, 3.0), (1000, 1.02, 3.2), (5000, 1.3, 3.6), (20000, 1.5, 4.0), (float("inf"), 1.6, 5.0))
LEVEL = 3
CHUNK_BYTES = 2048
#: A text goes when more than this share of its chunks lies outside their band.
MAX_ODD_CHUNKS = 0.2
#: Classes of lengths for each doubling, and how many there are.
PER_OCTAVE, CLASSES = 4, 160
#: Quartile distances that a band reaches below and above the quartiles, and the factor that it reaches at least. Ratios of sound
#: texts trail off slowly below, and noise lies far below them; tables and symbols lie close above.
SPREAD, LEAST = (6.0, 2.5), 1.05
#: Distinct texts that a class needs for a band of its own.
ENOUGH = 30
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, chunks array<double>"


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if n_bytes <= most)


def repeat_words(found: list[str]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(found) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    # Number pairs densely, then pairs with a third word: exact for any vocabulary, without overflow.
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, triple, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[triple] > 1
    covered = np.zeros(len(found), bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def compress(text: str, press: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, float, list[float]]:
    """(bytes, ratio, ratios of the chunks) of a text; 1 for an empty one, and no chunks for one that fits into one."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0, 1.0, []
    chunks = [data[i : i + chunk_bytes] for i in range(0, len(data) - chunk_bytes + 1, chunk_bytes)] if len(data) > chunk_bytes else []
    if chunks and len(data) % chunk_bytes:
        chunks.append(data[-chunk_bytes:])
    return len(data), len(data) / len(press.compress(data)), [chunk_bytes / len(press.compress(c)) for c in chunks]


@dataclass(frozen=True)
class Limits:
    """Least and greatest ratio of each class of lengths, and of chunks."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    chunk: tuple[float, float]

    @classmethod
    def fixed(cls, chunk_bytes: int = CHUNK_BYTES, bands=BANDS) -> Limits:
        low, high = zip(*(band(2 ** (c / PER_OCTAVE), bands) for c in range(CLASSES)))
        return cls(low, high, band(chunk_bytes, bands))


def length_class(n_bytes: Column) -> Column:
    return F.least(F.floor(PER_OCTAVE * F.log2(F.greatest(n_bytes, F.lit(1)).cast("double"))), F.lit(CLASSES - 1)).cast("int")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """(_id, _th, MEASURES) of every whole text, in one pass without a shuffle."""
    arrow_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_th"), F.col(f"`{text_col}`").alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.float64())]
        for batch in batches:
            for piece in pieces(batch, "_text"):
                rows = []
                for text in piece.column("_text"):
                    text = text.as_py() or ""
                    found = WORD.findall(text)
                    rows.append((len(found), sum(map(len, found)), len(SYMBOL.findall(text)), dup_lines(text), repeat_words(found), *compress(text, press, chunk_bytes)))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_th"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["_id", "_th", *(x.split()[0] for x in MEASURES.split(", "))])

    return own.mapInArrow(run, f"_id {kind}, _th long, {MEASURES}")


def fit_limits(measured: DataFrame, chunk_bytes: int = CHUNK_BYTES, spread: tuple[float, float] = SPREAD, least: float = LEAST, enough: int = ENOUGH) -> Limits:
    """Bands from the measures of a corpus. Texts that repeat count once; those of under 50 words or of mostly repeated ones do not.

    Ratios are counted by class in steps of 0.001, so the driver gets a row for each of at most CLASSES classes, and reruns agree.
    """
    sound = measured.where((F.col("n_words") >= 50) & (2 * F.col("n_repeat_words") <= F.col("n_words")))
    texts = sound.groupBy("_th", "n_bytes").agg(F.first("ratio").alias("ratio"), F.first("chunks").alias("chunks"))
    of = lambda number, ratio: F.struct(number.alias("c"), F.least(F.round(ratio, 3), F.lit(100.0)).alias("r"))
    ratios = texts.select(F.explode(F.concat(F.array(of(length_class(F.col("n_bytes")), F.col("ratio"))), F.transform("chunks", lambda r: of(F.lit(-1), r)))).alias("_x"))
    counted = ratios.groupBy("_x.c", "_x.r").agg(F.count("*").alias("n"))
    found = {r["c"]: (r["q"], r["n"]) for r in counted.groupBy("c").agg(F.expr("percentile(r, array(0.25, 0.75), n)").alias("q"), F.sum("n").alias("n")).collect()}
    bands = {}
    for c, ((q1, q3), n) in found.items():
        if n >= enough:
            bands[c] = min(q1 - spread[0] * (q3 - q1), q1 / least), max(q3 + spread[1] * (q3 - q1), q3 * least)
    fixed = Limits.fixed(chunk_bytes)
    low, high = list(fixed.low), list(fixed.high)
    for c in range(CLASSES):
        if c in bands:
            low[c], high[c] = bands[c]
            if c - 1 in bands and c + 1 in bands:
                low[c] = min(low[c], (bands[c - 1][0] + bands[c + 1][0]) / 2)
                high[c] = max(high[c], (bands[c - 1][1] + bands[c + 1][1]) / 2)
    return Limits(tuple(low), tuple(high), bands.get(-1, fixed.chunk))


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, chunk_bytes: int = CHUNK_BYTES, max_odd: float = MAX_ODD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """Word counts, repetition counts, compression ratios and a verdict for each row of `docs`.

    verdict is ok, repetitive, incompressible, odd chunks or empty. A null text is an empty text: no words, ratio
    1, verdict empty. Rows that repeat an id or a text are judged one by one and alike; null ids and other columns change
    nothing; an empty table gives an empty result. A ratio at a limit is inside. Texts of any length are compressed
    whole, and every byte of a text longer than a chunk lies in a judged chunk; the last one may overlap the one before.
    limits: those of another corpus; by default they are fitted to the measures of `docs`, which are written once.
    """
    rows = measure(docs, id_col, text_col, chunk_bytes, level)
    if limits is None:
        rows = cut(rows)
        limits = fit_limits(rows, chunk_bytes)
    c = length_class(F.col("n_bytes"))
    at = lambda values: F.get(F.array(*map(F.lit, values)), c)
    odd = F.size(F.filter("chunks", lambda r: (r < limits.chunk[0]) | (r > limits.chunk[1])))
    verdict = (
        F.when(F.col("n_bytes") == 0, "empty").when(F.col("ratio") > at(limits.high), "repetitive").when(F.col("ratio") < at(limits.low), "incompressible")
        .when(odd > max_odd * F.size("chunks"), "odd chunks").otherwise("ok")
    )
    names = [x.split()[0] for x in MEASURES.split(", ")][:-1]
    return rows.select(F.col("_id").alias(id_col), *names, F.size("chunks").cast("long").alias("n_chunks"), odd.cast("long").alias("n_odd_chunks"), verdict.alias("verdict"))
