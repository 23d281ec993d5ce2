"""Quality by Bradley-Terry ranking.

Documents marked good are preferred to documents marked bad. The chance that one is preferred to another is the
logistic function of the difference of their scores, and a score is linear in features of the whole text, so the
weights follow from logistic loss on feature differences of pairs. The quantile of the scores at the true share of
bad documents is the threshold. All labelled documents count, and all pairs of a good and a bad one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .labelled import known_labels, sample
from .textbytes import RangeHash, arrow_batches, mix, per_row, pieces, tidy, utf8, words

FEATURES = ("upper", "digits", "exclaims", "symbols", "bars", "blanks", "non_ascii", "word_length", "distinct", "same_next", "same_after_next", "repeated_pairs", "top_word", "dup_lines", "log_words", "line_words")
_KINDS = np.zeros((7, 256), bool)
for _k, _chars in enumerate((range(65, 91), range(48, 58), b"!", b"#*$%&<>", b"|", b" \t\n\x0b\x0c\r", range(128, 256))):
    _KINDS[_k, list(_chars)] = True


def _repeats(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: how many keys were there before, and the count of the most frequent one."""
    both = mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, first, count = np.unique(both, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, row[first], count)
    return per_row(np.ones(len(row)), row, n) - np.bincount(row[first], minlength=n), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: shares on a log scale, so that a small junk part of a long text shows."""
    n = len(offsets) - 1
    length = np.maximum(1, np.diff(offsets))
    sums = lambda hit: np.add.reduceat(np.append(hit, False), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0)
    out = [np.log(sums(kind[data]) / length + 1e-4) if len(data) else np.full(n, np.log(1e-4)) for kind in _KINDS]
    start, stop, row = words(data, offsets)
    count = np.maximum(1, np.bincount(row, minlength=n))
    if len(start):
        hashed = RangeHash(data, 29)
        w = hashed(start, stop)
        again, top = _repeats(w, row, n)
        share = lambda k: per_row((w[k:] == w[:-k]) & (row[k:] == row[:-k]), row[k:], n) / count
        inside = row[1:] == row[:-1]
        pairs, _ = _repeats(mix(w[1:][inside] + mix(w[:-1][inside])), row[1:][inside], n)
        line_start, line_stop, line_row = _lines(data, offsets)
        dup, _ = _repeats(hashed(line_start, line_stop), line_row, n)
        n_lines = np.maximum(1, np.bincount(line_row, minlength=n))
        out += [per_row(stop - start, row, n) / count / 10, again / count, np.log(share(1) + 1e-3), np.log(share(2) + 1e-3), np.log(pairs / count + 1e-2), np.log(top / count + 1e-2), np.log(dup / n_lines + 1e-2), np.log(count), np.log(count / n_lines)]
    else:
        out += [np.zeros(n)] * (len(FEATURES) - len(out))
    return np.stack(out, 1)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from .textbytes import runs

    return runs(data != 10, offsets)


@dataclass
class Ranking:
    """Scores are `weights` over standardised features; `threshold` divides good from bad and `slope` shapes the output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))


def train(x: np.ndarray, labels: np.ndarray, bad_share: float, pairs: int = 10_000, steps: int = 300, seed: int = 9) -> Ranking:
    """A ranking from the features of labelled texts. Without texts of both classes all scores are 0.5 or, with one class, lean to it."""
    y = np.asarray(labels, np.int64)
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        lean = 0.0 if not len(y) else (1.0 if y[0] else -1.0)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), -lean, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    for step in range(1, steps + 1):
        lose = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * lose[:, None]).mean(0) + 1e-2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    raw = z @ w
    # The quantile at the share of bad documents; the classes were sampled apart, so each row stands for its class.
    stands = np.where(y == 0, bad_share / (y == 0).sum(), (1 - bad_share) / (y == 1).sum())
    order = np.argsort(raw)
    below = np.cumsum(stands[order])
    at = min(int(np.searchsorted(below, bad_share - 1e-9)), len(raw) - 2)
    threshold = float(raw[order[at]] + raw[order[at + 1]]) / 2
    gap = abs(np.median(raw[y == 1]) - np.median(raw[y == 0])) + 1e-6
    return Ranking(mean, scale, w, threshold, 6.0 / gap)


#: Bins of scores for each class, and how many of them share second moments.
_BINS, _SHARED = 1024, 16


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _x): the features of each row, made where the texts are."""
    arrow_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(list(features(*utf8(piece.column("_text")))), pa.list_(pa.float64()))], names=["_id", "_x"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _totals(rows: DataFrame, add, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of what `add(total, label, x)` adds to an array of zeros for each batch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                add(total, batch.column("_label").to_numpy(zero_copy_only=False), _matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["_sum"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "_sum binary").collect():
        out += np.frombuffer(zlib.decompress(r["_sum"])).reshape(shape)
    return out


def _binned(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By class and bin of the score: rows and sums of their features (class, bin, 1 + k), and second moments of some bins together."""
    k, reach = len(w), 6 * np.abs(w).sum() + 1e-9

    def add(total, label, x):
        z = np.clip((x - mean) / scale, -6, 6)
        at = np.clip(((z @ w + reach) / (2 * reach) * _BINS).astype(np.int64), 0, _BINS - 1)
        sums, moments = total[: 2 * _BINS * (k + 1)].reshape(2, _BINS, k + 1), total[2 * _BINS * (k + 1) :].reshape(2, -1, k, k)
        np.add.at(sums, (label, at), np.column_stack([np.ones(len(z)), z]))
        for c, b in set(zip(label.tolist(), (at // _SHARED).tolist())):
            some = z[(label == c) & (at // _SHARED == b)]
            moments[c, b] += some.T @ some

    flat = _totals(rows, add, (2 * _BINS * (k + 1) + 2 * (_BINS // _SHARED) * k * k,))
    return flat[: 2 * _BINS * (k + 1)].reshape(2, _BINS, k + 1), flat[2 * _BINS * (k + 1) :].reshape(2, -1, k, k)


def _all_pairs(sums: np.ndarray, moments: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and about the Hessian over all pairs of a good and a bad document, from sums by bin.

    A row's score is taken as the mean score of its bin, so an error is of second order in the bin's width.
    """
    k = len(w)
    (n0, z0), (n1, z1) = ((s[:, 0], s[:, 1:]) for s in sums)
    score = [(z @ w) / np.maximum(1, n) for n, z in ((n0, z0), (n1, z1))]
    ahead = score[1][:, None] - score[0][None, :]
    every = n0.sum() * n1.sum()
    lose = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
    loss = n1 @ np.logaddexp(0, -ahead) @ n0 / every + 0.5e-2 * w @ w
    grad = -((lose @ n0) @ z1 - (n1 @ lose) @ z0) / every + 1e-2 * w
    bend = lose * (1 - lose)
    shared = lambda weight, n: (weight * n).reshape(-1, _SHARED).sum(1) / np.maximum(1, n.reshape(-1, _SHARED).sum(1))
    across = z1.T @ bend @ z0
    inside = np.tensordot(shared(bend @ n0, n1), moments[1], 1) + np.tensordot(shared(n1 @ bend, n0), moments[0], 1)
    return loss, grad, (inside - across - across.T) / every + 1e-2 * np.eye(k)


def nth(values: DataFrame, n: int, few: int = 2000) -> float:
    """The value in place n, from 0 on, of the ascending numbers in column _raw: from counts by ever smaller ranges, which end at it."""
    low, high = values.agg(F.min("_raw"), F.max("_raw")).first()
    while low < high:
        place = F.least(F.lit(4095), F.floor((F.col("_raw") - F.lit(low)) / F.lit((high - low) / 4096)).cast("int"))
        own = values.where(F.col("_raw").between(low, high))
        for r in sorted(own.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("_raw").alias("low"), F.max("_raw").alias("high")).collect()):
            if n < r["n"]:
                break
            n -= r["n"]
        low, high = r["low"], r["high"]
        if low < high and r["n"] <= few:
            return sorted(v for (v,) in values.where(F.col("_raw").between(low, high)).select("_raw").collect())[n]
    return low


def fit_measured(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", passes: int = 40) -> Ranking:
    """A ranking from the features (_id, _x) of documents, by all whose labels are known and not held out and by all their pairs.

    Of several rows of an id the one with the least features counts. Newton steps over all pairs, a pass over the features each,
    until no part of the gradient exceeds 0.00001; a step that raises the loss is halved. The driver gets sums by bin of the score.
    """
    k = len(FEATURES)
    known = known_labels(labels, label_col, id_col)
    rows = cut(rows.join(known, "_id").groupBy("_id", "_label").agg(F.min("_x").alias("_x")).select("_label", "_x"))

    def add(total, label, x):
        for c in (0, 1):
            total[c] += np.concatenate([[(label == c).sum()], x[label == c].sum(0), (x[label == c] ** 2).sum(0)])

    sums = _totals(rows, add, (2, 1 + 2 * k))
    bad, good = (int(n) for n in sums[:, 0])
    if not bad or not good:
        return train(np.zeros((1, k)) if bad or good else np.zeros((0, k)), np.array([1] if good else [0] if bad else []), 0.0)
    mean = sums[:, 1 : k + 1].sum(0) / (bad + good)
    scale = np.sqrt(np.maximum(0, sums[:, k + 1 :].sum(0) / (bad + good) - mean**2)) + 1e-6
    at = lambda w: _all_pairs(*_binned(rows, mean, scale, w), w)
    w = np.zeros(k)
    loss, grad, hess = at(w)
    step, part = np.linalg.solve(hess, grad), 1.0
    for _ in range(passes):
        if np.abs(grad).max() < 1e-5 or part < 1e-3:
            break
        new = at(w - part * step)
        if new[0] > loss + 1e-12:
            part /= 2
            continue
        w, (loss, grad, hess) = w - part * step, new
        step, part = np.linalg.solve(hess, grad), 1.0
    rank = Ranking(mean, scale, w, 0.0, 1.0)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(rank.raw(_matrix(batch)))], names=["_label", "_raw"])

    raw = cut(rows.mapInArrow(run, "_label int, _raw double"))
    threshold = (nth(raw, bad - 1) + nth(raw, bad)) / 2
    middle = [nth(raw.where(F.col("_label") == c), n // 2) for c, n in ((0, bad), (1, good))]
    return Ranking(mean, scale, w, threshold, 6.0 / (abs(middle[1] - middle[0]) + 1e-6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int | None = None, pairs: int | None = None) -> Ranking:
    """A ranking fitted to all documents whose labels are known and not held out, by all pairs of a good and a bad one.

    With per_class or pairs, to a sample instead: at most `per_class` (1 500) documents of each class, and of their pairs
    `pairs` (10 000) drawn at random with repetition.
    """
    if per_class is None and pairs is None:
        return fit_measured(measured(docs, id_col, text_col), labels, id_col, label_col)
    per_class, pairs = per_class or 1500, pairs or 10_000
    rows, counts = sample(docs, labels, label_col, per_class, id_col, text_col)
    arrow_batches(docs.sparkSession)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                x = features(*utf8(piece.column("_text")))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_label", "_x"])

    kind = rows.schema["_id"].dataType.simpleString()
    made = sorted(map(tuple, rows.mapInArrow(measure, f"_id {kind}, _label int, _x array<double>").collect()))
    x = np.array([r[2] for r in made]).reshape(-1, len(FEATURES))
    return train(x, np.array([r[1] for r in made]), counts.get(0, 0) / max(1, sum(counts.values())), pairs)


def scores_measured(rows: DataFrame, ranking: Ranking, id_col: str = "doc_id") -> DataFrame:
    """quality_scores of rows whose features (_id, _x) are there already."""
    kind = rows.schema["_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ranking.score(x)), pa.array(ranking.raw(x))], names=[id_col, "score", "raw"])

    return rows.select("_id", "_x").mapInArrow(run, f"`{id_col}` {kind}, score double, raw double")


def quality_scores(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and raw score of each row of `docs`; at score 0.5 the raw score is at the quantile threshold.

    Every whole text is read. A null text is empty; empty texts get a score too. Rows are independent: null or repeated
    ids and repeated rows are scored like any other. An empty table gives an empty result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                x = features(*utf8(piece.column("_text")))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(ranking.score(x)), pa.array(ranking.raw(x))], names=[id_col, "score", "raw"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, score double, raw double")
