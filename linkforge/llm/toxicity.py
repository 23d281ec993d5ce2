"""Toxic spans by a linear-chain conditional random field.

Each token is toxic or clean. Token labels come from the labelled documents: a token of a toxic document counts as
toxic if its form or a prefix of it stands in many contexts of toxic and in next to none of clean documents. (Contexts
are counted, not documents, because the words of one passage recur in all its copies.) The field has weights
for hashed features of the token (the form and its prefixes) and for transitions, learned by maximum likelihood.
Forward-backward marginals of all tokens give spans with their offsets, and summed up a score for the document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .textbytes import RangeHash, arrow_batches, pieces, runs, text_pieces, tidy, utf8

BITS = 22
#: Bytes of the prefixes that are features; longer and shorter forms share them.
PREFIXES = (4, 5, 6, 8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters U+00C0 to U+00DE, byte for byte, so that offsets stay."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[second] += 32
    return data


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each token, and its feature numbers: the form, then the prefixes (the form again where it is shorter)."""
    data = lowered(data)
    start, stop, row = runs(_LETTER[data], offsets)
    hashed = RangeHash(data, 17)
    mask = np.uint64((1 << BITS) - 1)
    features = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    features[:, 0] = hashed(start, stop) & mask
    for k, n in enumerate(PREFIXES):
        features[:, k + 1] = hashed(start, np.minimum(start + n, stop)) & mask
    return start, stop, row, features


@dataclass
class Crf:
    """Weights of a two-state chain. Scores are those of the toxic state less those of the clean one.

    Most features have no weight: the model travels as the numbers and weights of the others.
    """

    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = -3.0
    #: Of the document's score: constant, log(1 + toxic tokens), greatest marginal.
    doc: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def dense(self) -> np.ndarray:
        """A weight for every feature number."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weights
        return out

    def emission(self, features: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias)
        for k in range(features.shape[1]):
            total += dense[features[:, k]]
        return np.clip(total, -30, 30)

    def marginals(self, score: np.ndarray, first: np.ndarray, width: int = 128) -> np.ndarray:
        """P(toxic) of each token of a stream of documents; `first` is true where a document begins.

        The ratio of the forward variables obeys r' = (p r + q) / (s r + t), and so do the backward ones. The stream is cut
        into rows of `width` tokens; the maps of a row are multiplied up for all rows at once, the rows are
        chained, and a second walk fills in the tokens. The result is that of the plain recursion.
        """
        n = len(score)
        if not n:
            return np.zeros(0)
        a = np.exp(self.trans)
        size = -(-n // width) * width
        u = np.ones(size)
        u[:n] = np.exp(score)
        reset = np.ones(size, bool)
        reset[:n] = first
        last = np.ones(size, bool)
        last[: n - 1] = first[1:]
        zero = np.zeros(size)
        r = _mobius(np.where(reset, zero, u * a[1, 1]), np.where(reset, u * np.exp(self.start), u * a[0, 1]), np.where(reset, zero, a[1, 0]), np.where(reset, 1.0, a[0, 0]), width)
        ahead = np.ones(size)
        ahead[:-1] = u[1:]
        back = _mobius(*(x[::-1] for x in (np.where(last, zero, a[1, 1] * ahead), np.where(last, 1.0, a[1, 0]), np.where(last, zero, a[0, 1] * ahead), np.where(last, 1.0, a[0, 0]))), width)[::-1]
        odds = (r * back)[:n]
        return odds / (1.0 + odds)


def _mobius(p: np.ndarray, q: np.ndarray, s: np.ndarray, t: np.ndarray, width: int) -> np.ndarray:
    """All x[i] = (p[i] x[i-1] + q[i]) / (s[i] x[i-1] + t[i]) with x[-1] = 1."""
    p, q, s, t = (np.ascontiguousarray(v.reshape(-1, width).T) for v in (p, q, s, t))
    one, nil = np.ones(p.shape[1]), np.zeros(p.shape[1])
    a, b, c, d = one.copy(), nil.copy(), nil.copy(), one.copy()
    for i in range(width):
        a, b, c, d = p[i] * a + q[i] * c, p[i] * b + q[i] * d, s[i] * a + t[i] * c, s[i] * b + t[i] * d
        if i % 8 == 7:
            scale = 1.0 / (a + b + c + d)
            a, b, c, d = a * scale, b * scale, c * scale, d * scale
    x, begin = 1.0, np.empty(p.shape[1])
    for i, (a1, b1, c1, d1) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        begin[i] = x
        x = (a1 * x + b1) / (c1 * x + d1)
    out = np.empty_like(p)
    x = begin
    for i in range(width):
        x = (p[i] * x + q[i]) / (s[i] * x + t[i])
        out[i] = x
    return out.T.ravel()


def segments(row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, number of tokens and whether a document begins, for stretches of at most `length` tokens that never cross a document's end."""
    heads = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(row)))
    count = -(-size // length)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(heads, count) + nth * length
    return begin, np.minimum(length, np.repeat(heads + size, count) - begin), nth == 0


def gradient(crf: Crf, score: np.ndarray, gold: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected minus observed token labels, transitions and starts, over segments: rows of which the first `size` tokens count.

    before: the label of the token ahead of the segment, or -1 where its document begins.
    """
    n, length = score.shape
    a, e = np.exp(crf.trans), np.stack([np.ones_like(score), np.exp(score)], 2)
    f = np.empty((length, n, 2))
    opens = before < 0
    f[0] = e[:, 0] * np.where(opens[:, None], np.array([1.0, np.exp(crf.start)]), a[np.maximum(before, 0)])
    f[0] /= f[0].sum(1, keepdims=True)
    for i in range(1, length):
        step = (f[i - 1] @ a) * e[:, i]
        f[i] = np.where((i < size)[:, None], step / step.sum(1, keepdims=True), f[i - 1])
    b = np.ones((n, 2))
    p = np.zeros((n, length))
    pairs = np.zeros((2, 2))
    for i in range(length - 1, -1, -1):
        live = i < size
        m = f[i] * b
        p[:, i] = np.where(live, m[:, 1] / m.sum(1), 0.0)
        if i:
            eb = e[:, i] * b
            joint = (f[i - 1][:, :, None] * a[None] * eb[:, None, :])[live]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back = eb @ a.T
            b = np.where(live[:, None], back / back.sum(1, keepdims=True), b)
    inside = np.arange(length)[None] < size[:, None]
    np.add.at(pairs[:, 1], before[~opens], p[~opens, 0])
    np.add.at(pairs[:, 0], before[~opens], 1 - p[~opens, 0])
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
    np.add.at(seen, (before[~opens], gold[~opens, 0]), 1)
    return np.where(inside, p - gold, 0.0), pairs - seen, float((p[opens, 0] - gold[opens, 0]).sum())


def train(texts: list[str], labels: list[int], segment: int = 32, max_segments: int = 8000, steps: int = 80, seed: int = 5) -> Crf:
    """A field fitted to documents labelled 1 (toxic) or 0. Without documents of both kinds every token is clean."""
    crf = Crf()
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return crf
    rows, parts = [], []
    for first, data, offsets in text_pieces(texts):
        _, _, row, part = token_features(data, offsets)
        rows.append(row + first)
        parts.append(part)
    row, features = np.concatenate(rows).astype(np.int32), np.concatenate(parts)
    del rows, parts
    space = 1 << BITS
    n_docs, n_toxic = len(texts), int(y.sum())
    n_clean = n_docs - n_toxic
    toxic, clean = (_contexts(features[y[row] == label], row[y[row] == label]) for label in (1, 0))
    # A mark of toxic text has as many contexts as 1 % of the toxic documents, 4 at least, is over 25 times rarer in
    # clean ones (rates are by tokens), and no feature would lean so far by chance.
    tokens = np.bincount(y[row], minlength=2)
    share = tokens[1] / tokens.sum()
    seen = np.flatnonzero(toxic + clean)
    t, c = toxic[seen].astype(float), clean[seen].astype(float)
    lift = ((t + 0.5) / (tokens[1] + 1)) / ((c + 0.5) / (tokens[0] + 1))
    q = np.clip(t / (t + c), 1e-9, 1 - 1e-9)
    surprise = (t + c) * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
    mark = np.zeros(1 << BITS, bool)
    mark[seen] = (t >= max(4, 0.01 * n_toxic)) & (lift > 25) & (surprise > np.log(len(seen)) + 3)
    gold = (mark[features].any(1) & (y[row] == 1)).astype(np.int64)
    if not gold.any():
        return crf
    rng = np.random.default_rng(seed)
    begin, size, opens = segments(row, segment)
    marked = np.add.reduceat(gold, begin) > 0
    some = np.concatenate([rng.permutation(np.flatnonzero(m))[: max_segments // 2] for m in (marked, ~marked)])
    begin, size, opens = begin[some], size[some], opens[some]
    inside = np.arange(segment)[None] < size[:, None]
    place = np.minimum(begin[:, None] + np.arange(segment)[None], len(gold) - 1)
    g, f = np.where(inside, gold[place], 0), features[place]
    before = np.where(opens, -1, gold[begin - 1])
    # Only features of three contexts and more that lean to toxic text have weights; the others keep zero (the one past
    # the end). So clean tokens rest on the bias alone, in training as elsewhere, and unknown tokens count as clean.
    leans = np.zeros(space, bool)
    leans[seen] = (t + c >= 3) & (lift > 3)
    used, f = np.unique(np.where(leans[f], f, space), return_inverse=True)
    rare = np.flatnonzero(used == space)
    f, k = f.reshape(len(g), segment, -1), len(used)
    theta = np.zeros(k + 6)
    theta[k], theta[k + 5] = crf.bias, crf.start
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        crf.bias, crf.trans, crf.start = theta[k], theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5]
        score = np.clip(theta[f].sum(2) + crf.bias, -30, 30)
        token, pairs, start = gradient(crf, score, g, size, before)
        grad = np.zeros_like(theta)
        grad[:k] = np.bincount(f.ravel(), weights=np.repeat(token, f.shape[2], 1).ravel(), minlength=k)
        grad[k], grad[k + 1 : k + 5], grad[k + 5] = token.sum(), pairs.ravel(), start
        grad = grad / len(g) + 1e-5 * theta
        grad[rare] = 0.0
        grad[k + 1] = 0.0  # one transition is fixed, else the scale is open
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
    weights = theta[:k].astype(np.float32)
    has = (np.abs(weights) >= 0.02) & (used < space)
    crf.at, crf.weights = used[has].astype(np.int32), weights[has]
    crf.bias, crf.trans, crf.start = float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2).copy(), float(theta[k + 5])
    del f, g, place, inside, toxic, clean, mark, leans
    dense = crf.dense()
    x = np.zeros((n_docs, 3))
    for at in np.array_split(np.arange(n_docs), max(1, len(row) // 100_000)):
        some = slice(*np.searchsorted(row, [at[0], at[-1] + 1]))
        p = crf.marginals(crf.emission(features[some], dense), np.diff(row[some], prepend=-1) > 0)
        x[at] = doc_evidence(p, row[some] - at[0], len(at))
    weight = np.zeros(3)
    hess = np.eye(3) * 1e-2
    rate = np.where(y == 1, 0.5 / n_toxic, 0.5 / n_clean) * n_docs  # the sample is not drawn at the true rates
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        h = (x * (rate * q * (1 - q))[:, None]).T @ x + hess * n_docs
        weight -= np.linalg.solve(h, x.T @ (rate * (q - y)) + 1e-2 * n_docs * weight * np.array([0, 1, 1]))
    crf.doc = tuple(weight)
    return crf


def _contexts(features: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many forms each feature follows, by feature number."""
    out = np.zeros(1 << BITS, np.int32)
    before = np.where(np.diff(row, prepend=-1) > 0, -1, np.roll(features[:, 0], 1)).astype(np.int64)
    for k in range(features.shape[1]):
        pairs = np.unique((features[:, k].astype(np.int64) << 32) | (before & 0xFFFFFFFF))
        number, count = np.unique(pairs >> 32, return_counts=True)
        out[number] += count.astype(np.int32)
    return out


def doc_evidence(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Constant, log(1 + likely toxic tokens) and greatest marginal of each document."""
    out = np.zeros((n, 3))
    out[:, 0] = 1.0
    out[:, 1] = np.log1p(np.bincount(row[p >= 0.5], minlength=n))
    np.maximum.at(out[:, 2], row, p)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, max_segments: int = 8000) -> Crf:
    """A field fitted to a sample of at most `per_class` documents of each class whose labels are not held out.

    Token labels are mined from the whole texts of the sample; the field learns from at most `max_segments` segments
    of 32 tokens of them, drawn at random, half of them with toxic tokens and half without. Training is one task on
    an executor, which holds the texts of the sample and no others; the driver gets the weights only.
    """
    rows, _ = sample(docs, labels, label_col, per_class, id_col, text_col)
    arrow_batches(docs.sparkSession)

    @tidy
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        y: list[int] = []
        for b in batches:
            texts += b.column("_text").to_pylist()
            y += b.column("_label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, y, max_segments=max_segments))], pa.binary())], names=["model"])

    made = rows.repartition(1).sortWithinPartitions("_id").mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Crf()


def toxic_spans(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), spans: bool = True) -> DataFrame:
    """id, `keep` columns, score, n_toxic_tokens and spans (array of start, stop in code points, and probability).

    score is in 0 to 1 and needs no label. Every whole text is read; a null or empty text has no spans and the score of a
    text without toxic tokens. Rows are independent: null or repeated ids and repeated rows are scored like any
    other. An empty table gives an empty result; other columns are ignored, and so are columns to keep that have the name of
    a result.
    """
    made = ["score", "n_toxic_tokens", *(["spans"] if spans else [])]
    have = [id_col, *(c for c in keep if c != id_col and c not in made)]
    scored = _scored(docs, crf, have, text_col, spans)
    return scored.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(have)), *made)


def without_toxic(docs: DataFrame, crf: Crf, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below `least`, with all their columns, whatever their names."""
    scored = _scored(docs, crf, docs.columns, text_col, False).where(F.col("score") < least)
    return scored.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def _scored(docs: DataFrame, crf: Crf, keep: list[str], text_col: str, spans: bool) -> DataFrame:
    """The columns of `keep` as _k0, _k1 ... and the results."""
    arrow_batches(docs.sparkSession)
    own = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema if f.name != "_text"}
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = crf.dense()
        for batch in batches:
            for piece in pieces(batch, "_text"):
                n = piece.num_rows
                data, offsets = utf8(piece.column("_text"))
                start, stop, row, features = token_features(data, offsets)
                p = crf.marginals(crf.emission(features, dense), np.diff(row, prepend=-1) > 0)
                x = doc_evidence(p, row, n)
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(crf.doc), -30, 30)))
                made = [pa.array(score), pa.array(np.bincount(row[p >= 0.5], minlength=n))]
                if spans:
                    made.append(pa.array(_spans(data, offsets, start, stop, row, p), kind))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kinds), *made], names=[*kinds, "score", "n_toxic_tokens", *(["spans"] if spans else [])])

    schema = ", ".join([*(f"{k} {v}" for k, v in kinds.items()), "score double, n_toxic_tokens long", *(["spans array<struct<start:long,stop:long,p:double>>"] if spans else [])])
    return own.mapInArrow(run, schema)


def _spans(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray, p: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return out
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]))
    for a, b in zip(begins, [*begins[1:], len(hit)]):
        first, last = hit[a], hit[b - 1]
        base = point[offsets[row[first]]]
        out[row[first]].append({"start": int(point[start[first]] - base), "stop": int(point[stop[last]] - base), "p": float(p[first : last + 1].max())})
    return out
