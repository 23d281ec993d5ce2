"""Near-duplicate documents by BagMinHash signatures, bands and exact verification.

A document is the multiset of its five-word shingles. For each shingle a Poisson process, the same in all
documents, throws points on the plane of time and weight. Weights are discretised into strips (0, 1], (1, 2],
(2, 4], ..., and a strip is a tree of processes: each knows its first point, and is split into the processes of its
halves, of which one inherits that point and the other draws its own, later one. A document sees the points below
its shingles' counts: it takes the first point of a process that lies below as a whole, drops one that lies above, and
splits the others. Each point belongs to one of the signature's components, and a component is the first point
that it sees, so two documents agree in a component with the probability of their weighted Jaccard similarity. A
subtree ends once its first point is later than all that the signature already has.

Bands of components are buckets. Every document of a bucket is compared with the bucket's hub, the member that
shares the most buckets with others. Where a bucket still holds several classes, all pairs across classes that their
histograms, an exact bound, do not rule out are compared too. All comparisons are of whole multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.graph import components
from .bitmaps import bit_filter, may_be_in
from .textbytes import RangeHash, arrow_batches, mix, pieces, powers, tidy, utf8, words

U64 = np.uint64
SHINGLE = 5
SIMILAR = 0.8
#: Components of a signature.
SIZE = 120
#: The chance that a pair at the least similarity shares no band is at most this; at 0.8 it is 0.00007, with 24 bands of 5.
MISS = 1e-4
#: Bins of the histogram of shingle hashes that bounds how far two multisets can overlap.
BINS = 512
#: Doublings of the way that labels follow from hub to hub.
JUMPS = 2
_STEP = 0x9E3779B97F4A7C15


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct k-word shingles of each text, by row, and a 16-byte name of its word sequence.

    A text of fewer than k words is one shingle; one without words has none, and an empty name.
    """
    n = len(offsets) - 1
    start, stop, row = words(data, offsets)
    begin = np.searchsorted(row, np.arange(n + 1))
    total = np.diff(begin)
    name = np.zeros((n, 2), U64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), name
    w = RangeHash(data, 53)(start, stop)
    for c, base in enumerate((_STEP, 0xC2B2AE3D27D4EB4F)):
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U64(0)], np.cumsum(mix(w + U64(c)) * powers(base, len(w)))])
            back = powers(pow(base, -1, 1 << 64), len(w) + 1)
            name[:, c] = np.where(total > 0, mix((sums[begin[1:]] - sums[begin[:-1]]) * back[begin[:-1]] + total.astype(U64) * U64(base)), 0)
    h = w.copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h = h[:-1] if len(h) > 1 else h
            if len(w) > j:
                h = mix(h * U64(_STEP) + w[j:])
    inside = np.flatnonzero(np.arange(len(w)) + k <= begin[1:][row])
    short = np.flatnonzero((total > 0) & (total < k))
    r = np.concatenate([row[inside], short])
    h = np.concatenate([h[inside] if len(inside) else np.zeros(0, U64), name[short, 0]])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    return r[new], h[new], np.diff(np.append(new, len(r))), name


def _first_time(key: np.ndarray, rate: np.ndarray | int) -> np.ndarray:
    """Exponentially distributed times that the keys stand for."""
    return -np.log(((key >> U64(11)) + U64(1)).astype(np.float64) * 2.0**-53) / rate


def _process(h: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The key of the process of a shingle between two weights."""
    with np.errstate(over="ignore"):
        return mix(h ^ mix(low.astype(U64) * U64(_STEP) + width.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(7)))


def bag_minhash(row: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int = SIZE) -> np.ndarray:
    """Signatures (n x m, 16 bits each) of n weighted sets; rows without elements have zeros."""
    weight = np.bincount(row, weights=count, minlength=n)
    # Points later than this are looked at only for rows that turn out to need them.
    guess = m * (np.log(m) + 3) / np.maximum(weight, 1e-9)
    best = np.full((n, m), np.inf)
    flat = best.ravel()
    todo = weight > 0
    other = U64(0x632BE59BD9B4E019)
    while todo.any():
        best[todo] = np.inf
        horizon = guess.copy()
        elements = np.flatnonzero(todo[row])
        strip_low, strip = 0, 1
        while len(elements):
            elements = elements[count[elements] > strip_low]
            at, low, width = elements, np.full(len(elements), strip_low), np.full(len(elements), strip)
            key = _process(h[at], low, width)
            time, nth, fresh = _first_time(key, width), np.zeros(len(at), np.int64), np.ones(len(at), bool)
            point = key
            while len(at):
                alive = (time < horizon[row[at]]) & (low < count[at])
                at, low, width, key, time, nth, fresh, point = (x[alive] for x in (at, low, width, key, time, nth, fresh, point))
                below = low + width <= count[at]
                new = below & fresh
                with np.errstate(over="ignore"):
                    component = ((mix(point[new] + other) >> U64(32)) * U64(m)) >> U64(32)
                np.minimum.at(flat, row[at[new]] * m + component.astype(np.int64), time[new])
                horizon = np.minimum(horizon, best.max(1))
                leaf = width == 1
                # A strip of one weight goes on to its next point.
                a1, k1 = at[leaf], nth[leaf] + 1
                with np.errstate(over="ignore"):
                    p1 = mix(key[leaf] + k1.astype(U64) * U64(_STEP))
                nodes = [(a1, low[leaf], width[leaf], key[leaf], time[leaf] + _first_time(p1, 1), k1, np.ones(len(a1), bool), p1)]
                if not leaf.all():
                    up = ~leaf
                    half, taken = width[up] // 2, fresh[up] & ~below[up]
                    with np.errstate(over="ignore"):
                        right = (mix(key[up] ^ other) & U64(1)).astype(np.int64)
                    heir, rest = low[up] + right * half, low[up] + (1 - right) * half
                    zeros = np.zeros(len(half), np.int64)
                    nodes.append((at[up], heir, half, _process(h[at[up]], heir, half), time[up], zeros, taken, point[up]))
                    own = _process(h[at[up]], rest, half)
                    nodes.append((at[up], rest, half, own, time[up] + _first_time(own, half), zeros, np.ones(len(half), bool), own))
                at, low, width, key, time, nth, fresh, point = nodes[0] if len(nodes) == 1 else (np.concatenate(x) for x in zip(*nodes))
            strip_low, strip = strip_low + strip, max(1, strip_low + strip)
        todo = todo & np.isinf(best).any(1)
        guess = guess * 2
    best[weight == 0] = 0.0
    return (mix(best.view(U64)) & U64(0xFFFF)).astype(np.uint16)


def banding(similar: float) -> tuple[int, int]:
    """(bands, components of each): as many components as leave a pair at this similarity without a common band with chance MISS at most."""
    band = max(k for k in range(1, SIZE + 1) if k == 1 or (1 - similar**k) ** (SIZE // k) <= MISS)
    return SIZE // band, band


def band_keys(signature: np.ndarray, bands: int, band: int) -> np.ndarray:
    out = np.empty((len(signature), bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(signature), b + 1, U64)
            for c in signature[:, b * band : (b + 1) * band].T:
                key = mix(key * U64(_STEP) + c)
            out[:, b] = key
    return out.view(np.int64)


def multiset(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, h, count, _ = shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return h, count


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def histogram(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Shingle counts by hash bin, one byte each, 255 where a bin has more."""
    bins = np.bincount((bag[0] >> U64(40)).astype(np.int64) % BINS, weights=bag[1], minlength=BINS)
    return np.minimum(bins, 255).astype(np.uint8).tobytes()


def most_overlap(bins: np.ndarray, over: np.ndarray, other: np.ndarray, other_over: int) -> np.ndarray:
    """What the overlaps of multisets cannot exceed, from their histograms and from how much did not fit in those.

    Of two bins the smaller is a bound for what lies in both; where both are full, what is above them is bounded in all.
    """
    return np.minimum(bins, other).sum(1, dtype=np.int64) + np.minimum(over, other_over)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def possible(at: np.ndarray, i: int, band: int, sig: np.ndarray, bins: np.ndarray, over: np.ndarray, total: np.ndarray, similar: float) -> np.ndarray:
    """Those of the texts `at` that first share `band` with text i and that their histograms allow to be similar to it."""
    # A pair that shares several bands is taken in the first.
    bands, size = banding(similar)
    at = at[(sig[at, : bands * size] == sig[i, : bands * size]).reshape(-1, bands, size).all(2).argmax(1) == band]
    most = most_overlap(bins[at], over[at], bins[i], over[i])
    return at[most >= similar * (total[at] + total[i] - most)]


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, cell: int = 500) -> DataFrame:
    """For each row of `docs`: id, class_id, class_size and _th (hash of its text).

    Two texts are linked when the weighted Jaccard similarity of their five-word shingles is at least `similar`; words
    are runs without blanks, as they stand. A class is a connected component, class_id its smallest id, null last.
    Texts with the same words in the same order are alike; a text without words, null or empty, is a class by
    itself. Rows that repeat an id are rows of their own. An empty table gives an empty result; other columns are
    ignored. A bucket of any size is dealt out in cells of at most about 2 * `cell` members; none is capped. A linked
    pair is missed only if it shares no band (MISS) and no other links join its classes. Each step is written once.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    bands, size = banding(similar)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    th = _text_hash(text_col)
    own = docs.select(F.col(id_col).alias("_id"), th.alias("_th"), F.col(text_col).alias("_text"))

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                n = piece.num_rows
                r, h, c, name = shingles(*utf8(piece.column("_text")))
                signature = bag_minhash(r, h, c, n)
                empty = ~name.any(1)
                nodes = [None if e else x.tobytes() for x, e in zip(name, empty)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_id"), piece.column("_th"), pa.array(nodes, pa.binary()), pa.array([None if e else x.tobytes() for x, e in zip(signature, empty)], pa.binary())],
                    names=["_id", "_th", "_node", "_sig"],
                )

    rows = cut(own.mapInArrow(sign, f"_id {kind}, _th long, _node binary, _sig binary"))
    # Copies are one node from here on.
    nodes = rows.where("_node is not null").groupBy("_node").agg(
        F.min("_id").alias("_least"), F.count("*").alias("_n"), F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_th").alias("t"))).alias("_first"), F.first("_sig").alias("_sig")
    )
    nodes = cut(nodes)

    @tidy
    def to_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SIZE), bands, size)
            node = b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), bands)))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.tile(np.arange(bands), len(keys)), pa.int32()), pa.array(keys.ravel())], names=["_node", "_band", "_key"])

    banded = nodes.select("_node", "_sig").mapInArrow(to_bands, "_node binary, _band int, _key long")
    sizes = banded.groupBy("_key").agg(F.count("*").alias("_size")).where("_size > 1")
    members = cut(banded.join(sizes, "_key"))
    score = cut(members.groupBy("_node").agg(F.sum("_size").alias("_score")))
    hubs = members.join(score, "_node").groupBy("_key").agg(F.max(F.struct("_score", "_node")).alias("_hub")).select("_key", F.col("_hub._node").alias("_hub"), F.col("_hub._score").alias("_rank"))
    stars = cut(members.join(hubs, "_key").where("_node <> _hub").select(F.col("_node").alias("a"), F.col("_hub").alias("b"), F.col("_rank").alias("s")).distinct())

    # Texts of the nodes in buckets, once each, compressed. A bitmap of bounded size keeps the others out of the shuffle.
    wanted = nodes.join(score.select("_node"), "_node", "left_semi").select("_node", F.col("_first.i").alias("_i"), F.col("_first.t").alias("_t"))
    wanted = wanted.withColumn("_rk", F.xxhash64("_i", "_t"))
    some = may_be_in(own.withColumn("_rk", F.xxhash64("_id", "_th")), "_rk", bit_filter(wanted, "_rk"))
    texts = some.join(wanted, (some["_rk"] == wanted["_rk"]) & some["_id"].eqNullSafe(wanted["_i"]) & (some["_th"] == wanted["_t"])).select("_node", "_text")

    @tidy
    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["_node", "_z"])

    texts = cut(texts.mapInArrow(press, "_node binary, _z binary").groupBy("_node").agg(F.first("_z").alias("_z")))

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        hub, bag = None, None
        for batch in batches:
            links = []
            for x, y, s, p, q in zip(*(batch.column(c).to_pylist() for c in "abs"), batch.column("za").to_pylist(), batch.column("zb").to_pylist()):
                if y != hub:
                    hub, bag = y, multiset(z.decompress(q))
                if overlap(multiset(z.decompress(p)), bag) >= similar:
                    links.append((x, y, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "s"])

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("_node").alias("a"), F.col("_z").alias("za")), "a")
        return with_a.join(texts.select(F.col("_node").alias("b"), F.col("_z").alias("zb")), "b").mapInArrow(verify, "a binary, b binary, s long")

    links = cut(verified(stars))
    # A first idea of the classes: each node follows its best hub, hubs follow theirs. A hub ranks above its members,
    # so these steps form trees, and members of one tree are connected.
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("s", "b")).alias("best")).select("node", F.col("best.b").alias("label")))
    for _ in range(JUMPS):
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(labels.join(ahead, "label", "left").select("node", F.coalesce("next", "label").alias("label")))

    # What the hubs did not join: buckets with members of several classes. Only pairs with a member outside the largest
    # class are left, so both parts are dealt out in slots, and slots of the largest class do not meet each other.
    placed = cut(members.join(labels, members["_node"] == labels["node"], "left").select("_key", "_band", "_node", F.coalesce("label", "_node").alias("_label")))
    by_label = placed.groupBy("_key", "_label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("_key").agg(F.max(F.struct("n", "_label")).alias("_main"), F.sum("n").alias("_all"), F.count("*").alias("_labels")).where("_labels > 1")
    mixed = mixed.select("_key", F.col("_main._label").alias("_main"), F.ceil(F.col("_main.n") / cell).cast("int").alias("_g"), F.ceil((F.col("_all") - F.col("_main.n")) / cell).cast("int").alias("_o"))
    left = cut(placed.join(mixed, "_key"))

    @tidy
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            bags = [multiset(z.decompress(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([histogram(x) for x in bags], pa.binary()), pa.array([int(x[1].sum()) for x in bags], pa.int64()), b.column(2)], names=["_node", "_bins", "_total", "_sig"])

    sketches = texts.join(left.select("_node").distinct(), "_node").join(nodes.select("_node", "_sig"), "_node").select("_node", "_z", "_sig")
    left = left.join(sketches.mapInArrow(bound, "_node binary, _bins binary, _total long, _sig binary"), "_node")
    outside = F.col("_label") != F.col("_main")
    left = left.withColumn("_slot", F.when(outside, F.col("_g") + F.pmod(F.xxhash64("_node"), F.col("_o"))).otherwise(F.pmod(F.xxhash64("_node"), F.col("_g"))).cast("int"))
    left = left.withColumn("_other", F.explode(F.sequence(F.when(outside, F.lit(0)).otherwise(F.col("_g")), F.col("_g") + F.col("_o") - 1)))
    left = left.select("_key", F.least("_slot", "_other").alias("_lo"), F.greatest("_slot", "_other").alias("_hi"), "_band", "_slot", "_node", "_label", "_sig", "_bins", "_total")

    @tidy
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: list[tuple]) -> pa.RecordBatch:
            lo, hi, band = group[0][1], group[0][2], group[0][3]
            slot = np.array([g[4] for g in group])
            node = [g[5] for g in group]
            _, label = np.unique(np.array([g[6] for g in group], object), return_inverse=True)
            sig = np.frombuffer(b"".join(g[7] for g in group), np.uint16).reshape(-1, SIZE)
            bins = np.frombuffer(b"".join(g[8] for g in group), np.uint8).reshape(-1, BINS)
            total = np.array([g[9] for g in group])
            over = total - bins.sum(1, dtype=np.int64)
            main = np.bincount(label).argmax()
            found = []
            # Each pair across classes has at least one member outside the largest class.
            for i in np.flatnonzero(label != main):
                other = (label != label[i]) & ((label == main) | (np.arange(len(label)) > i))
                if lo != hi:
                    other &= slot != slot[i]
                at = possible(np.flatnonzero(other), i, band, sig, bins, over, total, similar)
                found += [(node[i], node[j]) for j in at]
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.binary()) for c in (0, 1)], names=["a", "b"])

        key, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:3] != key:
                    if len(held) > 1:
                        yield pairs(held)
                    key, held = row[:3], []
                held.append(row)
        if len(held) > 1:
            yield pairs(held)

    rest = cut(left.repartition("_key", "_lo", "_hi").sortWithinPartitions("_key", "_lo", "_hi").mapInArrow(across, "a binary, b binary"))
    more = cut(verified(rest.withColumn("s", F.lit(0).cast("long"))))
    labels = components(links.unionByName(more), "a", "b")

    named = nodes.join(labels, nodes["_node"] == labels["node"], "left").select("_node", "_least", "_n", F.coalesce("label", "_node").alias("_label"))
    classes = named.groupBy("_label").agg(F.min("_least").alias("_class"), F.sum("_n").alias("_size"))
    named = named.join(classes, "_label").select(F.col("_node").alias("_known"), "_class", "_size")
    # Rows without words have no node; keys of their own keep them from meeting in one partition.
    rows = rows.withColumn("_join", F.coalesce("_node", F.concat(F.lit("-"), F.col("_id").cast("string"), F.lit("-")).cast("binary"), F.lit("-").cast("binary")))
    out = rows.join(named, rows["_join"] == named["_known"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_known").isNull(), F.col("_id")).otherwise(F.col("_class")).alias("class_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("class_size"),
        "_th",
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs`, with all their columns, of which each class keeps the one with the smallest id, null last.

    Texts without words, null or empty, stay. Rows that repeat the kept row's id and text are that row again and go;
    of rows with the kept id and other texts of the class, the one with the least hash of its text stays. An empty table gives
    an empty result; columns may have any name.
    """
    classes = near_classes(docs, id_col, text_col, similar)
    stay = classes.where(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("_class"), F.col("class_size")).agg(F.min("_th").alias("_stays"))
    th = _text_hash(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(row.alias("_doc"), F.col(id_col).alias("_own_id"), th.alias("_own_th"))
    kept = own.join(stay.select("_class", "_stays").distinct(), F.col("_own_id").eqNullSafe(F.col("_class")) & (F.col("_own_th") == F.col("_stays")), "left_semi")
    return kept.dropDuplicates(["_own_id", "_own_th"]).select("_doc.*")
