"""Removal of long repeated byte strings by a distributed merge sort of suffixes that never re-compares known prefixes.

A string of `length` bytes can repeat only where all of it repeats, so a sorted sample of suffixes is enough: in
every window of `length` bytes the `ANCHOR` bytes with the least hash are its anchor, equal windows have equal
anchors at equal places, and a suffix is sorted for each anchor, with the windows that it stands for. A suffix whose
anchor occurs once needs no sorting (its distinguishing prefix is known to be short): a first exchange of 4-byte
hashes finds those. The others are sorted in runs, front-coded (length of the prefix shared with the suffix
before, and the rest) and exchanged by anchor. Each range merges its runs with a loser tree whose nodes
remember common prefix lengths. Equal suffixes come out side by side and tell which windows have an
earlier document.

An anchor that very many suffixes have is hot. Its windows are sorted one by one, so that they spread over the ranges, and of
equal windows a piece sends one, with the least of its ids. What comes back is one bit: whether the least of all is smaller.
So the places of a hot window never meet, however many there are.

Stages talk in pieces: a piece is a compressed block of whole documents with a key of its own, written once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .textbytes import RangeHash, arrow_batches, mix, pieces, rolling, tidy, utf8

U64 = np.uint64
ANCHOR = 24
_POSITION = U64((1 << 28) - 1)
#: An anchor with more occurrences than this in one range is sorted window by window.
HOT = 20_000
#: Of the suffix records that one run holds.
RUN = 150_000
FAN_IN = 256
#: Bytes of text that anchors are found in at once.
BLOCK = 1 << 19
_NO_ID = (1 << 63) - 1
#: One of each for a process; their buffers are large.
_press, _unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
_PACKED = [np.dtype(t) for t in (np.uint8, np.bool_, np.int32, np.int64)]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, last window, row, hash of the anchor) of the anchors of a buffer of texts."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none.astype(U64)
    if n > BLOCK and len(offsets) > 2:
        # Rows are taken by the block, so that the arrays of 8 bytes for each byte of text stay small.
        cuts = np.unique(np.searchsorted(offsets, np.arange(0, n, BLOCK)).clip(0, len(offsets) - 1).tolist() + [len(offsets) - 1])
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            at, first, last, row, h = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length) if b - a < len(offsets) - 1 else _anchors(data, offsets, length)
            found.append((at + offsets[a], first + offsets[a], last + offsets[a], row + a, h))
        return tuple(np.concatenate(c) for c in zip(*found))
    return _anchors(data, offsets, length)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none.astype(U64)
    spread = length - ANCHOR + 1
    hashed = rolling(data, ANCHOR, 41)
    least = hashed & ~_POSITION
    least |= np.arange(len(hashed), dtype=U64)
    have = 1
    while have * 2 <= spread:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < spread:
        least = np.minimum(least[: len(least) - (spread - have)], least[spread - have :])
    # Windows that would cross a text's end are left out.
    crosses = np.zeros(n + 1, np.int8)
    full = np.flatnonzero(np.diff(offsets))
    np.add.at(crosses, np.maximum(offsets[full], offsets[full + 1] - length + 1), 1)
    np.add.at(crosses, offsets[full + 1], -1)
    window = np.flatnonzero(np.cumsum(crosses, dtype=np.int8)[: len(least)] == 0)
    if not len(window):
        return none, none, none, none, none.astype(U64)
    anchor = (least[window] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(window)]]) - 1
    at = anchor[new]
    # Anchors have small hashes, being the least of their windows; mixed again they spread evenly over ranges.
    return at, window[new], window[last], np.searchsorted(offsets, at, "right") - 1, mix(hashed[at] + U64(1))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed block."""
    head = np.array([len(arrays), *(x for a in arrays for x in (_PACKED.index(a.dtype), len(a)))], np.int64)
    return _press.compress(b"".join([head[:1].tobytes(), head[1:].tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = _unpress.decompress(block)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8)
    out, at = [], 8 + 16 * count
    for number, size in head.reshape(-1, 2).tolist():
        kind = _PACKED[number]
        out.append(np.frombuffer(raw, kind, size, at))
        at += kind.itemsize * size
    return out


def numbered(data: np.ndarray, start: np.ndarray, length: int, name: np.ndarray) -> np.ndarray:
    """A number for each window of `length` bytes, the same for equal ones only. name: hashes, which are held against the bytes."""
    _, first, number = np.unique(name, return_index=True, return_inverse=True)
    windows, like = np.lib.stride_tricks.sliding_window_view(data, length), start[first][number]
    for i in range(0, len(start), 8192):
        if (windows[start[i : i + 8192]] != windows[like[i : i + 8192]]).any():  # two hashes met
            return np.unique(np.ascontiguousarray(windows[start]).view(f"S{length}").ravel(), return_inverse=True)[1]
    return number


def hot_windows(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The windows of hot anchors of a piece: (start, row, number) of each; (one of them, its anchor, least id) of each number."""
    n = last - first + 1
    start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    row, at = np.repeat(row, n), np.repeat(at, n)
    number = numbered(data, start, length, RangeHash(data, 47)(start, start + length))
    _, one = np.unique(number, return_index=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids[row])
    return start, row, number, start[one], at[one], least


def suffix_keys(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Keys as byte strings of one width: the suffix from the anchor, the bytes before it in reverse, and the lengths of both.

    Zero bytes fill up either part. The last byte is the length of the suffix and never zero.
    """
    before = length - ANCHOR
    padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)])
    rights, lefts = np.lib.stride_tricks.sliding_window_view(padded, length), np.lib.stride_tricks.sliding_window_view(padded, before)
    keys = np.empty((len(at), length + before + 2), np.uint8)
    right, left = last + length - at, at - first
    for i in range(0, len(at), 4096):
        part = slice(i, i + 4096)
        r, l, out = right[part, None], left[part, None], keys[part]
        out[:, :length] = rights[at[part] + before] * (np.arange(length) < r)
        out[:, length:-2] = lefts[at[part]][:, ::-1] * (np.arange(before) < l)
        out[:, -2:] = np.concatenate([l, r], 1)
    return keys


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefix shared with the key before, and the rests, of sorted distinct keys."""
    shared = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys), 4096):
        shared[i : i + 4096] = np.argmax(keys[i : i + 4096] != keys[i - 1 : i - 1 + len(keys[i : i + 4096])], 1)
    return shared.astype(np.uint8), keys[np.arange(keys.shape[1]) >= shared[:, None]]


def make_run(keys: np.ndarray, ids: np.ndarray, piece: np.ndarray, row: np.ndarray, first: np.ndarray, hot: np.ndarray) -> bytes:
    """A sorted, front-coded run; equal keys are one, with the list of places where they occur."""
    width = keys.shape[1]
    order = np.argsort(keys.view(f"S{width}").ravel(), kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    shared, data = front_code(keys[new])
    counts = np.diff(np.append(np.flatnonzero(new), len(keys)))
    return pack([shared, data, np.array([width], np.int32), counts.astype(np.int32), ids[order], piece[order], row[order].astype(np.int32), first[order].astype(np.int32), hot[order][new]])


class Run:
    """Walks a front-coded run."""

    def __init__(self, block: bytes):
        shared, data, width, counts, *self.places, hot = unpack(block)
        self.shared, self.data, self.width, self.hot = shared.tolist(), data.tobytes(), int(width[0]), hot.tolist()
        self.ends = np.cumsum(counts).tolist()
        self.at, self.byte, self.key = -1, 0, b""

    def step(self) -> int:
        """Moves on and gives the length of the prefix shared with the key before, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.shared):
            return -1
        shared = self.shared[self.at]
        end = self.byte + self.width - shared
        self.key = self.key[:shared] + self.data[self.byte : end]
        self.byte = end
        return shared

    def place(self) -> tuple[int, int]:
        return (self.ends[self.at - 1] if self.at else 0), self.ends[self.at]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two keys that share `known` bytes."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """Loser tree over runs: (number of the run that has the next key, prefix shared with the key before it).

    A node keeps the loser of its last match and how many bytes that shares with the winner. Of two candidates
    the one that shares more bytes with the last key given out is smaller, so bytes are read only where both
    share equally many, and only from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    loser, prefix = [-1] * k, [0] * k
    live = [r.step() >= 0 for r in runs] + [False] * (k - len(runs))

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if not live[a]:
            a, b = b, a
        if live[b]:
            x, y = runs[a].key, runs[b].key
            h = common(x, y, 0)
            if x[h:] > y[h:]:
                a, b = b, a
            prefix[node] = h
        loser[node] = b
        return a

    winner = play(1) if k > 1 else 0
    shared = 0
    while live[winner]:
        yield winner, shared
        run = runs[winner]
        h = run.step()
        if h < 0:
            live[winner] = False
        node, cand = (winner + k) // 2, winner
        while node:
            other = loser[node]
            if live[other]:
                if not live[cand]:
                    loser[node], cand, h, prefix[node] = cand, other, prefix[node], 0
                elif h < prefix[node]:
                    loser[node], cand, h, prefix[node] = cand, other, prefix[node], h
                elif h == prefix[node]:
                    x, y = runs[cand].key, runs[other].key
                    p = common(x, y, h)
                    prefix[node] = p
                    if x[p:] > y[p:]:
                        loser[node], cand = cand, other
            node //= 2
        winner, shared = cand, h


def _windows(keys: list[bytes], key_of: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, from, to) of stretches of repeated windows, for keys of anchors that have several keys.

    Places that have key k come with `key_of` k; a window is known by its bytes.
    """
    table = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    before = length - ANCHOR
    left, right = table[:, -2].astype(np.int64), table[:, -1].astype(np.int64)
    # Texts again in reading order: the bytes before the anchor, then the suffix.
    total = left + right
    begin = np.concatenate([[0], np.cumsum(total)])
    whole = np.concatenate([table[:, length:-2][:, ::-1], table[:, :length]], 1)
    j = np.arange(length + before)
    text = whole[(j >= before - left[:, None]) & (j < before + right[:, None])]
    count = total - length + 1
    key = np.repeat(np.arange(len(keys)), count)
    start = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
    where = begin[:-1][key] + start
    # Equal windows have equal anchors at equal places, so the bytes tell them apart.
    number = numbered(text, where, length, RangeHash(text, 43)(where, where + length))
    least_of_key = np.full(len(keys), _NO_ID)
    np.minimum.at(least_of_key, key_of, ids)
    least = np.full(number.max() + 1, _NO_ID)
    np.minimum.at(least, number, least_of_key[key])
    window_least = least[number]
    first = np.cumsum(count) - count
    n = count[key_of]
    place = np.repeat(np.arange(len(ids)), n)
    step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    hit = window_least[first[key_of][place] + step] < ids[place]
    place, step = place[hit], step[hit]
    if not len(place):
        return place, step, step
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 0) | (np.diff(step) > 1)]))
    stop = np.append(new[1:], len(place)) - 1
    return place[new], step[new], step[stop] + length


def resolve(blocks: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Merges runs and gives (piece, row, from, to) of all stretches that an earlier document has, and (piece, number) of hot windows that an earlier piece has."""
    runs = [Run(b) for b in blocks]
    ids, piece, row, first = (np.concatenate([r.places[c] for r in runs]) for c in range(4))
    base = np.concatenate([[0], np.cumsum([len(r.places[0]) for r in runs])]).tolist()
    out: list[tuple[np.ndarray, ...]] = []
    hot: list[tuple[np.ndarray, ...]] = []
    # Spans of places, with the number of their key: of keys alone with their anchor, and of the others.
    alone: list[tuple[int, int, int]] = []
    several: list[tuple[int, int, int]] = []
    lone: list[tuple[int, bool]] = []
    keys: list[bytes] = []
    held = 0

    def spread(spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """All places of the spans, and the number of the key of each."""
        begin, end, key = np.array(spans, np.int64).T
        n = end - begin
        return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(key, n)

    def flush() -> None:
        nonlocal held
        held = 0
        if alone:
            at, key = spread(alone)
            least = np.full(len(lone), _NO_ID)
            np.minimum.at(least, key, ids[at])
            size, is_hot = (np.array(c) for c in zip(*lone))
            hit = ids[at] > least[key]
            at, key = at[hit], key[hit]
            cold = ~is_hot[key]
            out.append((piece[at[cold]], row[at[cold]], first[at[cold]], first[at[cold]] + size[key[cold]]))
            hot.append((piece[at[~cold]], row[at[~cold]]))
            alone.clear()
            lone.clear()
        if several:
            at, key = spread(several)
            place, begin, end = _windows(keys, key, ids[at], length)
            at = at[place]
            out.append((piece[at], row[at], first[at] + begin, first[at] + end))
            several.clear()
            keys.clear()

    def close(group: list[tuple[bytes, list]], is_hot: bool) -> None:
        nonlocal held
        held += sum(b - a for _, places in group for a, b in places)
        if len(group) == 1:
            key, places = group[0]
            if len(places) > 1 or places[0][1] - places[0][0] > 1:
                alone.extend((a, b, len(lone)) for a, b in places)
                lone.append((key[-1] + key[-2], is_hot))
        else:
            for key, places in group:
                several.extend((a, b, len(keys)) for a, b in places)
                keys.append(key)
        if held > 50_000:
            flush()

    group: list[tuple[bytes, list]] = []
    was_hot = False
    for number, shared in merge(runs):
        run = runs[number]
        a, b = run.place()
        place = (base[number] + a, base[number] + b)
        if group and run.key == group[-1][0]:
            group[-1][1].append(place)
            continue
        # A hot anchor's keys are single windows: each is a group by itself.
        if group and (shared < ANCHOR or run.hot[run.at]):
            close(group, was_hot)
            group = []
        group.append((run.key, [place]))
        was_hot = run.hot[run.at]
    if group:
        close(group, was_hot)
    flush()
    join = lambda parts, n: [np.concatenate([o[c] for o in parts]) for c in range(n)] if parts else [np.zeros(0, np.int64)] * n
    return join(out, 4), join(hot, 2)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, piece_bytes: int = 1 << 20, range_bytes: int = 16 << 20, hot_from: int = HOT, with_text: bool = False) -> DataFrame:
    """For each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    A byte goes when a string of `length` bytes that covers it also starts in a row with a smaller id; strings are
    judged on the input. Texts are UTF-8 bytes, a null text is empty, and no string crosses two texts. Rows with
    equal ids never count as earlier than one another, and a null id comes after all others. Texts shorter than
    `length` stay whole. An empty table gives an empty result; other columns are ignored. Ids are integers; a table
    with others needs numbers first. Ranges hold some range_bytes of text each; past 65 536 of them they grow with the input.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    id_kind = docs.select(id_col).schema[0].dataType.simpleString()
    if id_kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is of type {id_kind}; documents are ordered by integer ids")
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    total = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = 2
    while ranges * range_bytes < total and ranges < 1 << 16:
        ranges *= 2
    piece_bytes = max(piece_bytes, ranges << 10)  # so that a piece has some 70 anchors for each range
    bits = ranges.bit_length() - 1
    narrow = np.uint16 if ranges <= 1 << 16 else np.uint32  # sorts by radix
    hash_range = lambda h: (h >> U64(64 - bits)).astype(np.int64)

    @tidy
    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small batches are gathered, so that a piece is about as large as it may be.
        held: list[pa.RecordBatch] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for whole in table.to_batches():
                for piece in pieces(whole, "_text", piece_bytes):
                    data, offsets = utf8(piece.column("_text"))
                    ids = piece.column("_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                    null = piece.column("_id").is_null().to_numpy(zero_copy_only=False)
                    block = pack([data, offsets, ids, null.astype(np.uint8)])
                    key = int.from_bytes(hashlib.blake2b(block, digest_size=8).digest(), "big", signed=True)
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([block], pa.binary())], names=["_piece", "_block"])

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= piece_bytes:
                yield from give()
                held, size = [], 0
        if held:
            yield from give()

    # Pieces that are equal are told apart by where they were written.
    stored = own.mapInArrow(to_pieces, "_piece long, _block binary").withColumn("_piece", F.xxhash64("_piece", F.monotonically_increasing_id()))
    stored = cut(stored)

    @tidy
    def to_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, block in zip(b.column(0).to_pylist(), b.column(1)):
                data, offsets, *_ = unpack(block.as_py())
                hashed = anchors(data, offsets, length)[4]
                where = hash_range(hashed)
                order = np.argsort(where.astype(narrow), kind="stable")
                small = hashed[order].astype(np.uint32)
                ends = np.searchsorted(where[order], np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([key] * len(full), pa.int64()), pa.array([small[ends[r] : ends[r + 1]].tobytes() for r in full], pa.binary())], names=["_range", "_piece", "_hashes"])

    @tidy
    def to_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_first(batches):
            parts = [np.frombuffer(r[1], np.uint32) for r in rows]
            _, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            # 0: occurs once, 1: more often, 2: hot
            mark = ((count > 1).astype(np.uint8) + (count > hot_from))[inverse.ravel()]
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            marks = [m.tobytes() for m in np.split(mark, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array(marks, pa.binary())], names=["_piece", "_range", "_marks"])

    hashes = stored.mapInArrow(to_hashes, "_range long, _piece long, _hashes binary")
    marks = hashes.repartitionById(ranges, F.col("_range").cast("int")).sortWithinPartitions("_range").mapInArrow(to_marks, "_piece long, _range long, _marks binary")
    marks = cut(marks.groupBy("_piece").agg(F.sort_array(F.collect_list(F.struct("_range", "_marks"))).alias("_marks")))

    def marked(anchored: tuple, marks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges and marks of a piece's anchors."""
        where = hash_range(anchored[4])
        mark = np.empty(len(where), np.uint8)
        mark[np.argsort(where.astype(narrow), kind="stable")] = np.frombuffer(b"".join(m["_marks"] for m in marks), np.uint8)
        return where, mark

    @tidy
    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            keys, ids, piece, row, first, hot, where = (np.concatenate([h[c] for h in held]) for c in range(7))
            order = np.argsort(where.astype(narrow), kind="stable")
            ends = np.searchsorted(where[order], np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(ends)).tolist():
                some = order[ends[r] : ends[r + 1]]
                block = make_run(keys[some], ids[some], piece[some], row[some], first[some], hot[some])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([block], pa.binary())], names=["_range", "_run"])

        for b in batches:
            for key, block, marked_ranges in zip(b.column("_piece").to_pylist(), b.column("_block"), b.column("_marks").to_pylist()):
                data, offsets, ids, _ = unpack(block.as_py())
                found = anchors(data, offsets, length)
                if not len(found[0]):
                    continue
                where, mark = marked(found, marked_ranges)
                at, first, last, row, _ = found
                pick = np.flatnonzero(mark == 1)
                if len(pick):
                    p, q = row[pick], at[pick]
                    held.append((suffix_keys(data, q, first[pick], last[pick], length), ids[p], np.full(len(q), key), p, first[pick] - offsets[p], np.zeros(len(q), bool), where[pick]))
                    size += len(q)
                pick = np.flatnonzero(mark == 2)
                if len(pick):
                    *_, one, q, least = hot_windows(data, at[pick], first[pick], last[pick], row[pick], ids, length)
                    to = hash_range(RangeHash(data, 47)(one, one + length))
                    held.append((suffix_keys(data, q, one, one, length), least, np.full(len(q), key), np.arange(len(q)), np.zeros(len(q), np.int64), np.ones(len(q), bool), to))
                    size += len(q)
                if size >= RUN:
                    yield from give()
                    held, size = [], 0
        if held:
            yield from give()

    @tidy
    def to_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_first(batches):
            # A block of one array holds numbers of hot windows, one of three holds stretches.
            for found in resolve([r[0] for r in rows], length):
                order = np.argsort(found[0], kind="stable")
                piece, *rest = (f[order] for f in found)
                new = np.flatnonzero(np.diff(piece, prepend=piece[:1] - 1 if len(piece) else 0)) if len(piece) else np.zeros(0, int)
                blocks = [pack([x[a:b].astype(np.int32) for x in rest]) for a, b in zip(new, [*new[1:], len(piece)])]
                yield pa.RecordBatch.from_arrays([pa.array(piece[new], pa.int64()), pa.array(blocks, pa.binary())], names=["_piece", "_cuts"])

    runs = stored.join(marks, "_piece").select("_piece", "_block", "_marks").mapInArrow(to_runs, "_range long, _run binary")
    stretches = runs.repartitionById(ranges, F.col("_range").cast("int")).sortWithinPartitions("_range").mapInArrow(to_stretches, "_piece long, _cuts binary")
    stretches = stretches.groupBy("_piece").agg(F.collect_list("_cuts").alias("_cuts"))

    @tidy
    def to_result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, marked_ranges, cuts in zip(b.column("_block"), b.column("_marks").to_pylist(), b.column("_cuts").to_pylist()):
                data, offsets, ids, null = unpack(block.as_py())
                level = np.zeros(len(data) + 1, np.int32)
                earlier = [np.zeros(0, np.int32)]
                for c in map(unpack, cuts or []):
                    if len(c) == 1:
                        earlier += c
                    else:
                        row, begin, end = c
                        np.add.at(level, offsets[row] + begin, 1)
                        np.add.at(level, offsets[row] + end, -1)
                if any(b"\x02" in m["_marks"] for m in marked_ranges or []):
                    found = anchors(data, offsets, length)
                    at, first, last, row = (x[marked(found, marked_ranges)[1] == 2] for x in found[:4])
                    start, row, number, _, _, least = hot_windows(data, at, first, last, row, ids, length)
                    hit = np.isin(number, np.concatenate(earlier)) | (ids[row] > least[number])
                    np.add.at(level, start[hit], 1)
                    np.add.at(level, start[hit] + length, -1)
                gone = np.cumsum(level[:-1]) > 0
                raw, made = data, []
                for r in range(len(ids)):
                    a, z = offsets[r], offsets[r + 1]
                    g = gone[a:z]
                    kept = raw[a:z][~g].tobytes()
                    spans = int(g[0]) + int(((~g[:-1]) & g[1:]).sum()) if len(g) else 0
                    made.append((int(z - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=null.astype(bool)), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), *([pa.array(columns[4], pa.binary())] if with_text else [])],
                    names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])],
                )

    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    result = stored.join(marks, "_piece", "left").join(stretches, "_piece", "left").select("_block", "_marks", "_cuts").mapInArrow(to_result, schema)
    return result.select(F.col("_id").cast(id_kind).alias(id_col), *result.columns[1:])


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches with the same first column, without that column."""
    number, held = None, []
    for b in batches:
        for first, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if first != number:
                if held:
                    yield number, held
                number, held = first, []
            held.append(tuple(rest))
    if held:
        yield number, held
