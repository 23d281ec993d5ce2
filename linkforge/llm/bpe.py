"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks, so that a passage shared by many documents gives the same
chunks wherever it stands. A chunk is encoded once and kept. A cut may fall inside a word, so a chunk is kept as the
word fragment before its first blank, the ids of the whole words in it, and the fragment after its last blank;
at each join the two fragments are put together and encoded again, over as many chunks as the word spans. Then the text from
the last whole word before the join to the first one after it is encoded as it stands: where its ids are not those
of the parts, the window grows to the whole text, whose ids are right by themselves.

Chunks are shared by the documents that one Python worker reads, through a store of bounded size. README says what sharing
them over the cluster would move and save.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import arrow_batches, pieces, rolling, tidy, utf8

BLANKS = " \t\n\x0b\x0c\r"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
#: Blanks for str.split() that are no blanks here.
ODD_BLANKS = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: Bytes without which a text has none of them.
_ODD_BYTES = (*(bytes([c]) for c in range(0x1C, 0x20)), *(c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, 0x205F, 0x3000))), b"\xe2\x80")
_IDS = np.dtype("<i4")


def cut_points(data: np.ndarray, offsets: np.ndarray, window: int = 16, bits: int = 9, seed: int = 3) -> np.ndarray:
    """Ends of chunks in a buffer of whole texts: where the hash of the last `window` bytes ends in `bits` zeros, and at each text's end.

    Cuts depend on content alone; one that would split a character moves to the character's end.
    """
    ends = [offsets[1:]]
    if len(data) > window:
        hit = (rolling(data, window, seed)[:-1] & np.uint64((1 << bits) - 1)) == 0
        at = np.flatnonzero(hit) + window
        for _ in range(3):
            at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
        ends.append(at[at < len(data)])
    return np.unique(np.concatenate(ends))


def split_words(text: str) -> list[str]:
    """The words between blanks, in order."""
    return text.split() if not ODD_BLANKS.search(text) else [w for w in BLANK.split(text) if w]


class ChunkEncoder:
    """Encodes batches of texts with kept chunks and words; what it keeps is bounded, results do not depend on it.

    Words are kept in two halves: when the newer one is full the older one goes, and words that are met again move over.
    """

    def __init__(self, path: str, max_words: int = 400_000, max_chunks: int = 15_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = ("ab", "Zq", "7", "é!", "x's")
        for a in probe:
            for b in probe:
                if self._ids(f"{a} {b}") != self._ids(a) + self._ids(b) or self._ids(f"{a}\n \t{b}") != self._ids(a) + self._ids(b):
                    raise ValueError("chunks can be joined only for a tokenizer that drops blanks between words")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: First fragment, ids of the whole words (None without a blank), last fragment, and for the joins: the text up to the
        #: end of the first whole word, its ids, the text from the last whole word on, its ids.
        self.chunks: dict[bytes, tuple[str, bytes | None, str, str, bytes, str, bytes]] = {}
        self.max_words, self.max_chunks = max_words, max_chunks
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [str(i) for i in range(size)]
        # Without a decoder the library puts a blank between tokens; a table of them does the same faster.
        self.tokens = None if self.tokenizer.decoder is not None else [self.tokenizer.id_to_token(i) or "" for i in range(size)]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, _IDS).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = self.older.get(word) or self._ids(word)
        return ids

    def _encode_words(self, words: list[str], together: int = 100) -> None:
        """Keeps the ids of words. Many are encoded as one text, and the tokens' places in it tell which word they are of."""
        for i in range(0, len(words), together):
            some = words[i : i + together]
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ids = np.array(found.ids, _IDS).tobytes()
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            at = (np.searchsorted(places, starts) * _IDS.itemsize).tolist()
            for w, a, b in zip(some, at, at[1:]):
                self.words[w] = ids[a:b]

    def _learn(self, new: list[bytes], odd: bool) -> None:
        """Keeps the chunks in `new`; their unknown words are encoded together. odd: whether there are ODD_BLANKS."""
        parts = []
        missing: dict[str, None] = {}
        known = self.words.get
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            body = split_words(text) if odd else text.split()
            head = tail = ""
            if not text or len(body) == 1 and len(body[0]) == len(text):
                parts.append((text, None, "", text, None))
                continue
            if text[0] not in BLANKS:
                head = body.pop(0)
            if body and text[-1] not in BLANKS:
                tail = body.pop()
            ids = list(map(known, body))
            if None in ids:
                for k, w in enumerate(body):
                    if ids[k] is None:
                        old = self.older.get(w)
                        if old is None:
                            missing[w] = None
                        else:
                            ids[k] = self.words[w] = old
            parts.append((head, body, tail, text, ids))
        self._encode_words(list(missing))
        for chunk, (head, body, tail, text, ids) in zip(new, parts):
            if body:
                if None in ids:
                    ids = [self.words[w] if x is None else x for w, x in zip(body, ids)]
                front = text[: text.index(body[0], len(head)) + len(body[0])]
                back = text[text.rindex(body[-1], 0, len(text) - len(tail)) :]
                self.chunks[chunk] = (head, b"".join(ids), tail, front, ids[0], back, ids[-1])
            elif body is None:
                self.chunks[chunk] = (head, None, "", text, b"", text, b"")
            else:
                blank = text[len(head) : len(text) - len(tail)]
                self.chunks[chunk] = (head, b"", tail, head + blank, b"", blank + tail, b"")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a buffer."""
        raw = data.tobytes()
        ends = cut_points(data, offsets)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        found = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        odd = any(x in raw for x in _ODD_BYTES) and ODD_BLANKS.search(raw.decode("utf-8", "replace")) is not None
        self._learn(list(dict.fromkeys(c for c in found if c not in self.chunks)), odd)
        last = np.searchsorted(ends, offsets, "left")  # index of the chunk that ends at each offset
        out, joins = [], []
        self._encode_words([w for w in self._fragments(found, starts, offsets) if w not in self.words and w not in self.older])
        for row in range(len(offsets) - 1):
            ids, fragment = [], ""
            before, window, want = False, "", b""
            if offsets[row] != offsets[row + 1]:
                first = int(np.searchsorted(ends, offsets[row], "right"))
                for chunk in found[first : int(last[row + 1]) + 1]:
                    head, body, tail, front, front_ids, back, back_ids = self.chunks[chunk]
                    fragment += head
                    window += front
                    if body is not None:
                        joined = self._word(fragment) if fragment else b""
                        if before:
                            joins.append((row, window, want + joined + front_ids))
                        ids += (joined, body)
                        fragment, before, window, want = tail, True, back, back_ids
                if fragment:
                    joined = self._word(fragment)
                    ids.append(joined)
                    if before:
                        joins.append((row, window, want + joined))
            out.append(np.frombuffer(b"".join(ids), _IDS))
        for row in self._disagreeing(joins):
            out[row] = np.frombuffer(self._ids(raw[offsets[row] : offsets[row + 1]].decode("utf-8", "replace")), _IDS)
        if len(self.words) > self.max_words // 2:
            self.words, self.older = {}, self.words
        if len(self.chunks) > self.max_chunks:
            for key in list(islice(self.chunks, len(self.chunks) - self.max_chunks // 2)):
                del self.chunks[key]
        return out

    def _fragments(self, found: list[bytes], starts: np.ndarray, offsets: np.ndarray) -> dict[str, None]:
        """The words that lie across joins, put together, and those at the ends of texts."""
        words: dict[str, None] = {}
        begins = set(offsets.tolist())
        fragment = ""
        for chunk, start in zip(found, starts.tolist()):
            if start in begins:
                words[fragment] = None
                fragment = ""
            head, body, tail = self.chunks[chunk][:3]
            fragment += head
            if body is not None:
                words[fragment] = None
                fragment = tail
        words[fragment] = None
        words.pop("", None)
        return words

    def _disagreeing(self, joins: list[tuple[int, str, bytes]], together: int = 32) -> set[int]:
        """Rows with a join (row, text around it, ids put together) whose text has other ids. Many joins are looked at together first."""
        rows = set()
        for i in range(0, len(joins), together):
            some = joins[i : i + together]
            if self._ids("\n".join(w for _, w, _ in some)) != b"".join(want for _, _, want in some):
                rows |= {row for row, w, want in some if self._ids(w) != want}
        return rows

    def forget(self) -> None:
        """Drops what was kept of texts."""
        self.words, self.older, self.chunks = {}, {}, {}

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if self.tokens is not None:
            return [" ".join(map(self.tokens.__getitem__, x.tolist())) for x in ids]
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def decimal(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_encoders: dict[str, ChunkEncoder] = {}


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encodes and decodes every whole text: the id and the chosen outputs for each row of `docs`.

    outputs: n_tokens, ids (array of int), decoded (the library's decode of the ids), ids_sha256 (of the decimal ids
    joined by one blank) and decoded_sha256. ids equal those of the tokenizers library without special tokens,
    truncation or padding. A null text is empty and has no ids; rows are independent, so null or repeated ids
    and repeated rows change nothing; other columns are ignored; an empty table gives an empty result.
    path: the tokenizer's file, the same on every executor.
    """
    arrow_batches(docs.sparkSession)
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    id_kind = docs.select(id_col).schema[0].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = ChunkEncoder(path)
        # What is kept has no cycles, and walking it for some would take a quarter of the time. The worker goes on as before.
        collects = gc.isenabled()
        gc.disable()
        try:
            yield from encoded(encoder, batches)
        finally:
            # A task's share of the corpus has more new words than the store holds: little is lost, and the next stage gets the room.
            encoder.forget()
            if collects:
                gc.enable()

    def encoded(encoder: ChunkEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for batch in batches:
            for piece in pieces(batch, "_text"):
                ids = encoder.encode(*utf8(piece.column("_text")))
                made: dict[str, list] = {"n_tokens": [len(x) for x in ids]}
                if "ids" in outputs:
                    made["ids"] = ids
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = [sha(encoder.decimal(x)) for x in ids]
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    made["decoded"] = encoder.decode(ids)
                    made["decoded_sha256"] = [sha(x) for x in made["decoded"]]
                yield pa.RecordBatch.from_arrays([piece.column("_id"), *(pa.array(made[o], kinds[o][1]) for o in outputs)], names=[id_col, *outputs])

    own = docs.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text")
    return own.mapInArrow(run, ", ".join([f"`{id_col}` {id_kind}", *(f"{o} {kinds[o][0]}" for o in outputs)]))
