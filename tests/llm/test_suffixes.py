import hashlib
import random

import numpy as np
import pytest

from linkforge.llm import suffix_dedup as sd

LENGTH = 50


def brute(rows):
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), (1 << 62) if i is None else i
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            first[w] = min(first.get(w, 1 << 63), k)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), (1 << 62) if i is None else i
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < k:
                gone[p : p + LENGTH] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    random.seed(4)
    words = ["the", "of", "and"] + ["".join(random.choice("abcdeé") for _ in range(random.randint(2, 8))) for _ in range(40)]
    base = [" ".join(random.choice(words) for _ in range(random.randint(0, 150))) for _ in range(30)]
    rows = []
    for _ in range(150):
        t, kind = random.choice(base), random.random()
        if kind < 0.3:
            a, u = random.randint(0, len(t)), random.choice(base)
            t = t[:a] + u[random.randint(0, len(u)) :][:300] + t[a:]
        elif kind < 0.5:
            t = " ".join(random.choice(words) if random.random() < 0.03 else w for w in t.split())
        elif kind < 0.6:
            t = random.choice(["a", "ab\x00", "é"]) * random.randint(0, 200)
        elif kind < 0.64:
            t = None
        rows.append((None if random.random() < 0.02 else random.randint(0, 140), t))
    return rows + rows[:3]


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, _piece binary").repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, sd.suffix_dedup(df).collect()), key=str) == want
    # The same in many small pieces and with nearly every anchor treated as a hot one.
    assert sorted(map(tuple, sd.suffix_dedup(df, piece_bytes=5000, hot_from=5).collect()), key=str) == want
    assert sd.suffix_dedup(df.limit(0)).collect() == []


def test_hot_passages_and_long_texts(spark):
    # A passage in every document, ids that repeat over pieces, nulls and a text of a megabyte that holds it often.
    random.seed(9)
    passage = "a passage that every single document has, of far more than fifty bytes in all"
    rows = [(random.choice([None, i, i // 3]), f"{i} " * random.randint(0, 40) + passage + f" {i}" * random.randint(0, 5)) for i in range(300)]
    rows += [(150, " ".join(f"x{j} {passage if j % 500 == 0 else j}" for j in range(60_000)))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _id int, _marks int").repartition(4)
    want = brute(rows)
    for hot_from in (3, 100, 1 << 40):
        assert sorted(map(tuple, sd.suffix_dedup(df, piece_bytes=3000, hot_from=hot_from).collect()), key=str) == want, hot_from


def test_windows_whose_hashes_meet_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabcabdabc\x00\x00\x00", np.uint8)
    start = np.arange(len(data) - 2)
    for name in (np.zeros(len(start), np.uint64), np.array([hash(data[s : s + 3].tobytes()) % (1 << 60) for s in start], np.uint64)):
        number = sd.numbered(data, start, 3, name)
        for i in start:
            for j in start:
                assert (number[i] == number[j]) == (data[i : i + 3].tobytes() == data[j : j + 3].tobytes())


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        sd.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_kept_bytes(spark):
    passage = "one passage that is certainly longer than fifty bytes, in both of the texts"
    got = {r.doc_id: bytes(r.kept) for r in sd.suffix_dedup(spark.createDataFrame([(1, passage), (2, f"before {passage} after")], "doc_id int, text string"), with_text=True).collect()}
    assert got == {1: passage.encode(), 2: b"before  after"}


def test_merge_is_a_sort():
    random.seed(1)
    runs, every = [], []
    for n in range(5):
        keys = np.array([[random.choice(b"ab") for _ in range(20)] + [7] for _ in range(random.randint(1, 60))], np.uint8)
        k = len(keys)
        runs.append(sd.Run(sd.make_run(keys, np.arange(k), np.zeros(k, np.int64), np.arange(k), np.arange(k), np.zeros(k, bool))))
        every += sorted({x.tobytes() for x in keys})
    got, before = [], b""
    for number, shared in sd.merge(runs):
        key = runs[number].key
        same = next((i for i, (a, b) in enumerate(zip(before, key)) if a != b), min(len(before), len(key)))
        assert not before or shared == same
        got.append(key)
        before = key
    assert got == sorted(every)
