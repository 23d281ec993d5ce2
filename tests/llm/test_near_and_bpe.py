import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkforge.llm import bpe, near_dedup as nd
from linkforge.llm.textbytes import pieces, utf8

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def bag(t):
    w = t.split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def buffer(texts):
    return utf8(pa.array(texts, pa.string()))


def test_signature_is_unbiased():
    random.seed(2)
    errors = []
    for _ in range(40):
        v = [str(random.randint(0, random.choice([5, 500]))) for _ in range(200)]
        u = [x if random.random() > 0.03 else "q" for x in v]
        r, h, c, _ = nd.shingles(*buffer([" ".join(v), " ".join(u)]))
        s = nd.bag_minhash(r, h, c, 2, m=1200)
        j = jaccard(bag(" ".join(v)), bag(" ".join(u)))
        errors.append((s[0] == s[1]).mean() - j)
        assert nd.overlap(nd.multiset(" ".join(v).encode()), nd.multiset(" ".join(u).encode())) == pytest.approx(j)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.06


def test_signature_of_weights_within_a_strip():
    # One element with different counts: the chance to agree is the ratio of the counts, whatever strip they lie in.
    for a, b in ((1, 2), (3, 4), (5, 8), (6, 7), (9, 16), (100, 130)):
        agree = []
        for seed in range(60):
            h = near_hash(seed)
            s = nd.bag_minhash(np.array([0, 1]), np.array([h, h]), np.array([a, b]), 2, m=64)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - a / b) < 0.05, (a, b)


def near_hash(seed):
    return np.random.default_rng(seed).integers(0, 1 << 63, dtype=np.uint64)


def brute_signature(h, count, m):
    """First times of the components over all points of all processes, found by walking each tree to its leaves."""
    best = np.full(m, np.inf)
    one = lambda x: np.array([x])

    def walk(x, low, width, time, point, c):
        if low >= c or time > 60:
            return
        key = nd._process(one(x), one(low), one(width))[0]
        if width == 1:
            k = 0
            while time < 60:
                component = int((int(nd.mix(one(point) + nd.U64(0x632BE59BD9B4E019))[0]) >> 32) * m >> 32)
                best[component] = min(best[component], time)
                k += 1
                with np.errstate(over="ignore"):
                    point = nd.mix(one(key) + nd.U64(k) * nd.U64(nd._STEP))[0]
                time += nd._first_time(one(point), 1)[0]
            return
        half, right = width // 2, int(nd.mix(one(key) ^ nd.U64(0x632BE59BD9B4E019))[0]) & 1
        walk(x, low + right * half, half, time, point, c)
        own = nd._process(one(x), one(low + (1 - right) * half), one(half))[0]
        walk(x, low + (1 - right) * half, half, time + nd._first_time(one(own), half)[0], own, c)

    for x, c in zip(h, count):
        low, width = 0, 1
        while low < c:
            key = nd._process(one(x), one(low), one(width))[0]
            walk(x, low, width, nd._first_time(one(key), width)[0], key, c)
            low, width = low + width, max(1, low + width)
    return (nd.mix(best.view(nd.U64)) & nd.U64(0xFFFF)).astype(np.uint16)


def test_signature_against_all_points():
    h, count = np.array([near_hash(s) for s in range(5)]), np.array([1, 3, 6, 13, 2])
    assert (nd.bag_minhash(np.zeros(5, int), h, count, 1, m=16)[0] == brute_signature(h, count, 16)).all()


def test_banding():
    assert nd.banding(0.8) == (24, 5) and nd.banding(0.7) == (40, 3)
    for s in (0.3, 0.5, 0.9, 0.95, 1.0):
        bands, size = nd.banding(s)
        assert bands * size <= nd.SIZE and ((1 - s**size) ** bands <= nd.MISS or size == 1)


def test_histogram_bounds_the_overlap():
    random.seed(6)
    for _ in range(50):
        a, b = (" ".join(random.choice("abc") if random.random() < p else "z" for _ in range(random.randint(1, 900))) for p in (0.05, 0.3))
        x, y = nd.multiset(a.encode()), nd.multiset(b.encode())
        hx, hy = (np.frombuffer(nd.histogram(v), np.uint8) for v in (x, y))
        over = [int(v[1].sum()) - int(h.sum(dtype=int)) for v, h in ((x, hx), (y, hy))]
        most = nd.most_overlap(hx[None, :], np.array(over[:1]), hy, over[1])[0]
        assert most >= sum((bag(a) & bag(b)).values())


def brute_classes(rows):
    bags = [bag(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and root(i) != root(j) and jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def near_fixture():
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(random.randint(20, 120))) for _ in range(12)]
    rows = []
    for i in range(160):
        w = random.choice(base).split()
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(200 + i, t) for i, t in enumerate(["", None, "  ", "a b", "a b", "a  b\n", "x", "x x x x x x x", "x x x x x x x x"])]
    return rows


def test_near_classes_against_brute_force(spark):
    rows = near_fixture()
    df = spark.createDataFrame([(i, t, t, i) for i, t in rows], "doc_id long, text string, _node string, a long")
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.class_size) for r in nd.near_classes(df).collect()}
    sizes = Counter(want.values())
    assert got == {d: (c, sizes[c]) for d, c in want.items()}
    # Lower similarities have bands of their own.
    bags = {i: bag(t or "") for i, t in rows}
    low = {r.doc_id: r.class_id for r in nd.near_classes(df, similar=0.6).collect()}
    assert all(low[a] == low[b] for a in bags for b in bags if a < b and bags[a] and jaccard(bags[a], bags[b]) >= 0.6)
    # Small cells give the same.
    assert {r.doc_id: r.class_id for r in nd.near_classes(df, cell=3).collect()} == want
    kept = nd.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.class_id, r.class_size) for r in nd.near_classes(df).collect())
    assert got == [("1", 1, 3), ("1", 1, 3), ("2", 2, 1), ("2", 2, 1), ("None", 1, 3)]
    assert sorted(r.doc_id for r in nd.near_dedup(df).collect()) == [1, 2]
    assert nd.near_classes(df.limit(0)).collect() == []


def test_near_classes_of_long_texts_and_large_groups(spark):
    # Two near copies of a very long text, a large group of exact copies and a chain of near ones, with columns of names used inside.
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    long = [word() for _ in range(60_000)]
    other = list(long)
    for i in range(0, 60_000, 600):
        other[i] = word()
    chain, w = [], [word() for _ in range(120)]
    for _ in range(40):
        w = list(w)
        w[random.randrange(120)] = word()
        chain.append(" ".join(w))
    rows = [(1, " ".join(long)), (2, " ".join(other))] + [(10 + i, "the very same text in many rows of the table") for i in range(300)] + [(1000 + i, t) for i, t in enumerate(chain)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, class_id int, _key int, _sig int, _th int")
    got = {r.doc_id: (r.class_id, r.class_size) for r in nd.near_classes(df, cell=7).collect()}
    assert got[1] == got[2] == (1, 2) and {got[10 + i] for i in range(300)} == {(10, 300)} and {got[1000 + i] for i in range(40)} == {(1000, 40)}
    kept = nd.near_dedup(df)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == [1, 10, 1000]


def odd_texts():
    random.seed(1)
    out = ["", None, "  ", "a", "é" * 50, "Don't STOP'S á x\u0301" * 20, "\x1cfoo\x85bar\xa0baz qux\u3000z" * 9, "<|startoftext|>hi <|endoftext|>" * 7, "ΣΣ İI " * 30, "a\u0000b c" * 40, "\U0001f600\U0001f600" * 100, "\u0301 \u0301a" * 60]
    return out + ["".join(random.choice("ab \n\t'sA1!é\u0301\xa0<|>\U0001f642") for _ in range(random.randint(0, 600))) for _ in range(200)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(PATH), odd_texts()
    encoder = bpe.ChunkEncoder(PATH, max_words=50, max_chunks=10)
    got = []
    for piece in pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]), "t", 2000):
        got += encoder.encode(*utf8(piece.column("t")))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in got] == want
    assert encoder.decode(got) == [library.decode(w, skip_special_tokens=False) for w in want]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "a b", [1])] * 2, "doc_id long, text string, ids array<int>")
    rows = bpe.bpe(df, PATH).collect()
    assert len(rows) == len(texts) + 2
    assert all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in rows if r.doc_id is not None)
    assert bpe.bpe(df.limit(0), PATH).collect() == []


def test_joins_that_disagree_are_encoded_again():
    from tokenizers import Tokenizer

    library, text = Tokenizer.from_file(PATH), " ".join(f"wordy{i} and" for i in range(300))
    encoder = bpe.ChunkEncoder(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(*buffer([text]))[0].tolist() == want
    # Fragments at joins that are encoded wrongly do not come through.
    encoder._word = lambda w: b"\0\0\0\0"
    assert encoder.encode(*buffer([text, "x y", None]))[0].tolist() == want
    long = "".join(f"unbroken{i}" for i in range(20_000)) + " end " + "\u3000x " * 1000
    for t in (long, " ".join([long, text, long])):
        assert bpe.ChunkEncoder(PATH).encode(*buffer([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_chunks_are_shared():
    passage = " ".join(f"word{i}" for i in range(400))
    encoder = bpe.ChunkEncoder(PATH)
    encoder.encode(*buffer([passage]))
    before = len(encoder.chunks)
    encoder.encode(*buffer([f"other beginning {passage}"]))
    assert before > 5 and len(encoder.chunks) - before <= 2


def test_pairs_across_classes_are_ruled_out_by_the_exact_bound_only():
    # Text 1 has text 0's histogram but shares two of its bands only; text 2 shares them too and overlaps too little.
    assert nd.banding(0.8) == (24, 5)
    sig = np.zeros((3, nd.SIZE), np.uint16)
    sig[1:] = np.arange(1, nd.SIZE + 1)
    sig[1:, 10:20] = 0
    bins = np.full((3, nd.BINS), 2, np.uint8)
    bins[2, ::2] = 0
    total, over = bins.sum(1, dtype=np.int64), np.zeros(3, np.int64)
    at = np.array([1, 2])
    assert nd.possible(at, 0, 2, sig, bins, over, total, 0.8).tolist() == [1]
    assert nd.possible(at, 0, 3, sig, bins, over, total, 0.8).tolist() == []
    assert nd.possible(at[:0], 0, 2, sig, bins, over, total, 0.8).tolist() == []
