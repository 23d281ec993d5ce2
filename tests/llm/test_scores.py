import random
import zlib
from collections import Counter

import numpy as np
import pytest

from linkforge.llm import labelled, quality, quality_rules, toxicity


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(3)
    crf = toxicity.Crf(trans=rng.normal(size=(2, 2)), start=0.3)
    score, first = rng.normal(size=1000) * 3, rng.random(1000) < 0.02
    first[0] = True
    got = crf.marginals(score, first, width=16)
    cuts = [*np.flatnonzero(first), 1000]
    a = np.exp(crf.trans)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        e = np.stack([np.ones(hi - lo), np.exp(score[lo:hi])], 1)
        f = [e[0] * [1, np.exp(crf.start)]]
        for t in range(1, hi - lo):
            f.append((f[-1] / f[-1].sum()) @ a * e[t])
        b = [np.ones(2)]
        for t in range(hi - lo - 1, 0, -1):
            b.append(a @ (e[t] * b[-1] / b[-1].sum()))
        m = np.array(f) * np.array(b[::-1])
        assert np.allclose(got[lo:hi], m[:, 1] / m.sum(1))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(8)
    row = np.repeat([0, 1, 2, 3], [70, 1, 32, 45])
    begin, size, opens = toxicity.segments(row, 32)
    assert begin.tolist() == [0, 32, 64, 70, 71, 103, 135] and size.tolist() == [32, 32, 6, 1, 32, 32, 13] and opens.tolist() == [True, False, False, True, True, True, False]
    n, length = len(size), 32
    score, gold = rng.normal(size=(n, length)), rng.integers(0, 2, (n, length))
    before = np.where(opens, -1, rng.integers(0, 2, n))

    def loss(score, trans, start):
        """Less the log likelihood of the labels, by the plain forward sum over both states."""
        total = 0.0
        for s, y, k, b in zip(score, gold, size, before):
            e = lambda i: np.array([0.0, s[i]])  # noqa: B023, E731
            head = np.array([0.0, start]) if b < 0 else trans[b]
            f, path = head + e(0), (head + e(0))[y[0]]
            for i in range(1, k):
                f = np.log(np.exp(f[:, None] + trans).sum(0)) + e(i)
                path += trans[y[i - 1], y[i]] + e(i)[y[i]]
            total += np.log(np.exp(f).sum()) - path
        return total

    trans, start, h = rng.normal(size=(2, 2)), 0.4, 1e-5
    token, pairs, first = toxicity.gradient(toxicity.Crf(trans=trans, start=start), score, gold, size, before)
    for i, j in ((0, 0), (0, 31), (2, 5), (2, 6), (3, 0), (3, 1), (6, 12)):
        up = score.copy()
        up[i, j] += h
        assert token[i, j] == pytest.approx((loss(up, trans, start) - loss(score, trans, start)) / h, abs=1e-3)
    for i in range(2):
        for j in range(2):
            up = trans.copy()
            up[i, j] += h
            assert pairs[i, j] == pytest.approx((loss(score, up, start) - loss(score, trans, start)) / h, abs=1e-3)
    assert first == pytest.approx((loss(score, trans, start + h) - loss(score, trans, start)) / h, abs=1e-3)


def test_document_score_is_the_logistic_function_of_the_evidence(spark):
    crf = toxicity.Crf(bias=-2.0, trans=np.array([[0.0, 0.3], [0.1, 0.5]]), start=-1.0, doc=(-3.0, 1.5, 2.0))
    texts = ["a b c", "", None, "one", "x " * 300]
    got = {r.doc_id: r for r in toxicity.toxic_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crf).collect()}
    for i, t in enumerate(texts):
        p = crf.marginals(np.full(len((t or "").split()), -2.0), np.arange(len((t or "").split())) == 0)
        raw = -3.0 + 1.5 * np.log1p((p >= 0.5).sum()) + 2.0 * (p.max() if len(p) else 0.0)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-raw))) and got[i].n_toxic_tokens == (p >= 0.5).sum()


def labelled_corpus(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    rows, marks = [], []
    for i in range(900):
        w = [word() for _ in range(random.randint(5, 80))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(random.randint(1, 3)):
                w.insert(random.randrange(len(w)), random.choice(["Zwort", "qqmist" + word(), "zwort,"]))
        if bad:
            w = [f"{x}$$$" for x in w] if i % 2 else [w[0]] * len(w)
        rows.append((i, " ".join(w)))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(None, "a"), (5000, None), (5001, ""), (1, "repeated id")]
    marks += [(None, 1, 1), (5000, None, None), (7000, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m for m in marks}


def test_toxicity(spark):
    docs, labels, truth = labelled_corpus(spark)
    crf = toxicity.fit(docs, labels)
    got = toxicity.toxic_spans(docs, crf).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [r for r in got if r.doc_id is not None and 1 < r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.7) == bool(truth[r.doc_id][2]) for r in held]) > 0.93
    spans = [texts[r.doc_id][s.start : s.stop].lower() for r in held for s in r.spans]
    assert spans and np.mean([s.startswith(("zwort", "qqmist")) for s in spans]) > 0.85
    # Rows of any names pass through, clashing ones too, and very long texts are scored whole.
    odd = docs.selectExpr("doc_id", "text", "1 as score", "2 as _text", "3 as n_toxic_tokens", "4 as _k0").union(spark.createDataFrame([(9000, "clean " * 400_000 + "zwort", 1, 2, 3, 4)], "a long, b string, c int, d int, e int, f int"))
    left = toxicity.without_toxic(odd, crf, 0.7)
    assert left.schema == odd.schema and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.score < 0.7}
    kept = toxicity.toxic_spans(odd, crf, keep=("score", "_text"), spans=False)
    assert kept.columns == ["doc_id", "_text", "score", "n_toxic_tokens"] and {r.n_toxic_tokens for r in kept.where("doc_id = 9000").collect()} == {1}
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.n_toxic_tokens for r in toxicity.toxic_spans(docs, none).collect()} == {0}
    assert toxicity.toxic_spans(docs.limit(0), crf).collect() == []


def test_offsets_count_code_points(spark):
    docs, labels, _ = labelled_corpus(spark)
    crf = toxicity.fit(docs, labels)
    text = "Ééé ü \U0001f600 ZWORT end"
    r = toxicity.toxic_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), crf).first()
    assert [text[s.start : s.stop] for s in r.spans] == ["ZWORT"]


def test_quality(spark):
    docs, labels, truth = labelled_corpus(spark)
    ranking = quality.fit(docs, labels)
    got = quality.quality_scores(docs, ranking).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 1 < r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id][1]) for r in held]) > 0.95
    assert quality.quality_scores(docs, quality.fit(docs, labels.limit(0))).count() == docs.count()
    assert quality.quality_scores(docs.limit(0), ranking).collect() == []


def test_ranking_against_plain_newton_steps():
    rng = np.random.default_rng(3)
    k = len(quality.FEATURES)
    y = (np.arange(400) % 3 > 0).astype(int)
    x = rng.normal(size=(400, k)) + y[:, None] * np.linspace(-0.4, 0.8, k)
    got = quality.train(x, y, bad_share=0.25, pairs=3000)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    draw = np.random.default_rng(9)
    diff = z[draw.choice(np.flatnonzero(y == 1), 3000)] - z[draw.choice(np.flatnonzero(y == 0), 3000)]
    loss = lambda w: np.log1p(np.exp(-(diff @ w))).mean() + 0.5e-2 * w @ w
    w = np.zeros(k)
    for _ in range(30):
        lose = 1 / (1 + np.exp(diff @ w))
        hess = (diff * (lose * (1 - lose))[:, None]).T @ diff / len(diff) + 1e-2 * np.eye(k)
        w -= np.linalg.solve(hess, -(diff * lose[:, None]).mean(0) + 1e-2 * w)
    assert loss(got.weights) < loss(w) * 1.02 + 1e-4 and np.corrcoef(got.weights, w)[0, 1] > 0.99
    # The threshold is the quantile of the scores at the share of bad documents, each class weighted to its share.
    raw = got.raw(x)
    below = 0.25 * (raw[y == 0] < got.threshold).mean() + 0.75 * (raw[y == 1] < got.threshold).mean()
    assert below == pytest.approx(0.25, abs=0.01)


def test_quality_of_any_columns_lengths_and_ties(spark):
    docs, labels, _ = labelled_corpus(spark)
    ranking = quality.fit(docs, labels)
    rows = [(1, "good words here", 1, 2, 3), (1, "good words here", 1, 2, 3), (None, None, 1, 2, 3), (2, "word " * 400_000, 1, 2, 3), (3, "", 1, 2, 3)]
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, score int, raw int, _id int"), ranking).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"] and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and {r.score for r in got if r.doc_id == 3} == {r.score for r in got if r.doc_id is None}
    # A text at the threshold scores one half, whatever the slope, and scores keep the order of the ranking.
    x = np.array([[0.0] * len(quality.FEATURES), [1.0] * len(quality.FEATURES)])
    tie = quality.Ranking(np.zeros(16), np.ones(16), np.full(16, 0.25), 4.0, 3.0)
    assert tie.score(x)[1] == 0.5 and tie.score(x)[0] < 0.5


def test_held_out_labels_are_not_read(spark):
    docs, labels, truth = labelled_corpus(spark)
    _, counts = labelled.sample(docs, labels, "toxic", 10_000)
    open_ids = [i for i, m in truth.items() if i is not None and m[2] is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    assert counts == Counter(truth[i][2] for i in open_ids)
    picked = labelled.sample(docs.union(docs), labels, "toxic", 7)[0].collect()
    # One text for each id, however often the id or the row repeats.
    assert len({r._id for r in picked}) == len(picked) and max(Counter(r._label for r in picked).values()) <= 7
    assert {r._id for r in picked} <= set(open_ids) and all(r._label == truth[r._id][2] for r in picked)


def brute_rules(text):
    text = text or ""
    words = quality_rules.WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if quality_rules.WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_rules_against_brute_force(spark):
    random.seed(7)
    texts = [None, "", " \n ", "a b a b a b", "x\nx\n\nx", "#*$%&|<>", "a\u00a0b \x0bc"] + [" ".join(random.choice("abcdé") for _ in range(random.randint(0, 60))) + random.choice(["", "\na b"]) * 3 for _ in range(150)]
    prose = " ".join("".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 9))) for _ in range(900))
    texts += [prose, "same words " * 900, "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(3000)), prose[:2500] + "xy " * 6000]
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)] + [(None, "a", "v")] * 2, "doc_id long, text string, verdict string")
    got = quality_rules.compression_rules(df).collect()
    assert len(got) == len(texts) + 2
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
    n = len(texts)
    assert [by_id[i].verdict for i in range(n - 4, n)] == ["ok", "repetitive", "incompressible", "repetitive"]
    assert by_id[0].verdict == "empty" and quality_rules.compression_rules(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["Crf"])
def test_model_defaults(name):
    assert getattr(toxicity, name)().marginals(np.zeros(0), np.zeros(0, bool)).shape == (0,)


def test_a_text_is_judged_to_its_end(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(600)]
    prose = " ".join(rng.choices(vocabulary, k=3000))
    noise = "".join(rng.choices([chr(c) for c in range(33, 127)], k=2047))
    texts = [prose[:6144] + noise, prose[:6144] + "word " * 400, prose[:8191], prose[:6144], prose[:2048], prose[:2049]]
    got = {r.doc_id: (r.n_chunks, r.n_odd_chunks, r.verdict) for r in quality_rules.compression_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [(4, 1, "odd chunks")] * 2 + [(4, 0, "ok"), (3, 0, "ok"), (0, 0, "ok"), (2, 0, "ok")]


def test_limits_follow_the_corpus(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [prose(rng.randint(150, 1200)) for _ in range(1200)]
    tables = [" | ".join(rng.choices(vocabulary[:90], k=400)) for _ in range(40)]
    # A text that makes up a third of all rows does not narrow the band of its length.
    rows = texts + tables + [texts[0]] * 600 + ["", None, "long words " * 200_000]
    df = spark.createDataFrame([(i, t, 1.5, "x") for i, t in enumerate(rows)], "doc_id long, text string, ratio double, chunks string")
    got = {r.doc_id: r.verdict for r in quality_rules.compression_rules(df).collect()}
    assert sum(got[i] != "ok" for i in range(1200)) <= 6
    assert all(got[i] == "repetitive" for i in range(1200, 1240)) and [got[i] for i in range(1840, 1843)] == ["empty", "empty", "repetitive"]
    limits = quality_rules.fit_limits(quality_rules.measure(df))
    assert limits == quality_rules.fit_limits(quality_rules.measure(df.repartition(7)))
    # The quartiles by hand, for every class of enough distinct texts.
    press, by_class = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL), {}
    for t in set(texts + tables):
        n_words, *_, inside = brute_rules(t)
        if n_words < 50 or 2 * inside > n_words:
            continue
        n, ratio, _ = quality_rules.compress(t, press)
        by_class.setdefault(int(np.floor(4 * np.log2(n))), []).append(round(ratio, 3))
    own = {}
    for c, ratios in by_class.items():
        if len(ratios) >= quality_rules.ENOUGH:
            a, b = np.percentile(ratios, [25, 75])
            own[c] = min(a - 6.0 * (b - a), a / 1.05), max(b + 2.5 * (b - a), b * 1.05)
    for c, (low, high) in own.items():
        if c - 1 in own and c + 1 in own:
            low, high = min(low, (own[c - 1][0] + own[c + 1][0]) / 2), max(high, (own[c - 1][1] + own[c + 1][1]) / 2)
        assert limits.low[c] == pytest.approx(low) and limits.high[c] == pytest.approx(high)
    assert len(own) > 5 and quality_rules.fit_limits(quality_rules.measure(df.limit(0))) == quality_rules.Limits.fixed()


def test_fits_bound_their_samples_by_parameters(spark, monkeypatch):
    docs, labels, _ = labelled_corpus(spark)
    got, plain = {}, quality.train
    monkeypatch.setattr(quality, "train", lambda x, y, bad_share, pairs: got.update(pairs=pairs, x=x.shape, y=Counter(y.tolist())) or plain(x, y, bad_share, pairs))
    quality.fit(docs, labels, per_class=20, pairs=30)
    assert got == {"pairs": 30, "x": (40, len(quality.FEATURES)), "y": {0: 20, 1: 20}}
    texts = [r.text for r in docs.collect() if r.doc_id is not None and r.doc_id < 900]
    few, many = (toxicity.train(texts, [int(i % 5 == 0) for i in range(len(texts))], max_segments=n) for n in (4, 8000))
    assert len(few.at) < len(many.at)


def test_ranking_of_all_pairs_against_brute_force(spark):
    docs, labels, truth = labelled_corpus(spark)
    got = quality.fit(docs, labels)
    rows = quality.measured(docs.where("doc_id between 0 and 899 and text <> 'repeated id'")).collect()
    rows = [r for r in rows if zlib.crc32(str(r._id).encode()) % 3 != 1]
    # Of the two rows of id 1 the one with the least features counts.
    again = {r._id: min(list(o._x) for o in quality.measured(docs.where(f"doc_id = {r._id}")).collect()) for r in rows if r._id == 1}
    x, y = np.array([again.get(r._id, r._x) for r in rows]), np.array([truth[r._id][1] for r in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        lose = 1 / (1 + np.exp(diff @ w))
        hess = (diff * (lose * (1 - lose))[:, None]).T @ diff / len(diff) + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(hess, -(diff * lose[:, None]).mean(0) + 1e-2 * w)
    assert got.mean == pytest.approx(mean) and got.weights == pytest.approx(w, abs=2e-3)
    raw = np.sort(got.raw(x))
    bad = (y == 0).sum()
    assert got.threshold == pytest.approx((raw[bad - 1] + raw[bad]) / 2, abs=1e-9)


def test_value_in_a_place(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, 1e-300, -3.5, rng.gauss(0, 1), rng.gauss(0, 1e6)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "_raw double")
    assert all(quality.nth(df, n, few=3) == sorted(values)[n] for n in (0, 700, 1500, 2999))
