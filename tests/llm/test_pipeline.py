import random

import numpy as np
import pytest

import corpus_pipeline
from linkforge.llm import toxicity
from linkforge.llm.textbytes import utf8


def test_stages(spark, tmp_path):
    rows = [(i, f"document {i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 10) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 10), (101, None, "en", None, 0), (102, "", None, "s1", 0)]
    rows += [(200 + i, f"t{i}a t{i}b nastyword t{i}c t{i}d", "en", "s2", 10) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "mixing", "encoding"]
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{k}")
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        if k < 4:
            assert now.columns == docs.columns
        kept.append(now.collect())
    assert {r.doc_id for r in kept[0]} == {r[0] for r in rows if r[0] < 200}
    # Document 100 is nothing but a copy; those that were empty before stay.
    assert {r.doc_id for r in kept[1]} == {r[0] for r in rows if r[0] < 200} - {100}
    assert {r.doc_id for r in kept[2]} == {r[0] for r in rows if r[0] < 200} - {100}
    words = sum(len(r.text.split()) for r in kept[3])
    assert abs(words - sum(len((r.text or "").split()) for r in kept[2])) <= 3 * 128
    assert len(kept[4]) == len(kept[3]) and all(r.n_tokens == len(r.ids) for r in kept[4])


def test_stages_of_clashing_columns(spark, tmp_path):
    names = ["score", "_text", "n_lines", "n_removed_lines", "n_runs", "longest_run", "n_toxic_tokens", "_cuts", "_id", "_th", "_node", "_k0", "_runs", "_doc", "_source", "size"]
    long = "very " * 150_000 + "long"
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", None, 0), (4, long, "en", "b", len(long)), (None, "no id at all", "en", "a", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{i} as {n}" for i, n in enumerate(names)))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert now.columns == docs.columns and all(r[n] == i for r in now.collect() for i, n in enumerate(names))
    words = lambda t: len((t or "").split())
    mixed = spark.read.parquet(str(tmp_path / "stage3")).collect()
    near = spark.read.parquet(str(tmp_path / "stage2")).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "2", "3", "4", "None"]
    assert abs(sum(words(r.text) for r in mixed) - sum(words(r.text) for r in near)) <= 3 * 128 and {r.doc_id for r in mixed} <= {1, 4, None}
    assert now.count() == len(mixed)


def test_stages_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.collect() == []


def test_run_writes_each_stage(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda s, docs, d: seen.append(docs.inputFiles()) or docs.where("doc_id < 3")) for name in ("stage one", "two")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert all("documents.parquet" in f for f in seen[0]) and all("/stage-one-" in f and folder.split(":")[-1] in f for f in seen[1])
    assert all("/two-" in f for f in out.inputFiles())


def brute_toxic(crf, text):
    """A document's score by the plain forward-backward recursion, token by token."""
    import pyarrow as pa

    data, offsets = utf8(pa.array([text or ""]))
    _, _, _, features = toxicity.token_features(data, offsets)
    weight = dict(zip(crf.at.tolist(), crf.weights.tolist()))
    score = [min(30.0, max(-30.0, crf.bias + sum(weight.get(f, 0.0) for f in row))) for row in features.tolist()]
    a, e = np.exp(crf.trans), [np.array([1.0, np.exp(s)]) for s in score]
    p = []
    if e:
        f = [e[0] * [1.0, np.exp(crf.start)]]
        for x in e[1:]:
            f.append((f[-1] / f[-1].sum()) @ a * x)
        b = [np.ones(2)]
        for x in e[:0:-1]:
            b.append(a @ (x * b[-1] / b[-1].sum()))
        m = [u * v for u, v in zip(f, b[::-1])]
        p = [v[1] / v.sum() for v in m]
    c, n, top = crf.doc
    return 1 / (1 + np.exp(-(c + n * np.log1p(sum(x >= 0.5 for x in p)) + top * max(p, default=0.0))))


def test_stages_against_brute_force(spark, tmp_path):
    near = pytest.importorskip("test_near_and_bpe")
    lines = pytest.importorskip("test_exact_and_lines")
    from tokenizers import Tokenizer

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(120)]
    for i in range(0, 60):
        w = texts[i].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [f"{word()} {word()}\n{passage}\n{word()}" for _ in range(5)] + ["one line\nanother line\n" + t for t in texts[60:70]] + [None, "", " \n"]
    texts += [" ".join([word(), rng.choice(["nastyword", "vileword"]), word(), "nastyword", word()]) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    toxic = {i for i, t in enumerate(texts) if t and "nastyword" in t}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    def staged(k, before):
        corpus_pipeline.STAGES[k][1](spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        return spark.read.parquet(str(tmp_path / f"stage{k}"))

    held = lambda df: {r.doc_id: r.text for r in df.collect()}
    whole = held(docs)
    crf = toxicity.fit(docs, labels)
    one = staged(0, docs)
    assert held(one) == {i: t for i, t in whole.items() if brute_toxic(crf, t) < 0.7} and not toxic & set(held(one))
    two = staged(1, one)
    kept = lines.brute_lines(list(held(one).items()), 2, 50)
    want = {i: t for i, t in held(one).items() if not (t or "").split()} | {i: kept[i] for i, t in held(one).items() if (t or "").split() and kept[i].split()}
    assert held(two) == want and sum(passage in (t or "") for t in want.values()) == 1
    three = staged(2, two)
    classes = near.brute_classes(sorted(want.items()))
    assert set(held(three)) == set(classes.values()) and held(three) == {i: want[i] for i in held(three)}
    four = staged(3, three)
    size = {i: len((t or "").split()) for i, t in held(three).items()}
    got: dict[int, int] = {}
    for r in four.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert all(part in held(three)[r.doc_id] for part in r.text.split("\n") if len(held(three)[r.doc_id].split("\n")) == 1)
    assert abs(sum(got.values()) - sum(size.values())) <= 3 * 128 and all(n <= 3 * size[i] for i, n in got.items())
    library = Tokenizer.from_file(near.PATH)
    ids = sorted(tuple(library.encode(r.text, add_special_tokens=False).ids) for r in four.collect())
    assert sorted(tuple(r.ids) for r in staged(4, four).collect()) == ids
