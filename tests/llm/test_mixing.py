import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkforge.llm import mixing


def rows(spark, data):
    return spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in data], "doc_id long, text string, source string, n_chars long")


def corpus(n=300):
    rng = np.random.default_rng(1)
    return [(i, " ".join(f"w{i}_{j}" for j in range(int(rng.integers(0, 90)))), rng.choice(["a", "b", "c", "d"])) for i in range(n)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5], [0, 7], [5], [1, 1, 1, 1000]])
def test_water_filling(sizes):
    weights = [1.0 + i % 3 for i in range(len(sizes))]
    target = mixing.water_fill(sizes, weights)
    assert sum(target) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(target, sizes))
    free = [t / w for t, w, s in zip(target, weights, sizes) if t < 3 * s - 1e-9]
    assert not free or max(free) == pytest.approx(min(free))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    for seed in range(3):
        assert sorted(mixing.permuted(np.arange(n), n, seed)) == list(range(n))


def test_counts(spark):
    data = corpus() + [(900, None, "a"), (901, "", None), (902, "only words of no source " * 30, None), (903, "x y", "b"), (903, "x y", "b"), (None, "no id " * 20, "c")]
    out = mixing.mix_counts(rows(spark, data), block_words=8, shard_slots=256, rows_per_bucket=50)
    got = out.collect()
    assert len(got) == len(data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    assert sum({(r.source_size, r.target) for r in got} and [t for t in {round(r.target, 6) for r in got}]) > 0
    taken, target, source_of = Counter(), {}, {i: s for i, _, s in data}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.taken <= 3 * r.size
        taken[s] += r.taken
        target[s] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    assert [target[s] for s in order] == pytest.approx(brute_targets([sizes[s] for s in order], [1.0, 2.0, 3.0, 1.0, 2.0]))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 16
    again = mixing.mix_counts(rows(spark, data).repartition(5), block_words=8, shard_slots=256, rows_per_bucket=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_counts(rows(spark, [])).collect() == []


def test_texts_hold_what_counts_say(spark):
    data = corpus(80) + [(80, "same text here", "a"), (80, "same text here", "a")]
    options = dict(block_words=8, shard_slots=64, rows_per_bucket=20)
    counted = defaultdict(int)
    for r in mixing.mix_counts(rows(spark, data), **options).collect():
        counted[r.doc_id] += r.taken
    df = rows(spark, data)
    out = mixing.mix_texts(df, **options)
    assert out.columns == df.columns
    whole, found = {i: t for i, t, _ in data}, defaultdict(int)
    for r in out.collect():
        words = r.text.split()
        assert r.n_chars == len(r.text) and set(words) <= set(whole[r.doc_id].split())
        for part in re.split("\n", r.text):
            assert part in whole[r.doc_id]
        found[r.doc_id] += len(words)
    assert found == {k: v for k, v in counted.items() if v}


def test_small_mixes_are_drawn_too(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "w " * 640) for i in range(20)], "doc_id long, source string, text string")
    _, sources, slots = mixing.placed(docs, "doc_id", "source", "text", 64, 11, 1 << 16, 4_000)
    got = slots.groupBy("_shard", "_source").count().collect()
    total = sum(s[4] for s in sources)
    per_shard, per_source = Counter(), Counter()
    for r in got:
        per_shard[r["_shard"]] += r["count"]
        per_source[r["_source"]] += r["count"]
    # Every shard but the last is full, none is there to fill up, and each draws both sources.
    assert len(per_shard) >= mixing.LEAST_SHARDS and sorted(per_shard.values())[1:] == [total // mixing.LEAST_SHARDS] * (len(per_shard) - 1)
    assert per_source == {s[0]: s[4] for s in sources} and len(got) == 2 * len(per_shard)


@pytest.mark.parametrize("quotas, slots", [([500, 300, 200], 64), ([1, 0, 5, 1000], 100), ([7], 3), ([40, 40], 80)])
def test_shards_draw_from_a_multinomial_that_meets_the_quotas(quotas, slots):
    total = sum(quotas)
    shards = -(-total // slots)
    quotas = np.array(quotas)
    at = np.zeros(len(quotas), int)
    for n in range(shards):
        first, count = mixing.shard_draw(n, shards, slots, quotas, 4)
        assert (first == at).all() and count.sum() == min(slots, total - n * slots) and (count >= 0).all()
        at += count
    assert (at == quotas).all()
    # Means and spread over seeds are those of urns that are emptied: drawn by hand without putting back.
    if len(quotas) > 1 and shards > 1:
        counts = np.array([mixing.shard_draw(1, shards, slots, quotas, seed)[1] for seed in range(400)])
        urn = np.repeat(np.arange(len(quotas)), quotas)
        rng = np.random.default_rng(0)
        by_hand = np.array([np.bincount(rng.permutation(urn)[:slots], minlength=len(quotas)) for _ in range(400)])
        assert np.abs(counts.mean(0) - by_hand.mean(0)).max() < 0.1 * slots**0.5 + 0.05
        assert np.abs(counts.std(0) - by_hand.std(0)).max() < 0.15 * slots**0.5


def test_draws_of_very_many_slots_meet_the_quotas():
    quotas = np.array([3 * 10**11, 10**10, 5, 0, 2 * 10**11])
    rng = np.random.default_rng(1)
    for n in (1, 10**9, 255_000_000_003, 5 * 10**11):
        got = mixing.split_draw(quotas, n, rng)
        assert got.sum() == n and (got >= 0).all() and (got <= quotas).all()
        assert np.abs(got - quotas * (n / quotas.sum())).max() <= 10 * n**0.5


def brute_targets(sizes, weights):
    """The level that all sources not at 3 times their size share, found by halving."""
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * w, 3.0 * s) for s, w in zip(sizes, weights)) < sum(sizes) else (low, level)
    return [min(high * w, 3.0 * s) for s, w in zip(sizes, weights)]


def test_targets_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(100):
        sizes = [int(x) for x in rng.choice([0, 1, 3, 50, 10_000, 123_456], rng.integers(1, 9))]
        weights = [1.0 + i % 3 for i in range(len(sizes))]
        assert mixing.water_fill(sizes, weights) == pytest.approx(brute_targets(sizes, weights), abs=1e-6)


def test_texts_of_any_columns_and_lengths(spark):
    data = [(1, "long " * 300_000, "a", 1, "x", 5), (2, None, "a", 2, "y", 0), (3, "", None, 3, "z", 0), (4, "few words here", "b", 4, "w", 14), (4, "few words here", "b", 4, "w", 14)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, _cuts int, _k0 string, n_chars int")
    out = mixing.mix_texts(df)
    assert out.schema == df.schema
    counts = Counter()
    for r in mixing.mix_counts(df).collect():
        counts[r.doc_id] += r.taken
    found = Counter()
    for r in out.collect():
        assert (r["_cuts"], r["_k0"]) == {1: (1, "x"), 4: (4, "w")}[r.doc_id] and r.n_chars == len(r.text)
        found[r.doc_id] += len(r.text.split())
    assert found == {k: v for k, v in counts.items() if v} and counts[2] == counts[3] == 0
    assert mixing.mix_texts(df.limit(0)).collect() == []
