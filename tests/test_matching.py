import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st

from linkforge import queries
from linkforge.functions.words import ENGLISH, STOP_WORDS
from linkforge.operators import fuzzy, graph, groups, match, numbering, prepare, profile, report, sweep
from linkforge.plans import matching
from linkforge.plans.settings import ColumnConfig, MatchSettings

CONFIG = ColumnConfig(product=("product_name",), size="size", gtin=("gtin",), row_id="row_id")


@pytest.mark.parametrize(
    "a, b, want",
    [("organic olive oil", "olive oil extra virgin", 69.2308), ("cheddar cheese", "sharp cheddar", 70.0), ("organic milk", "whole milk", 57.1429), ("tomato sauce", "tomato basil sauce", 100.0), ("pasta penne", "penne pasta", 100.0), ("cocacola classic", "coke classic", 73.6842), ("apple", "banana", 18.1818), ("", "a", 0.0)],
)
def test_token_set_ratio(a, b, want):
    assert round(fuzzy.token_set_ratio(a, b), 4) == want
    assert round(fuzzy.token_set_ratio(b, a), 4) == want


@hypothesis_settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    assert fuzzy.lcs_length(a, b) == row[-1]


def rows(spark, data):
    return spark.createDataFrame(data, "row_id long, product_name string, size string, gtin string")


def test_both_ways_of_finding_candidates_agree(spark):
    random.seed(3)
    words = "red blue green bolt nut gear rod small large steel".split()
    data = [(i, " ".join(random.sample(words, random.randint(1, 4))), None, None) for i in range(60)] + [(60, None, None, None), (61, "", None, None)]
    df = rows(spark, data)
    low = MatchSettings(threshold=49.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=None)
    high = MatchSettings(threshold=55.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=None)
    every = {(r.left_id, r.right_id, r.confidence) for r in matching.match_within(df, CONFIG, low).collect() if r.confidence >= 55}
    assert every == {(r.left_id, r.right_id, r.confidence) for r in matching.match_within(df, CONFIG, high).collect()}
    assert all((b, a, c) in every for a, b, c in every)


def test_blend_of_all_scores(spark):
    left = rows(spark, [(1, "olive oil", "12 oz", "036000291453"), (2, "plain thing", None, None)])
    right = rows(spark, [(10, "olive oil", "12 oz", "036000291452"), (11, "unrelated words", "2 kg", "036000291452")])
    s = MatchSettings(threshold=30.0, w_tfidf=0.25, w_fuzzy=0.25, w_gtin=0.5, w_size=0.2)
    got = {(r.left_id, r.right_id): r for r in matching.match_between(right, left, CONFIG, CONFIG, s).collect()}
    best = got[(1, 10)]
    assert (best.gtin_score, best.gtin_match_type, best.size_score) == (92.0, "Corrected Match", 100.0)
    assert best.confidence == pytest.approx(0.8 * 96 + 20)
    # No word in common: the barcode alone makes the pair a candidate, and its text is scored too.
    assert got[(1, 11)].gtin_score == 92.0 and got[(1, 11)].fuzzy_score > 0
    assert [r.left_id for r in match.unmatched(left.withColumnRenamed("product_name", "name"), matching.match_between(right, left, CONFIG, CONFIG, s)).collect()] == [2]


def every_pair(rows, s):
    """All pairs of different rows at or above the threshold, scored one by one."""
    cleaned = [(i, " ".join(w for w in (n or "").lower().split() if w not in STOP_WORDS), b) for i, n, b in rows]
    count, n = Counter(), 2 * len(rows)
    for _, name, _ in cleaned:
        count.update(2 * [t for t in set(name.split()) if len(t) > 1 and t not in ENGLISH])

    def vector(name):
        v = {t: c * (math.log((1 + n) / (1 + count[t])) + 1) for t, c in Counter(t for t in name.split() if len(t) > 1 and t not in ENGLISH).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    out = {}
    for i, a, p in cleaned:
        for j, b, q in cleaned:
            if i != j:
                x, y = vector(a), vector(b)
                t = round(100 * sum(w * y.get(k, 0.0) for k, w in x.items()), 4)
                f = round(fuzzy.token_set_ratio(a, b), 4)
                size = 0.0
                if p is not None and q is not None:
                    apart = (max(p, q) - min(p, q)) * 100 / max(p, q) if max(p, q) else 0.0
                    size = round(max(0.0, 1 - apart / s.size_tolerance) * 100, 4)
                text = (t * s.w_tfidf + f * s.w_fuzzy) / (s.w_tfidf + s.w_fuzzy)
                c = round(min(100.0, text * (1 - s.w_size) + size * s.w_size), 6)
                if c >= s.threshold:
                    out[i, j] = c
    return out


@pytest.mark.parametrize("settings", [
    dict(threshold=60.0, w_tfidf=0.5, w_fuzzy=0.5), dict(threshold=40.0, w_tfidf=0.5, w_fuzzy=0.5), dict(threshold=50.0, w_tfidf=0.25, w_fuzzy=0.25, w_size=0.2),
    dict(threshold=45.0, w_tfidf=0.1, w_fuzzy=0.9, w_size=0.3), dict(threshold=20.0, w_tfidf=0.9, w_fuzzy=0.1, w_size=0.3), dict(threshold=70.0, w_tfidf=0.0, w_fuzzy=1.0), dict(threshold=0.0, w_tfidf=0.5, w_fuzzy=0.5),
])
def test_candidates_lose_no_pair(spark, settings):
    rng = random.Random(12)
    words = "red blue green bolt nut gear rod small large steel reed blues greens bolts nuts gears rods of x".split()
    data = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice([None, 0.0, 100.0, 104.0, 109.0, 119.0, 130.0])) for i in range(70)] + [(70, None, 100.0), (71, "aab", None), (72, "abb", None)]
    s = MatchSettings(**settings, w_gtin=0.0, max_matches=None)
    df = spark.createDataFrame([(i, n, None if b is None else f"{b} g") for i, n, b in data], "row_id long, product_name string, size string")
    out = matching.match_within(df, ColumnConfig(product=("product_name",), size="size"), s)
    got = {(r.left_id, r.right_id): r.confidence for r in out.collect()}
    want = every_pair(data, s)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    plan = out._jdf.queryExecution().toString()
    assert settings["threshold"] <= 0 or ("CartesianProduct" not in plan and "NestedLoop" not in plan)


def test_rows_that_score_alike_are_stood_for_by_the_first(spark):
    rng = random.Random(2)
    names, sizes_, codes = ["red bolt", "red bolts", "blue gear", "gear blue small"], ["10 g", "11 g", None], ["036000291452", "036000291453", None, None]
    left, right = (rows(spark, [(i, rng.choice(names), rng.choice(sizes_), rng.choice(codes)) for i in range(n)]) for n in (25, 60))
    for more in (dict(w_gtin=0.5, w_size=0.2), dict(w_gtin=0.0, sort_by="size_score", w_size=0.3), dict(w_gtin=0.5, min_fuzzy=80.0)):
        s = MatchSettings(**{**dict(threshold=40.0, w_tfidf=0.25, w_fuzzy=0.25, max_matches=3), **more})
        a, b = (prepare.prepare(df, CONFIG, s) for df in (left, right))
        every = match.top_k(match.scored_pairs(a, b, s), 3, s.sort_by).select("left_id", "right_id", "confidence").collect()
        got = match.top_k(match.scored_pairs(a, b, s, best=3), 3, s.sort_by).select("left_id", "right_id", "confidence").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, every)) and len(got) > 20


def test_candidate_mode_is_a_subset(spark):
    df = rows(spark, [(i, f"red bolt {i % 7} gear{i % 3}", None, None) for i in range(30)])
    s = dict(threshold=60.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=None)
    exact = {(r.left_id, r.right_id) for r in matching.match_within(df, CONFIG, MatchSettings(**s)).collect()}
    assert {(r.left_id, r.right_id) for r in matching.match_within(df, CONFIG, MatchSettings(**s, mode="candidates")).collect()} <= exact


def test_restrictions_treat_null_as_empty(spark):
    df = spark.createDataFrame([(1, "red bolt", "A"), (2, "red bolt", "a"), (3, "red bolt", None), (4, "red bolt", "")], "row_id long, product_name string, kind string")
    s = MatchSettings(threshold=60.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=None, restrictions=("kind",))
    got = {(r.left_id, r.right_id) for r in matching.match_within(df, ColumnConfig(product=("product_name",)), s).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_components_against_union_find(spark):
    random.seed(8)
    edges = [(random.randint(0, 120), random.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: root(n) for n in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_conservative_split(spark):
    members = spark.createDataFrame([(1, m) for m in (1, 2, 3, 4)], "group_key long, member_id long")
    pairs = [(1, 1, 2, 90.0), (1, 1, 3, 50.0), (1, 1, 4, 50.0), (1, 2, 3, 85.0), (1, 2, 4, 40.0), (1, 3, 4, 82.0)]
    got = groups.conservative_split(members, spark.createDataFrame(pairs, "group_key long, src long, dst long, score double"), 80.0)
    # 3 has the highest mean (72.3) and takes 2 and 4; 1 is left alone.
    assert {(r.group_key, r.member_id) for r in got.collect()} == {(2, 2), (2, 3), (2, 4)}


def test_sweeps_of_tables_without_groups(spark):
    df = rows(spark, [(1, "red bolt", None, None), (2, "blue gear", None, None)])
    s = MatchSettings(threshold=70.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=None, sweep=(70, 80))
    g = matching.group_within(df, CONFIG, s)
    evolved, summary = matching.explore(g, s)
    assert evolved.collect() == [] and [tuple(r) for r in summary.orderBy("threshold").collect()] == [(t, 0, 0, 0, 0.0, 2) for t in (70, 75, 80)]
    assert [tuple(r) for r in matching.explore_anew(g, s).orderBy("threshold").collect()] == [(t, 0, 0, 0, 0.0) for t in (70, 75, 80)]


def test_attributes_on_evolution_rows(spark):
    evolved = spark.createDataFrame([("G001", 70, 1), ("G001", 70, 9)], "group_id string, threshold int, member_id long")
    df = spark.createDataFrame([(1, "a", 5)], "row_id long, brand string, threshold int")
    out = sweep.with_attributes(evolved, df, "row_id", ["brand", "threshold", "absent"])
    assert sorted((r.member_id, r.brand, r.member_threshold) for r in out.collect()) == [(1, "a", 5), (9, None, None)]


def test_row_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert sorted((r.row_id, r.name) for r in prepare.with_row_id(df, ["name"]).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_numbers_follow_the_order_over_all_parts(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "hash(id) as h").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = numbering.numbered(df, ["h", "id"], "n").orderBy("n").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.n for r in got] == list(range(1, 5001)) and [(r.h, r.id) for r in got] == sorted((r.h, r.id) for r in got)
    assert numbering.numbered(df.where("id < 0"), ["h"], "n").collect() == []


def test_orders_of_a_report(spark):
    pairs = spark.createDataFrame([(1, 2, "b", "x", 70.0), (2, 1, "a", "y", 90.0), (3, 1, "a", "z", 90.0)], "left_id long, right_id long, left_name string, right_name string, confidence double")
    first = lambda order, n: [(r.place, r.left_id) for r in match.report_page(pairs, order, n).orderBy("place").collect()]
    assert first("confidence", 2) == [(1, 2), (2, 3)] and first("confidence_ascending", 1) == [(1, 1)]
    assert first("left_name", 3) == [(1, 2), (2, 3), (3, 1)] and [r.left_id for r in match.ordered(pairs, "right_name").collect()] == [1, 2, 3]


def test_detection(spark):
    df = spark.createDataFrame([(str(i), "x", f"c{i % 3}", f"00036000{i:04d}") for i in range(10)], "Product string, Description string, Category string, UPC string")
    assert profile.name_columns(df) == ["Product", "Description"]
    assert profile.restriction_columns(df) == ["Category"]
    assert profile.gtin_columns(df, "Product") == ["UPC"]
    found = ColumnConfig.detect(df, "Product")
    assert (found.product, found.gtin, found.restrictions) == (("Product", "Description"), ("UPC",), ("Category",))


def test_gtin_quality(spark):
    df = spark.createDataFrame([("036000291452",), ("036000291453",), ("1234567",), ("1234567890123",), ("n/a",), (None,)], "g string")
    got = report.gtin_quality(df, ["g"]).first().asDict()
    assert (got["total_products"], got["products_with_gtins"], got["valid_gtins"], got["correctable_gtins"], got["invalid_gtins"]) == (6, 4, 1, 2, 1)


def test_stream(spark, tmp_path):
    from linkforge.streaming.matching import match_stream

    source = tmp_path / "in"
    rows(spark, [(1, "red bolt", None, None)]).write.parquet(str(source))
    stream = spark.readStream.schema("row_id long, product_name string, size string, gtin string").parquet(str(source))
    found = []
    s = MatchSettings(threshold=60.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0)
    query = match_stream(stream, rows(spark, [(7, "bolt red", None, None)]), CONFIG, CONFIG, s, lambda df, _: found.extend(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert [(r.left_id, r.right_id) for r in found] == [(1, 7)]


def most_rows(df):
    """The most rows that an operator of the executed plan made, and the rows of the result."""
    n, todo, most = len(df.collect()), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most, n


@pytest.mark.parametrize("query", ["text_match_topk", "combined_match_topk", "tfidf_topk", "additive_scores", "enriched_match"])
def test_best_matches_of_rows_of_few_names_do_not_meet_all(spark, tmp_path, query):
    kinds = "ECONOMY STANDARD PROMO SMALL MEDIUM LARGE".split()
    rng = random.Random(8)
    part = [(i, " ".join(rng.choice(w.split()) for w in ("red blue hot cold steel", "bolt gear ring nut rod")), f"Brand#{rng.randint(1, 3)}", rng.choice(kinds), rng.randint(1, 50)) for i in range(1500)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    most, n = most_rows(queries.QUERIES[query](spark, str(tmp_path)))
    assert n >= 3 * 1500 and most <= 4 * n
    if query == "combined_match_topk":
        a, b = queries._prepared(spark, str(tmp_path), queries.ALL)
        every = match.top_k(match.scored_pairs(a.where("row_id % 50 = 7"), b, queries.ALL), 5).select("left_id", "right_id").collect()
        got = match.best_pairs(a.where("row_id % 50 = 7"), b, queries.ALL, 5).select("left_id", "right_id").collect()
        assert len(every) > 90 and set(every) == set(got)


def test_best_matches_write_few_rows_and_no_pools(spark, monkeypatch):
    """Only the rows behind the best names of each class are gathered, not those behind every name and amount."""
    written = []
    monkeypatch.setattr(match, "cut", lambda df, real=match.cut: written.append(real(df)) or written[-1])
    rng = random.Random(9)
    part = [(i, " ".join(rng.choice(w.split()) for w in ("red blue hot cold steel", "bolt gear ring nut rod")), f"{rng.randint(1, 50)} {rng.choice(['g', 'oz', 'ml', 'lb'])}", f"{36000290000 + i}") for i in range(600)]
    s = queries.ALL
    a, b = (prepare.prepare(rows(spark, part), CONFIG, s) for _ in "ab")
    got = {(r.left_id, r.right_id): r.confidence for r in match.best_pairs(a, b, s, 5).collect()}
    assert len(got) == 5 * 600 and all("gtin_pool" not in df.columns for df in written)
    assert max(df.count() for df in written) <= 10 * 600
    every = match.top_k(match.scored_pairs(a.where("row_id % 40 = 7"), b, s), 5)
    assert {(r.left_id, r.right_id): r.confidence for r in every.collect()} == {k: v for k, v in got.items() if k[0] % 40 == 7}


@pytest.mark.parametrize("query", ["text_match_topk", "enriched_match"])
def test_best_matches_read_each_table_twice(spark, tmp_path, monkeypatch, query):
    """Names are cleaned once for all that is known of texts, and once with the rows."""
    plans = []
    monkeypatch.setattr(match, "cut", lambda df, real=match.cut: plans.append(df) or real(df))
    part = [(i, f"red {'bolt' if i % 3 else 'gear'}", f"Brand#{i % 4}", "SMALL", i % 9 + 1) for i in range(100)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    out = queries.QUERIES[query](spark, str(tmp_path))
    assert out.count() > 100 and sum(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in [*plans, out]) <= 4


def test_output_columns_come_with_their_rows(spark):
    """With and without sizes, as a join of the pairs with both tables gives them; also nulls, maps and odd names."""
    rng = random.Random(4)
    data = [(i, f"red {rng.choice(['bolt', 'bolts', 'gear'])}", rng.choice(["10 g", "11 g", None]), rng.choice([None, "a", "b"]), {"k": i} if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(data, "row_id long, product_name string, size string, `a.b name` string, left_more map<string,long>")
    plain = ColumnConfig(product=("product_name",), size="size")
    left, right = (ColumnConfig(**{**plain.__dict__, "output": c}) for c in (("left_more", "absent", "size"), ("a.b name", "row_id")))
    for more in ({}, {"w_size": 0.2}):
        s = MatchSettings(**{**dict(threshold=50.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=2), **more})
        got = matching.match_between(df, df, right, left, s)
        want = match.enrich(matching.match_between(df, df, plain, plain, s), df, df, "row_id", "row_id", left.output, right.output)
        assert got.columns == want.columns and len(got.columns) == 17
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 80


def test_means_on_a_half_are_the_same_in_any_order(spark):
    """Splits and representatives against whole fractions, with many means that are equal or end in half a millionth."""
    rng = random.Random(5)
    scores = {g: {(100 * g + i, 100 * g + j): rng.choice([61234567, 61234568] * 4 + [70123451]) for i in range(9) for j in range(i + 1, 9)} for g in range(150)}
    want, first = set(), {}
    for g, known in scores.items():
        at = lambda a, b: known[min(a, b), max(a, b)]
        rest = [100 * g + i for i in range(9)]
        while len(rest) > 1:
            mean = lambda m: (2 * sum(at(m, o) for o in rest if o != m) + len(rest) - 1) // (2 * (len(rest) - 1))
            best = min(rest, key=lambda m: (-mean(m), m))
            first.setdefault(100 * g, best)
            taken = [m for m in rest if m == best or at(best, m) >= 70_000_000]
            want |= {(taken[0], m) for m in taken if len(taken) > 1}
            rest = [m for m in rest if m not in taken]
    pairs = spark.createDataFrame([(100 * g, a, b, n / 1e6) for g, known in scores.items() for (a, b), n in known.items()], "group_key long, src long, dst long, score double")
    members = spark.createDataFrame([(100 * g, 100 * g + i) for g in scores for i in range(9)], "group_key long, member_id long")
    assert {(r.group_key, r.member_id) for r in groups.conservative_split(members, pairs, 70.0).collect()} == want
    assert {r.group_key: r.representative_id for r in groups.representatives(members, pairs).collect()} == first
