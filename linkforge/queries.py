"""Record-linkage queries over the part table, and DuckDB SQL that says the same.

Catalog: names and brands; customer list: names and types, words in another order. Both have every row of the table where they
are matched with each other; for matching within, which gives all pairs, the catalog has a row for each distinct name.
Sizes and barcodes are made from the keys by arithmetic, so that both engines see the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import gtin, sizes, text
from .functions.words import ENGLISH, STOP_WORDS, UNITS
from .lineage import cut
from .operators import fuzzy, groups, match, profile, report, score, sweep, tfidf
from .operators.prepare import prepare
from .plans import matching
from .plans.settings import ColumnConfig, MatchSettings

UNIT_OF_TYPE = (("ECONOMY", "oz"), ("STANDARD", "lb"), ("PROMO", "fl oz"), ("SMALL", "g"), ("MEDIUM", "ml"), ("LARGE", "kg"))
GROUP_AT = 75.0
SWEEP = (70, 90)


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def size_text(key: Column, size: Column, kind: Column) -> Column:
    unit = F.lit(None).cast("string")
    for name, u in UNIT_OF_TYPE:
        unit = F.when(kind == name, u).otherwise(unit)
    return F.when(key % 7 == 0, F.lit("Medium")).otherwise(F.concat_ws(" ", size.cast("string"), unit))


def code_text(key: Column) -> Column:
    """Clean, wrong check digit, no check digit, 13 digits or with dashes, by key."""
    base = F.lpad((key * 7919).cast("string"), 11, "0")
    full = gtin.with_check_digit(base)
    wrong = F.concat(base, ((F.substring(full, 12, 1).cast("int") + 1) % 10).cast("string"))
    dashed = F.concat_ws("-", F.substring(full, 1, 1), F.substring(full, 2, 5), F.substring(full, 7, 5), F.substring(full, 12, 1))
    return F.when(key % 5 == 0, full).when(key % 5 == 1, wrong).when(key % 5 == 2, base).when(key % 5 == 3, F.concat(F.lit("9"), full)).otherwise(dashed)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part(spark, sf_dir).groupBy("p_name", "p_brand").agg(F.min(F.struct("p_partkey", "p_size", "p_type")).alias("f"))
    key = F.col("f.p_partkey")
    return rows.select(key.alias("row_id"), F.concat_ws(" ", "p_name", "p_brand").alias("product_name"), F.col("p_brand").alias("brand"), size_text(key, F.col("f.p_size"), F.col("f.p_type")).alias("size"), code_text(key).alias("gtin"))


def all_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return part(spark, sf_dir).select(key.alias("row_id"), F.concat_ws(" ", "p_name", "p_brand").alias("product_name"), F.col("p_brand").alias("brand"), size_text(key, F.col("p_size"), F.col("p_type")).alias("size"), code_text(key).alias("gtin"))


def all_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    words = F.concat_ws(" ", F.reverse(F.split("p_name", " ")))
    return part(spark, sf_dir).select(key.alias("row_id"), F.concat_ws(" ", words, F.lower("p_type"), F.lit("of the")).alias("product_name"), size_text(key, F.col("p_size"), F.col("p_type")).alias("size"), code_text(key).alias("gtin"))


CONFIG = ColumnConfig(product=("product_name",), size="size", gtin=("gtin",))
TEXT_ONLY = MatchSettings(threshold=60.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=5)
ALL = MatchSettings(threshold=50.0, w_tfidf=0.25, w_fuzzy=0.25, w_gtin=0.5, w_size=0.2, max_matches=5)
WITHIN = MatchSettings(threshold=70.0, w_tfidf=0.5, w_fuzzy=0.5, w_gtin=0.0, max_matches=None)


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part(spark, sf_dir).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("raw"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return parts.unionByName(docs).select("kind", "id", text.clean(F.col("raw")).alias("clean"))


def size_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = size_text(F.col("p_partkey"), F.col("p_size"), F.col("p_type"))
    return part(spark, sf_dir).select("p_partkey", raw.alias("raw"), sizes.base_amount(raw).alias("size_base"), (sizes.standardise(raw) != "").alias("parsed"))


def size_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = part(spark, sf_dir).select("p_name", sizes.base_amount(size_text(F.col("p_partkey"), F.col("p_size"), F.col("p_type"))).alias("b")).distinct()
    pairs = base.alias("x").join(base.alias("y"), "p_name").select("p_name", F.col("x.b").alias("size_a"), F.col("y.b").alias("size_b"))
    return pairs.withColumn("score", F.round(sizes.similarity(F.col("size_a"), F.col("size_b")), 4))


def _prepared(spark: SparkSession, sf_dir: str, settings: MatchSettings) -> tuple[DataFrame, DataFrame]:
    return prepare(all_customer(spark, sf_dir), CONFIG, settings), prepare(all_catalog(spark, sf_dir), CONFIG, settings)


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _prepared(spark, sf_dir, TEXT_ONLY)
    return tfidf.weights(match.distinct_texts(left, right), stop_words=ENGLISH).select("text", "term", F.round("weight", 4).alias("weight"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = MatchSettings(threshold=1.0, w_tfidf=1.0, w_fuzzy=0.0, w_gtin=0.0, max_matches=3)
    left, right = _prepared(spark, sf_dir, only)
    return match.best_pairs(left, right, only, 3).select("left_id", "right_id", "tfidf_score")


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with names that have as many letters or a few more or less."""
    a = part(spark, sf_dir).select(text.clean(F.concat_ws(" ", "p_name", "p_type")).alias("a")).distinct()
    b = part(spark, sf_dir).select(text.clean(F.col("p_name")).alias("b")).distinct()
    near = F.explode(F.sequence(F.length("b"), F.length("b") + 12)).alias("n")
    return a.join(b.select("b", near), F.length("a") == F.col("n")).select("a", "b", F.round(fuzzy.ratio(F.col("a"), F.col("b")), 4).alias("score"))


def gtin_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = code_text(F.col("p_partkey"))
    return part(spark, sf_dir).select("p_partkey", code.alias("code"), gtin.with_check_digit(F.lpad((F.col("p_partkey") * 7919).cast("string"), 11, "0")).alias("completed"), gtin.is_valid(code).alias("valid"), gtin.corrected(code).alias("corrected"))


def gtin_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).select("p_partkey", F.explode(gtin.variants(code_text(F.col("p_partkey")))).alias("v")).select("p_partkey", "v.gtin14", "v.source")


def gtin_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.gtin_quality(part(spark, sf_dir).select(code_text(F.col("p_partkey")).alias("gtin")), ["gtin"])
    return out.withColumn("coverage_percentage", F.round("coverage_percentage", 4))


def gtin_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _prepared(spark, sf_dir, ALL)
    return match.gtin_pairs(left, right).select("left_id", "right_id", "gtin_score", "gtin_match_type", F.array_join("matching_gtins", ",").alias("matching_gtins"))


def text_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.match_between(all_catalog(spark, sf_dir), all_customer(spark, sf_dir), CONFIG, CONFIG, TEXT_ONLY)
    return out.select("left_id", "right_id", "left_name", "right_name", "confidence", "tfidf_score", "fuzzy_score")


def combined_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all four scores, best five of each customer row."""
    out = matching.match_between(all_catalog(spark, sf_dir), all_customer(spark, sf_dir), CONFIG, CONFIG, ALL)
    return out.select("left_id", "right_id", "confidence", "tfidf_score", "fuzzy_score", "gtin_score", "gtin_match_type", "size_score")


def _within(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return matching.match_within(catalog(spark, sf_dir), CONFIG, MatchSettings(**{**WITHIN.__dict__, **more}))


def within_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(spark, sf_dir).select("left_id", "right_id", "confidence")


def restricted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(spark, sf_dir, restrictions=("brand",), threshold=60.0).select("left_id", "right_id", "confidence")


def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _prepared(spark, sf_dir, TEXT_ONLY)
    strict = MatchSettings(**{**TEXT_ONLY.__dict__, "threshold": 72.0})
    return match.unmatched(left, match.scored_pairs(left, right, strict)).select("left_id", "note")


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.match_summary(_within(spark, sf_dir))


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_pairs(_within(spark, sf_dir))


def _grouping(spark: SparkSession, sf_dir: str, conservative: bool, threshold: float = GROUP_AT) -> matching.Grouping:
    settings = MatchSettings(**{**WITHIN.__dict__, "threshold": threshold, "conservative": conservative, "max_groups": None})
    return matching.group_within(catalog(spark, sf_dir), CONFIG, settings)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouping(spark, sf_dir, False).members


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouping(spark, sf_dir, False).groups.select("group_id", "group_key", "group_size", F.round("avg_similarity", 3).alias("avg_similarity"), F.round("min_similarity", 4).alias("min_similarity"))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouping(spark, sf_dir, False).groups.select("group_id", "representative_id")


def pairwise_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grouping(spark, sf_dir, False)
    return groups.pairwise_rows(g.groups, g.pair_scores)


def conservative_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grouping(spark, sf_dir, True)
    names = g.rows.select(F.col("row_id").alias("member_id"), "name")
    return groups.grouped_rows(g.groups, g.members, names)


def group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten groups of three and more in each of the three orders."""
    g, out = _grouping(spark, sf_dir, False), None
    for by in ("size", "avg_similarity", "min_similarity"):
        page = groups.filter_groups(g.groups, 3, 10, by).select(F.lit(by).alias("sort_by"), "group_id", "group_size")
        out = page if out is None else out.unionByName(page)
    return out


def _explored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = _grouping(spark, sf_dir, False, float(SWEEP[0]))
    return matching.explore(g, MatchSettings(**{**WITHIN.__dict__, "sweep": SWEEP}))


def evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explored(spark, sf_dir)[0].select("group_id", "threshold", "member_id", "is_representative", F.round("similarity_to_representative", 6).alias("similarity_to_representative"), "group_size_at_threshold", "in_group")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explored(spark, sf_dir)[1].withColumn("avg_group_similarity", F.round("avg_group_similarity", 1))


def evolution_leaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evolution with a score of 0 from the representative to itself, so that it leaves its group."""
    g = _grouping(spark, sf_dir, False, float(SWEEP[0]))
    evolved = matching.explore(g, MatchSettings(**{**WITHIN.__dict__, "sweep": SWEEP}), keep_representative=False)[0]
    return evolved.select("group_id", "threshold", "member_id", F.round("similarity_to_representative", 6).alias("similarity_to_representative"), "group_size_at_threshold", "in_group")


def evolution_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    evolved = _explored(spark, sf_dir)[0]
    out = sweep.with_attributes(evolved, catalog(spark, sf_dir), "row_id", ["brand", "product_name", "threshold", "no_such_column"])
    return out.select("group_id", "threshold", "member_id", "brand", "product_name")


def threshold_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.at_threshold(_explored(spark, sf_dir)[0], 80).select("group_id", "member_id", "group_size_at_threshold")


def sweep_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grouping(spark, sf_dir, False, float(SWEEP[0]))
    out = matching.explore_anew(g, MatchSettings(**{**WITHIN.__dict__, "sweep": SWEEP}))
    return out.withColumn("avg_group_similarity", F.round("avg_group_similarity", 3))


def enriched_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (ColumnConfig(**{**CONFIG.__dict__, "output": columns}) for columns in (("size", "no_such_column"), ("brand", "gtin")))
    out = matching.match_between(all_catalog(spark, sf_dir), all_customer(spark, sf_dir), right, left, TEXT_ONLY)
    return out.select("left_id", "right_id", "Customer size", "Catalog brand", "Catalog gtin")


def least_scores_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(spark, sf_dir, min_tfidf=55.0, min_fuzzy=90.0).select("left_id", "right_id", "confidence")


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pairs in each of the four orders."""
    pairs, out = cut(_within(spark, sf_dir)), None
    for order in match.ORDERS:
        page = match.report_page(pairs, order).select(F.lit(order).alias("sort_by"), "place", "left_id", "right_id")
        out = page if out is None else out.unionByName(page)
    return out


def gtin_only_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = MatchSettings(threshold=75.0, w_tfidf=0.0, w_fuzzy=0.0, w_gtin=1.0, w_size=0.2, max_matches=5)
    return matching.match_between(all_catalog(spark, sf_dir), all_customer(spark, sf_dir), CONFIG, CONFIG, only).select("left_id", "right_id", "confidence", "gtin_score", "size_score")


def additive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.match_between(all_catalog(spark, sf_dir), all_customer(spark, sf_dir), CONFIG, CONFIG, TEXT_ONLY)
    return out.select("left_id", "right_id", F.round(score.additive(F.col("tfidf_score"), F.col("fuzzy_score"), F.lit(50.0), 0.5, 0.25, 0.5), 4).alias("score"))


def sized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(catalog(spark, sf_dir), CONFIG, MatchSettings(include_size_in_text=True)).select("row_id", "name", "size_text")


def restriction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.restriction_profile(part(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_names, size_standardize, size_similarity, tfidf_weights, tfidf_topk, fuzzy_pairs, gtin_check_digit, gtin_variants, gtin_quality, gtin_join,
        text_match_topk, combined_match_topk, within_match, restricted_match, unmatched_rows, match_summary, distinct_pairs, components, group_stats,
        representatives, pairwise_groups, conservative_groups, group_page, evolution, evolution_leaving, evolution_attributes, threshold_preview,
        threshold_sweep, sweep_recomputed, enriched_match, least_scores_match, report_pages, gtin_only_match, additive_scores, sized_names, restriction_profile,
    )
}


# --- The same in SQL, written from the definitions, not from the plans above. ---


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _clean(x: str) -> str:
    kept = rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda w: w NOT IN ({_quoted(STOP_WORDS)}))"
    return rf"trim(regexp_replace(array_to_string({kept}, ' '), '\s+', ' ', 'g'))"


def _size(key: str, size: str, kind: str) -> str:
    units = " ".join(f"WHEN '{k}' THEN '{u}'" for k, u in UNIT_OF_TYPE)
    return f"CASE WHEN {key} % 7 = 0 THEN 'Medium' ELSE {size} || ' ' || CASE {kind} {units} END END"


def _amount(x: str) -> str:
    tried = [rf"round(try_cast(nullif(regexp_extract(lower({x}), '(\d*\.?\d+)\s*({u})\b', 1), '') AS DOUBLE) * CAST({f} AS DOUBLE), 1)" for u, f in UNITS]
    return f"coalesce({', '.join(tried)})"


def _check(x: str) -> str:
    total = f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: CAST(substr(reverse({x}), i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))"
    return f"CAST((10 - {total} % 10) % 10 AS VARCHAR)"


def _code(key: str) -> str:
    base = f"lpad(CAST({key} * 7919 AS VARCHAR), 11, '0')"
    c = _check(base)
    return (
        f"CASE {key} % 5 WHEN 0 THEN {base} || {c} WHEN 1 THEN {base} || CAST((CAST({c} AS INT) + 1) % 10 AS VARCHAR) WHEN 2 THEN {base} WHEN 3 THEN '9' || {base} || {c} "
        f"ELSE substr({base}, 1, 1) || '-' || substr({base}, 2, 5) || '-' || substr({base}, 7, 5) || '-' || {c} END"
    )


def _lcs(x: str, y: str) -> str:
    row = f"list_reduce(range(1, length({y}) + 1), lambda a, j: list_append(a, greatest(a[-1], p[j + 1], p[j] + CAST(c = {y}[j] AS INTEGER))), [0])"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 ELSE list_reduce(string_split({x}, ''), lambda p, c: {row}, list_transform(range(0, length({y}) + 1), lambda z: 0))[-1] END"


def _ratio(source: str, a: str, b: str) -> str:
    """A query over `source` with score, the token-set ratio of columns a and b, beside its columns."""
    return f"""
        SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 WHEN len(sh) > 0 AND (x = '' OR y = '') THEN 100.0
            ELSE greatest(100.0 - 100.0 * (length(x) + length(y) - 2 * lcs) / (la + lb), CASE WHEN gap = 1 THEN 100.0 - 100.0 * (1 + length(x)) / (core + la) ELSE 0 END, CASE WHEN gap = 1 THEN 100.0 - 100.0 * (1 + length(y)) / (core + lb) ELSE 0 END) END AS fz
        FROM (SELECT *, core + gap + length(x) AS la, core + gap + length(y) AS lb, {_lcs("x", "y")} AS lcs
        FROM (SELECT *, array_to_string(list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))), ' ') AS x, array_to_string(list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))), ' ') AS y,
                     length(array_to_string(sh, ' ')) AS core, CASE WHEN len(sh) > 0 THEN 1 ELSE 0 END AS gap
        FROM (SELECT *, list_filter(ta, lambda w: list_contains(tb, w)) AS sh
        FROM (SELECT *, list_distinct(list_filter(string_split({a}, ' '), lambda w: w <> '')) AS ta, list_distinct(list_filter(string_split({b}, ' '), lambda w: w <> '')) AS tb FROM {source}))))"""


_CATALOG = f"""cat AS (SELECT k AS row_id, {_clean("p_name || ' ' || p_brand")} AS name, p_brand AS brand, {_size("k", "sz", "ty")} AS size, {_code("k")} AS gtin
    FROM (SELECT p_name, p_brand, min(p_partkey) AS k, arg_min(p_size, p_partkey) AS sz, arg_min(p_type, p_partkey) AS ty FROM part GROUP BY p_name, p_brand))"""
_ALL = f"""cat AS (SELECT *, {_amount('size')} AS amount FROM (SELECT p_partkey AS row_id, {_clean("p_name || ' ' || p_brand")} AS name, p_brand AS brand, {_size("p_partkey", "p_size", "p_type")} AS size, {_code("p_partkey")} AS gtin FROM part)),
    cus AS (SELECT *, {_amount('size')} AS amount FROM (SELECT p_partkey AS row_id, {_clean("array_to_string(list_reverse(string_split(p_name, ' ')), ' ') || ' ' || lower(p_type) || ' of the'")} AS name, {_size("p_partkey", "p_size", "p_type")} AS size, {_code("p_partkey")} AS gtin FROM part))"""


def _tfidf(left: str, right: str) -> str:
    """CTEs ending in wt(name, term, w): weights over both sides together."""
    return rf"""corpus AS (SELECT name, count(*) AS n FROM (SELECT name FROM {left} UNION ALL SELECT name FROM {right}) GROUP BY name),
    tok AS (SELECT name, n, term, count(*) AS tf FROM (SELECT name, n, unnest(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM corpus) WHERE term NOT IN ({_quoted(ENGLISH)}) GROUP BY name, n, term),
    idf AS (SELECT term, ln((1.0 + (SELECT sum(n) FROM corpus)) / (1.0 + sum(n))) + 1.0 AS idf FROM tok GROUP BY term),
    rawt AS (SELECT name, term, tf * idf AS w FROM tok JOIN idf USING (term)),
    wt AS (SELECT name, term, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM rawt)"""


def _texts(left: str, right: str, fuzzy_too: bool = True) -> str:
    """CTEs ending in txt(lt, rt, tfidf_score, fuzzy_score) for all pairs of distinct names."""
    cos = f"""cos AS (SELECT a.name AS lt, b.name AS rt, sum(a.w * b.w) * 100 AS c FROM wt a JOIN wt b USING (term) GROUP BY ALL),
    prs AS (SELECT l.name AS lt, r.name AS rt, round(coalesce(c, 0.0), 4) AS tfidf_score FROM (SELECT DISTINCT name FROM {left}) l CROSS JOIN (SELECT DISTINCT name FROM {right}) r LEFT JOIN cos ON cos.lt = l.name AND cos.rt = r.name)"""
    if not fuzzy_too:
        return f"{_tfidf(left, right)}, {cos}, txt AS (SELECT *, 0.0 AS fuzzy_score FROM prs)"
    return f"{_tfidf(left, right)}, {cos}, txt AS (SELECT lt, rt, tfidf_score, round(CAST(fz AS DOUBLE), 4) AS fuzzy_score FROM ({_ratio('prs', 'lt', 'rt')}))"


_DIGITS = r"regexp_replace(gtin, '\D', '', 'g')"


def _variants(source: str, key: str) -> str:
    """CTEs ending in var(id, g, src) of the codes in source(key, gtin); none here has 7 or 8 digits."""
    body = "substr(d, 1, length(d) - 1)"
    return f"""dg AS (SELECT {key} AS id, {_DIGITS} AS d FROM {source}),
    v0 AS (SELECT id, d, lpad(d, 14, '0') AS g, 'original' AS src, 1 AS o FROM dg WHERE d <> '' AND length(d) <= 14
        UNION ALL SELECT id, d, lpad({body} || {_check(body)}, 14, '0'), 'corrected', 2 FROM dg WHERE length(d) IN (12, 14) AND {body} || {_check(body)} <> d
        UNION ALL SELECT id, d, lpad(d || {_check("d")}, 14, '0'), 'missing_check', 3 FROM dg WHERE length(d) = 11
        UNION ALL SELECT id, d, rpad(repeat('0', i) || d, 14, '0'), 'original', 4 FROM (SELECT *, unnest(range(0, 14 - length(d))) AS i FROM dg WHERE d <> '' AND length(d) < 14)),
    v1 AS (SELECT *, row_number() OVER (PARTITION BY id, g ORDER BY CASE WHEN o = 4 THEN 0 ELSE o END DESC) AS k FROM v0),
    var AS (SELECT id, g, src FROM v1 WHERE k = 1)"""


def _codes(left: str, right: str) -> str:
    """CTEs ending in gp(left_id, right_id, gtin_score, gtin_match_type, matching_gtins)."""
    both = f"SELECT row_id AS key, gtin FROM {left}"
    one = _variants(f"({both})", "key")
    two = _variants(f"(SELECT row_id AS key, gtin FROM {right})", "key").replace("dg ", "dh ").replace("FROM dg", "FROM dh").replace("v0 ", "w0 ").replace("FROM v0", "FROM w0").replace("v1 ", "w1 ").replace("FROM v1", "FROM w1").replace("var AS", "vaw AS")
    return f"""{one}, {two},
    gm AS (SELECT a.id AS left_id, b.id AS right_id, g, CASE WHEN a.src = 'original' AND b.src = 'original' THEN 120.0 WHEN 'corrected' IN (a.src, b.src) THEN 92.0 WHEN 'missing_check' IN (a.src, b.src) THEN 92.0 ELSE 120.0 END AS c FROM var a JOIN vaw b USING (g)),
    gb AS (SELECT *, max(c) OVER (PARTITION BY left_id, right_id) AS m FROM gm),
    gp AS (SELECT left_id, right_id, CAST(m AS DOUBLE) AS gtin_score, CASE WHEN m = 120 THEN 'Exact Match' ELSE 'Corrected Match' END AS gtin_match_type, array_to_string(list_sort(list(DISTINCT g))[1:3], ',') AS matching_gtins FROM gb WHERE c = m GROUP BY left_id, right_id, m)"""


_WITHIN = f"""{_CATALOG}, {_texts("cat", "cat")},
    pr AS (SELECT l.row_id AS left_id, r.row_id AS right_id, l.name AS left_name, r.name AS right_name, l.brand AS lb, r.brand AS rb, tfidf_score, fuzzy_score, round(least(tfidf_score * 0.5 + fuzzy_score * 0.5, 100.0), 6) AS confidence
        FROM cat l JOIN txt ON l.name = txt.lt JOIN cat r ON r.name = txt.rt WHERE l.row_id <> r.row_id)"""


def _grouped(at: float) -> str:
    """CTEs from within pairs to mem(group_key, member_id), sc(group_key, src, dst, score) and grp."""
    return f"""{_WITHIN},
    ed AS MATERIALIZED (SELECT left_id, right_id FROM pr WHERE confidence >= {at}),
    cc AS (SELECT left_id AS node, left_id AS root FROM ed UNION SELECT e.right_id, cc.root FROM cc JOIN ed e ON e.left_id = cc.node WHERE cc.root < e.right_id),
    mem AS MATERIALIZED (SELECT min(root) AS group_key, node AS member_id FROM cc GROUP BY node),
    sc AS MATERIALIZED (SELECT a.group_key, a.member_id AS src, b.member_id AS dst, confidence AS score FROM mem a JOIN mem b ON a.group_key = b.group_key AND a.member_id < b.member_id JOIN pr ON pr.left_id = a.member_id AND pr.right_id = b.member_id),
    reps AS (SELECT group_key, m AS representative_id FROM (SELECT group_key, m, row_number() OVER (PARTITION BY group_key ORDER BY round(avg(score), 6) DESC, m) AS k FROM (SELECT group_key, src AS m, score FROM sc UNION ALL SELECT group_key, dst, score FROM sc) GROUP BY group_key, m) WHERE k = 1),
    st AS (SELECT group_key, avg(score) AS avg_similarity, min(score) AS min_similarity FROM sc GROUP BY group_key),
    sz AS (SELECT group_key, count(*) AS group_size FROM mem GROUP BY group_key),
    grp AS MATERIALIZED (SELECT 'G' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS group_id, * FROM (SELECT row_number() OVER (ORDER BY group_key) AS n, * FROM sz JOIN st USING (group_key) JOIN reps USING (group_key)))"""


def _conservative(thresholds: str) -> str:
    """CTEs from within pairs to fin(t, group_key, member), the groups split around representatives at each of the thresholds."""
    return f"""{_WITHIN},
    ts AS (SELECT CAST(t AS INT) AS t FROM {thresholds} r(t)),
    ed AS MATERIALIZED (SELECT t, left_id, right_id FROM pr JOIN ts ON confidence >= t),
    cc AS (SELECT t, left_id AS node, left_id AS root FROM ed UNION SELECT cc.t, e.right_id, cc.root FROM cc JOIN ed e ON e.t = cc.t AND e.left_id = cc.node WHERE cc.root < e.right_id),
    com AS MATERIALIZED (SELECT t, min(root) AS component, node AS member FROM cc GROUP BY t, node),
    sc2 AS MATERIALIZED (SELECT a.t, a.component, a.member AS a, b.member AS b, confidence AS score FROM com a JOIN com b ON a.t = b.t AND a.component = b.component AND a.member <> b.member JOIN pr ON pr.left_id = a.member AND pr.right_id = b.member),
    spl AS (SELECT t, component, 0 AS step, member, CASE WHEN count(*) OVER (PARTITION BY t, component) <= 2 THEN component END AS rep FROM com
        UNION ALL (WITH r AS (SELECT t, component, step, member, count(*) OVER (PARTITION BY t, component) AS n FROM spl WHERE rep IS NULL),
            mean AS (SELECT r.t, r.component, r.member, round(sum(score) / max(r.n - 1), 6) AS mean FROM r JOIN sc2 ON sc2.t = r.t AND sc2.a = r.member JOIN r o ON o.t = r.t AND o.component = r.component AND o.member = sc2.b WHERE r.n > 1 GROUP BY r.t, r.component, r.member),
            best AS (SELECT t, component, member AS rep FROM (SELECT *, row_number() OVER (PARTITION BY t, component ORDER BY mean DESC, member) AS k FROM mean) WHERE k = 1)
            SELECT r.t, r.component, r.step + 1, r.member, CASE WHEN r.member = best.rep OR score >= r.t THEN best.rep END FROM r JOIN best ON best.t = r.t AND best.component = r.component LEFT JOIN sc2 ON sc2.t = r.t AND sc2.a = best.rep AND sc2.b = r.member)),
    fin AS MATERIALIZED (SELECT * FROM (SELECT t, min(member) OVER w AS group_key, member, count(*) OVER w AS group_size FROM spl WHERE rep IS NOT NULL WINDOW w AS (PARTITION BY t, component, rep)) WHERE group_size > 1),
    fsc AS MATERIALIZED (SELECT x.t, x.group_key, x.member AS src, y.member AS dst, confidence AS score FROM fin x JOIN fin y ON x.t = y.t AND x.group_key = y.group_key AND x.member < y.member JOIN pr ON pr.left_id = x.member AND pr.right_id = y.member)"""


_EVOLVED = f"""{_grouped(SWEEP[0])},
    bt AS (SELECT group_key, src AS a, dst AS b, score FROM sc UNION ALL SELECT group_key, dst, src, score FROM sc),
    ev0 AS (SELECT group_id, CAST(t AS INT) AS threshold, member_id, member_id = representative_id AS is_representative, CASE WHEN member_id = representative_id THEN 100.0 ELSE score END AS sim
        FROM mem JOIN grp USING (group_key) LEFT JOIN bt ON bt.group_key = mem.group_key AND bt.a = representative_id AND bt.b = member_id CROSS JOIN range({SWEEP[0]}, {SWEEP[1]} + 1, 5) r(t)),
    ev AS (SELECT *, sim >= threshold AS in_group, count(*) FILTER (sim >= threshold) OVER w AS n, avg(sim) FILTER (sim >= threshold) OVER w AS mean FROM ev0 WINDOW w AS (PARTITION BY group_id, threshold))"""

_P = "p_name || ' ' || p_brand"
ORACLES: dict[str, str] = {
    "clean_names": f"SELECT 'part' AS kind, p_partkey AS id, {_clean(_P)} AS clean FROM part UNION ALL SELECT 'document', doc_id, {_clean('text')} FROM documents",
    "size_standardize": f"SELECT p_partkey, raw, {_amount('raw')} AS size_base, {_amount('raw')} IS NOT NULL AS parsed FROM (SELECT p_partkey, {_size('p_partkey', 'p_size', 'p_type')} AS raw FROM part)",
    "size_similarity": f"""WITH b AS (SELECT DISTINCT p_name, {_amount('raw')} AS b FROM (SELECT p_name, {_size('p_partkey', 'p_size', 'p_type')} AS raw FROM part)),
        p AS (SELECT x.p_name, x.b AS size_a, y.b AS size_b, greatest(x.b, y.b) AS hi, least(x.b, y.b) AS lo FROM b x JOIN b y ON x.p_name = y.p_name)
        SELECT p_name, size_a, size_b, CASE WHEN size_a IS NULL OR size_b IS NULL THEN 0.0 WHEN lo = 0 THEN CASE WHEN hi = 0 THEN 100.0 ELSE 0.0 END WHEN (hi - lo) * 100.0 / hi <= 20.0 THEN round(greatest(0.0, least(100.0, (1.0 - (hi - lo) * 100.0 / hi / 20.0) * 100.0)), 4) ELSE 0.0 END::DOUBLE AS score FROM p""",
    "tfidf_weights": f"WITH {_ALL}, {_tfidf('cus', 'cat')} SELECT name AS text, term, round(w, 4) AS weight FROM wt",
    "tfidf_topk": f"""WITH {_ALL}, {_texts('cus', 'cat', False)},
        p AS (SELECT l.row_id AS left_id, r.row_id AS right_id, tfidf_score, row_number() OVER (PARTITION BY l.row_id ORDER BY tfidf_score DESC, r.row_id) AS k FROM cus l JOIN txt ON l.name = lt JOIN cat r ON r.name = rt WHERE tfidf_score >= 1)
        SELECT left_id, right_id, tfidf_score FROM p WHERE k <= 3""",
    "fuzzy_pairs": f"""WITH a AS (SELECT DISTINCT {_clean("p_name || ' ' || p_type")} AS a FROM part), b AS (SELECT DISTINCT {_clean('p_name')} AS b FROM part), q AS (SELECT a, b FROM a JOIN b ON length(a) BETWEEN length(b) AND length(b) + 12)
        SELECT a, b, round(CAST(fz AS DOUBLE), 4) AS score FROM ({_ratio('q', 'a', 'b')})""",
    "gtin_check_digit": f"""WITH c AS (SELECT p_partkey, {_code('p_partkey')} AS gtin, lpad(CAST(p_partkey * 7919 AS VARCHAR), 11, '0') AS base FROM part), d AS (SELECT *, {_DIGITS} AS d FROM c), e AS (SELECT *, CASE WHEN length(d) IN (12, 14) THEN substr(d, 1, length(d) - 1) || {_check('substr(d, 1, length(d) - 1)')} ELSE '' END AS fix FROM d)
        SELECT p_partkey, gtin AS code, base || {_check('base')} AS completed, length(d) IN (12, 14) AND fix = d AS valid, fix AS corrected FROM e""",
    "gtin_variants": f"WITH c AS (SELECT p_partkey, {_code('p_partkey')} AS gtin FROM part), {_variants('c', 'p_partkey')} SELECT id AS p_partkey, g AS gtin14, src AS source FROM var",
    "gtin_quality": f"""WITH c AS (SELECT {_code('p_partkey')} AS gtin FROM part), d AS (SELECT {_DIGITS} AS d FROM c),
        q AS (SELECT d, CASE WHEN length(d) = 11 THEN 'correctable' WHEN length(d) = 13 THEN 'invalid' WHEN d = substr(d, 1, length(d) - 1) || {_check('substr(d, 1, length(d) - 1)')} THEN 'valid' ELSE 'correctable' END AS m FROM d)
        SELECT count(*) AS total_products, count(*) FILTER (d <> '') AS products_with_gtins, count(*) FILTER (m = 'valid') AS valid_gtins, count(*) FILTER (m = 'correctable') AS correctable_gtins, count(*) FILTER (m = 'invalid') AS invalid_gtins, round(count(*) FILTER (d <> '') * 100.0 / count(*), 4)::DOUBLE AS coverage_percentage FROM q""",
    "gtin_join": f"WITH {_ALL}, {_codes('cus', 'cat')} SELECT * FROM gp",
    "text_match_topk": f"""WITH {_ALL}, {_texts('cus', 'cat')},
        p AS (SELECT l.row_id AS left_id, r.row_id AS right_id, l.name AS left_name, r.name AS right_name, round(least(tfidf_score * 0.5 + fuzzy_score * 0.5, 100.0), 6) AS confidence, tfidf_score, fuzzy_score FROM cus l JOIN txt ON l.name = lt JOIN cat r ON r.name = rt),
        k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY confidence DESC, right_id) AS k FROM p WHERE confidence >= 60) SELECT * EXCLUDE (k) FROM k WHERE k <= 5""",
    "combined_match_topk": f"""WITH {_ALL}, {_texts('cus', 'cat')}, {_codes('cus', 'cat')},
        p AS (SELECT l.row_id AS left_id, r.row_id AS right_id, tfidf_score, fuzzy_score, coalesce(gtin_score, 0.0) AS gtin_score, gtin_match_type, l.amount AS a, r.amount AS b
              FROM cus l JOIN txt ON l.name = lt JOIN cat r ON r.name = rt LEFT JOIN gp ON gp.left_id = l.row_id AND gp.right_id = r.row_id),
        q AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN (greatest(a, b) - least(a, b)) * 100.0 / greatest(a, b) <= 20.0 THEN round(greatest(0.0, least(100.0, (1.0 - (greatest(a, b) - least(a, b)) * 100.0 / greatest(a, b) / 20.0) * 100.0)), 4) ELSE 0.0 END AS size_score, tfidf_score * 0.5 + fuzzy_score * 0.5 AS t FROM p),
        s AS (SELECT *, round(least(CASE WHEN gtin_score > 0 THEN t * 0.5 + gtin_score * 0.5 ELSE t END * 0.8 + size_score * 0.2, 100.0), 6) AS confidence FROM q),
        k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY confidence DESC, right_id) AS k FROM s WHERE confidence >= 50)
        SELECT left_id, right_id, confidence::DOUBLE AS confidence, tfidf_score, fuzzy_score, gtin_score, gtin_match_type, size_score::DOUBLE AS size_score FROM k WHERE k <= 5""",
    "within_match": f"WITH {_WITHIN} SELECT left_id, right_id, confidence FROM pr WHERE confidence >= 70",
    "restricted_match": f"WITH {_WITHIN} SELECT left_id, right_id, confidence FROM pr WHERE confidence >= 60 AND lower(lb) = lower(rb)",
    "unmatched_rows": f"""WITH {_ALL}, {_texts('cus', 'cat')}, hit AS (SELECT DISTINCT lt FROM txt WHERE round(least(tfidf_score * 0.5 + fuzzy_score * 0.5, 100.0), 6) >= 72)
        SELECT row_id AS left_id, 'No matches found above threshold' AS note FROM cus WHERE name NOT IN (SELECT lt FROM hit)""",
    "match_summary": f"""WITH {_WITHIN}, m AS (SELECT * FROM pr WHERE confidence >= 70), n AS (SELECT count(DISTINCT least(left_name, right_name) || chr(0) || greatest(left_name, right_name)) AS d FROM m)
        SELECT count(*) AS n_matches, round(avg(confidence), 4) AS avg_confidence, (SELECT d FROM n) AS distinct_pairs, count(DISTINCT left_id) AS rows_with_matches, (SELECT d FROM n) * 2 AS pairs_times_two FROM m""",
    "distinct_pairs": f"WITH {_WITHIN} SELECT least(left_name, right_name) AS name_a, greatest(left_name, right_name) AS name_b, max(confidence) AS confidence FROM pr WHERE confidence >= 70 GROUP BY ALL",
    "components": f"WITH RECURSIVE {_grouped(GROUP_AT)} SELECT group_key, member_id FROM mem",
    "group_stats": f"WITH RECURSIVE {_grouped(GROUP_AT)} SELECT group_id, group_key, group_size, round(avg_similarity, 3) AS avg_similarity, round(min_similarity, 4) AS min_similarity FROM grp",
    "representatives": f"WITH RECURSIVE {_grouped(GROUP_AT)} SELECT group_id, representative_id FROM grp",
    "pairwise_groups": f"WITH RECURSIVE {_grouped(GROUP_AT)} SELECT group_id, group_size, src, dst, score FROM sc JOIN grp USING (group_key)",
    "evolution": f"WITH RECURSIVE {_EVOLVED} SELECT group_id, threshold, member_id, is_representative, round(CAST(sim AS DOUBLE), 6) AS similarity_to_representative, n AS group_size_at_threshold, in_group FROM ev",
    "threshold_sweep": f"""WITH RECURSIVE {_EVOLVED}, s AS (SELECT threshold, count(DISTINCT group_id) AS g, count(DISTINCT member_id) AS p, max(n) AS big, avg(round(mean, 2)) AS m FROM ev WHERE in_group GROUP BY threshold)
        SELECT CAST(t AS INT) AS threshold, coalesce(g, 0) AS groups_found, coalesce(p, 0) AS products_in_groups, coalesce(big, 0) AS largest_group_size, round(coalesce(CAST(m AS DOUBLE), 0.0), 1) AS avg_group_similarity, (SELECT count(*) FROM cat) - coalesce(p, 0) AS singletons FROM range({SWEEP[0]}, {SWEEP[1]} + 1, 5) r(t) LEFT JOIN s ON s.threshold = t""",
    "group_page": f"""WITH RECURSIVE {_grouped(GROUP_AT)}, g AS (SELECT *, row_number() OVER (ORDER BY group_size DESC, group_key) AS a, row_number() OVER (ORDER BY round(avg_similarity, 6) DESC, group_key) AS b, row_number() OVER (ORDER BY round(min_similarity, 6) DESC, group_key) AS c FROM grp WHERE group_size >= 3)
        SELECT 'size' AS sort_by, group_id, group_size FROM g WHERE a <= 10 UNION ALL SELECT 'avg_similarity', group_id, group_size FROM g WHERE b <= 10 UNION ALL SELECT 'min_similarity', group_id, group_size FROM g WHERE c <= 10""",
    "conservative_groups": f"""WITH RECURSIVE {_conservative(f"(VALUES ({GROUP_AT}))")},
        st AS (SELECT group_key, avg(score) AS m, min(score) AS lo FROM fsc GROUP BY group_key),
        rp AS (SELECT group_key, m AS rep FROM (SELECT group_key, m, row_number() OVER (PARTITION BY group_key ORDER BY round(avg(score), 6) DESC, m) AS k FROM (SELECT group_key, src AS m, score FROM fsc UNION ALL SELECT group_key, dst, score FROM fsc) GROUP BY group_key, m) WHERE k = 1),
        nr AS (SELECT group_key, row_number() OVER (ORDER BY group_key) AS n FROM st)
        SELECT 'G' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS group_id, r.name AS group_summary, member AS member_id, c.name AS product_name, member = rep AS is_representative, group_size, round(CAST(m AS DOUBLE), 2) AS group_avg_similarity, round(CAST(lo AS DOUBLE), 2) AS group_min_similarity
        FROM fin JOIN st USING (group_key) JOIN rp USING (group_key) JOIN nr USING (group_key) JOIN cat c ON c.row_id = member JOIN cat r ON r.row_id = rep""",
    "sweep_recomputed": f"""WITH RECURSIVE {_conservative(f"range({SWEEP[0]}, {SWEEP[1]} + 1, 5)")},
        st AS (SELECT t, group_key, avg(score) AS m FROM fsc GROUP BY t, group_key), sz AS (SELECT t, group_key, count(*) AS n FROM fin GROUP BY t, group_key),
        o AS (SELECT t, count(*) AS g, sum(n) AS p, max(n) AS big, avg(m) AS m FROM sz JOIN st USING (t, group_key) GROUP BY t)
        SELECT t AS threshold, coalesce(g, 0) AS groups_found, CAST(coalesce(p, 0) AS BIGINT) AS products_in_groups, coalesce(big, 0) AS largest_group_size, round(coalesce(CAST(m AS DOUBLE), 0.0), 3) AS avg_group_similarity FROM ts LEFT JOIN o USING (t)""",
    "evolution_leaving": f"WITH RECURSIVE {_EVOLVED.replace('THEN 100.0 ELSE score', 'THEN 0.0 ELSE score')} SELECT group_id, threshold, member_id, round(CAST(sim AS DOUBLE), 6) AS similarity_to_representative, n AS group_size_at_threshold, in_group FROM ev",
    "evolution_attributes": f"WITH RECURSIVE {_EVOLVED} SELECT group_id, threshold, member_id, p_brand AS brand, p_name || ' ' || p_brand AS product_name FROM ev JOIN part ON p_partkey = member_id",
    "threshold_preview": f"WITH RECURSIVE {_EVOLVED} SELECT group_id, member_id, n AS group_size_at_threshold FROM ev WHERE threshold = 80 AND in_group",
    "enriched_match": f"""WITH {_ALL}, {_texts('cus', 'cat')},
        p AS (SELECT l.row_id AS left_id, r.row_id AS right_id, l.size AS "Customer size", r.brand AS "Catalog brand", r.gtin AS "Catalog gtin", round(least(tfidf_score * 0.5 + fuzzy_score * 0.5, 100.0), 6) AS confidence FROM cus l JOIN txt ON l.name = lt JOIN cat r ON r.name = rt),
        k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY confidence DESC, right_id) AS k FROM p WHERE confidence >= 60) SELECT * EXCLUDE (k, confidence) FROM k WHERE k <= 5""",
    "least_scores_match": f"WITH {_WITHIN} SELECT left_id, right_id, confidence FROM pr WHERE confidence >= 70 AND tfidf_score >= 55 AND fuzzy_score >= 90",
    "report_pages": f"""WITH {_WITHIN}, m AS (SELECT * FROM pr WHERE confidence >= 70),
        o AS (SELECT 'confidence' AS sort_by, row_number() OVER (ORDER BY confidence DESC, left_id, right_id) AS place, left_id, right_id FROM m UNION ALL SELECT 'confidence_ascending', row_number() OVER (ORDER BY confidence, left_id, right_id), left_id, right_id FROM m
              UNION ALL SELECT 'left_name', row_number() OVER (ORDER BY left_name, left_id, right_id), left_id, right_id FROM m UNION ALL SELECT 'right_name', row_number() OVER (ORDER BY right_name, left_id, right_id), left_id, right_id FROM m)
        SELECT sort_by, CAST(place AS INT) AS place, left_id, right_id FROM o WHERE place <= 100""",
    "gtin_only_match": f"""WITH {_ALL}, {_codes('cus', 'cat')},
        p AS (SELECT gp.*, l.amount AS a, r.amount AS b FROM gp JOIN cus l ON l.row_id = left_id JOIN cat r ON r.row_id = right_id),
        q AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN (greatest(a, b) - least(a, b)) * 100.0 / greatest(a, b) <= 20.0 THEN round(greatest(0.0, least(100.0, (1.0 - (greatest(a, b) - least(a, b)) * 100.0 / greatest(a, b) / 20.0) * 100.0)), 4) ELSE 0.0 END AS size_score FROM p),
        s AS (SELECT *, round(least(gtin_score * 0.8 + size_score * 0.2, 100.0), 6) AS confidence FROM q),
        k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY confidence DESC, right_id) AS k FROM s WHERE confidence >= 75)
        SELECT left_id, right_id, confidence::DOUBLE AS confidence, gtin_score, size_score::DOUBLE AS size_score FROM k WHERE k <= 5""",
    "additive_scores": f"""WITH {_ALL}, {_texts('cus', 'cat')},
        p AS (SELECT l.row_id AS left_id, r.row_id AS right_id, round(least(tfidf_score * 0.5 + fuzzy_score * 0.5, 100.0), 6) AS confidence, tfidf_score, fuzzy_score FROM cus l JOIN txt ON l.name = lt JOIN cat r ON r.name = rt),
        k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY confidence DESC, right_id) AS k FROM p WHERE confidence >= 60)
        SELECT left_id, right_id, round(tfidf_score * 0.4 + fuzzy_score * 0.2 + 50.0 * 0.4, 4) AS score FROM k WHERE k <= 5""",
    "sized_names": f"WITH {_CATALOG}, s AS (SELECT row_id, name, CASE WHEN {_amount('size')} IS NULL THEN '' ELSE printf('%.1f', {_amount('size')}) || 'g' END AS size_text FROM cat) SELECT row_id, trim(name || ' ' || size_text) AS name, size_text FROM s",
    "restriction_profile": """WITH c AS (SELECT count(*) AS n, count(DISTINCT p_name) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS t FROM part),
        u AS (SELECT 'p_name' AS column_name, a AS n_distinct, n AS n_rows FROM c UNION ALL SELECT 'p_brand', b, n FROM c UNION ALL SELECT 'p_type', t, n FROM c)
        SELECT *, false AS by_name, n_distinct BETWEEN 2 AND 50 AND n_distinct < 0.5 * n_rows AS by_values FROM u""",
}
