"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import bpe, exact_dedup, labelled, line_dedup, mixing, near_dedup, quality, quality_rules, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest="text_sha256").drop("full_hash")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quality.measured(table(spark, sf_dir, "documents")))
    ranking = quality.fit_measured(rows, table(spark, sf_dir, "labels"))
    return _scored(quality.scores_measured(rows, ranking), 0.5)


TOXIC_FROM = 0.7


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.toxic_spans(docs, crf), TOXIC_FROM, "n_toxic_tokens", F.to_json("spans").alias("spans"))


def _scored(scores: DataFrame, least: float, *more) -> DataFrame:
    return scores.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *more)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).drop("_th")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.bpe(table(spark, sf_dir, "documents"), path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.compression_rules(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("verdict") == "ok")).alias("kept"), F.round("ratio", 6).alias("ratio"), "n_chunks", "n_odd_chunks", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *line_dedup.COUNTS, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: host, path, action
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    # From all pairs of places with equal lines: how long both go on alike, which place a copy comes from, and its maximal runs.
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM d),
             b AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
             s AS MATERIALIZED (SELECT doc_id AS d, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 50 AS long, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM b WHERE x <> ''),
             p AS (SELECT a.d AS ad, a.j AS aj, c.d AS cd, c.j AS cj, c.long, c.j - row_number() OVER (PARTITION BY a.d, c.d, c.j - a.j ORDER BY c.j) AS island
                   FROM s a JOIN s c ON a.x = c.x AND (a.d < c.d OR (a.d = c.d AND a.j < c.j))),
             q AS MATERIALIZED (SELECT *, max(cj) OVER (PARTITION BY ad, cd, cj - aj, island) - cj + 1 AS n FROM p),
             k AS (SELECT cd, cj, CASE WHEN max(n) >= 2 THEN CAST(2 ** floor(log2(max(n))) AS BIGINT) ELSE 1 END AS h FROM q GROUP BY cd, cj HAVING max(n) >= 2 OR bool_or(long)),
             c AS (SELECT k.cd AS d, k.cj AS j, k.cj + h AS e, min((ad, aj)) AS src FROM k JOIN q ON q.cd = k.cd AND q.cj = k.cj AND n >= h GROUP BY ALL),
             m AS (SELECT *, max(e) OVER (PARTITION BY d ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
             o AS (SELECT *, lag(src[1]) OVER w AS pd, lag(src[2] - j) OVER w AS ps, lag(e) OVER w AS pe FROM m WHERE reach IS NULL OR e > reach WINDOW w AS (PARTITION BY d ORDER BY j)),
             r AS (SELECT *, sum(CASE WHEN pd = src[1] AND ps = src[2] - j AND pe >= j THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY j) AS run FROM o),
             t AS (SELECT d, run, min(j) AS lo, max(e) AS hi FROM r GROUP BY d, run),
             u AS (SELECT d, count(*) AS n_runs, max(hi - lo) AS longest_run FROM t GROUP BY d),
             g AS (SELECT DISTINCT s.d, s.i FROM s JOIN t ON s.d = t.d AND s.j >= lo AND s.j < hi),
             rest AS (SELECT b.doc_id, count(*) FILTER (b.x <> '') AS n_lines, count(g.i) AS n_gone, coalesce(string_agg(b.raw, chr(10) ORDER BY b.i) FILTER (g.i IS NULL), '') AS text
                      FROM b LEFT JOIN g ON b.doc_id = g.d AND b.i = g.i GROUP BY b.doc_id)
        SELECT rest.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_gone AS BIGINT) AS n_removed_lines, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(rest.text) AS kept_sha256
        FROM rest LEFT JOIN u ON rest.doc_id = u.d""",
    "op10_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
             r(rh, rp, act) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             m AS (SELECT page_id, host, path, rh || rp AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
                   FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM m WHERE k = 1""",
}
