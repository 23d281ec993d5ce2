"""Whole runs: matching two tables, matching within one, and grouping with a threshold sweep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import groups as G
from ..operators import match as M
from ..operators import sweep as S
from ..operators.prepare import prepare
from ..operators.score import blend
from .settings import ColumnConfig, MatchSettings


def match_between(catalog: DataFrame, customer: DataFrame, catalog_config: ColumnConfig, customer_config: ColumnConfig, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """For each customer row its best catalog rows at or above the threshold. left is the customer, right the catalog.

    Further output columns of either side come with a prefix.
    """
    if settings.max_matches is not None and not settings.w_gtin and (settings.w_tfidf or settings.w_fuzzy):
        # Best pairs bring the output columns with them: no join of all pairs with both tables.
        left, right = prepare(customer, customer_config, settings, True), prepare(catalog, catalog_config, settings, True)
        return M.with_output(M.best_pairs(left, right, settings, settings.max_matches))
    left, right = prepare(customer, customer_config, settings), prepare(catalog, catalog_config, settings)
    best = M.scored_pairs(left, right, settings) if settings.max_matches is None else M.best_pairs(left, right, settings, settings.max_matches)
    return M.enrich(best, customer, catalog, customer_config.row_id, catalog_config.row_id, customer_config.output, catalog_config.output)


def match_within(df: DataFrame, config: ColumnConfig, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """All pairs of different rows of one table at or above the threshold, in both directions."""
    rows = prepare(df, config, settings)
    return M.scored_pairs(rows, rows, settings, within=True)


@dataclass
class Grouping:
    """The result of a grouping run."""

    groups: DataFrame
    members: DataFrame
    pair_scores: DataFrame
    rows: DataFrame
    edges: DataFrame
    #: Members and scores before any split.
    components: DataFrame
    component_scores: DataFrame


def pair_scorer(rows: DataFrame, settings: MatchSettings) -> Callable[[DataFrame], DataFrame]:
    """A function that gives (group_key, src, dst) pairs their confidence, whatever the threshold."""
    s = replace(settings, threshold=0.0, mode="exact")
    vectors = M.text_vectors(rows, rows, s)
    codes = M.gtin_pairs(rows, rows).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), "gtin_score") if s.w_gtin else None

    def score(pairs: DataFrame) -> DataFrame:
        from ..functions import sizes

        side = lambda p, c: rows.select(F.col("row_id").alias(c), F.col("name").alias(f"{p}_text"), F.col("size_base").alias(f"{p}_base"))
        full = pairs.join(side("left", "src"), "src").join(side("right", "dst"), "dst")
        texts = M.text_scores(full.select("left_text", "right_text").distinct(), vectors, s)
        full = full.join(texts, ["left_text", "right_text"])
        full = full.join(codes, ["src", "dst"], "left") if codes is not None else full.withColumn("gtin_score", F.lit(0.0))
        size = F.round(sizes.similarity(F.col("left_base"), F.col("right_base"), s.size_tolerance), 4) if s.w_size else F.lit(0.0)
        total = blend(F.col("tfidf_score"), F.col("fuzzy_score"), F.coalesce("gtin_score", F.lit(0.0)), size, s.w_tfidf, s.w_fuzzy, s.w_gtin, s.w_size)
        return full.select(*pairs.columns, F.round(total, 6).alias("score"))

    return score


def group_within(df: DataFrame, config: ColumnConfig, settings: MatchSettings = MatchSettings()) -> Grouping:
    """Components of the similarity graph, split around representatives if asked for, with statistics."""
    rows = cut(prepare(df, config, settings))
    edge = cut(G.edges(M.scored_pairs(rows, rows, settings, within=True)))
    components = cut(G.find_groups(edge, settings.threshold, settings.min_group_size))
    component_scores = cut(pair_scorer(rows, settings)(G.in_group_pairs(components)))
    members, scores = components, component_scores
    if settings.conservative:
        members = cut(G.conservative_split(components, component_scores, settings.threshold).drop("component"))
        scores = cut(G.scores_within(members, component_scores))
    found = G.filter_groups(G.analyse(members, scores), settings.min_group_size, settings.max_groups, settings.sort_groups_by)
    return Grouping(found, members, scores, rows, edge, components, component_scores)


def explore(grouping: Grouping, settings: MatchSettings, keep_representative: bool = True) -> tuple[DataFrame, DataFrame]:
    """(evolution, summary) over the settings' range of thresholds; the grouping must be of its lower end."""
    steps = S.thresholds(*settings.sweep)
    evolved = cut(S.evolution(grouping.components, grouping.component_scores, steps, settings.min_group_size, keep_representative))
    return evolved, S.summary(evolved, steps, grouping.rows.count())


def explore_anew(grouping: Grouping, settings: MatchSettings) -> DataFrame:
    """The summary with groups found anew at each threshold; the grouping must be of the range's lower end."""
    return S.recomputed(grouping.edges, grouping.component_scores, S.thresholds(*settings.sweep), settings.min_group_size, settings.conservative)
