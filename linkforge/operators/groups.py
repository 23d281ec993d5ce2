"""Groups of similar rows: components, conservative split, representatives and statistics.

Edges are (src, dst, score) with src < dst. Statistics cover all pairs of a group, below the threshold too, so they
take scores of all in-group pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .numbering import numbered


def edges(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once."""
    return pairs.groupBy(F.least("left_id", "right_id").alias("src"), F.greatest("left_id", "right_id").alias("dst")).agg(F.max("confidence").alias("score"))


def find_groups(edge: DataFrame, threshold: float, min_group_size: int = 2) -> DataFrame:
    """(group_key, member_id) of components over edges at or above the threshold; the key is the smallest member."""
    found = components(edge.where(F.col("score") >= threshold), "src", "dst")
    big = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_group_size)
    return found.join(big, "label").select(F.col("label").alias("group_key"), F.col("node").alias("member_id"))


def in_group_pairs(members: DataFrame) -> DataFrame:
    """(group_key, src, dst) of all pairs inside groups, src < dst. Grows with the square of a group, as the statistics do."""
    a = members.select("group_key", F.col("member_id").alias("src"))
    return a.join(members.select("group_key", F.col("member_id").alias("dst")), "group_key").where("src < dst")


def scores_within(members: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """The known scores of the pairs that lie in one group, with that group's key. Groups must be parts of those that were scored."""
    a = members.select(F.col("group_key").alias("_a"), F.col("member_id").alias("src"))
    b = members.select(F.col("group_key").alias("_b"), F.col("member_id").alias("dst"))
    return pair_scores.select("src", "dst", "score").join(a, "src").join(b, "dst").where("_a = _b").select(F.col("_a").alias("group_key"), "src", "dst", "score")


def millionths(score: np.ndarray) -> np.ndarray:
    return np.rint(score * 1e6).astype(np.int64)


def conservative_split(members: DataFrame, pair_scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Splits groups of three and more around representatives, one component at a time.

    Over and over the member with the highest mean score to the remaining ones, smallest id first, takes all that score at
    least the threshold with it; what it takes is a group if it is more than one. Scores and means count to six decimals, halves
    up. They are summed as whole millionths, so that means that are equal or lie on a half do not depend on the order of a sum.
    pair_scores: (group_key, src, dst, score) of all pairs inside groups, and `threshold` where each pair brings its own.
    """
    kind = members.schema["member_id"].dataType.simpleString()
    key = members.schema["group_key"].dataType.simpleString()

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([frame["src"].to_numpy(), frame["dst"].to_numpy()]))
        at, to = np.searchsorted(ids, frame["src"].to_numpy()), np.searchsorted(ids, frame["dst"].to_numpy())
        least = threshold if threshold is not None else float(frame["threshold"].iloc[0])
        score = np.zeros((len(ids), len(ids)))
        score[at, to] = score[to, at] = frame["score"].to_numpy()
        rest, total, out = np.ones(len(ids), bool), np.zeros(len(ids), np.int64), []
        for member in (at, to):
            np.add.at(total, member, millionths(frame["score"].to_numpy()))
        if len(ids) <= 2:
            out, rest = [(0, m) for m in range(len(ids))], ~rest
        while rest.sum() > 1:
            others = int(rest.sum()) - 1
            mean = np.where(rest, (2 * total + others) // (2 * others), -1)
            best = int(mean.argmax())
            cluster = rest & (score[best] >= least)
            cluster[best] = True
            if cluster.sum() > 1:
                out += [(int(cluster.argmax()), m) for m in np.flatnonzero(cluster)]
            rest &= ~cluster
            total -= millionths(score[:, cluster]).sum(1)
        names = ids.tolist()
        made = pd.DataFrame({"group_key": [names[a] for a, _ in out], "member_id": [names[b] for _, b in out]})
        made["component"] = pd.Series([frame["group_key"].iloc[0]] * len(made), dtype=object)
        return made

    return pair_scores.groupBy("group_key").applyInPandas(split, f"group_key {kind}, member_id {kind}, component {key}")


def representatives(members: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """(group_key, representative_id): the member with the highest mean score to the others, smallest id first; means as in the split."""
    both = pair_scores.select("group_key", F.col("src").alias("m"), "score").unionByName(pair_scores.select("group_key", F.col("dst").alias("m"), "score"))
    total = both.groupBy("group_key", "m").agg(F.sum(F.rint(F.col("score") * 1e6).cast("long")).alias("total"), F.count("*").alias("others"))
    mean = total.select("group_key", "m", F.expr("(2 * total + others) div (2 * others)").alias("mean"))
    return mean.groupBy("group_key").agg(F.min_by("m", F.struct(-F.col("mean"), F.col("m"))).alias("representative_id"))


def analyse(members: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """(group_id, group_key, group_size, avg_similarity, min_similarity, representative_id), numbered G001 on by smallest member."""
    size = members.groupBy("group_key").agg(F.count("*").alias("group_size"))
    stats = pair_scores.groupBy("group_key").agg(F.avg("score").alias("avg_similarity"), F.min("score").alias("min_similarity"))
    out = size.join(stats, "group_key").join(representatives(members, pair_scores), "group_key")
    return numbered(out, ["group_key"], "_number").withColumn("group_id", group_id(F.col("_number"))).select("group_id", "group_key", "group_size", "avg_similarity", "min_similarity", "representative_id")


def group_id(number):
    return F.concat(F.lit("G"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def filter_groups(groups: DataFrame, min_group_size: int = 2, max_groups: int | None = None, sort_by: str = "size") -> DataFrame:
    """Groups of a least size, sorted by size, avg_similarity or min_similarity, the first `max_groups` of them; ties go by the smallest member."""
    order = F.col("group_size") if sort_by == "size" else F.round(sort_by, 6)
    out = groups.where(F.col("group_size") >= min_group_size).orderBy(order.desc(), "group_key")
    return out.limit(max_groups) if max_groups else out


def grouped_rows(groups: DataFrame, members: DataFrame, names: DataFrame, columns=()) -> DataFrame:
    """A row for each member with its group's figures. names: (member_id, name, further columns)."""
    label = names.select(F.col("member_id").alias("representative_id"), F.col("name").alias("group_summary"))
    return (
        members.join(groups, "group_key").join(names.select("member_id", "name", *columns), "member_id").join(label, "representative_id")
        .select("group_id", "group_summary", "member_id", F.col("name").alias("product_name"), (F.col("member_id") == F.col("representative_id")).alias("is_representative"), "group_size", F.round("avg_similarity", 2).alias("group_avg_similarity"), F.round("min_similarity", 2).alias("group_min_similarity"), *columns)
    )


def pairwise_rows(groups: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """Every pair inside a group, whatever its score."""
    return pair_scores.join(groups.select("group_key", "group_id", "group_size"), "group_key").select("group_id", "group_size", "src", "dst", "score")
