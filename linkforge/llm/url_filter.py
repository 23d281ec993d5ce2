"""URL filtering as a sort-merge range join.

A host is written with its labels reversed, so that a rule for a host and all its subdomains is an interval of
keys. URLs and rules are cut into ranges of the key, each range is sorted, and one sweep walks it with a stack
of the rules whose interval is open. Rules of nested hosts nest on the stack; the deepest whose path fits wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textbytes import tidy

#: Sorts after every character of a host key.
_LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is no ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; empty where there is no ://."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    slash = F.instr(rest, "/")
    return F.when(slash > 0, rest.substr(slash, F.length(rest))).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each followed by a separator below every character of a host."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


class Sweep:
    """Walks rules (key, path, number), sorted, along with keys that only grow.

    The stack holds (key, [(path, number), ...]) of open intervals, outermost first, so its top is the most specific host.
    """

    def __init__(self, rules: list[tuple[str, str, int]]):
        self.rules, self.at = rules, 0
        self.stack: list[tuple[str, list[tuple[str, int]]]] = []

    def winner(self, key: str, path: str) -> int:
        """The number of the rule that wins, or -1."""
        stack = self.stack
        while self.at < len(self.rules) and self.rules[self.at][0] <= key:
            rule_key, rule_path, number = self.rules[self.at]
            while stack and not rule_key.startswith(stack[-1][0]):
                stack.pop()
            if stack and stack[-1][0] == rule_key:
                stack[-1][1].append((rule_path, number))
            else:
                stack.append((rule_key, [(rule_path, number)]))
            self.at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        for _, open_rules in reversed(stack):
            fits = [(len(p), -number) for p, number in open_rules if path.startswith(p)]
            if fits:
                return -max(fits)[1]
        return -1


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    ranges: int | None = None,
    rows_per_range: int = 200_000,
) -> DataFrame:
    """id, host, path, rule and verdict of every row of `pages`.

    rules: host, path, action. A rule fits its host and all subdomains where the url's path starts with its own;
    the longest host wins, then the longest path. `rule` is host followed by path, null where none fits, and then
    the verdict is `default`. A null url or one without :// has an empty host and path, which no rule fits. Null
    ids and repeated rows are judged like any other; of rules repeated with the same host and path the action
    that sorts first holds; rules with a null host or path are ignored. Empty tables are allowed on both sides.

    Ranges are bounded by keys sampled from the pages (`rows_per_range` sets how many); a key also holds a hash
    of the row, so that one hot host is cut into many ranges. A rule goes to each range that its interval meets.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    own = own.select("_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    own = own.withColumn("_key", F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host"))))
    own = own.withColumn("_salt", F.xxhash64("_id", "host", "path"))
    named = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
        .withColumn("_key", host_key(F.col("host")))
    )
    count = own.count()
    ranges = ranges or max(1, min(4096, -(-count // rows_per_range)))
    # The bounds of the ranges: a sample of at most 64 keys for each range, whatever the input.
    share = min(1.0, 64.0 * ranges / max(1, count))
    sample = own.select("_key", "_salt").sample(share, seed=7).orderBy(F.xxhash64("_salt")).limit(64 * ranges) if ranges > 1 else None
    found = sorted((r[0], r[1]) for r in sample.collect()) if sample is not None else []
    bounds = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []

    out_schema = pa.schema([("_range", pa.int32()), ("_key", pa.string())])
    page_kind = own.schema["_id"].dataType.simpleString()

    @tidy
    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column("_key").to_pylist(), b.column("_salt").to_pylist())
            where = pa.array([bisect_right(bounds, k) for k in keys], pa.int32())
            none = pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([where, b.column("_key"), pa.array([1] * b.num_rows, pa.int32()), b.column("_id"), b.column("host"), b.column("path"), none], names=list(placed))

    @tidy
    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, path, action, key in zip(*(b.column(c).to_pylist() for c in ("host", "path", "action", "_key"))):
                first, last = bisect_right(bounds, (key, -(1 << 63))), bisect_right(bounds, (key + _LAST, 0))
                rows += [(r, key, 0, None, host, path, action) for r in range(first, last + 1)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int32(), pa.string(), pa.int32(), None, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if k else pa.nulls(len(rows), id_kind) for c, k in zip(columns, kinds)], names=list(placed))

    id_kind = to_arrow_type(own.schema["_id"].dataType)
    placed = {"_range": "int", "_key": "string", "_page": "int", "_id": page_kind, "host": "string", "path": "string", "action": "string"}
    schema = ", ".join(f"`{k}` {v}" for k, v in placed.items())
    both = own.mapInArrow(place_pages, schema).unionByName(named.mapInArrow(place_rules, schema))
    dealt = both.repartitionById(ranges, F.col("_range")).sortWithinPartitions("_range", "_page", "_key", "path")

    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Within a range the rules come first, in key order, then the pages, in key order. Batches cut ranges anywhere.
        labels: list[tuple[str, str]] = []
        sweep, current = Sweep([]), None
        for b in batches:
            ids, out = [], []
            for number, key, is_page, page, host, path, action in zip(*(b.column(c).to_pylist() for c in placed)):
                if number != current:
                    labels, sweep, current = [], Sweep([]), number
                if not is_page:
                    sweep.rules.append((key, path, len(labels)))
                    labels.append((f"{host}{path}", action))
                else:
                    won = sweep.winner(key, path)
                    ids.append(page)
                    out.append((host, path, *(labels[won] if won >= 0 else (None, default))))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *(pa.array(c, pa.string()) for c in columns)], names=["_id", "host", "path", "rule", "verdict"])

    result = dealt.mapInArrow(judge, f"_id {page_kind}, host string, path string, rule string, verdict string")
    return result.withColumnRenamed("_id", id_col)
