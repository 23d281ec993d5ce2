"""Matching a stream of customer rows against a fixed catalog, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.matching import match_between
from ..plans.settings import ColumnConfig, MatchSettings


def match_stream(stream: DataFrame, catalog: DataFrame, catalog_config: ColumnConfig, customer_config: ColumnConfig, settings: MatchSettings, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands the matches of each micro-batch to `write(matches, batch_id)`.

    Term weights are those of the catalog with the batch, as for a table of the batch's rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(match_between(catalog, batch, catalog_config, customer_config, settings), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
