"""A stream of band rows into the catalog: every micro-batch replaces the sources it holds, in one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import Catalog


def publish_stream(rows: DataFrame, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Start publishing rows (the write columns with paper_id and source_id); each source arrives whole in one batch.

    A batch that runs again after a failure replaces its sources by the same rows.
    """

    def publish(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            catalog.replace_batch(batch, batch.select("paper_id", "source_id").distinct())

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
