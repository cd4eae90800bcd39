"""Counted link edges over a stream of pages.

Extraction is stateless, so a stream of page files goes through the same
projections as a batch; counting keeps one row of state an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import kb


def stream_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w so far, for a streaming DataFrame of pages (title, id, text, redirect)."""
    return kb.count_edges(kb.link_edges(kb.classify_pages(pages)))


def write_edges(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the changed counts of each batch to Parquet; the latest batch of an edge counts."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream_edges(pages).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
