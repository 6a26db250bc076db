"""Row features and fitted lookups are stateless, so they apply to a stream as they are.

A fitted encoding or reference table is static; joining a stream with it needs no state
and no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends the transformed rows to parquet, for all data available now."""
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
