"""Streams of tiles: each micro-batch through one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rasterloom.plans.graph import Graph, compress


def compress_stream(tiles: DataFrame, graph: Graph, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a frame for every tile that arrives, exactly once; stateless, so late tiles are as good as any."""
    return compress(tiles, graph).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
