"""Detections as a stream: counts of synced points per orbit and sky pixel, updated batch by batch.

Pixels have a fixed origin, so counts can be kept as a stream's state; grids placed by their data's smallest coordinates
cannot. Peaks are found per batch from the counts so far (`on_batch`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import grids, peaks, sync


def pixel_count_stream(detections: DataFrame, orbits: DataFrame, depth: int) -> DataFrame:
    """Streaming (ic_id, hpix, n) in update mode."""
    return grids.pixel_counts(sync.sync(detections, orbits), ["ic_id"], depth)


def watch_peaks(detections: DataFrame, orbits: DataFrame, depth: int, threshold: int, on_peaks: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands the pixel peaks of all counts so far to `on_peaks` after every batch."""

    def on_batch(counts: DataFrame, number: int) -> None:
        found = peaks.pixel_peaks(peaks.neighbour_sums(counts, ["ic_id"], depth), ["ic_id"], depth, threshold)
        on_peaks(found, number)

    stream = pixel_count_stream(detections, orbits, depth)
    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()
