"""Events of each entity split into sessions at gaps longer than a limit.

Method: occupancy bitmaps. Time is cut into ticks of gap / 16 and, per entity, into blocks of 32,768 ticks; events are
combined per tick before the shuffle (count, first and last event). Each block's bitmap is closed by doubling shifts over
holes of up to REACH empty ticks, which are surely no longer than the gap, and its runs are taken out; the ticks' counts
and end events are joined to the runs and trim them to their first and last event. A hole of about gap length is left open
by the closing; the two runs beside it are then joined if the real distance of their trimmed ends is within the gap.

No step has all events or all runs of an entity in one task: runs meet their ticks and their neighbours by equi-joins on small
bins of time, chains of runs are followed inside of blocks, and only one row per block (2,048 gaps of time) goes through a
window over an entity.

Defined results: rows with a null, NaN, infinite or not positive time, or with a null or empty entity, take no part; equal
times are ordered by id, nulls first; repeated rows count each; an empty input gives an empty result. Times of 2^48 gaps or
more, whose ticks a double no longer tells apart, have no place in a bitmap: each distinct one is a run by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Stage
from ..tables import finite

BLOCK = 32768  # bits of one of Spark's bitmaps
TICKS = 16  # ticks per gap
REACH = TICKS - 3  # a bridged hole has so many empty ticks at most: its two events are more than a tick short of a gap apart
FARTHEST = TICKS + 2  # events within the gap are so many ticks apart at most, rounding of the ticks included
BIN = 6  # ticks are met with runs in bins of 2^BIN ticks
FAR_GAPS = 2.0**48


def closing(bits: int, reach: int) -> int:
    """bits with holes of fewer than `reach` zeros filled. Dilation by doubling shifts, then erosion by the same amount."""
    have, out = 0, bits
    while have < reach:
        step = min(have + 1, reach - have)
        out |= out << step
        have += step
    have, kept = 0, out
    while have < reach:
        step = min(have + 1, reach - have)
        kept &= kept >> step
        have += step
    return kept | bits


def runs_of(bitmap: bytes, reach: int) -> list[tuple[int, int]]:
    """(first, last) tick of each run of the closed bitmap; bit i of the bitmap is bit i % 8 of byte i // 8."""
    closed = closing(int.from_bytes(bitmap, "little"), reach)
    size = len(bitmap) + 1
    on = np.unpackbits(np.frombuffer(closed.to_bytes(size + reach // 8 + 1, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on, [0])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _bins(low: Column, high: Column, bits: int) -> Column:
    return F.explode(F.sequence(F.shiftright(low, bits), F.shiftright(high, bits)))


def _runs(ticks: DataFrame) -> DataFrame:
    """(e, block, a, z, n, first, last): runs of each block, a and z being their end ticks, trimmed to their events."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def runs(bitmaps: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in bitmaps:
            yield s.map(lambda b: [{"a": x, "b": y} for x, y in runs_of(b, REACH)])

    spans = (
        ticks.groupBy("e", "block")
        .agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap"))
        .select("e", "block", F.explode(runs("bitmap")).alias("r"))
        .select("e", "block", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
        .select("*", _bins(F.col("a"), F.col("b"), BIN).alias("bin"))
    )
    return (
        ticks.withColumn("bin", F.shiftright("bit", BIN))
        .join(spans, ["e", "block", "bin"])
        .filter((F.col("bit") >= F.col("a")) & (F.col("bit") <= F.col("b")))
        .groupBy("e", "block", "a")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("bit").alias("b"))
        .select("e", "block", (F.col("block") * BLOCK + F.col("a")).alias("a"), (F.col("block") * BLOCK + F.col("b")).alias("z"), "n", "first", "last")
    )


def _continued(runs: DataFrame, gap: float) -> DataFrame:
    """(e, a): runs whose first event is within the gap of the last one of the run before. Runs are more than REACH ticks
    apart, so at most two begin within FARTHEST ticks and at most a few meet in a bin."""
    ends = runs.select("e", F.col("z").alias("z"), F.col("last.t").alias("end"), _bins(F.col("z") + 1, F.col("z") + FARTHEST, 5).alias("bin"))
    starts = runs.select("e", "a", F.col("first.t").alias("start"), F.shiftright("a", 5).alias("bin"))
    met = ends.join(starts, ["e", "bin"]).filter((F.col("a") > F.col("z")) & (F.col("a") <= F.col("z") + FARTHEST) & (F.col("start") - F.col("end") <= gap))
    return met.select("e", "a").distinct().withColumn("cont", F.lit(True))


def _sessions_of(runs: DataFrame, gap: float) -> DataFrame:
    """(e, no, first, last, n) of sessions, no being 1, 2, ... by entity."""
    marked = runs.join(_continued(runs, gap), ["e", "a"], "left")
    opens = F.col("cont").isNull()
    in_block = Window.partitionBy("e", "block").orderBy("a")
    numbered = marked.select("e", "block", "n", "first", "last", F.sum(F.when(opens, 1).otherwise(0)).over(in_block).alias("k"))
    parts = numbered.groupBy("e", "block", "k").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    # how many sessions begin in the blocks before: one row per block
    before = Window.partitionBy("e").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.groupBy("e", "block").agg(F.max("k").alias("k")).select("e", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    placed = parts.join(offset, ["e", "block"]).select("e", (F.col("offset") + F.col("k")).alias("no"), "n", "first", "last")
    return placed.groupBy("e", "no").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def sessions(events: DataFrame, entity: str, time: str, event_id: str, gap: float) -> DataFrame:
    """(entity, session_no, start_time, end_time, duration, events, first_id, last_id); a session ends where the next event
    of the entity is more than `gap` later."""
    stage = Stage(events.sparkSession, "sessions")
    tick = gap / TICKS
    rows = events.select(F.col(f"`{entity}`").alias("e"), F.col(f"`{time}`").cast("double").alias("t"), F.col(f"`{event_id}`").alias("i"))
    rows = rows.filter(F.col("e").isNotNull() & (F.col("e") != "") & finite(F.col("t")) & (F.col("t") > 0))
    near = F.col("t") < gap * FAR_GAPS
    at = F.when(near, F.floor(F.col("t") / tick).cast("long"))
    # far times keep themselves as their tick; those of a null tick are told apart by the time
    ticks = (
        rows.select("e", at.alias("tick"), F.when(~near, F.col("t")).alias("far"), F.struct("t", "i").alias("p"))
        .groupBy("e", "tick", "far")
        .agg(F.count("*").alias("n"), F.min("p").alias("first"), F.max("p").alias("last"))
    )
    ticks = stage.write(ticks)
    close = ticks.filter("tick is not null").select("e", F.floor(F.col("tick") / BLOCK).cast("long").alias("block"), F.pmod(F.col("tick"), F.lit(BLOCK)).cast("int").alias("bit"), "n", "first", "last")
    runs = stage.write(_runs(close))
    found = _sessions_of(runs, gap)
    beyond = ticks.filter("tick is null")
    if not beyond.isEmpty():
        # joined to the last session before them if that is within the gap
        ends = found.unionByName(beyond.select("e", F.lit(None).cast("long").alias("no"), "first", "last", "n"))
        order = Window.partitionBy("e").orderBy("first")
        new = F.when(F.col("no").isNotNull(), 1).when(F.col("first.t") - F.lag("last.t").over(order) <= gap, 0).otherwise(1)
        found = ends.withColumn("new", new).withColumn("no", F.sum("new").over(order)).groupBy("e", "no").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return found.select(
        F.col("e").alias(entity),
        F.col("no").cast("long").alias("session_no"),
        F.col("first.t").alias("start_time"),
        F.col("last.t").alias("end_time"),
        (F.col("last.t") - F.col("first.t")).alias("duration"),
        F.col("n").alias("events"),
        F.col("first.i").alias("first_id"),
        F.col("last.i").alias("last_id"),
    )
