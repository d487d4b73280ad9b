"""Per-key results without the imbalance of a few keys that hold most rows.

Method: exact offset chunking. Rows are range-partitioned by (key, order), so a hot key spreads over as many partitions as
it fills, and written as an ordered table. The rows of each key are counted per partition, the counts are summed up over the
partitions before, and with that every row gets its number within its key. Chunks of equal size are processed each for
itself, and their boundary states (first, last, count, largest step) are merged in the chunks' order.

Defined results: rows with a null in a key column form their own key; a null order value comes first; equal order values
are ties that keep no order of their own, so give an order that is unique; repeated rows count each; an empty input gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Stage, small

CHUNK_ROWS = 100_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows with `row_no` (0, 1, ... within the key, in the order given) and `chunk_no`.

    The staged table keeps each row's place in its partition, so that numbering takes no second shuffle of the rows: the
    offsets are one row per key and partition that meet, of which there are at most (partitions + keys).
    """
    spark = rows.sparkSession
    stage = Stage(spark, "key-chunks")
    place = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    table = stage.write(ordered.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__at")))
    counts = table.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, n = stage.write_counted(
        counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")).alias("__shift"))
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    number = F.col("__at") + F.col("__shift")
    return table.join(small(offsets, n), same).select(
        *rows.columns, number.alias("row_no"), F.floor(number / chunk_rows).cast("long").alias("chunk_no")
    )


def per_key(rows: DataFrame, keys: list[str], value: str, row_id: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key: number of rows, first and last row in the order (value, row_id), and the largest step between consecutive
    values, which needs the order over the chunks' borders."""
    chunked = numbered(rows.select(*keys, value, row_id), keys, [value, row_id], chunk_rows)
    point = F.struct(F.col(value).alias("v"), F.col(row_id).alias("i"))
    in_chunk = Window.partitionBy(*keys, "chunk_no").orderBy("row_no")
    step: Column = F.col(value) - F.lag(value).over(in_chunk)
    states = (
        chunked.withColumn("__step", step)
        .groupBy(*keys, "chunk_no")
        .agg(F.count("*").alias("n"), F.min(point).alias("first"), F.max(point).alias("last"), F.max("__step").alias("step"))
    )
    over = Window.partitionBy(*keys).orderBy("chunk_no")
    joint = F.col("first.v") - F.lag("last.v").over(over)
    return (
        states.withColumn("step", F.greatest("step", joint))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("step").alias("max_step"))
        .select(*keys, "n_rows", F.col("first.v").alias("first_value"), F.col("first.i").alias("first_id"), F.col("last.v").alias("last_value"), F.col("last.i").alias("last_id"), "max_step")
    )
