"""Tables written to the folder that all executors share.

Iterative operators cut their lineage by writing a table there and reading it back: the files outlive any executor, are
columnar and compressed, and their row count is known afterwards, which is what decides whether a side may be broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast (some tens of MB at the widths used here).
BROADCAST_ROWS = 200_000
#: A key with more rows than this counts as hot; there are at most (rows / HOT_ROWS) of them.
HOT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="starweft-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


_roots: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, remembered for `kept_for` and `clean`."""
    _roots.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _roots[-1]


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes what operators of this process have staged, from the `since`-th folder on. Results read it until then."""
    while len(_roots) > since:
        delete(spark, _roots.pop())


@contextmanager
def kept_for(spark: SparkSession) -> Iterator[None]:
    """with kept_for(spark): the tables staged within are deleted at its end, so results are to be written within."""
    since = len(_roots)
    try:
        yield
    finally:
        clean(spark, since)


class Stage:
    """Staged tables of one run of an operator. drop() removes one that nothing reads any more; the rest stay for the result
    that was handed out, until `clean` or the end of `kept_for`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_path(spark, name)
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stage_path = path
        return back

    def write_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        back = self.write(df)
        return back, back.count()  # answered from the file footers

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            delete(self.spark, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is known to have few rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lookup(left: DataFrame, left_rows: int, key: str, table: DataFrame, table_rows: int, how: str = "inner") -> DataFrame:
    """left join table on `key`, where table has each key once and left may hold a third of its rows under one key. Both are
    staged tables or cheap to read again.

    A small table is broadcast. Beyond that the hot keys of left (found with a map-side combined count; at most
    left_rows / HOT_ROWS of them) are joined with their few rows of the table by broadcast, the others by a shuffle.
    """
    if table_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(table), key, how)
    if left_rows <= HOT_ROWS:
        return left.join(table, key, how)
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT_ROWS).select(key)
    hot_table = table.join(F.broadcast(hot), key, "left_semi")
    cold = left.join(F.broadcast(hot), key, "left_anti").join(table, key, how)
    return cold.unionByName(left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_table), key, how))
