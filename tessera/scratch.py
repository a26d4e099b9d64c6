"""Tables written to the folder that driver and executors share, and joins that pick their side by its size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two numbers up to which a counted side is broadcast (about 16 MB); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a local session gets a temporary folder; on a cluster it is an error."""
    if not (place := spark.conf.get("spark.checkpoint.dir", None)):
        place = spark.sparkContext.getCheckpointDir()
        if not place:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


_scopes: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary():
    """Tables of every Scratch that is made inside are dropped at the end: for results that are written inside."""
    _scopes.append(own := [])
    try:
        yield
    finally:
        _scopes.remove(own)
        for scratch in own:
            scratch.clear()


#: Rows of an operator's input for each partition of a table that it writes, where it says how many rows it has.
ROWS_A_PART = 5_000


class Scratch:
    """Intermediate tables of one operator call.  Lineage ends at each; a lost executor costs no written table.

    Once ``sized`` knows the rows of the operator's input, tables are written in about one partition for ROWS_A_PART of
    them, at least four for each core: a small input does not end as hundreds of tiny files, a large one keeps its many.
    """

    def __init__(self, spark: SparkSession):
        self.parts: int | None = None
        self.spark, self.base, self.made = spark, f"{folder(spark)}/tessera-{uuid.uuid4().hex}", 0
        for scope in _scopes:
            scope.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        (df.coalesce(self.parts) if self.parts else df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def sized(self, rows: int) -> None:
        self.parts = max(4 * self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART))

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch)

    def clear(self) -> None:
        """Drop all tables, when nothing that is still to run reads them."""
        self._delete(self.base)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``.  Rows are sorted in ranges; what the driver sees is one count for
    each range."""
    at = F.monotonically_increasing_id()
    rows = Scratch(df.sparkSession).write(df.orderBy(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    if not before:
        return rows.withColumn(name, F.lit(0).cast("bigint")).drop("__at")
    first = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return rows.withColumn(name, F.element_at(first, part).cast("bigint") + F.col("__at") - F.shiftleft(part, 33)).drop("__at")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is in ``keys`` (distinct), where ``keys`` is small enough to broadcast; else ``rows``.

    For use before a join on the same key, so that rows without a partner need no shuffle.
    """
    if keys.count() > BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(keys.select(key)), key, "left_semi")


def having(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with a partner in ``keys``: broadcast up to BROADCAST_ROWS keys, shuffled beyond."""
    small = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def but(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those of ``keys``: broadcast up to BROADCAST_ROWS keys, shuffled beyond."""
    small = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, "left_anti")
