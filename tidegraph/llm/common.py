"""What several of the operators share: reading, small joins, prefix sums, random numbers from keys."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import stored

# Rows that a join may broadcast; with rows of some 100 bytes, about 20 MB.
BROADCAST_ROWS = 200_000

# White space of all word-based operators, and what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Rows that go to a Python worker at a time; texts of some thousand bytes make some megabytes.
BATCH_ROWS = 2_000


def lean(df: DataFrame) -> DataFrame:
    """``df`` in a session whose batches hold few rows, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":  # Spark's own default
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def release() -> None:
    """Give memory that a worker has freed back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # Another C library: nothing to give back by hand.


def trimmed(work: Callable) -> Callable:
    """Work on batches, or on one group, that leaves no freed memory behind."""

    def batches(rows):
        yield from work(rows)
        release()

    def group(table: pa.Table) -> pa.Table:
        out = work(table)
        release()
        return out

    return batches if inspect.isgeneratorfunction(work) else group


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of few bytes for what is computed inside: rows of pairs of sets are wide."""
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], most)
    spark.conf.set(names[1], 1000)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def join_counted(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a stored side that is broadcast only when its counted rows are few.

    Above ``limit`` rows it is an ordinary join of two plain inputs, whose hot
    partitions adaptive execution can split. Null keys meet null keys.
    """
    small = right.count() <= limit
    names = {c: f"__r_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(right[names[c]])
    return left.join(F.broadcast(right) if small else right, match, how).drop(*names.values())


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number strictly between 0 and 1 that only depends on the seed and the columns' values."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def offsets_before(df: DataFrame, group: list[str], place: str, amount: Column, name: str) -> DataFrame:
    """For each (group, place): the sum of ``amount`` over earlier places of the group, stored.

    Rows are added up per place before anything is ordered, so a group's window
    holds a row per place (a partition or a bin), never its rows.
    """
    earlier = Window.partitionBy(*group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, place).agg(F.sum(amount).alias("__sum"))
    return stored(
        sums.select(*group, place, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("bigint").alias(name)),
        "offsets",
    )
