"""Tables written to shared storage to cut a plan or to keep it for a later run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the cluster's ``spark.checkpoint.dir``; without that setting the
    warehouse, which driver and executors share as well. Never a temporary folder
    of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/tidegraph-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the work folder that no other table uses."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: a plan of its own that outlives executors."""
    path = new_path(df.sparkSession, label)
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Paths of the tables that ``stored`` has written in each open ``passing`` context.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are dropped at the end: only what is written to other paths by then may need them."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no DataFrame needs any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables that one computation writes for itself and drops once nothing reads them.

    Used as a context, it drops what is left at the end, so a result that outlives
    the context must be written elsewhere (``stored``).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[DataFrame, str] = {}

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop(*list(self.paths))

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[table] = path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of this computation; others and None are left alone."""
        for table in tables:
            path = self.paths.pop(table, None)
            if path is not None:
                drop(self.spark, path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no DataFrame needs them any more."""
    drop(spark, work_dir(spark))
