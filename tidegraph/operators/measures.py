"""Sizes of the stored models and summaries of timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .snapshots import Snapshots
from .validity import is_merged


def _size(df: DataFrame, model: str, part: str, entries: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(entries), F.lit(0)).cast("bigint").alias("attribute_entries")
    ).select(F.lit(model).alias("model"), F.lit(part).alias("part"), "rows", "attribute_entries")


def storage_comparison(intervals: DataFrame, snapshots: dict[str, Snapshots]) -> DataFrame:
    """Rows and attribute entries that each model stores for the same log."""
    in_map = F.size(F.coalesce("attributes", F.create_map().cast("map<string,string>"))).cast("bigint")
    per_row = F.when(F.col("key").isNotNull(), 1).otherwise(0) if is_merged(intervals) else in_map
    result = _size(intervals, "intervals", "intervals", per_row)
    for name, model in snapshots.items():
        result = result.unionByName(_size(model.states, name, "snapshots", in_map))
        result = result.unionByName(_size(model.log, name, "log", in_map))
    return result


def stored_bytes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(model, part, files, bytes) of stored models: a part is a folder directly under a model's path.

    The sizes come from the file system's own listing, one recursive summary per part.
    """
    rows = []
    for model, path in paths.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for part in system.listStatus(place):
            summary = system.getContentSummary(part.getPath())
            rows.append((model, part.getPath().getName(), summary.getFileCount(), summary.getLength()))
    return spark.createDataFrame(rows, "model STRING, part STRING, files BIGINT, bytes BIGINT")


def mean_runtime(timings: DataFrame, by: list[str] = ["function"]) -> DataFrame:
    """Mean of repeated timings (columns ``function`` and ``value``)."""
    return timings.groupBy(*by).agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("runs")
    )


def scaling_slope(timings: DataFrame, by: str = "file", x: str = "n_logs", y: str = "value") -> DataFrame:
    """Least-squares slope of time, divided by its largest value, on log size, per file.

    Dividing the times first or the slope afterwards is the same, so one aggregate
    with partial sums does it.
    """
    return timings.groupBy(by).agg((F.regr_slope(y, x) / F.max(y)).alias("slope"))
