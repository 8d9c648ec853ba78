"""Change logs as text, one entry per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import (
    deserialize_attributes,
    parse_action,
    parse_entity,
    parse_instant,
    serialize_log,
)
from ..operators.changelog import indexed_log
from ..operators.ordered import dense_index
from ..schema import CHANGELOG, conform


def log_lines(log: DataFrame) -> DataFrame:
    """One text line per entry."""
    columns = ("ts", "action", "entity_type", "id", "src", "dst", "attributes")
    return log.select(serialize_log(*[F.col(c) for c in columns]).alias("value"))


def write_changelog_tsv(log: DataFrame, path: str) -> None:
    """Write the log as text, oldest entry first; every part is written by its own task."""
    ranged = log.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")
    log_lines(ranged).write.text(path)


def _trailing_empty_dropped(fields: Column) -> Column:
    return F.filter(
        fields,
        lambda field, i: (field != "") | F.exists(F.slice(fields, i + 2, F.size(fields)), lambda later: later != ""),
    )


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse text lines (column ``value``) to entries and, apart, the lines that are none.

    Every other column of ``lines`` is kept. A rejected line comes with its reason.
    """
    kept = [c for c in lines.columns if c != "value"]
    fields = F.split("value", "\t")
    parsed = (
        lines.withColumn("fields", fields)
        .withColumn("ts", parse_instant(F.get("fields", F.lit(0))))
        .withColumn("action", parse_action(F.get("fields", F.lit(1))))
        .withColumn("entity", parse_entity(F.get("fields", F.lit(2))))
        .withColumn(
            "attributes",
            deserialize_attributes(_trailing_empty_dropped(F.slice("fields", 4, F.greatest(F.size("fields"), F.lit(1))))),
        )
        .withColumn(
            "reason",
            F.when(F.size("fields") < 3, "too_few_fields")
            .when(F.col("ts").isNull(), "bad_timestamp")
            .when(F.col("action").isNull(), "bad_action")
            .when(F.col("entity").isNull(), "bad_entity")
            .when(F.col("attributes").isNull(), "bad_attributes"),
        )
    )
    entries = parsed.where(F.col("reason").isNull()).select(*kept, "ts", "action", "entity.*", "attributes")
    rejected = parsed.where(F.col("reason").isNotNull()).select(*kept, "value", "reason")
    return entries, rejected


def read_changelog_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The log in a text file or folder, and the lines that could not be read.

    An entry's ``seq`` is its place by time and, at one time, by file name and place
    in the file. A file is read in blocks, each by one task from its start to its end.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )
    entries, rejected = parse_lines(lines)
    numbered = dense_index(entries, ["ts", "__file", "__block", "__line"], "seq")
    return conform(numbered, CHANGELOG), rejected.select("value", "reason")


def reindexed(log: DataFrame) -> DataFrame:
    """The log with its places in (ts, seq) order as new ``seq``."""
    return conform(indexed_log(log).drop("seq").withColumnRenamed("position", "seq"), CHANGELOG)
