"""Delimited files of timestamped contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CONTACTS, conform


def parse_contacts(lines: DataFrame, sep: str = " ") -> tuple[DataFrame, DataFrame]:
    """Contacts (src, dst, time) of the lines in a column ``value``, and the rejected lines with their reasons.

    A line has three whole numbers; blanks around them are ignored, and so are empty
    lines. Every other column of ``lines`` is kept.
    """
    kept = [c for c in lines.columns if c != "value"]
    # A separator is one or more characters as they stand, not a pattern.
    parts = F.split("value", "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    field = lambda i: F.trim(F.get(F.col("__parts"), F.lit(i)))
    whole = r"^[+-]?[0-9]+$"
    names = [f.name for f in CONTACTS.fields]
    parsed = (
        lines.where(F.trim("value") != "")
        .withColumn("__parts", parts)
        .withColumns({f"__{c}": F.when(field(i).rlike(whole), field(i).try_cast("bigint")) for i, c in enumerate(names)})
        .withColumn(
            "reason",
            F.when(F.size("__parts") < 3, "too_few_fields")
            .when(F.size("__parts") > 3, "too_many_fields")
            .when(F.col("__src").isNull(), "bad_source")
            .when(F.col("__dst").isNull(), "bad_target")
            .when(F.col("__time").isNull(), "bad_time"),
        )
    )
    good = parsed.where(F.col("reason").isNull()).select(*kept, *[F.col(f"__{c}").alias(c) for c in names])
    return good, parsed.where(F.col("reason").isNotNull()).select(*kept, "value", "reason")


def read_contact_lines(spark: SparkSession, path: str, sep: str = " ") -> tuple[DataFrame, DataFrame]:
    """The contacts of a file or folder of lines ``from<sep>to<sep>time``, and (value, reason) of what could not be read."""
    contacts, rejected = parse_contacts(spark.read.text(path).select("value"), sep)
    return conform(contacts, CONTACTS), rejected


def read_contacts(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Columns src, dst and time (whole units) of the lines that can be read."""
    return read_contact_lines(spark, path, sep)[0]


def write_contacts(contacts: DataFrame, path: str, sep: str = " ") -> None:
    contacts.select("src", "dst", "time").write.option("sep", sep).csv(path)
