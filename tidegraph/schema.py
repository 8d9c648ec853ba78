"""Column layout of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

CREATE, UPDATE, DELETE = "CREATE", "UPDATE", "DELETE"
VERTEX, EDGE = "VERTEX", "EDGE"

# An entity is named by its kind and its id; its entries are ordered by time and,
# at one time, by their position in the log.
ENTITY = ["entity_type", "id"]
ORDER = ["ts", "seq"]

ATTRIBUTES = MapType(StringType(), StringType())

CHANGELOG = StructType(
    [
        StructField("seq", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("action", StringType()),
        StructField("entity_type", StringType()),
        StructField("id", LongType()),
        StructField("src", LongType()),
        StructField("dst", LongType()),
        StructField("attributes", ATTRIBUTES),
    ]
)

CONTACTS = StructType(
    [
        StructField("src", LongType()),
        StructField("dst", LongType()),
        StructField("time", LongType()),
    ]
)

# One row per state of an entity; the attributes are those of the entry itself.
INTERVALS = StructType(
    [
        StructField("entity_type", StringType()),
        StructField("id", LongType()),
        StructField("src", LongType()),
        StructField("dst", LongType()),
        StructField("valid_from", TimestampNTZType()),
        StructField("valid_to", TimestampNTZType()),
        StructField("seq", LongType()),
        StructField("attributes", ATTRIBUTES),
    ]
)

# One row per life of an entity (key is null) and per value of an attribute.
ATTRIBUTE_INTERVALS = StructType(
    [
        StructField("entity_type", StringType()),
        StructField("id", LongType()),
        StructField("src", LongType()),
        StructField("dst", LongType()),
        StructField("key", StringType()),
        StructField("value", StringType()),
        StructField("valid_from", TimestampNTZType()),
        StructField("valid_to", TimestampNTZType()),
        StructField("seq", LongType()),
    ]
)

STATE = StructType(
    [
        StructField("entity_type", StringType()),
        StructField("id", LongType()),
        StructField("src", LongType()),
        StructField("dst", LongType()),
        StructField("attributes", ATTRIBUTES),
    ]
)

SNAPSHOT_INDEX = StructType(
    [
        StructField("snapshot_no", LongType()),
        StructField("snapshot_ts", TimestampNTZType()),
        StructField("snapshot_seq", LongType()),
    ]
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in order and cast; absent ones are null."""
    have = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in schema.fields:
        if f.name not in have:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif have[f.name] == f.dataType:
            columns.append(F.col(f.name))
        else:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def no_attributes() -> Column:
    """An empty attribute map."""
    return F.create_map().cast(ATTRIBUTES)
