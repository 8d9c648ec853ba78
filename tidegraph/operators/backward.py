"""Replay backward: what was before each entry, and states made from a later snapshot.

The undo table has a row per entity, attribute key and entry that changed it: the
value just before the entry, or that there was none. A row whose key is null tells the
same of the entity's life. The earliest such row after a time is how things stood at
that time, so going back over a stretch of the log is one aggregate over its undo rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.times import instant
from ..schema import ATTRIBUTES, CHANGELOG, ENTITY, ORDER, STATE, conform, no_attributes
from .changelog import is_lifecycle
from .ordered import OrderedRows
from .validity import _is_live, attribute_intervals_over

# ``value`` is that of a key; ``attributes`` are those of an entity whose entries replace the whole map.
UNDO = StructType(
    [
        *[CHANGELOG[c] for c in ("ts", "seq", "entity_type", "id")],
        StructField("key", StringType()),
        StructField("present", BooleanType()),
        *[CHANGELOG[c] for c in ("src", "dst")],
        StructField("value", StringType()),
        StructField("attributes", ATTRIBUTES),
    ]
)


def _held(log: DataFrame, attributes: str, hot_rows: int | None) -> DataFrame:
    """Lives and values, or whole states, from one place of the log's order to another."""
    placed = log.withColumn("__at", F.struct(*ORDER))
    if attributes == "merge":
        return attribute_intervals_over(placed, "__at", hot_rows)
    action = F.col("action")
    return (
        OrderedRows.of(placed, ENTITY, ORDER, hot_rows)
        .with_values(lead={"valid_to": F.col("__at")}, before={"__life": F.when(is_lifecycle(action), action)})
        .rows()
        .where(_is_live(action, F.col("__life")))
        .withColumns({"valid_from": F.col("__at"), "key": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    )


def undo_entries(log: DataFrame, attributes: str = "merge", hot_rows: int | None = None) -> DataFrame:
    """The undo table of a log.

    What begins at an entry was not there before it, what ends at an entry was; where one
    value follows another the latter counts. Rows number at most two per interval.
    """
    if attributes not in ("merge", "replace"):
        raise ValueError("attributes must be 'merge' or 'replace'")
    rows = _held(log, attributes, hot_rows)
    # In one pass, so the intervals are found once; an open interval ends at no entry.
    ends = F.array(
        F.struct(F.col("valid_from").alias("at"), F.lit(False).alias("present")),
        F.struct(F.col("valid_to").alias("at"), F.lit(True).alias("present")),
    )
    held = [c for c in ("src", "dst", "value", "attributes") if c in rows.columns]
    marks = rows.select(*ENTITY, "key", *held, F.inline(ends)).where(F.col("at").isNotNull())
    was = F.max_by(F.struct(*held), "present").alias("was")
    found = marks.groupBy(*ENTITY, "key", "at").agg(F.max("present").alias("present"), was)
    kept = [F.when(F.col("present"), F.col("was")[c]).alias(c) for c in held]
    return conform(found.select("at.ts", "at.seq", *ENTITY, "key", "present", *kept), UNDO)


def between(snapshot, t) -> Column:
    """Undo rows of entries after a time and not after a later snapshot.

    The bare comparisons of ``ts`` reach the file scan; the last part settles entries
    at the very instant of the snapshot.
    """
    ts, seq = F.col("ts"), F.col("seq")
    stamp = instant(snapshot["snapshot_ts"])
    return (ts > instant(t)) & (ts <= stamp) & ((ts < stamp) | (seq <= snapshot["snapshot_seq"]))


def undo_logs(state: DataFrame, undo: DataFrame) -> DataFrame:
    """The state before a stretch of the log from the state after it and the stretch's undo rows.

    An entity whose life changed in the stretch is wholly told by its undo rows: a value of
    an earlier life ended in the stretch. Any other keeps its stored map but for the keys
    that were written. As in forward replay the stored state is only looked up, by a left
    join that leaves it in place when few entities changed.
    """
    was = F.struct("present", "src", "dst", "value", "attributes")
    first = undo.groupBy(*ENTITY, "key").agg(F.min_by(was, F.struct("ts", "seq")).alias("was"))
    of_life, key = F.col("key").isNull(), F.col("key")
    restored = F.when(key.isNotNull() & F.col("was.present"), F.struct(key, F.col("was.value")))
    net = first.groupBy(*ENTITY).agg(
        F.max(F.when(of_life, F.col("was.present"))).alias("life"),
        F.max(F.when(of_life, F.col("was.src"))).alias("src"),
        F.max(F.when(of_life, F.col("was.dst"))).alias("dst"),
        F.max_by(F.col("was.attributes"), of_life).alias("whole"),
        # As many as the entity has distinct keys: its attribute map.
        F.map_from_entries(F.collect_list(restored)).alias("restored"),
        F.collect_list(key).alias("touched"),
    )
    back = net.where("life").withColumn("attributes", F.coalesce("whole", "restored", no_attributes()))
    change = net.select(*ENTITY, "life", "restored", "touched")
    untouched = F.map_filter("attributes", lambda k, _: ~F.array_contains("touched", k))
    kept = (
        state.join(change, ENTITY, "left")
        .where(F.col("life").isNull())
        .withColumn(
            "attributes",
            F.when(F.col("touched").isNull(), F.col("attributes")).otherwise(F.map_concat(untouched, "restored")),
        )
    )
    return conform(kept, STATE).unionByName(conform(back, STATE))
