"""Interval edges from raw timestamped contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import MICROS, epoch_micros
from ..storage import stored
from .ordered import OrderedRows, dense_index, is_scan

PAIR = ["src", "dst"]

# The thresholds of the sweep (0 stands for no merging).
SWEEP_THRESHOLDS = [*range(1, 20), *range(20, 200, 20), *range(200, 1001, 100)]


def _gap(df: DataFrame, time: str, previous: str) -> Column:
    """Time since the previous contact: microseconds of a timestamp, else plain units."""
    if dict(df.dtypes)[time].startswith("timestamp"):
        return epoch_micros(F.col(time)) - epoch_micros(F.col(previous))
    return F.col(time) - F.col(previous)


def _limit(df: DataFrame, time: str, threshold):
    return int(threshold * MICROS) if dict(df.dtypes)[time].startswith("timestamp") else threshold


def _unique(contacts: DataFrame, time: str) -> DataFrame:
    """One row per pair and time, with the number of contacts it stands for.

    Copies never change a session, and without them the order of a pair is unique.
    """
    return contacts.groupBy(*PAIR, time).agg(F.count(F.lit(1)).alias("contacts"))


def contact_bounds(contacts: DataFrame, time: str = "ts") -> DataFrame:
    """First and last contact of each pair."""
    return contacts.groupBy(*PAIR).agg(F.min(time).alias("first"), F.max(time).alias("last"))


def contacts_raw_graph(contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (all ends) and one edge per contact, without merging."""
    ends = contacts.select(F.col("src").alias("id")).unionByName(contacts.select(F.col("dst").alias("id")))
    return ends.distinct(), contacts


def contacts_in_sessions(
    contacts: DataFrame, threshold, time: str = "ts", hot_rows: int | None = None
) -> DataFrame:
    """Each pair and contact time with the start of the session it belongs to (``valid_from``)."""
    unique = _unique(contacts, time)
    limit = _limit(unique, time, threshold)
    opens = F.col("__previous").isNull() | (_gap(unique, time, "__previous") > limit)
    return (
        OrderedRows.of(unique, PAIR, [time], hot_rows)
        .with_values(lag={"__previous": F.col(time)})
        .map(lambda df: df.withColumn("__opened", F.when(opens, F.col(time))))
        .with_values(before={"__since": F.col("__opened")})
        .rows()
        .select(*PAIR, time, "contacts", F.coalesce("__opened", "__since").alias("valid_from"))
    )


def merge_contacts(
    contacts: DataFrame, threshold, time: str = "ts", hot_rows: int | None = None
) -> DataFrame:
    """Merge contacts of a pair into sessions.

    A contact continues the session of the pair's previous contact when the gap is
    at most ``threshold`` (seconds for a timestamp). One row per session, from its
    first to its last contact.
    """
    return sessions_of(contacts_in_sessions(contacts, threshold, time, hot_rows), time)


def sessions_of(members: DataFrame, time: str = "ts") -> DataFrame:
    """One row per session from its contacts."""
    return (
        members.groupBy(*PAIR, "valid_from")
        .agg(F.max(time).alias("valid_to"), F.sum("contacts").alias("contacts"))
        .select(*PAIR, "valid_from", "valid_to", "contacts")
    )


def with_edge_ids(sessions: DataFrame) -> DataFrame:
    """Number the sessions 1, 2, ... by pair and start: an id that no two edges share."""
    # Stored first, since range partitioning reads its input twice.
    sessions = sessions if is_scan(sessions) else stored(sessions, "sessions")
    numbered = dense_index(sessions, [*PAIR, "valid_from"], "edge_id")
    return numbered.withColumn("edge_id", F.col("edge_id") + 1)


def threshold_sweep(
    contacts: DataFrame,
    thresholds: list | None = None,
    time: str = "ts",
    hot_rows: int | None = None,
    unit: int = 1,
) -> DataFrame:
    """Number of edges after merging with each threshold; 0 gives the raw contacts.

    The gap of each contact is found once and tested against every threshold in
    the same pass. ``unit`` scales the thresholds (seconds per unit).
    """
    thresholds = SWEEP_THRESHOLDS if thresholds is None else thresholds
    unique = _unique(contacts, time)
    gaps = (
        OrderedRows.of(unique, PAIR, [time], hot_rows)
        .with_values(lag={"__previous": F.col(time)})
        .rows()
        .select("contacts", _gap(unique, time, "__previous").alias("gap"))
    )
    opened = lambda th: F.count_if(F.col("gap").isNull() | (F.col("gap") > _limit(unique, time, th * unit)))
    counts = gaps.agg(
        F.coalesce(F.sum("contacts"), F.lit(0)).alias("t0"), *[opened(th).alias(f"t{i}") for i, th in enumerate(thresholds, 1)]
    )
    labels = [0, *thresholds]
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(th).cast("bigint").alias("threshold"), F.col(f"t{i}").alias("edges"))
                    for i, th in enumerate(labels)
                ]
            )
        )
    )


def threshold_sweeps(sources: dict[str, DataFrame], **options) -> DataFrame:
    """The sweep of several sources of contacts, labelled by source."""
    sweeps = [
        threshold_sweep(contacts, **options).select(F.lit(name).alias("source"), "threshold", "edges")
        for name, contacts in sources.items()
    ]
    return reduce(DataFrame.unionByName, sweeps)
