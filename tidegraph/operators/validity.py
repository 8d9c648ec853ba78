"""The interval model: every state of an entity is a row with the time it holds.

Two tables can be built from a log. ``validity_intervals`` keeps the attributes of
each entry as they are (an UPDATE replaces). ``attribute_intervals`` keeps one row
per life of an entity and one per value of an attribute (an UPDATE merges). An
interval that is still open has no ``valid_to``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attributes import other_end
from ..functions.intervals import half_open_contains, left_open_contains, touches, within
from ..functions.times import instant
from ..schema import ATTRIBUTE_INTERVALS, CREATE, EDGE, ENTITY, INTERVALS, ORDER, STATE, UPDATE, VERTEX, conform
from .changelog import is_lifecycle
from .ordered import OrderedRows


# Partition columns of stored intervals: the years of ``valid_to``, or OPEN, and of ``valid_from``;
# of stored first activations: the year of the first start.
END_YEAR, START_YEAR, FIRST_YEAR, OPEN = "end_year", "start_year", "first_year", 9999


def with_years(intervals: DataFrame) -> DataFrame:
    return intervals.withColumns(
        {END_YEAR: F.coalesce(F.year("valid_to"), F.lit(OPEN)), START_YEAR: F.year("valid_from")}
    )


def _bounds() -> tuple[Column, Column]:
    return F.col("valid_from"), F.col("valid_to")


def _is_live(action: Column, last_lifecycle: Column) -> Column:
    return (action == CREATE) | ((action == UPDATE) & (last_lifecycle == CREATE))


def validity_intervals(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """A row per CREATE or UPDATE, valid until the entity's next entry."""
    action = F.col("action")
    rows = (
        OrderedRows.of(log, ENTITY, ORDER, hot_rows)
        .with_values(
            lead={"valid_to": F.col("ts")}, before={"__life": F.when(is_lifecycle(action), action)}
        )
        .rows()
        .where(_is_live(action, F.col("__life")))
        .withColumnRenamed("ts", "valid_from")
    )
    return conform(rows, INTERVALS)


def attribute_intervals_over(log: DataFrame, at: str, hot_rows: int | None = None) -> DataFrame:
    """Lives and attribute values with their bounds measured in the column ``at``."""
    action = F.col("action")
    no_pairs = F.array().cast("array<struct<key:string,value:string>>")
    none = F.lit(None).cast("string")
    live = F.when(action == CREATE, F.array(F.struct(none.alias("key"), none.alias("value")))).otherwise(no_pairs)
    rows = (
        OrderedRows.of(log, ENTITY, ORDER, hot_rows)
        .with_values(
            before={"__life": F.when(is_lifecycle(action), action)},
            after={"__end": F.when(is_lifecycle(action), F.col(at))},
        )
        .map(lambda df: df.where(_is_live(action, F.col("__life"))))
        .map(
            lambda df: df.select(
                *[c for c in df.columns if c not in ("attributes", "__life")],
                F.inline(F.concat(live, F.coalesce(F.map_entries("attributes"), no_pairs))),
            )
        )
        # A value holds until the key is written again or the life ends.
        .within("key")
        .with_values(lead={"__next": F.col(at)})
        .rows()
    )
    of_life = F.col("key").isNull()
    return rows.select(
        *ENTITY,
        F.when(of_life, F.col("src")).alias("src"),
        F.when(of_life, F.col("dst")).alias("dst"),
        "key",
        "value",
        F.col(at).alias("valid_from"),
        F.least("__next", "__end").alias("valid_to"),
        "seq",
    )


def attribute_intervals(log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """A row per life of an entity (key is null) and per value of each attribute."""
    return conform(attribute_intervals_over(log, "ts", hot_rows), ATTRIBUTE_INTERVALS)


def is_merged(intervals: DataFrame) -> bool:
    """Whether the table holds attribute rows rather than whole states."""
    return "key" in intervals.columns


def presence(intervals: DataFrame) -> DataFrame:
    """Rows that tell when an entity exists."""
    return intervals.where(F.col("key").isNull()) if is_merged(intervals) else intervals


def assemble(rows: DataFrame, *by: str) -> DataFrame:
    """Whole states from life and attribute rows, one per entity and ``by`` columns.

    A life row makes the entity exist; its attribute rows fill the map.
    """
    pair = F.when(F.col("key").isNotNull(), F.struct("key", "value"))
    return (
        rows.groupBy(*by, *ENTITY)
        .agg(
            F.max("src").alias("src"),
            F.max("dst").alias("dst"),
            F.map_from_entries(F.collect_list(pair)).alias("attributes"),
        )
        .select(*by, *ENTITY, "src", "dst", "attributes")
    )


def _states(intervals: DataFrame, keep: Column) -> DataFrame:
    rows = intervals.where(keep)
    return assemble(rows) if is_merged(intervals) else conform(rows, STATE)


def snapshot_validity(intervals: DataFrame, t) -> DataFrame:
    """State at a time: rows with from <= t < to.

    A stored table is partitioned by the years in which rows end and start, so what
    ended in earlier years or starts in later ones is not read.
    """
    intervals = _around(intervals, t)
    return _states(intervals, half_open_contains(*_bounds(), t))


def _around(intervals: DataFrame, t) -> DataFrame:
    """Of a stored table the partitions that may hold at a time."""
    year = F.year(instant(t))
    if END_YEAR in intervals.columns:
        intervals = intervals.where(F.col(END_YEAR) >= year)
    if START_YEAR in intervals.columns:
        intervals = intervals.where(F.col(START_YEAR) <= year)
    return intervals


def snapshot_validity_left_open(intervals: DataFrame, t) -> DataFrame:
    """Rows with from < t <= to, with all their columns."""
    return intervals.where(left_open_contains(*_bounds(), t))


def entity_at_validity(intervals: DataFrame, entity_type: str, id_: int, t) -> DataFrame:
    """The state of one entity at a time: one row, or none."""
    named = (F.col("entity_type") == entity_type) & (F.col("id") == id_)
    return _states(_around(intervals, t).where(named), half_open_contains(*_bounds(), t))


def vertex_at_validity(intervals: DataFrame, id_: int, t) -> DataFrame:
    return entity_at_validity(intervals, VERTEX, id_, t)


def edge_at_validity(intervals: DataFrame, id_: int, t) -> DataFrame:
    return entity_at_validity(intervals, EDGE, id_, t)


def neighbours_validity(intervals: DataFrame, vertex: int, start=None, stop=None) -> DataFrame:
    """Vertices that share an edge with ``vertex`` at any time of the closed interval."""
    src, dst = F.col("src"), F.col("dst")
    return (
        presence(intervals)
        .where((F.col("entity_type") == EDGE) & ((src == vertex) | (dst == vertex)))
        .where(touches(*_bounds(), start, stop))
        .select(other_end(src, dst, vertex).alias("id"))
        .distinct()
    )


def edge_ends(rows: DataFrame, *more: str) -> DataFrame:
    """Each edge row at both of its ends: ``vertex`` and ``other``, with further columns."""
    src, dst = F.col("src"), F.col("dst")
    ends = F.array(
        F.struct(src.alias("vertex"), dst.alias("other")), F.struct(dst.alias("vertex"), src.alias("other"))
    )
    return rows.where(F.col("entity_type") == EDGE).select(F.inline(ends), *more)


def life_ends(intervals: DataFrame) -> DataFrame:
    """The lives of edges by vertex, for asking one vertex: (vertex, other, id, valid_from, valid_to)."""
    return edge_ends(presence(intervals), "id", "valid_from", "valid_to")


def neighbours_of_ends(ends: DataFrame, vertex: int, start=None, stop=None) -> DataFrame:
    """As ``neighbours_validity``, from the lives by vertex."""
    found = ends.where((F.col("vertex") == vertex) & touches(*_bounds(), start, stop))
    return found.select(F.col("other").alias("id")).distinct()


def earliest_payload(intervals: DataFrame) -> DataFrame:
    """The first state of each entity."""
    rows = presence(intervals)
    first = F.min_by(F.struct("src", "dst", "valid_from", "valid_to", "seq"), F.struct("valid_from", "seq"))
    return rows.groupBy(*ENTITY).agg(first.alias("first")).select(*ENTITY, "first.*")


def first_activations(rows: DataFrame, start: str = "valid_from") -> DataFrame:
    """(entity_type, id, first, first_year): when each entity first comes to exist, from its lives or CREATE entries."""
    firsts = rows.groupBy(*ENTITY).agg(F.min(start).alias("first"))
    return firsts.withColumn(FIRST_YEAR, F.year("first"))


def activated_first(firsts: DataFrame, start=None, stop=None) -> DataFrame:
    """Entities whose first activation lies in the closed interval, from a stored table of them: a scan of its years."""
    if start is not None:
        firsts = firsts.where(F.col(FIRST_YEAR) >= F.year(instant(start)))
    if stop is not None:
        firsts = firsts.where(F.col(FIRST_YEAR) <= F.year(instant(stop)))
    return firsts.where(within(F.col("first"), start, stop)).select(*ENTITY)


def activated_validity(
    intervals: DataFrame, start=None, stop=None, mode: str = "first_activation"
) -> DataFrame:
    """Entities activated in the closed interval.

    ``first_activation``: the first life starts inside. ``net_create``: the last
    lifecycle entry inside is a CREATE.
    """
    if mode == "net_create":
        if not is_merged(intervals):
            raise ValueError("net_create needs lives: build the intervals with attribute_intervals")
        begins, ends = _bounds()
        inside = within(begins, start, stop)
        if stop is not None:
            inside = inside & (ends.isNull() | (ends > instant(stop)))
        else:
            inside = inside & ends.isNull()
        return presence(intervals).where(inside).select(*ENTITY)
    if mode != "first_activation":
        raise ValueError("mode must be 'first_activation' or 'net_create'")
    # Later rows cannot move a first start into the interval, so the scan stops at its end.
    rows = presence(intervals).where(within(F.col("valid_from"), None, stop))
    return (
        rows.groupBy(*ENTITY)
        .agg(F.min("valid_from").alias("first"))
        .where(within(F.col("first"), start, stop))
        .select(*ENTITY)
    )


def activated_vertices_validity(intervals: DataFrame, start=None, stop=None, mode="first_activation"):
    return activated_validity(intervals.where(F.col("entity_type") == VERTEX), start, stop, mode).select("id")


def activated_edges_validity(intervals: DataFrame, start=None, stop=None, mode="first_activation"):
    return activated_validity(intervals.where(F.col("entity_type") == EDGE), start, stop, mode).select("id")
