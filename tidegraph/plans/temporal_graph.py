"""One interface over the interval model and the snapshot model."""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import graph as g
from ..operators import snapshots as sn
from ..operators import validity as vl
from ..schema import ATTRIBUTE_INTERVALS, EDGE, INTERVALS, VERTEX
from ..sources import store


class TemporalGraph(ABC):
    """The four temporal queries, and the graph as it is now."""

    @abstractmethod
    def snapshot_at_time(self, t) -> DataFrame:
        """The state of the graph at a time."""

    @abstractmethod
    def entity_at_time(self, entity_type: str, id_: int, t) -> DataFrame:
        """One vertex or edge at a time: one row, or none."""

    @abstractmethod
    def direct_neighbours(self, vertex: int, start=None, stop=None) -> DataFrame:
        """Ids that share an edge with a vertex at any time of the closed interval."""

    @abstractmethod
    def activated_entities(self, start=None, stop=None, mode: str = "first_activation") -> DataFrame:
        """Entities activated in the closed interval."""

    def activated_vertices(self, start=None, stop=None, mode: str = "first_activation") -> DataFrame:
        return self.activated_entities(start, stop, mode).where(F.col("entity_type") == VERTEX).select("id")

    def activated_edges(self, start=None, stop=None, mode: str = "first_activation") -> DataFrame:
        return self.activated_entities(start, stop, mode).where(F.col("entity_type") == EDGE).select("id")

    def graph_at(self, t, with_endpoints: bool = False, drop_dangling: bool = False) -> g.PropertyGraph:
        return g.graph_of(self.snapshot_at_time(t), t, with_endpoints, drop_dangling)

    def current_graph(self, **options) -> g.PropertyGraph:
        """The graph at this moment, found anew on each call."""
        return self.graph_at(dt.datetime.now(dt.timezone.utc), **options)

    def vertices(self) -> DataFrame:
        return self.current_graph().vertices

    def edges(self) -> DataFrame:
        return self.current_graph().edges

    def triplets(self) -> DataFrame:
        return g.triplets(self.current_graph())

    def map_vertices(self, value: Column) -> g.PropertyGraph:
        return g.map_vertices(self.current_graph(), value)

    def map_edges(self, value: Column) -> g.PropertyGraph:
        return g.map_edges(self.current_graph(), value)

    def reverse(self) -> g.PropertyGraph:
        return g.reverse_graph(self.current_graph())

    def subgraph(self, vertex_keep: Column | None = None, triplet_keep: Column | None = None) -> g.PropertyGraph:
        return g.subgraph(self.current_graph(), vertex_keep, triplet_keep)

    def aggregate_messages(self, merge, to_src: Column | None = None, to_dst: Column | None = None) -> DataFrame:
        return g.aggregate_messages(self.current_graph(), merge, to_src, to_dst)


class IntervalGraph(TemporalGraph):
    """Answers from a table of intervals; stored ones also hold the lives of edges by vertex and first activations."""

    def __init__(self, intervals: DataFrame, ends: DataFrame | None = None, firsts: DataFrame | None = None):
        self.intervals, self.ends, self.firsts = intervals, ends, firsts

    @classmethod
    def from_log(cls, log: DataFrame, attributes: str = "merge", hot_rows: int | None = None) -> "IntervalGraph":
        build = vl.attribute_intervals if attributes == "merge" else vl.validity_intervals
        return cls(build(log, hot_rows))

    @classmethod
    def load(cls, spark: SparkSession, path: str, attributes: str = "merge") -> "IntervalGraph":
        schema = ATTRIBUTE_INTERVALS if attributes == "merge" else INTERVALS
        return cls(store.load_intervals(spark, path, schema), store.load_ends(spark, path), store.load_firsts(spark, path))

    def save(self, path: str) -> None:
        store.save_intervals(self.intervals, path)

    def snapshot_at_time(self, t) -> DataFrame:
        return vl.snapshot_validity(self.intervals, t)

    def entity_at_time(self, entity_type: str, id_: int, t) -> DataFrame:
        return vl.entity_at_validity(self.intervals, entity_type, id_, t)

    def direct_neighbours(self, vertex: int, start=None, stop=None) -> DataFrame:
        if self.ends is not None:
            return vl.neighbours_of_ends(self.ends, vertex, start, stop)
        return vl.neighbours_validity(self.intervals, vertex, start, stop)

    def activated_entities(self, start=None, stop=None, mode: str = "first_activation") -> DataFrame:
        if self.firsts is not None and mode == "first_activation":
            return vl.activated_first(self.firsts, start, stop)
        return vl.activated_validity(self.intervals, start, stop, mode)


class SnapshotGraph(TemporalGraph):
    """Answers from snapshots and the log between them; stored ones also hold the log by entity, edge entries by
    vertex and first activations."""

    def __init__(self, model: sn.Snapshots, ends: DataFrame | None = None, firsts: DataFrame | None = None):
        self.model, self.ends, self.firsts = model, ends, firsts

    @classmethod
    def from_log(
        cls,
        log: DataFrame,
        every_seconds: int | None = None,
        every_actions: int | None = None,
        attributes: str = "merge",
        hot_rows: int | None = None,
        backward: bool = False,
    ) -> "SnapshotGraph":
        """Either spacing; with ``backward`` also the undo table, so states come from the nearer snapshot."""
        if (every_seconds is None) == (every_actions is None):
            raise ValueError("give either every_seconds or every_actions")
        if every_seconds is not None:
            model = sn.snapshots_by_time(log, every_seconds, attributes, hot_rows)
        else:
            model = sn.snapshots_by_count(log, every_actions, attributes, hot_rows)
        return cls(sn.with_undo(model, hot_rows) if backward else model)

    @classmethod
    def each_from_log(
        cls, log: DataFrame, every_actions: Iterable[int], attributes: str = "merge", hot_rows: int | None = None
    ) -> "list[SnapshotGraph]":
        """A model for each of several spacings of one log."""
        return [cls(model) for model in sn.snapshots_by_counts(log, every_actions, attributes, hot_rows)]

    @classmethod
    def load(cls, spark: SparkSession, path: str, attributes: str = "merge") -> "SnapshotGraph":
        model = store.load_snapshots(spark, path, attributes)
        return cls(model, store.load_ends(spark, path), store.load_firsts(spark, path))

    def save(self, path: str) -> None:
        store.save_snapshots(self.model, path)

    def snapshot_at_time(self, t) -> DataFrame:
        return sn.snapshot_nearest(self.model, t)

    def entity_at_time(self, entity_type: str, id_: int, t) -> DataFrame:
        return sn.entity_at_delta(self.model, entity_type, id_, t)

    def direct_neighbours(self, vertex: int, start=None, stop=None) -> DataFrame:
        if self.ends is not None:
            return sn.neighbours_of_actions(self.ends, vertex, start, stop)
        return sn.neighbours_delta(self.model.log, vertex, start, stop)

    def activated_entities(self, start=None, stop=None, mode: str = "first_activation") -> DataFrame:
        if self.firsts is not None and mode == "first_activation":
            return vl.activated_first(self.firsts, start, stop)
        return sn.activated_delta(self.model.log, start, stop, mode)
