"""Parameter sweeps: one temporal query asked for a range of log sizes, times or vertices.

Each gives one row per setting with what the query found, so that the two models
can be compared; how long a setting takes is for the caller to measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import instant
from ..operators import graph as g
from ..operators.changelog import indexed_log, log_timestamp_quantiles, times_at_places
from ..operators.ordered import dense_index
from ..schema import CREATE, EDGE, ENTITY, VERTEX
from ..sources import store
from ..storage import new_path
from .temporal_graph import IntervalGraph, SnapshotGraph, TemporalGraph


def together(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _found(answer: DataFrame, **labels) -> DataFrame:
    tags = [F.lit(value).alias(name) for name, value in labels.items()]
    return answer.agg(F.count(F.lit(1)).alias("found")).select(*tags, "found")


@dataclass(frozen=True)
class Prepared:
    """A log's size and the times that are asked for, and both models of it."""

    entries: int
    # At a twentieth of the log; of a log under twenty entries, its first time.
    early: object
    low: object
    high: object
    models: dict[str, TemporalGraph]

    @classmethod
    def of(cls, log: DataFrame, models: dict[str, TemporalGraph]) -> "Prepared":
        entries, low, high = log.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
        early = times_at_places(log, [entries // 20 - 1]).first()
        return cls(entries, early["ts"] if early else low, low, high, models)


def prepared(log: DataFrame, attributes: str = "merge", keep: bool = False) -> Prepared:
    """Both models of a log; the snapshots are a tenth of the log apart.

    ``keep`` stores the models, which pays when several questions follow.
    """
    spacing = max(log.count() // 10, 1)
    models: dict[str, TemporalGraph] = {
        "intervals": IntervalGraph.from_log(log, attributes),
        "snapshots": SnapshotGraph.from_log(log, every_actions=spacing, attributes=attributes),
    }
    return Prepared.of(log, {name: saved(log, m, attributes) if keep else m for name, m in models.items()})


def saved(log: DataFrame, model: TemporalGraph, attributes: str = "merge") -> TemporalGraph:
    """A model as it answers once it is stored."""
    path = new_path(log.sparkSession, "model")
    model.save(path)
    return type(model).load(log.sparkSession, path, attributes)


def growing_prepared(spark: SparkSession, log_path: str, path: str, iterations: int = 5) -> dict[int, Prepared]:
    """The logs of all iterations of a stored growing log with both their models, which are made once for all."""
    log = store.load_growing_runs(spark, log_path)
    if not store.exists(spark, f"{path}/states"):
        store.save_growing_models(log, path, iterations)
    sizes, out = store.load_growing_sizes(spark, path), {}
    for i, (intervals, lives, model, actions) in store.load_growing_models(spark, path, log, iterations).items():
        models = {"intervals": IntervalGraph(intervals, lives), "snapshots": SnapshotGraph(model, actions)}
        out[i] = Prepared(*sizes[i], models)
    return out


Logs = dict[str, Prepared]


def over_log_sizes(logs: Logs, ask: Callable[[TemporalGraph, Prepared], DataFrame]) -> DataFrame:
    """Ask both models of each log; one row per log and model with the size of the log."""
    return together(
        _found(ask(graph, log), log=name, model=model, entries=F.lit(log.entries).cast("bigint"))
        for name, log in logs.items()
        for model, graph in log.models.items()
    )


def neighbours_all_time(logs: Logs, vertex: int) -> DataFrame:
    """Neighbours over all time against log size."""
    return over_log_sizes(logs, lambda graph, _: graph.direct_neighbours(vertex))


def snapshot_early(logs: Logs) -> DataFrame:
    """The state at a twentieth of the log against log size."""
    return over_log_sizes(logs, lambda graph, log: graph.snapshot_at_time(log.early))


def entity_early(logs: Logs, entity_type: str, id_: int) -> DataFrame:
    """One entity at a twentieth of the log against log size."""
    return over_log_sizes(logs, lambda graph, log: graph.entity_at_time(entity_type, id_, log.early))


def activated_first_half(logs: Logs, half_of: str = "epoch") -> DataFrame:
    """Entities activated from the first entry up to half of the last one's epoch time, or half of the span."""

    def ask(graph: TemporalGraph, log: Prepared) -> DataFrame:
        begin = log.high.__class__(1970, 1, 1) if half_of == "epoch" else log.low
        return graph.activated_entities(log.low, begin + (log.high - begin) / 2)

    return over_log_sizes(logs, ask)


def four_questions(logs: Logs, vertex: int, half_of: str = "epoch") -> DataFrame:
    """The four questions above on the same logs, labelled by question."""
    answers = {
        "neighbours": neighbours_all_time(logs, vertex),
        "snapshot": snapshot_early(logs),
        "entity": entity_early(logs, VERTEX, vertex),
        "activated": activated_first_half(logs, half_of),
    }
    return together(df.withColumn("question", F.lit(name)) for name, df in answers.items())


def snapshot_near_materialisation(
    log: DataFrame, every_actions: int, offsets: Iterable[int], attributes: str = "merge"
) -> DataFrame:
    """The state at entries some way before or after a snapshot in the middle of the log."""
    offsets = list(offsets)
    middle = log.count() // 2 // every_actions * every_actions - 1
    places = {middle + o: o for o in offsets}
    # Stored, so that each state is a folder of one snapshot and a stretch of the log.
    model = saved(log, SnapshotGraph.from_log(log, every_actions=every_actions, attributes=attributes), attributes)
    times = {places[r["position"]]: r["ts"] for r in times_at_places(log, list(places)).collect()}
    return together(_found(model.snapshot_at_time(times[o]), offset=o) for o in offsets if o in times)


def _share_times(log: DataFrame, parts: int) -> list:
    """First time of the log and the times at each ``1/parts`` of it: as many driver values as parts."""
    return [r["ts"] for r in log_timestamp_quantiles(log, parts).orderBy("iteration").collect()]


def _counted_up_to(firsts: DataFrame, first: Column, model: str, times: list) -> DataFrame:
    """How many firsts lie at or before each time, all in one pass."""
    counts = firsts.agg(*[F.count_if(first <= instant(t)).alias(f"t{i}") for i, t in enumerate(times)])
    rows = [F.struct(F.lit(i).alias("iteration"), F.col(f"t{i}").alias("found")) for i in range(len(times))]
    return counts.select(F.inline(F.array(*rows))).select(F.lit(model).alias("model"), "iteration", "found")


def neighbours_by_share(log: DataFrame, vertex: int, parts: int = 21) -> DataFrame:
    """Neighbours from the first entry up to each share of the log.

    An interval that begins with the log meets an edge when the edge starts before
    the interval ends, so the first start per neighbour answers all shares at once.
    """
    times = _share_times(log, parts)
    src, dst = F.col("src"), F.col("dst")
    other = F.when(dst == vertex, src).otherwise(dst).alias("id")
    touching = (F.col("entity_type") == EDGE) & ((src == vertex) | (dst == vertex))
    lives = IntervalGraph.from_log(log).intervals.where(F.col("key").isNull() & touching)
    from_lives = lives.groupBy(other).agg(F.min("valid_from").alias("first"))
    created = log.where(touching & (F.col("action") == CREATE))
    from_log = created.groupBy(other).agg(F.min("ts").alias("first"))
    first = F.col("first")
    return together(
        [
            _counted_up_to(from_lives, first, "intervals", times),
            _counted_up_to(from_log, first, "snapshots", times),
        ]
    )


def activated_by_share(log: DataFrame, parts: int = 21) -> DataFrame:
    """Entities activated from the first entry up to each share of the log, in one pass."""
    times = _share_times(log, parts)
    lives = IntervalGraph.from_log(log).intervals.where(F.col("key").isNull())
    from_lives = lives.groupBy(*ENTITY).agg(F.min("valid_from").alias("first"))
    created = log.where(F.col("action") == CREATE)
    from_log = created.groupBy(*ENTITY).agg(F.min("ts").alias("first"))
    first = F.col("first")
    return together(
        [
            _counted_up_to(from_lives, first, "intervals", times),
            _counted_up_to(from_log, first, "snapshots", times),
        ]
    )


def neighbours_by_degree(log: DataFrame, edges: DataFrame, steps: int = 20) -> DataFrame:
    """Neighbours over all time of ``steps`` vertices spread evenly over the degree order, from both models."""
    ranked = dense_index(g.in_out_degree_sum(edges), ["degree", "id"])
    size = ranked.count()
    places = {int(i / steps * (size - 1)) for i in range(steps)} if size else set()
    chosen = ranked.where(F.col("position").isin(sorted(places))).select("id", "degree")
    # Both stored models hold edges by vertex; over all time every life and every CREATE counts.
    intervals = saved(log, IntervalGraph.from_log(log))
    snapshots = saved(log, SnapshotGraph.from_log(log, every_actions=max(log.count() // 10, 1)))
    ends = {"intervals": intervals.ends, "snapshots": snapshots.ends.where(F.col("action") == CREATE)}
    # As many vertices as steps, so this side is small and its ids reach the scan.
    few = F.broadcast(chosen.withColumnRenamed("id", "vertex"))
    return together(
        touching.join(few, "vertex")
        .select(F.lit(name).alias("model"), F.col("vertex").alias("id"), "degree", "other")
        .distinct()
        .groupBy("model", "id", "degree")
        .agg(F.count(F.lit(1)).alias("found"))
        for name, touching in ends.items()
    )


def entity_by_spacing(
    log: DataFrame, entity_type: str, id_: int, spacings: Iterable[int], t, attributes: str = "merge"
) -> DataFrame:
    """One entity from snapshot models with different spacings."""
    rows = []
    indexed = indexed_log(log)  # Numbered once for all spacings.
    for spacing in spacings:
        model = SnapshotGraph.from_log(indexed, every_actions=spacing, attributes=attributes)
        answer = saved(log, model, attributes).entity_at_time(entity_type, id_, t)
        rows.append(_found(answer, spacing=spacing))
    return together(rows)
