"""The snapshot model: whole states stored at intervals, and the log in between."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.attributes import other_end
from ..functions.intervals import within
from ..functions.times import MICROS, epoch_micros, floor_div, instant, micros_to_ts
from ..schema import CHANGELOG, CREATE, ENTITY, ORDER, SNAPSHOT_INDEX, STATE, conform
from ..storage import stored
from .backward import between, undo_entries, undo_logs
from .changelog import (
    apply_logs,
    create_graph_from_logs,
    edge_logs,
    indexed_log,
    is_lifecycle,
    lifecycle_edge_logs,
    logs_in_interval,
    net_actions,
    state_at,
    vertex_logs,
)
from .ordered import OrderedRows, repeat_rows
from .validity import _is_live, attribute_intervals_over, edge_ends, first_activations

# "Every entry at this instant is included."
_ALL_OF_INSTANT = (1 << 63) - 1


@dataclass(frozen=True)
class Snapshots:
    """States by snapshot number, when each was taken, and the log they came from."""

    states: DataFrame
    index: DataFrame
    log: DataFrame
    attributes: str = "merge"
    # The log once more, in buckets of entities (see ``in_buckets``); only stored models have it.
    entries: DataFrame | None = None
    # What was before each entry (see ``backward``); with it a state may come from a later snapshot.
    undo: DataFrame | None = None
    # The states as runs: one row for all snapshots of a block in which an entity's state is the same.
    runs: DataFrame | None = None


# Columns of a run: the numbers of the first and last snapshot of its block, and of those in which its state stands.
BLOCK_FROM, BLOCK_TO, RUN_FROM, RUN_TO = "snapshot_no_from", "snapshot_no_to", "first_no", "last_no"
RUNS = StructType([*STATE.fields, *[StructField(c, LongType()) for c in (RUN_FROM, RUN_TO, BLOCK_FROM, BLOCK_TO)]])

# Snapshots of a block at most, which bounds what one entity brings to a group.
MOST_IN_BLOCK = 4096


def _block_size(snapshots: int, entries: int, entities: int) -> int:
    """Snapshots between two entries of an entity, on the average.

    With blocks of so many, cutting the runs at the ends of blocks adds about one run per
    entry: all runs together grow with the log, and a block has about two per live entity.
    """
    return min(max(snapshots * entities // max(entries, 1), 1), MOST_IN_BLOCK)


def _sizes(log: DataFrame, *more: Column) -> list:
    """Driver values: entries, about how many entities, and further aggregates."""
    entities = F.approx_count_distinct(F.xxhash64(*ENTITY))
    return list(log.agg(F.count(F.lit(1)), entities, *more).first())


def _held(log: DataFrame, at: str, attributes: str, hot_rows) -> DataFrame:
    """Rows that hold over [valid_from, valid_to) of the column ``at``: lives and attribute values, or whole states."""
    if attributes == "merge":
        return attribute_intervals_over(log, at, hot_rows)
    action = F.col("action")
    return (
        OrderedRows.of(log, ENTITY, ORDER, hot_rows)
        .with_values(lead={"valid_to": F.col(at)}, before={"__life": F.when(is_lifecycle(action), action)})
        .rows()
        .where(_is_live(action, F.col("__life")))
        .withColumn("valid_from", F.col(at))
    )


def _runs(rows: DataFrame, width: int, origin: int, last: int, block: int, attributes: str) -> DataFrame:
    """All states at the ends of windows of ``width`` units, as runs, from the rows that hold.

    A row that holds over [from, to) is part of the snapshots numbered
    window(from) .. window(to) - 1. Rows that hold at the end of no window fall
    away; the others are cut at the ends of blocks of ``block`` snapshots. In a block
    the rows of an entity are put together to one whole state per run of snapshots
    without a change, so nothing is repeated for every snapshot.
    """
    window = lambda c: floor_div(F.col(c) - origin, width)
    first, final = window("valid_from"), F.coalesce(window("valid_to") - 1, F.lit(last))
    spans = rows.withColumns({"__first": first.cast("bigint"), "__final": final.cast("bigint")}).where("__final >= __first")
    spans = spans.withColumn("__blocks", floor_div(F.col("__final"), block) - floor_div(F.col("__first"), block) + 1)
    # The parts stay in their tasks: grouping by block and entity needs no exchange after that by entity.
    begins = (floor_div(F.col("__first"), block) + F.col("__k")) * block
    parts = repeat_rows(spans, "__blocks", None, "__k").withColumn(BLOCK_FROM, begins.cast("bigint"))
    parts = parts.withColumn(BLOCK_TO, F.least(F.col(BLOCK_FROM) + (block - 1), F.lit(last).cast("bigint"))).withColumns(
        {RUN_FROM: F.greatest("__first", BLOCK_FROM), RUN_TO: F.least("__final", BLOCK_TO)}
    )
    if attributes != "merge":
        return conform(parts, RUNS)
    held = F.collect_list(F.struct(RUN_FROM, RUN_TO, "key", "value", "src", "dst"))
    # An entity has a row per key and snapshot at most, so a group is bounded by its block.
    grouped = parts.groupBy(BLOCK_FROM, BLOCK_TO, *ENTITY).agg(held.alias("__rows"))
    bounds = F.concat(F.transform("__rows", lambda r: r[RUN_FROM]), F.transform("__rows", lambda r: r[RUN_TO] + 1))
    bounded = grouped.withColumn("__bounds", F.array_sort(F.array_distinct(bounds)))
    run = lambda start, i: F.struct(
        start.alias(RUN_FROM),
        (F.get("__bounds", i + 1) - 1).alias(RUN_TO),
        F.filter("__rows", lambda r: (r[RUN_FROM] <= start) & (start <= r[RUN_TO])).alias("rows"),
    )
    cut = bounded.withColumn("__run", F.explode(F.transform("__bounds", run))).where(F.size("__run.rows") > 0)
    pairs = F.filter("__run.rows", lambda r: r["key"].isNotNull())
    end = lambda c: F.array_max(F.transform("__run.rows", lambda r: r[c])).alias(c)
    whole = cut.select(
        *ENTITY,
        end("src"),
        end("dst"),
        F.map_from_entries(F.transform(pairs, lambda r: F.struct(r["key"], r["value"]))).alias("attributes"),
        f"__run.{RUN_FROM}", f"__run.{RUN_TO}", BLOCK_FROM, BLOCK_TO,
    )
    return conform(whole, RUNS)


def each_snapshot(runs: DataFrame) -> DataFrame:
    """The states of all snapshots: a run's state in each of its snapshots."""
    numbered = runs.withColumn("snapshot_no", F.explode(F.sequence(RUN_FROM, RUN_TO)))
    return numbered.select("snapshot_no", *STATE.fieldNames())


def runs_of(model: Snapshots) -> DataFrame:
    """The model's runs; of one that has only states, each state as a run of its own."""
    if model.runs is not None:
        return model.runs
    no = F.col("snapshot_no")
    return conform(model.states.withColumns({c: no for c in (RUN_FROM, RUN_TO, BLOCK_FROM, BLOCK_TO)}), RUNS)


def _every(log: DataFrame, at: str, width: int, origin: int, last: int, attributes: str, hot_rows) -> DataFrame:
    """All states at the ends of windows, one by one."""
    block = _block_size(last + 1, *_sizes(log))
    return each_snapshot(_runs(_held(log, at, attributes, hot_rows), width, origin, last, block, attributes))


def state_of(model: Snapshots, no) -> DataFrame:
    """The rows of a snapshot's state, by its number. Of a stored model one block is read."""
    if model.runs is None:
        return model.states.where(F.col("snapshot_no") == no)
    in_block = (F.col(BLOCK_FROM) <= no) & (F.col(BLOCK_TO) >= no)
    return model.runs.where(in_block & (F.col(RUN_FROM) <= no) & (F.col(RUN_TO) >= no))


def snapshots_by_time(
    log: DataFrame, every_seconds: int, attributes: str = "merge", hot_rows: int | None = None
) -> Snapshots:
    """A snapshot at the end of every window of ``every_seconds`` from the first entry on.

    A window is half-open and its snapshot is stamped one microsecond before its
    end. A window without entries repeats the state before it.
    """
    width = every_seconds * MICROS
    timed = log.withColumn("__micros", epoch_micros(F.col("ts")))
    entries, entities, low, high = _sizes(timed, F.min("__micros"), F.max("__micros"))
    spark = log.sparkSession
    if low is None:
        return Snapshots(
            spark.createDataFrame([], _states_schema()), spark.createDataFrame([], SNAPSHOT_INDEX), log, attributes,
            runs=spark.createDataFrame([], RUNS),
        )
    last = (high - low) // width
    block = _block_size(last + 1, entries, entities)
    runs = _runs(_held(timed, "__micros", attributes, hot_rows), width, low, last, block, attributes)
    index = spark.range(last + 1).select(
        F.col("id").alias("snapshot_no"),
        micros_to_ts(F.col("id") * width + (low + width - 1)).alias("snapshot_ts"),
        F.lit(_ALL_OF_INSTANT).alias("snapshot_seq"),
    )
    return Snapshots(each_snapshot(runs), conform(index, SNAPSHOT_INDEX), log, attributes, runs=runs)


def snapshots_by_count(
    log: DataFrame, every_actions: int, attributes: str = "merge", hot_rows: int | None = None
) -> Snapshots:
    """A snapshot after every ``every_actions`` entries, and one after the last entry.

    A log that ``indexed_log`` has numbered already is taken as it is.
    """
    indexed = log if "position" in log.columns else indexed_log(log)
    return _by_count(indexed, _held(indexed, "position", attributes, hot_rows), *_sizes(indexed), every_actions, attributes)


def snapshots_by_counts(
    log: DataFrame, every_actions: Iterable[int], attributes: str = "merge", hot_rows: int | None = None
) -> list[Snapshots]:
    """As ``snapshots_by_count`` for each of several spacings: the log is numbered, and what holds when is found, once."""
    indexed = log if "position" in log.columns else indexed_log(log)
    held, sizes = stored(_held(indexed, "position", attributes, hot_rows), "held"), _sizes(indexed)
    return [_by_count(indexed, held, *sizes, every, attributes) for every in every_actions]


def _by_count(indexed: DataFrame, held: DataFrame, size: int, entities: int, every_actions: int, attributes: str) -> Snapshots:
    last = max(size - 1, 0) // every_actions
    runs = _runs(held, every_actions, 0, last, _block_size(last + 1, size, entities), attributes)
    position = F.col("position")
    closing = (F.pmod(position, F.lit(every_actions)) == every_actions - 1) | (position == size - 1)
    index = indexed.where(closing).select(
        floor_div(position, every_actions).alias("snapshot_no"),
        F.col("ts").alias("snapshot_ts"),
        F.col("seq").alias("snapshot_seq"),
    )
    return Snapshots(each_snapshot(runs), conform(index, SNAPSHOT_INDEX), indexed.drop("position"), attributes, runs=runs)


def _states_schema():
    return SNAPSHOT_INDEX.__class__([SNAPSHOT_INDEX["snapshot_no"], *STATE.fields])


def latest_snapshot_before(index: DataFrame, t) -> DataFrame:
    """The newest snapshot not after a time: one row, or none."""
    newest = F.max(F.struct("snapshot_ts", "snapshot_no", "snapshot_seq"))
    return (
        index.where(F.col("snapshot_ts") <= instant(t))
        .agg(newest.alias("newest"))
        .where(F.col("newest").isNotNull())
        .select("newest.snapshot_no", "newest.snapshot_ts", "newest.snapshot_seq")
    )


def closest_snapshot(index: DataFrame, t) -> DataFrame:
    """The snapshot nearest in time; of two equally near ones the earlier."""
    away = F.abs(epoch_micros(F.col("snapshot_ts")) - epoch_micros(instant(t)))
    nearest = F.min_by(F.struct("snapshot_no", "snapshot_ts", "snapshot_seq"), F.struct(away, "snapshot_no"))
    return (
        index.agg(nearest.alias("nearest"))
        .where(F.col("nearest").isNotNull())
        .select("nearest.snapshot_no", "nearest.snapshot_ts", "nearest.snapshot_seq")
    )


def _since(snapshot, t) -> Column:
    """Log entries after a snapshot and not after a time.

    The bare comparison of ``ts`` reaches the file scan; the second part settles
    entries at the very instant of the snapshot.
    """
    ts, seq = F.col("ts"), F.col("seq")
    stamp = instant(snapshot["snapshot_ts"])
    return (ts >= stamp) & (ts <= instant(t)) & ((ts > stamp) | (seq > snapshot["snapshot_seq"]))


def snapshot_delta(model: Snapshots, t) -> DataFrame:
    """State at a time: the newest earlier snapshot plus the entries since."""
    # Driver value: one row of the index. As a constant it prunes the partitions.
    snapshot = latest_snapshot_before(model.index, t).first()
    if snapshot is None:
        return state_at(model.log, t, model.attributes)
    state = state_of(model, snapshot["snapshot_no"])
    return apply_logs(conform(state, STATE), model.log.where(_since(snapshot, t)), model.attributes)


def with_undo(model: Snapshots, hot_rows: int | None = None) -> Snapshots:
    """The model with its undo table, for states from the nearer snapshot on either side."""
    return replace(model, undo=undo_entries(model.log, model.attributes, hot_rows))


def snapshot_nearest(model: Snapshots, t) -> DataFrame:
    """State at a time: the snapshot nearest in time, replayed forward or backward.

    No more than half the time between two snapshots is replayed. The result is that of
    ``snapshot_delta``; a model without an undo table is answered by it.
    """
    if model.undo is None:
        return snapshot_delta(model, t)
    # Driver value: one row of the index, with the time asked as the index's type.
    later = (F.col("snapshot_ts") > instant(t)).alias("later")
    snapshot = closest_snapshot(model.index, t).select("*", later).first()
    if snapshot is None or not snapshot["later"]:
        return snapshot_delta(model, t)
    state = conform(state_of(model, snapshot["snapshot_no"]), STATE)
    return undo_logs(state, model.undo.where(between(snapshot, t)))


# Partition columns of the log by entity: how many buckets there are, and the entity's.
BUCKETS, BUCKET, BUCKET_ROWS, MOST_BUCKETS = "buckets", "bucket", 1_000_000, 4096


def _bucket(entity_type: Column, id_: Column) -> Column:
    return F.pmod(F.xxhash64(entity_type, id_), F.col(BUCKETS).cast("bigint")).cast("int")


def in_buckets(log: DataFrame, rows: int) -> DataFrame:
    """The log with an entity's bucket, of which there are enough for about ``BUCKET_ROWS`` rows in each."""
    buckets = min(max(-(-rows // BUCKET_ROWS), 1), MOST_BUCKETS)
    numbered = log.withColumn(BUCKETS, F.lit(buckets))
    return numbered.withColumn(BUCKET, _bucket(F.col("entity_type"), F.col("id")))


def _entries_of(model: Snapshots, entity_type: str, id_: int) -> DataFrame:
    named = (F.col("entity_type") == entity_type) & (F.col("id") == id_)
    if model.entries is None:
        return model.log.where(named)
    # Both sides are partition columns and constants, so one folder is read.
    bucket = F.col(BUCKET) == _bucket(F.lit(entity_type), F.lit(id_).cast("bigint"))
    return model.entries.where(bucket & named)


def entity_at_delta(model: Snapshots, entity_type: str, id_: int, t) -> DataFrame:
    """The state of one entity at a time: one row, or none.

    Both inputs are cut to the entity before they meet. Its stored state is replayed
    as a CREATE at the place of the snapshot, so one squash gives the answer. The
    snapshot is a scalar subquery: its number prunes the partitions of the states as
    the query runs, and no job goes before it.
    """
    named = (F.col("entity_type") == entity_type) & (F.col("id") == id_)
    newest = F.max(F.struct("snapshot_ts", "snapshot_no", "snapshot_seq"))
    snapshot = model.index.where(F.col("snapshot_ts") <= instant(t)).agg(newest.alias("newest")).scalar()
    stored_state = state_of(model, snapshot["snapshot_no"]).where(named).withColumns(
        {"ts": snapshot["snapshot_ts"], "seq": snapshot["snapshot_seq"], "action": F.lit(CREATE)}
    )
    ts, stamp = F.col("ts"), snapshot["snapshot_ts"]
    # Without an earlier snapshot all entries up to the time count.
    later = (ts > stamp) | ((ts == stamp) & (F.col("seq") > snapshot["snapshot_seq"])) | stamp.isNull()
    since = _entries_of(model, entity_type, id_).where((ts <= instant(t)) & later).select(*CHANGELOG.fieldNames())
    return create_graph_from_logs(conform(stored_state, CHANGELOG).unionByName(since), model.attributes)


def entity_at_delta_unmaterialised(
    log: DataFrame, entity_type: str, id_: int, t, attributes: str = "merge"
) -> DataFrame:
    """The state of one entity at a time from the log alone."""
    return state_at(log.where((F.col("entity_type") == entity_type) & (F.col("id") == id_)), t, attributes)


def neighbours_delta(log: DataFrame, vertex: int, start=None, stop=None) -> DataFrame:
    """Vertices that share an edge with ``vertex`` at any time of the closed interval.

    An edge counts when it is alive as the interval begins or is created inside it.
    """
    other = other_end(F.col("src"), F.col("dst"), vertex)
    return _touched(lifecycle_edge_logs(log, vertex), ["id", "src", "dst"], start, stop, other)


def _touched(entries: DataFrame, by: list[str], start, stop, other: Column) -> DataFrame:
    ts, action = F.col("ts"), F.col("action")
    rows = entries.where(within(ts, None, stop))
    created = F.coalesce(F.max(F.when(within(ts, start, None), action == CREATE)), F.lit(False))
    touched = created
    if start is not None:
        earlier = F.max_by(action, F.when(ts < instant(start), F.struct("ts", "seq")))
        touched = touched | F.coalesce(earlier == CREATE, F.lit(False))
    return (
        rows.groupBy(*by)
        .agg(touched.alias("touched"))
        .where("touched")
        .select(other.alias("id"))
        .distinct()
    )


def first_creations(log: DataFrame) -> DataFrame:
    """The first activation of each entity, from its CREATE entries."""
    return first_activations(log.where(F.col("action") == CREATE), "ts")


def action_ends(log: DataFrame) -> DataFrame:
    """CREATE and DELETE entries of edges by vertex, for asking one vertex."""
    return edge_ends(log.where(is_lifecycle(F.col("action"))), "id", "ts", "seq", "action")


def neighbours_of_actions(ends: DataFrame, vertex: int, start=None, stop=None) -> DataFrame:
    """As ``neighbours_delta``, from the entries by vertex."""
    return _touched(ends.where(F.col("vertex") == vertex), ["id", "other"], start, stop, F.col("other"))


def activated_delta(log: DataFrame, start=None, stop=None, mode: str = "first_activation") -> DataFrame:
    """Entities activated in the closed interval, from the log; see ``activated_validity``."""
    ts = F.col("ts")
    if mode == "net_create":
        net = net_actions(logs_in_interval(log, start, stop))
        return net.where(F.col("action") == CREATE).select(*ENTITY)
    if mode != "first_activation":
        raise ValueError("mode must be 'first_activation' or 'net_create'")
    return (
        log.where((F.col("action") == CREATE) & within(ts, None, stop))
        .groupBy(*ENTITY)
        .agg(F.min("ts").alias("first"))
        .where(within(F.col("first"), start, stop))
        .select(*ENTITY)
    )


def activated_vertices_delta(log: DataFrame, start=None, stop=None, mode="first_activation") -> DataFrame:
    return activated_delta(vertex_logs(log), start, stop, mode).select("id")


def activated_edges_delta(log: DataFrame, start=None, stop=None, mode="first_activation") -> DataFrame:
    return activated_delta(edge_logs(log), start, stop, mode).select("id")
