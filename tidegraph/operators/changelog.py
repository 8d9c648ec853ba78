"""Change-log algebra: selecting, squashing, checking and replaying entries.

The state of an entity after some entries is decided by its last CREATE or DELETE.
After a DELETE (or with neither) it does not exist; after a CREATE its attributes
are those of the CREATE and of the later UPDATEs, the newest value of a key
winning (``attributes="merge"``) or only those of the newest entry (``"replace"``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attributes import attributes_text, merge_attributes
from ..functions.intervals import within
from ..functions.times import epoch_micros, instant
from ..schema import CREATE, DELETE, EDGE, ENTITY, ORDER, STATE, UPDATE, VERTEX, conform, no_attributes
from .ordered import OrderedRows, dense_index, rows_at_places


def is_lifecycle(action: Column) -> Column:
    return action.isin(CREATE, DELETE)


# -- selecting ---------------------------------------------------------------


def logs_in_interval(log: DataFrame, start=None, stop=None) -> DataFrame:
    """Entries with start <= ts <= stop."""
    return log.where(within(F.col("ts"), start, stop))


def logs_for_entity(
    log: DataFrame, entity_type: str, id_: int, src: int | None = None, dst: int | None = None
) -> DataFrame:
    """Entries of one entity; for an edge the ends may be asked for as well."""
    rows = log.where((F.col("entity_type") == entity_type) & (F.col("id") == id_))
    if src is not None:
        rows = rows.where(F.col("src") == src)
    if dst is not None:
        rows = rows.where(F.col("dst") == dst)
    return rows


def vertex_logs(log: DataFrame) -> DataFrame:
    return log.where(F.col("entity_type") == VERTEX)


def edge_logs(log: DataFrame) -> DataFrame:
    return log.where(F.col("entity_type") == EDGE)


def lifecycle_edge_logs(log: DataFrame, vertex: int) -> DataFrame:
    """CREATE and DELETE entries of the edges that touch a vertex."""
    touching = (F.col("src") == vertex) | (F.col("dst") == vertex)
    return edge_logs(log).where(is_lifecycle(F.col("action")) & touching)


# -- ordering ----------------------------------------------------------------


def sort_logs(log: DataFrame) -> DataFrame:
    """The whole log, oldest entry first."""
    return log.orderBy("ts", "seq")


def reverse_logs(log: DataFrame) -> DataFrame:
    """The whole log, newest entry first; at one time the later entry comes first."""
    return log.orderBy(F.col("ts").desc(), F.col("seq").desc())


def indexed_log(log: DataFrame) -> DataFrame:
    """The log stored in order, with the place of each entry counted from 0."""
    return dense_index(log, ORDER)


def log_bounds(log: DataFrame) -> DataFrame:
    """First and last time in the log."""
    return log.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def log_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("entries"))


def times_at_places(log: DataFrame, places: list[int]) -> DataFrame:
    """(position, ts) of the entries at some places of the log, which is neither sorted nor numbered for it."""
    order = {"ts": epoch_micros(F.col("ts")), "seq": F.col("seq")}
    return rows_at_places(log, order, places).select("position", "ts")


def nth_log_timestamp(log: DataFrame, divisor: int = 20) -> DataFrame:
    """Time of the entry at place floor(n / divisor), counted from 1."""
    return times_at_places(log, [log.count() // divisor - 1]).select("ts")


def log_timestamp_quantiles(log: DataFrame, parts: int = 21) -> DataFrame:
    """Times of the entries at place floor(n / parts) * i, counted from 0, for each i < parts."""
    step = log.count() // parts
    places = [step * i for i in range(parts)]
    numbers = log.sparkSession.createDataFrame(list(enumerate(places)), "iteration INT, position BIGINT")
    # As many rows as parts.
    return numbers.join(F.broadcast(times_at_places(log, places)), "position").select("iteration", "ts")


# -- squashing ---------------------------------------------------------------


def _moment(*fields: str) -> Column:
    return F.struct(*[F.col(f) for f in ("ts", "seq", *fields)])


def _squash_merge(log: DataFrame) -> DataFrame:
    # One row per attribute and one marker (key is null) per entry. The newest
    # value of each key is found by a partial aggregate, so a busy entity shrinks
    # to its distinct keys before it moves.
    marker = F.array(
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    )
    written = F.when(
        F.col("action") != DELETE, F.map_entries(F.coalesce(F.col("attributes"), no_attributes()))
    ).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    writes = log.select(
        *ENTITY, "ts", "seq", "action", "src", "dst", F.inline(F.concat(marker, written))
    )
    is_marker = F.col("key").isNull()
    per_key = writes.groupBy(*ENTITY, "key").agg(
        F.max(F.when(~is_marker, _moment("value"))).alias("write"),
        F.max(F.when(is_marker & is_lifecycle(F.col("action")), _moment("action", "src", "dst"))).alias("life"),
        F.max(F.when(is_marker, _moment("src", "dst"))).alias("entry"),
    )
    return (
        per_key.groupBy(*ENTITY)
        .agg(
            F.max("life").alias("life"),
            F.max("entry").alias("entry"),
            # As many as the entity has distinct keys: its attribute map.
            F.collect_list(
                F.when(
                    F.col("key").isNotNull(),
                    F.struct(
                        F.struct("write.ts", "write.seq").alias("at"), F.col("key"), F.col("write.value").alias("value")
                    ),
                )
            ).alias("writes"),
        )
        .withColumn(
            "attributes",
            F.expr(
                f"""map_from_entries(transform(
                    filter(writes, w -> life IS NULL
                                        OR (life.action = '{CREATE}' AND w.at >= struct(life.ts, life.seq))),
                    w -> struct(w.key, w.value)))"""
            ),
        )
    )


def _squash_replace(log: DataFrame) -> DataFrame:
    lasting = F.col("action") != DELETE
    return (
        log.groupBy(*ENTITY)
        .agg(
            F.max(F.when(is_lifecycle(F.col("action")), _moment("action", "src", "dst"))).alias("life"),
            F.max(_moment("src", "dst")).alias("entry"),
            F.max_by("attributes", F.when(lasting, F.struct("ts", "seq"))).alias("attributes"),
        )
        .withColumn(
            "attributes",
            F.when(F.col("life.action") == DELETE, no_attributes()).otherwise(
                F.coalesce(F.col("attributes"), no_attributes())
            ),
        )
    )


def _net(log: DataFrame, attributes: str) -> DataFrame:
    if attributes not in ("merge", "replace"):
        raise ValueError("attributes must be 'merge' or 'replace'")
    net = _squash_merge(log) if attributes == "merge" else _squash_replace(log)
    return net.withColumn("action", F.coalesce(F.col("life.action"), F.lit(UPDATE)))


def squash_entities(log: DataFrame, attributes: str = "merge") -> DataFrame:
    """One net entry per entity: CREATE, UPDATE or DELETE with the combined attributes.

    A CREATE keeps its own time, a run of UPDATEs takes the latest, a DELETE
    clears what came before it.
    """
    lived = F.col("life").isNotNull()
    pick = lambda f: F.when(lived, F.col(f"life.{f}")).otherwise(F.col(f"entry.{f}")).alias(f)
    return _net(log, attributes).select(
        *ENTITY, "action", pick("ts"), pick("seq"), pick("src"), pick("dst"), "attributes"
    )


def _changes(log: DataFrame, attributes: str) -> DataFrame:
    """Net entries for a state. Only a CREATE brings ends, so those of UPDATEs are not looked up."""
    # Stated here because a join would add it on its side only, and then the two
    # uses of the result would no longer share an exchange.
    named = log.where(F.col("entity_type").isNotNull() & F.col("id").isNotNull())
    return _net(named, attributes).select(
        *ENTITY, "action", F.col("life.src").alias("src"), F.col("life.dst").alias("dst"), "attributes"
    )


def squash_vertices(log: DataFrame, attributes: str = "merge") -> DataFrame:
    return squash_entities(vertex_logs(log), attributes)


def squash_edges(log: DataFrame, attributes: str = "merge") -> DataFrame:
    return squash_entities(edge_logs(log), attributes)


def net_actions(log: DataFrame) -> DataFrame:
    """The net action of each entity, without its attributes."""
    return (
        log.groupBy(*ENTITY)
        .agg(F.max(F.when(is_lifecycle(F.col("action")), _moment("action"))).alias("life"))
        .select(*ENTITY, F.coalesce(F.col("life.action"), F.lit(UPDATE)).alias("action"))
    )


# -- replaying ---------------------------------------------------------------


def create_graph_from_logs(log: DataFrame, attributes: str = "merge") -> DataFrame:
    """State after the whole log, starting from nothing."""
    return conform(_changes(log, attributes).where(F.col("action") == CREATE), STATE)


def state_at(log: DataFrame, t, attributes: str = "merge") -> DataFrame:
    """State at a time, by replaying the log from its start."""
    return create_graph_from_logs(log.where(F.col("ts") <= instant(t)), attributes)


def apply_squashed(state: DataFrame, net: DataFrame, attributes: str = "merge") -> DataFrame:
    """Next state from a state and net entries.

    A net CREATE brings its own attributes and needs nothing of the old state; only
    UPDATE and DELETE look it up. That lookup is a left join, so when the net
    entries are few Spark sends them to the state and leaves the state in place.
    Both uses of the net entries need the same columns and share one exchange.
    """
    fresh = conform(net.where(F.col("action") == CREATE), STATE)
    change = net.select(*ENTITY, "action", F.col("attributes").alias("newer"))
    combined = (
        merge_attributes(F.col("attributes"), F.col("newer")) if attributes == "merge" else F.col("newer")
    )
    kept = (
        state.join(change, ENTITY, "left")
        .where(F.col("action").isNull() | (F.col("action") == UPDATE))
        .withColumn("attributes", F.when(F.col("action").isNull(), F.col("attributes")).otherwise(combined))
    )
    return conform(kept, STATE).unionByName(fresh)


def apply_logs(state: DataFrame, log: DataFrame, attributes: str = "merge") -> DataFrame:
    """State after applying a range of the log to an earlier state."""
    return apply_squashed(state, _changes(log, attributes), attributes)


def apply_vertex_logs(state: DataFrame, log: DataFrame, attributes: str = "merge") -> DataFrame:
    """Next vertices."""
    return apply_logs(state.where(F.col("entity_type") == VERTEX), vertex_logs(log), attributes)


def apply_edge_logs(state: DataFrame, log: DataFrame, attributes: str = "merge") -> DataFrame:
    """Next edges; ids and ends are kept."""
    return apply_logs(state.where(F.col("entity_type") == EDGE), edge_logs(log), attributes)


# -- checking ----------------------------------------------------------------


def validate_changelog(log: DataFrame, strict: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Entries that cannot follow the entries before them, with the reason.

    ``strict`` also reports a CREATE after a DELETE. An UPDATE of a deleted entity
    at the very time of the deletion is tolerated.
    """
    action, ts = F.col("action"), F.col("ts")
    previous, since = F.col("__previous.action"), F.col("__previous.ts")
    reason = (
        F.when(action == UPDATE, F.when(previous.isNull(), "update_without_create").when(
            (previous == DELETE) & (ts > since), "update_after_delete"))
        .when(action == DELETE, F.when(previous.isNull(), "delete_without_create").when(
            previous == DELETE, "delete_after_delete"))
        .when(action == CREATE, F.when(previous == CREATE, "create_while_alive").when(
            (previous == DELETE) & F.lit(strict), "create_after_delete"))
        .otherwise("unknown_action")
    )
    lifecycle = F.when(is_lifecycle(action), F.struct("action", "ts"))
    return (
        OrderedRows.of(log.select(*ENTITY, *ORDER, "action"), ENTITY, ORDER, hot_rows)
        .with_values(before={"__previous": lifecycle})
        .rows()
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*ENTITY, *ORDER, "action", "reason")
    )


def conflicting_ends(log: DataFrame) -> DataFrame:
    """Edge ids that the log uses for more than one pair of ends."""
    ends = F.struct("src", "dst")
    return (
        edge_logs(log)
        .groupBy("id")
        .agg(F.min(ends).alias("low"), F.max(ends).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("id")
    )


def grouped_logs(log: DataFrame) -> DataFrame:
    """Size and first and last time of each entity's entries, as a display of the groups."""
    return log.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def flat(state: DataFrame) -> DataFrame:
    """The rows with their attribute map as sorted text."""
    return state.withColumn("attributes", attributes_text(F.col("attributes")))
