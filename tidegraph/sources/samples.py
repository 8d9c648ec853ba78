"""Change logs and contacts derived from the supplied order, line-item and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.attributes import attributes_of
from ..functions.times import epoch_micros
from ..operators.ordered import OrderedRows, dealt, dense_index
from ..operators.synthesis import action_rank
from ..operators.topology import contacts_in_sessions, sessions_of, with_edge_ids
from ..schema import CHANGELOG, CREATE, DELETE, EDGE, UPDATE, VERTEX, conform, no_attributes
from ..storage import new_path, stored
from .store import exists, load_or_generate_changelog

DAY = 86_400
_paths: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as vertices with several lives.

    An ``error`` deletes a live user and is dropped for a dead one; the event after
    an ``error``, and the first, creates; any other updates.
    """
    previous, now = F.col("__previous"), F.col("event_type")
    dead = previous.isNull() | (previous == "error")
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    action = (
        F.when(now == "error", F.when(~dead, DELETE)).when(dead, CREATE).otherwise(UPDATE)
    )
    rows = (
        OrderedRows.of(events.select("seq", "ts", "user_id", "event_type", "value"), ["user_id"], ["ts", "seq"])
        .with_values(lag={"__previous": now})
        .rows()
        .withColumn("action", action)
        .where(F.col("action").isNotNull())
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    return conform(
        rows.select(
            "seq",
            "ts",
            "action",
            F.lit(VERTEX).alias("entity_type"),
            F.col("user_id").alias("id"),
            F.when(F.col("action") == DELETE, no_attributes())
            .otherwise(attributes_of(event_type=now, cents=cents))
            .alias("attributes"),
        ),
        CHANGELOG,
    )


def nation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as vertices whose many orders share days and set only some keys."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("ts"),
        F.col("c_nationkey").cast("bigint").alias("id"),
        attributes_of(
            priority=F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")),
            status=F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")),
        ).alias("attributes"),
    )
    # The first entry of a nation creates it: a partial minimum, not a window.
    first = rows.groupBy("id").agg(F.min(F.struct("ts", "seq")).alias("first"))
    return conform(
        rows.join(first, "id").select(
            "seq",
            "ts",
            F.when(F.struct("ts", "seq") == F.col("first"), CREATE).otherwise(UPDATE).alias("action"),
            F.lit(VERTEX).alias("entity_type"),
            "id",
            "attributes",
        ),
        CHANGELOG,
    )


def nation_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments between nations: customer's nation, supplier's nation, ship date."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    # Customers meet the orders first, so the many line items move once, by their order.
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey", "l_shipdate")
    return (
        sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("c_nationkey").cast("bigint").alias("src"),
            F.col("s_nationkey").cast("bigint").alias("dst"),
            F.col("l_shipdate").alias("ts"),
        )
        .distinct()
    )


def trade_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in contact through an order, on the order date."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    contacts = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("src"),
        (F.col("l_suppkey") + 10_000_000).alias("dst"),
        F.col("o_orderdate").alias("ts"),
    )
    # Hardly two line items make the same contact, so nearly all rows reach the aggregates.
    return dealt(contacts, lineitem.count(), "src", "dst", "ts").distinct()


def contact_log(contacts: DataFrame, threshold_seconds: int = 30 * DAY) -> DataFrame:
    """An edge log from contacts.

    Each session is an edge: CREATE at its first contact, UPDATE at each contact in
    between, DELETE at its last. A session of one contact lives for no time at all.
    """
    entries = _contact_entries(contacts, threshold_seconds)
    return conform(dense_index(entries, ["ts", "rank", "id"], "seq"), CHANGELOG)


def _contact_entries(contacts: DataFrame, threshold_seconds: int) -> DataFrame:
    """The entries of such a log before they are numbered."""
    members = stored(contacts_in_sessions(contacts, threshold_seconds), "contacts")
    sessions = with_edge_ids(sessions_of(members))
    ends = sessions.select(
        F.col("edge_id").alias("id"),
        "src",
        "dst",
        F.inline(
            F.array(
                F.struct(F.col("valid_from").alias("ts"), F.lit(CREATE).alias("action")),
                F.struct(F.col("valid_to").alias("ts"), F.lit(DELETE).alias("action")),
            )
        ),
    )
    inner = (
        members.where(F.col("ts") > F.col("valid_from"))
        .join(sessions.drop("contacts"), ["src", "dst", "valid_from"])
        .where(F.col("ts") < F.col("valid_to"))
        .select(F.col("edge_id").alias("id"), "src", "dst", "ts", F.lit(UPDATE).alias("action"))
    )
    return ends.unionByName(inner).select(
        "ts",
        "action",
        F.lit(EDGE).alias("entity_type"),
        "id",
        "src",
        "dst",
        F.when(F.col("action") == DELETE, no_attributes())
        .otherwise(F.create_map(F.lit("month"), F.substring(F.col("ts").cast("string"), 1, 7)))
        .alias("attributes"),
        action_rank(F.col("action")).alias("rank"),
    )


def nation_edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_log(nation_contacts(spark, sf_dir))


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers with their contacts: vertices and edges in one log.

    A vertex is created with its first contact and updated by each later order day.
    """
    contacts = stored(trade_contacts(spark, sf_dir), "contacts")
    edges = _contact_entries(contacts, 365 * DAY)
    days = contacts.select(F.explode(F.array("src", "dst")).alias("id"), "ts").distinct()
    first = days.groupBy("id").agg(F.min("ts").alias("first"))
    vertices = days.join(first, "id").select(
        "ts",
        F.when(F.col("ts") == F.col("first"), CREATE).otherwise(UPDATE).alias("action"),
        F.lit(VERTEX).alias("entity_type"),
        "id",
        F.lit(None).cast("bigint").alias("src"),
        F.lit(None).cast("bigint").alias("dst"),
        F.create_map(F.lit("day"), F.substring(F.col("ts").cast("string"), 1, 10)).alias("attributes"),
    ).withColumn("rank", action_rank(F.col("action")))
    numbered = dense_index(edges.unionByName(vertices), ["ts", "rank", "entity_type", "id"], "seq")
    return conform(numbered, CHANGELOG)


_LOGS = {"users": user_log, "nations": nation_log, "nation_edges": nation_edge_log, "trade": trade_log}


def stored_log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the logs above, generated and stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _paths.setdefault(key, new_path(spark, f"log-{name}"))
    return load_or_generate_changelog(spark, path, lambda: _LOGS[name](spark, sf_dir))


def kept(
    spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """A table derived from the supplied ones, stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _paths.setdefault(key, new_path(spark, name))
    if not exists(spark, path):
        make(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as timings: a file per flag and status, quantity as log size, price as time."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("file"),
        F.col("l_linestatus").alias("function"),
        F.col("l_quantity").cast("bigint").alias("n_logs"),
        F.col("l_extendedprice").alias("value"),
    )


def log_key_seconds(df: DataFrame, column: str = "ts") -> DataFrame:
    """A timestamp column as whole epoch seconds in a column ``time``."""
    return df.withColumn("time", (epoch_micros(F.col(column)) / 1_000_000).cast("bigint"))
