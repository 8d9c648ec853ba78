"""Change logs and contacts: reading, writing, selecting, ordering, squashing, checking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as at
from ..functions import intervals as iv
from ..functions import text as tx
from ..functions.attributes import attributes_text, other_end, surrogate_id
from ..functions.times import epoch_seconds, seconds_to_ts
from ..operators import changelog as cl
from ..operators import topology as tp
from ..operators.graph import PropertyGraph
from ..operators.ordered import dense_index
from ..operators.synthesis import Distribution, even_timestamps_per_row
from ..sources import changelog_text, contacts, samples, store
from ..storage import new_path
from . import sql as q
from .registry import query

_ENTRY = ["seq", "ts", "action", "entity_type", "id"]
_RANGE = f"ts >= TIMESTAMP '{q.USERS_SPAN[0]}' AND ts <= TIMESTAMP '{q.USERS_SPAN[1]}'"


def users(spark, sf):
    return samples.stored_log(spark, sf, "users")


def nations(spark, sf):
    return samples.stored_log(spark, sf, "nations")


def edges(spark, sf):
    return samples.stored_log(spark, sf, "nation_edges")


def raw_users(spark, sf):
    """Events read as entries as they come, legal or not."""
    kind = F.col("event_type")
    return samples.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind == "signup", "CREATE").when(kind == "error", "DELETE").otherwise("UPDATE").alias("action"),
        F.lit("VERTEX").alias("entity_type"),
        F.col("user_id").alias("id"),
        F.lit(None).cast("bigint").alias("src"),
        F.lit(None).cast("bigint").alias("dst"),
        F.create_map(F.lit("event_type"), kind).alias("attributes"),
    )


RAW_USERS = """
raw AS (
  SELECT event_id AS seq, ts,
         CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action,
         'VERTEX' AS entity_type, user_id AS id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, event_type
  FROM events),
raw_writes AS (SELECT entity_type, id, ts, seq, 'event_type' AS key, event_type AS value FROM raw WHERE action <> 'DELETE')
"""

# -- sources and sinks -------------------------------------------------------


@query(f"WITH {q.NATION_CONTACTS} SELECT src, dst, CAST(epoch(ts) AS BIGINT) AS time FROM contacts")
def read_contacts(spark, sf):
    path = new_path(spark, "contacts")
    contacts.write_contacts(samples.log_key_seconds(samples.nation_contacts(spark, sf)), path, ",")
    return contacts.read_contacts(spark, path, ",")


@query(
    "SELECT CASE l_linenumber WHEN 1 THEN 'bad_source' WHEN 2 THEN 'bad_target' WHEN 3 THEN 'bad_time' WHEN 4 THEN 'too_few_fields' "
    "ELSE 'too_many_fields' END AS reason, count(*) AS lines FROM lineitem WHERE l_linenumber <= 4 OR l_returnflag = 'R' GROUP BY 1"
)
def rejected_contacts(spark, sf):
    """Lines of a contact file that cannot be read, by reason."""
    number = F.col("l_linenumber")
    src = F.when(number == 1, "customer").otherwise(F.col("l_orderkey").cast("string"))
    dst = F.when(number == 2, "1.5").otherwise(F.col("l_suppkey").cast("string"))
    time = F.when(number == 3, "99999999999999999999").otherwise(F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string"))
    more = F.when((number > 4) & (F.col("l_returnflag") == "R"), F.lit(";7")).otherwise("")
    line = F.when(number == 4, F.concat_ws(";", src, dst)).otherwise(F.concat(F.concat_ws(";", src, dst, time), more))
    path = new_path(spark, "contact-lines")
    samples.table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    _, rejected = contacts.read_contact_lines(spark, path, ";")
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"WITH {q.TRADE_CONTACTS}, ends AS (SELECT src AS id FROM contacts UNION SELECT dst FROM contacts) "
    "SELECT 'vertex' AS part, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS TIMESTAMP) AS ts FROM ends "
    "UNION ALL SELECT 'edge', NULL, src, dst, ts FROM contacts"
)
def contacts_raw_graph(spark, sf):
    vertices, raw_edges = tp.contacts_raw_graph(samples.trade_contacts(spark, sf))
    rows = vertices.select(F.lit("vertex").alias("part"), "id").unionByName(
        raw_edges.select(F.lit("edge").alias("part"), "src", "dst", "ts"), allowMissingColumns=True
    )
    return rows.select("part", "id", "src", "dst", "ts")


@query(f"WITH {q.USERS} SELECT row_number() OVER (ORDER BY ts, seq) - 1 AS seq, ts, action, entity_type, id, attributes FROM users")
def read_changelog_tsv(spark, sf):
    path = new_path(spark, "log-text")
    changelog_text.write_changelog_tsv(users(spark, sf), path)
    log, _ = changelog_text.read_changelog_tsv(spark, path)
    return cl.flat(log.select(*_ENTRY, "attributes"))


@query(
    "SELECT CASE WHEN event_type = 'view' THEN 'bad_action' WHEN event_type = 'click' THEN 'bad_entity' "
    "WHEN event_type = 'error' THEN 'bad_timestamp' WHEN event_type = 'signup' THEN 'bad_attributes' END AS reason, "
    "count(*) AS lines FROM events WHERE event_type <> 'purchase' GROUP BY 1"
)
def quarantined_lines(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    stamp = F.when(kind == "error", "yesterday").otherwise(tx.serialize_instant(F.col("ts")))
    action = F.when(kind == "view", "LOOK").otherwise("UPDATE")
    entity = F.when(kind == "click", F.concat(F.lit("VERTEX:u"), user)).otherwise(F.concat(F.lit("VERTEX:"), user))
    pair = F.when(kind == "signup", "no pair").otherwise("a:1")
    lines = samples.table(spark, sf, "events").select(F.concat_ws("\t", stamp, action, entity, pair).alias("value"))
    _, rejected = changelog_text.parse_lines(lines)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


_INSTANT = (
    "CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') "
    "WHEN epoch_us(ts) % 1000 = 0 THEN substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 23) || 'Z' "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END"
)


@query(
    f"WITH {q.USERS} SELECT {_INSTANT} || chr(9) || action || chr(9) || 'VERTEX:' || id || CASE WHEN action = 'DELETE' "
    "THEN '' ELSE chr(9) || 'cents:' || cents || chr(9) || 'event_type:' || event_type END AS value FROM users"
)
def write_changelog_tsv(spark, sf):
    path = new_path(spark, "log-text")
    changelog_text.write_changelog_tsv(users(spark, sf), path)
    return spark.read.text(path)


@query(
    f"WITH {q.NATION_EDGES} SELECT seq, {_INSTANT} || chr(9) || action || chr(9) || 'EDGE:' || id || ':' || src || ':' "
    "|| dst || CASE WHEN action = 'DELETE' THEN '' ELSE chr(9) || 'month:' || month END AS line FROM edges"
)
def serialize_log(spark, sf):
    columns = ("ts", "action", "entity_type", "id", "src", "dst", "attributes")
    return edges(spark, sf).select("seq", tx.serialize_log(*[F.col(c) for c in columns]).alias("line"))


@query(f"WITH {q.NATIONS} SELECT seq, ts, action, entity_type, id, attributes FROM nations")
def save_load_changelog(spark, sf):
    path = new_path(spark, "log")
    store.save_changelog(nations(spark, sf), path)
    return cl.flat(store.load_changelog(spark, path).select(*_ENTRY, "attributes"))


@query(f"WITH {q.NATION_EDGES} SELECT seq, ts, action, id, src, dst, attributes FROM edges")
def load_or_generate_changelog(spark, sf):
    path = store.changelog_path(new_path(spark, "logs"), "nations", Distribution("uniform", 0, 10))
    for _ in range(2):  # The second call finds the log of the first.
        log = store.load_or_generate_changelog(spark, path, lambda: edges(spark, sf))
    return cl.flat(log).select("seq", "ts", "action", "id", "src", "dst", "attributes")


@query(
    f"WITH {q.USERS}, {q.state('users', q.USERS_T, 'user_state')}, {q.NATION_EDGES}, {q.state('edges', q.ORDERS_T, 'edge_state')} "
    "SELECT 'vertex' AS part, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, attributes FROM user_state "
    "UNION ALL SELECT 'edge', id, src, dst, attributes FROM edge_state"
)
def save_graph(spark, sf):
    """The users and the live edges between nations, stored and read again."""
    vertices = cl.state_at(users(spark, sf), q.USERS_T).select("id", "attributes")
    live = cl.state_at(edges(spark, sf), q.ORDERS_T).select("id", "src", "dst", "attributes")
    path = new_path(spark, "graph")
    store.save_graph(PropertyGraph(vertices, live), path)
    graph = store.load_graph(spark, path)
    rows = cl.flat(graph.vertices).withColumn("part", F.lit("vertex")).unionByName(
        cl.flat(graph.edges).withColumn("part", F.lit("edge")), allowMissingColumns=True
    )
    return rows.select("part", "id", "src", "dst", "attributes")


# -- intervals ---------------------------------------------------------------

_SPANS = """
spans AS (
  SELECT l_returnflag AS flag, least(o_orderdate, l_shipdate) AS a_from, greatest(o_orderdate, l_shipdate) AS a_to,
         o_orderdate + INTERVAL 30 DAY AS b_from, o_orderdate + INTERVAL 90 DAY AS b_to
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def spans(spark, sf):
    """The time between order and shipment of each line item, and a window after the order."""
    joined = samples.table(spark, sf, "lineitem").join(
        samples.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    rows = joined.select(
        F.col("l_returnflag").alias("flag"),
        F.col("o_orderdate").alias("a_from"),
        F.col("l_shipdate").alias("a_to"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("b_from"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("b_to"),
    )
    return iv.normalise_interval(rows, "a_from", "a_to")


def _count_by_flag(df, test):
    return df.groupBy("flag").agg(F.count_if(test).alias("hits"))


def _span_sql(test):
    return f"WITH {_SPANS} SELECT flag, count(*) FILTER (WHERE {test}) AS hits FROM spans GROUP BY flag"


_AB = ("a_from", "a_to", "b_from", "b_to")


@query(_span_sql("a_from <= b_to AND b_from <= a_to"))
def interval_overlaps(spark, sf):
    return _count_by_flag(spans(spark, sf), iv.overlaps(*[F.col(c) for c in _AB]))


@query(_span_sql("a_from <= b_from AND b_to <= a_to"))
def interval_contains_interval(spark, sf):
    return _count_by_flag(spans(spark, sf), iv.contains_interval(*[F.col(c) for c in _AB]))


@query(_span_sql("a_from <= b_from AND b_from <= a_to"))
def interval_contains_instant(spark, sf):
    test = iv.contains_instant(F.col("a_from"), F.col("a_to"), F.col("b_from"))
    return _count_by_flag(spans(spark, sf), test)


@query(_span_sql("a_from <= b_from AND b_from < a_to"))
def interval_half_open_contains(spark, sf):
    test = iv.half_open_contains(F.col("a_from"), F.col("a_to"), F.col("b_from"))
    return _count_by_flag(spans(spark, sf), test)


@query(
    f"WITH {_SPANS} SELECT flag, count(*) AS n, min(a_from) AS first, max(a_to) AS last, "
    "CAST(sum(epoch_us(a_to) - epoch_us(a_from)) // 86400000000 AS BIGINT) AS days FROM spans GROUP BY flag"
)
def normalise_interval(spark, sf):
    days = F.datediff("a_to", "a_from").cast("bigint")
    return spans(spark, sf).groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.min("a_from").alias("first"), F.max("a_to").alias("last"), F.sum(days).alias("days")
    )


# -- selecting ---------------------------------------------------------------


@query(f"WITH {q.USERS} SELECT seq, ts, action, entity_type, id FROM users WHERE {_RANGE}")
def logs_in_interval(spark, sf):
    return cl.logs_in_interval(users(spark, sf), *q.USERS_SPAN).select(*_ENTRY)


@query(f"WITH {q.USERS} SELECT seq, ts, action, entity_type, id FROM users WHERE id = 7")
def logs_for_entity(spark, sf):
    return cl.logs_for_entity(users(spark, sf), "VERTEX", 7).select(*_ENTRY)


def _both(spark, sf):
    return users(spark, sf).unionByName(edges(spark, sf))


_BOTH = f"{q.USERS}, {q.NATION_EDGES}, both_logs AS (SELECT seq, ts, action, entity_type, id FROM users UNION ALL SELECT seq, ts, action, entity_type, id FROM edges)"


@query(f"WITH {_BOTH} SELECT * FROM both_logs WHERE entity_type = 'VERTEX'")
def vertex_logs(spark, sf):
    return cl.vertex_logs(_both(spark, sf)).select(*_ENTRY)


@query(f"WITH {_BOTH} SELECT * FROM both_logs WHERE entity_type = 'EDGE'")
def edge_logs(spark, sf):
    return cl.edge_logs(_both(spark, sf)).select(*_ENTRY)


@query(f"WITH {q.NATION_EDGES} SELECT seq, ts, action, id, src, dst FROM edges WHERE action <> 'UPDATE' AND (src = 3 OR dst = 3)")
def lifecycle_edge_logs(spark, sf):
    return cl.lifecycle_edge_logs(edges(spark, sf), 3).select("seq", "ts", "action", "id", "src", "dst")


# -- ordering ----------------------------------------------------------------


def _placed(log):
    """The entries with their places in the order they come in."""
    placed = log.withColumn("__at", F.monotonically_increasing_id())
    return dense_index(placed, ["__at"]).select("seq", "ts", "action", "id", "position")


@query(f"WITH {q.NATIONS} SELECT seq, ts, action, id, row_number() OVER (ORDER BY ts, seq) - 1 AS position FROM nations")
def sort_logs(spark, sf):
    return _placed(cl.sort_logs(nations(spark, sf)))


@query(f"WITH {q.NATIONS} SELECT seq, ts, action, id, row_number() OVER (ORDER BY ts DESC, seq DESC) - 1 AS position FROM nations")
def reverse_logs(spark, sf):
    return _placed(cl.reverse_logs(nations(spark, sf)))


@query(f"WITH {q.USERS} SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM users")
def log_bounds(spark, sf):
    return cl.log_bounds(users(spark, sf))


@query(f"WITH {q.USERS} SELECT count(*) AS entries FROM users")
def log_count(spark, sf):
    return cl.log_count(users(spark, sf))


_PLACES = "places AS (SELECT ts, row_number() OVER (ORDER BY ts, seq) - 1 AS position, count(*) OVER () AS n FROM users)"


@query(f"WITH {q.USERS}, {_PLACES} SELECT ts FROM places WHERE position = n // 20 - 1")
def nth_log_timestamp(spark, sf):
    return cl.nth_log_timestamp(users(spark, sf))


@query(
    f"WITH {q.USERS}, {_PLACES} SELECT CAST(i AS INTEGER) AS iteration, ts FROM range(21) r(i) "
    "JOIN places ON position = (n // 21) * i"
)
def log_timestamp_quantile(spark, sf):
    return cl.log_timestamp_quantiles(users(spark, sf), 21)


# -- squashing ---------------------------------------------------------------


def squash_sql(log: str, where: str, ctes: str) -> str:
    return f"""
WITH {ctes},
part AS (SELECT * FROM {log} WHERE {where}),
part_writes AS (SELECT * FROM {log}_writes WHERE {where}),
life AS (SELECT entity_type, id, ts, seq, action FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_type, id ORDER BY ts DESC, seq DESC) AS rn
  FROM part WHERE action <> 'UPDATE') WHERE rn = 1),
newest AS (SELECT entity_type, id, ts, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_type, id ORDER BY ts DESC, seq DESC) AS rn FROM part) WHERE rn = 1),
kept AS (SELECT w.entity_type, w.id, w.key, w.value,
    row_number() OVER (PARTITION BY w.entity_type, w.id, w.key ORDER BY w.ts DESC, w.seq DESC) AS rn
  FROM part_writes w LEFT JOIN life l ON l.entity_type = w.entity_type AND l.id = w.id
  WHERE l.id IS NULL OR (l.action = 'CREATE' AND (w.ts > l.ts OR (w.ts = l.ts AND w.seq >= l.seq)))),
maps AS (SELECT entity_type, id, string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) AS attributes
  FROM kept WHERE rn = 1 GROUP BY entity_type, id)
SELECT n.entity_type, n.id, coalesce(l.action, 'UPDATE') AS action, coalesce(l.ts, n.ts) AS ts,
  coalesce(l.seq, n.seq) AS seq, coalesce(m.attributes, '') AS attributes
FROM newest n LEFT JOIN life l ON l.entity_type = n.entity_type AND l.id = n.id
LEFT JOIN maps m ON m.entity_type = n.entity_type AND m.id = n.id"""


_NET = ["entity_type", "id", "action", "ts", "seq", "attributes"]


@query(squash_sql("users", _RANGE, q.USERS))
def squash_vertices(spark, sf):
    log = cl.logs_in_interval(users(spark, sf), *q.USERS_SPAN)
    return cl.flat(cl.squash_vertices(log)).select(*_NET)


_HALF = "ts <= TIMESTAMP '1998-06-01'"


@query(squash_sql("edges", _HALF, q.NATION_EDGES))
def squash_edges(spark, sf):
    log = cl.logs_in_interval(edges(spark, sf), None, q.ORDERS_T)
    return cl.flat(cl.squash_edges(log)).select(*_NET)


@query(squash_sql("nations", "ts >= TIMESTAMP '1996-03-01' AND ts <= TIMESTAMP '1998-06-01'", q.NATIONS))
def squash_entities(spark, sf):
    log = cl.logs_in_interval(nations(spark, sf), "1996-03-01", q.ORDERS_T)
    return cl.flat(cl.squash_entities(log)).select(*_NET)


@query(squash_sql("raw", _RANGE, RAW_USERS))
def merge_logs(spark, sf):
    log = cl.logs_in_interval(raw_users(spark, sf), *q.USERS_SPAN)
    return cl.flat(cl.squash_entities(log)).select(*_NET)


@query(
    "SELECT doc.a_id AS id, doc.a_flag || '|' || doc.a_pri AS merged FROM ("
    "SELECT o_orderkey AS a_id, 'flag=' || o_orderstatus AS a_flag, 'pri=' || "
    "CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderpriority END AS a_pri FROM orders) doc"
)
def merge_attributes(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    base = F.create_map(F.lit("flag"), status, F.lit("pri"), F.lit("none"))
    newer = F.when(status == "P", F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("pri"), priority)
    )
    merged = F.translate(attributes_text(at.merge_attributes(base, newer)), ";", "|")
    return samples.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), merged.alias("merged"))


@query(
    f"WITH {_BOTH} SELECT entity_type, id, count(*) AS entries, min(ts) AS first_ts, max(ts) AS last_ts "
    "FROM both_logs GROUP BY entity_type, id"
)
def grouped_logs(spark, sf):
    return cl.grouped_logs(_both(spark, sf))


@query(f"""
WITH {RAW_USERS},
before AS (SELECT *, last_value(CASE WHEN action <> 'UPDATE' THEN action END IGNORE NULLS) OVER w AS prev,
    last_value(CASE WHEN action <> 'UPDATE' THEN ts END IGNORE NULLS) OVER w AS since
  FROM raw WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT entity_type, id, ts, seq, action, CASE
    WHEN action = 'UPDATE' AND prev IS NULL THEN 'update_without_create'
    WHEN action = 'UPDATE' AND prev = 'DELETE' AND ts > since THEN 'update_after_delete'
    WHEN action = 'DELETE' AND prev IS NULL THEN 'delete_without_create'
    WHEN action = 'DELETE' AND prev = 'DELETE' THEN 'delete_after_delete'
    WHEN action = 'CREATE' AND prev = 'CREATE' THEN 'create_while_alive'
    WHEN action = 'CREATE' AND prev = 'DELETE' THEN 'create_after_delete' END AS reason FROM before)
SELECT * FROM judged WHERE reason IS NOT NULL""")
def validate_changelog(spark, sf):
    return cl.validate_changelog(raw_users(spark, sf), strict=True)


@query(
    "SELECT o_custkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey "
    "HAVING min(l_suppkey) <> max(l_suppkey)"
)
def conflicting_ends(spark, sf):
    joined = samples.table(spark, sf, "orders").join(
        samples.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    log = joined.select(
        F.lit("EDGE").alias("entity_type"), F.col("o_custkey").alias("id"), F.col("o_custkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
    )
    return cl.conflicting_ends(log)


# -- scalar functions --------------------------------------------------------


@query(
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'VERTEX' WHEN o_orderstatus = 'O' THEN 'EDGE' "
    "ELSE 'none' END AS kind, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS parsed FROM orders"
)
def parse_entity(spark, sf):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat_ws(":", F.lit("VERTEX"), cust))
        .when(F.col("o_orderstatus") == "O", F.concat_ws(":", F.lit("EDGE"), cust, key, key))
        .otherwise(F.concat_ws(":", F.lit("EDGE"), cust, key))
    )
    parsed = tx.parse_entity(text)
    return samples.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.coalesce(parsed["entity_type"], F.lit("none")).alias("kind"),
        F.coalesce(parsed["id"], F.lit(-1)).alias("parsed"),
    )


@query(
    "SELECT p_partkey AS id, 'brand:' || replace(p_brand, ':', '') || chr(9) || 'name:' || replace(p_name, ':', '') "
    "|| chr(9) || 'typesize:' || p_type || p_size AS text FROM part"
)
def serialize_attributes(spark, sf):
    attributes = F.create_map(
        F.lit("name"), F.col("p_name"),
        F.lit("brand"), F.col("p_brand"),
        F.lit("type:size"), F.concat(F.col("p_type"), F.lit(":\t"), F.col("p_size").cast("string")),
    )
    return samples.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), tx.serialize_attributes(attributes).alias("text")
    )


@query(
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'rejected' ELSE 'brand=' || p_brand || ';size=' || p_size "
    "END AS parsed FROM part"
)
def deserialize_attributes(spark, sf):
    size = F.col("p_size").cast("string")
    pairs = F.array(
        F.concat(F.lit("brand:"), F.col("p_brand")),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("size:a:"), size)).otherwise(F.concat(F.lit("size:"), size)),
    )
    parsed = attributes_text(tx.deserialize_attributes(pairs))
    return samples.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.coalesce(parsed, F.lit("rejected")).alias("parsed")
    )


@query("SELECT CASE WHEN event_type = 'signup' THEN 'CREATE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'none' END AS action, count(*) AS n FROM events GROUP BY 1")
def parse_action(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "signup", "CREATE").when(kind == "error", "DELETE").otherwise(kind)
    action = F.coalesce(tx.parse_action(text), F.lit("none"))
    return samples.table(spark, sf, "events").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC' AS second FROM events")
def seconds_to_timestamp(spark, sf):
    second = seconds_to_ts(epoch_seconds(F.col("ts")))
    return samples.table(spark, sf, "events").select(F.col("event_id").alias("id"), second.alias("second"))


@query(
    f"WITH {q.NATION_CONTACTS}, {q.sessions(30)} SELECT edge_id, position, "
    "valid_from + to_seconds(position * ((epoch_us(valid_to) - epoch_us(valid_from)) // 1000000 // greatest(contacts - 1, 1))) AS ts "
    "FROM (SELECT *, unnest(range(contacts)) AS position FROM sessions)"
)
def even_timestamps(spark, sf):
    sessions = tp.with_edge_ids(tp.merge_contacts(samples.nation_contacts(spark, sf), 30 * samples.DAY))
    spread = even_timestamps_per_row(sessions, "contacts", "valid_from", "valid_to", ["edge_id"])
    return spread.select("edge_id", "position", "ts")


@query("SELECT o_orderkey AS id, CAST('0x' || substr(md5(o_custkey || '|' || o_orderkey), 1, 15) AS BIGINT) AS surrogate FROM orders")
def surrogate_ids(spark, sf):
    surrogate = surrogate_id(F.col("o_custkey"), F.col("o_orderkey"))
    return samples.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), surrogate.alias("surrogate"))


@query(f"WITH {q.NATION_EDGES} SELECT seq, CASE WHEN dst = 3 THEN src ELSE dst END AS other FROM edges WHERE src = 3 OR dst = 3")
def other_ends(spark, sf):
    src, dst = F.col("src"), F.col("dst")
    touching = edges(spark, sf).where((src == 3) | (dst == 3))
    return touching.select("seq", other_end(src, dst, 3).alias("other"))


# -- topology ----------------------------------------------------------------


@query(f"WITH {q.TRADE_CONTACTS} SELECT src, dst, min(ts) AS first, max(ts) AS last FROM contacts GROUP BY src, dst")
def contact_bounds(spark, sf):
    return tp.contact_bounds(samples.trade_contacts(spark, sf))


def _merge_sql(contacts_sql: str, days: int) -> str:
    return f"WITH {contacts_sql}, {q.sessions(days)} SELECT edge_id, src, dst, valid_from, valid_to, contacts FROM sessions"


@query(_merge_sql(q.NATION_CONTACTS, 30))
def merge_contacts(spark, sf):
    sessions = tp.merge_contacts(samples.nation_contacts(spark, sf), 30 * samples.DAY)
    return tp.with_edge_ids(sessions).select("edge_id", "src", "dst", "valid_from", "valid_to", "contacts")


@query(_merge_sql(q.TRADE_CONTACTS, 90))
def merge_contacts_large(spark, sf):
    sessions = tp.merge_contacts(samples.trade_contacts(spark, sf), 90 * samples.DAY)
    return tp.with_edge_ids(sessions).select("edge_id", "src", "dst", "valid_from", "valid_to", "contacts")


_THRESHOLDS = ", ".join(f"({t})" for t in tp.SWEEP_THRESHOLDS)


@query(f"""
WITH {q.NATION_CONTACTS},
gaps AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src, dst ORDER BY ts)) AS gap FROM contacts)
SELECT CAST(0 AS BIGINT) AS threshold, count(*) AS edges FROM gaps
UNION ALL
SELECT CAST(t AS BIGINT), count(*) FILTER (WHERE gap IS NULL OR gap > t * {q.DAY_MICROS}::BIGINT)
FROM gaps, (VALUES {_THRESHOLDS}) v(t) GROUP BY t""")
def threshold_sweep(spark, sf):
    return tp.threshold_sweep(samples.nation_contacts(spark, sf), unit=samples.DAY)


def _sweep_sql(name: str, contacts_sql: str) -> str:
    return f"""
SELECT '{name}' AS source, t AS threshold, edges FROM (
WITH {contacts_sql},
gaps AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src, dst ORDER BY ts)) AS gap FROM contacts)
SELECT CAST(t AS BIGINT) AS t, count(*) FILTER (WHERE t = 0 OR gap IS NULL OR gap > t * {q.DAY_MICROS}::BIGINT) AS edges
FROM gaps, (VALUES (0), {_THRESHOLDS}) v(t) GROUP BY t)"""


@query(_sweep_sql("nations", q.NATION_CONTACTS) + " UNION ALL " + _sweep_sql("trade", q.TRADE_CONTACTS))
def threshold_sweep_sources(spark, sf):
    sources = {"nations": samples.nation_contacts(spark, sf), "trade": samples.trade_contacts(spark, sf)}
    return tp.threshold_sweeps(sources, unit=samples.DAY)
