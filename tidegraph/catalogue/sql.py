"""SQL for the sample logs and for the temporal questions, as named subqueries."""

from __future__ import annotations

MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS

USERS_T = "2024-01-15 00:00:00"
ORDERS_T = "1998-06-01 00:00:00"
# A closed interval on each time line.
USERS_SPAN = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
ORDERS_SPAN = ("1998-06-01 00:00:00", "1998-06-30 00:00:00")

# users(seq, ts, action, entity_type, id, src, dst, event_type, cents)
USERS = """
user_events AS (
  SELECT event_id AS seq, ts, user_id AS id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
  FROM events),
users AS (
  SELECT seq, ts,
         CASE WHEN event_type = 'error' THEN 'DELETE'
              WHEN prev IS NULL OR prev = 'error' THEN 'CREATE' ELSE 'UPDATE' END AS action,
         'VERTEX' AS entity_type, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst,
         event_type, cents,
         CASE WHEN event_type = 'error' THEN '' ELSE 'cents=' || cents || ';event_type=' || event_type END AS attributes
  FROM user_events
  WHERE NOT (event_type = 'error' AND (prev IS NULL OR prev = 'error'))),
users_writes AS (
  SELECT entity_type, id, ts, seq, 'cents' AS key, CAST(cents AS VARCHAR) AS value FROM users WHERE action <> 'DELETE'
  UNION ALL
  SELECT entity_type, id, ts, seq, 'event_type', event_type FROM users WHERE action <> 'DELETE')
"""

# nations(seq, ts, action, entity_type, id, src, dst, priority, status)
NATIONS = """
nation_rows AS (
  SELECT o_orderkey AS seq, o_orderdate AS ts, CAST(c_nationkey AS BIGINT) AS id,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey),
nations AS (
  SELECT seq, ts,
         CASE WHEN row_number() OVER (PARTITION BY id ORDER BY ts, seq) = 1 THEN 'CREATE' ELSE 'UPDATE' END AS action,
         'VERTEX' AS entity_type, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, priority, status,
         CASE WHEN priority IS NOT NULL AND status IS NOT NULL THEN 'priority=' || priority || ';status=' || status
              WHEN priority IS NOT NULL THEN 'priority=' || priority
              WHEN status IS NOT NULL THEN 'status=' || status ELSE '' END AS attributes
  FROM nation_rows),
nations_writes AS (
  SELECT entity_type, id, ts, seq, 'priority' AS key, priority AS value FROM nations WHERE priority IS NOT NULL
  UNION ALL
  SELECT entity_type, id, ts, seq, 'status', status FROM nations WHERE status IS NOT NULL)
"""

NATION_CONTACTS = """
contacts AS (
  SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
"""

TRADE_CONTACTS = """
contacts AS (
  SELECT DISTINCT o_custkey AS src, l_suppkey + 10000000 AS dst, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def sessions(days: int) -> str:
    """sessions(edge_id, src, dst, valid_from, valid_to, contacts) from contacts."""
    return f"""
contact_gaps AS (
  SELECT src, dst, ts, lag(ts) OVER (PARTITION BY src, dst ORDER BY ts) AS prev FROM contacts),
contact_runs AS (
  SELECT src, dst, ts,
         sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {days * DAY_MICROS} THEN 1 ELSE 0 END)
           OVER (PARTITION BY src, dst ORDER BY ts) AS run
  FROM contact_gaps),
session_rows AS (
  SELECT src, dst, run, min(ts) AS valid_from, max(ts) AS valid_to, count(*) AS contacts
  FROM contact_runs GROUP BY src, dst, run),
sessions AS (
  SELECT row_number() OVER (ORDER BY src, dst, valid_from) AS edge_id, src, dst, run, valid_from, valid_to, contacts
  FROM session_rows)
"""


# edges(seq, ts, action, entity_type, id, src, dst, month) on top of contacts and sessions
EDGE_LOG = """
edge_entries AS (
  SELECT valid_from AS ts, 'CREATE' AS action, 0 AS rank, edge_id AS id, src, dst FROM sessions
  UNION ALL
  SELECT valid_to, 'DELETE', 2, edge_id, src, dst FROM sessions
  UNION ALL
  SELECT r.ts, 'UPDATE', 1, s.edge_id, s.src, s.dst
  FROM contact_runs r JOIN sessions s ON r.src = s.src AND r.dst = s.dst AND r.run = s.run
  WHERE r.ts > s.valid_from AND r.ts < s.valid_to),
edges AS (
  SELECT row_number() OVER (ORDER BY ts, rank, id) - 1 AS seq, ts, action, 'EDGE' AS entity_type, id, src, dst,
         strftime(ts, '%Y-%m') AS month,
         CASE WHEN action = 'DELETE' THEN '' ELSE 'month=' || strftime(ts, '%Y-%m') END AS attributes
  FROM edge_entries),
edges_writes AS (
  SELECT entity_type, id, ts, seq, 'month' AS key, month AS value FROM edges WHERE action <> 'DELETE')
"""

NATION_EDGES = f"{NATION_CONTACTS}, {sessions(30)}, {EDGE_LOG}"


def state(log: str, t: str | None = None, name: str = "state") -> str:
    """Subquery with the state at a time: the newest value of each key since the last CREATE."""
    until = f"AND ts <= TIMESTAMP '{t}'" if t else ""
    return f"""
{name}_alive AS (
  SELECT entity_type, id, src, dst, ts, seq, action FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_type, id ORDER BY ts DESC, seq DESC) AS rn
    FROM {log} WHERE action <> 'UPDATE' {until}) WHERE rn = 1 AND action = 'CREATE'),
{name}_values AS (
  SELECT entity_type, id, string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) AS attributes FROM (
    SELECT w.entity_type, w.id, w.key, w.value,
           row_number() OVER (PARTITION BY w.entity_type, w.id, w.key ORDER BY w.ts DESC, w.seq DESC) AS rn
    FROM (SELECT * FROM {log}_writes WHERE true {until}) w JOIN {name}_alive a
      ON a.entity_type = w.entity_type AND a.id = w.id
    WHERE w.ts > a.ts OR (w.ts = a.ts AND w.seq >= a.seq)) WHERE rn = 1 GROUP BY entity_type, id),
{name} AS (
  SELECT a.entity_type, a.id, a.src, a.dst, coalesce(v.attributes, '') AS attributes
  FROM {name}_alive a LEFT JOIN {name}_values v ON a.entity_type = v.entity_type AND a.id = v.id)
"""


def lives(log: str, name: str = "lives") -> str:
    """Subquery with the lives of each entity; an open one has no valid_to."""
    return f"""
{name} AS (
  SELECT entity_type, id, src, dst, seq, ts AS valid_from, next_ts AS valid_to FROM (
    SELECT *, lead(ts) OVER (PARTITION BY entity_type, id ORDER BY ts, seq) AS next_ts
    FROM {log} WHERE action <> 'UPDATE') WHERE action = 'CREATE')
"""


def intervals(log: str, name: str = "intervals") -> str:
    """Subquery with a row per CREATE or UPDATE of a log without entries for the dead."""
    return f"""
{name} AS (
  SELECT entity_type, id, src, dst, seq, ts AS valid_from, next_ts AS valid_to, attributes FROM (
    SELECT *, lead(ts) OVER (PARTITION BY entity_type, id ORDER BY ts, seq) AS next_ts FROM {log})
  WHERE action <> 'DELETE')
"""


def values_over_time(log: str, name: str = "facts") -> str:
    """Subquery with lives (key '') and attribute values over time."""
    return f"""
{lives(log, f"{name}_lives")},
{name}_ends AS (
  SELECT entity_type, id, seq, action,
         min(CASE WHEN action <> 'UPDATE' THEN ts END) OVER (
           PARTITION BY entity_type, id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS life_end
  FROM {log}),
{name} AS (
  SELECT entity_type, id, '' AS key, '' AS value, valid_from, valid_to, seq FROM {name}_lives
  UNION ALL
  SELECT w.entity_type, w.id, w.key, w.value, w.ts,
         least(lead(w.ts) OVER (PARTITION BY w.entity_type, w.id, w.key ORDER BY w.ts, w.seq), e.life_end), w.seq
  FROM {log}_writes w JOIN {name}_ends e ON e.entity_type = w.entity_type AND e.id = w.id AND e.seq = w.seq)
"""
