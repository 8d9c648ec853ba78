"""The interval model and the snapshot model, their queries, and the parameter sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changelog as cl
from ..operators import measures as ms
from ..operators import snapshots as sn
from ..operators import topology as tp
from ..operators import validity as vl
from ..plans import sweeps
from ..plans.temporal_graph import IntervalGraph, SnapshotGraph
from ..sources import samples, store
from ..storage import new_path
from . import sql as q
from .logs import edges, nations, users
from .registry import query

_DAY = 86_400
_T, _OT = f"TIMESTAMP '{q.USERS_T}'", f"TIMESTAMP '{q.ORDERS_T}'"
_LO, _HI = (f"TIMESTAMP '{t}'" for t in q.USERS_SPAN)
_OLO, _OHI = (f"TIMESTAMP '{t}'" for t in q.ORDERS_SPAN)
_STATE = ["entity_type", "id", "attributes"]


def saved(spark, model):
    """A model as it answers once it is stored."""
    path = new_path(spark, "model")
    model.save(path)
    return type(model).load(spark, path)


def _state(df, *columns):
    return cl.flat(df).select(*(columns or _STATE))


# -- building ----------------------------------------------------------------


@query(
    f"WITH {q.USERS}, {q.intervals('users')} SELECT entity_type, id, valid_from, valid_to, seq, attributes FROM intervals"
)
def validity_intervals(spark, sf):
    rows = cl.flat(vl.validity_intervals(users(spark, sf)))
    return rows.select("entity_type", "id", "valid_from", "valid_to", "seq", "attributes")


@query(
    f"WITH {q.NATION_EDGES}, {q.intervals('edges')} SELECT id, src, dst, valid_from, valid_to, seq, attributes FROM intervals"
)
def edge_intervals(spark, sf):
    rows = cl.flat(vl.validity_intervals(edges(spark, sf)))
    return rows.select("id", "src", "dst", "valid_from", "valid_to", "seq", "attributes")


def _facts(df):
    return df.select(
        "entity_type",
        "id",
        F.coalesce("key", F.lit("")).alias("key"),
        F.coalesce("value", F.lit("")).alias("value"),
        "valid_from",
        "valid_to",
        "seq",
    )


@query(f"WITH {q.USERS}, {q.values_over_time('users')} SELECT * FROM facts")
def attribute_intervals(spark, sf):
    return _facts(vl.attribute_intervals(users(spark, sf)))


@query(f"WITH {q.NATIONS}, {q.values_over_time('nations')} SELECT * FROM facts")
def attribute_intervals_with_ties(spark, sf):
    return _facts(vl.attribute_intervals(nations(spark, sf)))


@query(f"WITH {q.NATIONS}, {q.state('nations')} SELECT entity_type, id, attributes FROM state")
def create_graph_from_logs(spark, sf):
    return _state(cl.create_graph_from_logs(nations(spark, sf)))


_MID = "2024-01-08 00:00:00"


@query(f"WITH {q.USERS}, {q.state('users', q.USERS_T)} SELECT entity_type, id, attributes FROM state")
def apply_vertex_logs(spark, sf):
    log = users(spark, sf)
    later = log.where((F.col("ts") > F.lit(_MID).cast("timestamp_ntz"))).where(
        F.col("ts") <= F.lit(q.USERS_T).cast("timestamp_ntz")
    )
    return _state(cl.apply_vertex_logs(cl.state_at(log, _MID), later))


@query(f"WITH {q.NATION_EDGES}, {q.state('edges', q.ORDERS_T)} SELECT id, src, dst, attributes FROM state")
def apply_edge_logs(spark, sf):
    log = edges(spark, sf)
    middle = F.lit("1997-03-01").cast("timestamp_ntz")
    later = log.where((F.col("ts") > middle) & (F.col("ts") <= F.lit(q.ORDERS_T).cast("timestamp_ntz")))
    return _state(cl.apply_edge_logs(cl.state_at(log, "1997-03-01"), later), "id", "src", "dst", "attributes")


# Each window of the user log as one row per live user. Both attributes are set by
# every entry, so a plain interval holds a whole state.
def _windows_sql(at: str, width: str, last: str) -> str:
    return f"""
placed AS (SELECT *, {at} AS place FROM users),
held AS (SELECT * FROM (SELECT *, lead(place) OVER (PARTITION BY id ORDER BY ts, seq) AS until FROM placed)
  WHERE action <> 'DELETE'),
windows AS (SELECT CAST(i AS BIGINT) AS snapshot_no, (i + 1) * {width} AS stop FROM range({last} + 1) r(i)),
snapshots AS (SELECT snapshot_no, entity_type, id, attributes FROM held JOIN windows
  ON place < stop AND (until IS NULL OR until >= stop))"""


_BY_TIME = _windows_sql(
    "epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM users)",
    f"{q.DAY_MICROS}",
    f"(SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) // {q.DAY_MICROS} FROM users)",
)
_BY_COUNT = _windows_sql(
    "row_number() OVER (ORDER BY ts, seq) - 1", "1000", "(SELECT (count(*) - 1) // 1000 FROM users)"
)


def user_snapshots_by_time(spark, sf):
    return sn.snapshots_by_time(users(spark, sf), _DAY)


def user_snapshots_by_count(spark, sf):
    return sn.snapshots_by_count(users(spark, sf), 1000)


@query(f"WITH {q.USERS}, {_BY_TIME} SELECT * FROM snapshots")
def snapshots_by_time(spark, sf):
    return _state(user_snapshots_by_time(spark, sf).states, "snapshot_no", *_STATE)


@query(f"WITH {q.USERS}, {_BY_COUNT} SELECT * FROM snapshots")
def snapshots_by_count(spark, sf):
    # The attributes become text once per run, not again in every snapshot through which a state stands.
    runs = cl.flat(sn.runs_of(user_snapshots_by_count(spark, sf)))
    return sn.each_snapshot(runs).select("snapshot_no", *_STATE)


_INDEX_COUNT = f"""
{_BY_COUNT},
index_rows AS (SELECT CAST(place // 1000 AS BIGINT) AS snapshot_no, ts AS snapshot_ts, seq AS snapshot_seq
  FROM placed WHERE place % 1000 = 999 OR place = (SELECT count(*) - 1 FROM users))"""
_INDEX_TIME = f"""
{_BY_TIME},
index_rows AS (SELECT snapshot_no,
    make_timestamp((SELECT min(epoch_us(ts)) FROM users) + CAST(stop AS BIGINT) - 1) AS snapshot_ts FROM windows)"""


@query(f"WITH {q.USERS}, {_INDEX_COUNT} SELECT * FROM index_rows")
def snapshot_index_by_count(spark, sf):
    return user_snapshots_by_count(spark, sf).index


@query(f"WITH {q.USERS}, {_INDEX_TIME} SELECT * FROM index_rows")
def snapshot_index_by_time(spark, sf):
    return user_snapshots_by_time(spark, sf).index.select("snapshot_no", "snapshot_ts")


@query(
    f"WITH {q.USERS}, {_INDEX_COUNT} SELECT * FROM index_rows WHERE snapshot_ts <= {_T} ORDER BY snapshot_no DESC LIMIT 1"
)
def latest_snapshot_before(spark, sf):
    return sn.latest_snapshot_before(user_snapshots_by_count(spark, sf).index, q.USERS_T)


@query(
    f"WITH {q.USERS}, {_INDEX_COUNT} SELECT * FROM index_rows "
    f"ORDER BY abs(epoch_us(snapshot_ts) - epoch_us({_T})), snapshot_no LIMIT 1"
)
def closest_snapshot(spark, sf):
    return sn.closest_snapshot(user_snapshots_by_count(spark, sf).index, q.USERS_T)


@query(f"WITH {q.USERS}, {_BY_COUNT} SELECT * FROM snapshots")
def save_snapshots(spark, sf):
    path = new_path(spark, "snapshots")
    store.save_snapshots(user_snapshots_by_count(spark, sf), path)
    return _state(store.load_snapshots(spark, path).states, "snapshot_no", *_STATE)


def _parts_sql(parts: int) -> str:
    """Rows of the states of so many snapshots of the users' log, one more if the last is not full."""
    every = f"greatest((SELECT count(*) FROM users) // {parts}, 1)"
    windows = _windows_sql("row_number() OVER (ORDER BY ts, seq) - 1", every, f"(SELECT (count(*) - 1) // {every} FROM users)")
    return (
        f"SELECT '{parts} snapshots' AS model, 'snapshots' AS part, count(*) AS rows, count(*) * 2 AS attribute_entries "
        f"FROM (WITH {windows} SELECT * FROM snapshots) UNION ALL SELECT '{parts} snapshots', 'log', count(*), "
        "CAST(2 * sum(CASE WHEN action <> 'DELETE' THEN 1 ELSE 0 END) AS BIGINT) FROM users"
    )


@query(f"""
WITH {q.USERS}, {q.values_over_time('users')}
SELECT 'intervals' AS model, 'intervals' AS part, count(*) AS rows, count(*) FILTER (WHERE key <> '') AS attribute_entries FROM facts
UNION ALL {_parts_sql(10)} UNION ALL {_parts_sql(100)}""")
def storage_comparison(spark, sf):
    """What a log takes as intervals and with 10 and 100 snapshots, read back from what is stored."""
    log = users(spark, sf)
    entries, numbers = log.count(), (10, 100)
    graphs = SnapshotGraph.each_from_log(log, [max(entries // n, 1) for n in numbers])
    models = {f"{n} snapshots": saved(spark, graph).model for n, graph in zip(numbers, graphs)}
    return ms.storage_comparison(saved(spark, IntervalGraph.from_log(log)).intervals, models)


# -- state at a time ---------------------------------------------------------


@query(f"WITH {q.USERS}, {q.state('users', q.USERS_T)} SELECT entity_type, id, attributes FROM state")
def snapshot_validity(spark, sf):
    return _state(saved(spark, IntervalGraph.from_log(users(spark, sf))).snapshot_at_time(q.USERS_T))


@query(
    f"WITH {q.NATIONS}, {q.intervals('nations')} SELECT entity_type, id, attributes FROM intervals "
    f"WHERE valid_from <= {_OT} AND (valid_to IS NULL OR {_OT} < valid_to)"
)
def snapshot_validity_replace(spark, sf):
    return _state(IntervalGraph.from_log(nations(spark, sf), "replace").snapshot_at_time(q.ORDERS_T))


@query(f"WITH {q.NATIONS}, {q.state('nations', q.ORDERS_T)} SELECT entity_type, id, attributes FROM state")
def snapshot_validity_merge(spark, sf):
    return _state(saved(spark, IntervalGraph.from_log(nations(spark, sf))).snapshot_at_time(q.ORDERS_T))


@query(
    f"WITH {q.USERS}, {q.intervals('users')} SELECT id, valid_from, valid_to, seq, attributes FROM intervals "
    f"WHERE valid_from < {_T} AND (valid_to IS NULL OR {_T} <= valid_to)"
)
def snapshot_validity_left_open(spark, sf):
    rows = vl.snapshot_validity_left_open(vl.validity_intervals(users(spark, sf)), q.USERS_T)
    return _state(rows, "id", "valid_from", "valid_to", "seq", "attributes")


@query(f"WITH {q.USERS}, {q.state('users', q.USERS_T)} SELECT entity_type, id, attributes FROM state")
def snapshot_delta(spark, sf):
    return _state(saved(spark, SnapshotGraph(user_snapshots_by_count(spark, sf))).snapshot_at_time(q.USERS_T))


@query(f"WITH {q.NATIONS}, {q.state('nations', q.ORDERS_T)} SELECT entity_type, id, attributes FROM state")
def snapshot_delta_with_ties(spark, sf):
    model = saved(spark, SnapshotGraph.from_log(nations(spark, sf), every_actions=777))
    return _state(model.snapshot_at_time(q.ORDERS_T))


@query(f"WITH {q.NATION_EDGES}, {q.state('edges', q.ORDERS_T)} SELECT id, src, dst, attributes FROM state")
def snapshot_delta_by_time(spark, sf):
    model = saved(spark, SnapshotGraph.from_log(edges(spark, sf), every_seconds=90 * _DAY))
    return _state(model.snapshot_at_time(q.ORDERS_T), "id", "src", "dst", "attributes")


@query(f"WITH {q.NATION_EDGES}, {q.state('edges', q.ORDERS_T)} SELECT id, src, dst, attributes FROM state")
def snapshot_nearest(spark, sf):
    """The state of the edges out of a later snapshot: of windows of 270 days, in whose second half the time asked lies."""
    model = saved(spark, SnapshotGraph.from_log(edges(spark, sf), every_seconds=270 * _DAY, backward=True))
    return _state(model.snapshot_at_time(q.ORDERS_T), "id", "src", "dst", "attributes")


_NATIONS_BACK = "1998-05-20 00:00:00"


@query(f"WITH {q.NATIONS}, {q.state('nations', _NATIONS_BACK)} SELECT entity_type, id, attributes FROM state")
def snapshot_nearest_with_ties(spark, sf):
    """All nations go back from the state after the last entry."""
    log = nations(spark, sf)
    model = saved(spark, SnapshotGraph.from_log(log, every_actions=1_000_000_000, backward=True))
    return _state(model.snapshot_at_time(_NATIONS_BACK))


@query(f"WITH {q.USERS}, {q.state('users')} SELECT id, attributes FROM state")
def current_graph(spark, sf):
    return cl.flat(IntervalGraph.from_log(users(spark, sf)).current_graph().vertices)


# -- one entity --------------------------------------------------------------

_ONE_USER = f"WITH {q.USERS}, {q.state('users', q.USERS_T)} SELECT entity_type, id, attributes FROM state WHERE id = 7"


@query(_ONE_USER)
def vertex_at_validity(spark, sf):
    return _state(vl.vertex_at_validity(vl.attribute_intervals(users(spark, sf)), 7, q.USERS_T))


@query(
    f"WITH {q.NATION_EDGES}, {q.state('edges', q.ORDERS_T)} SELECT id, src, dst, attributes FROM state "
    "WHERE id = (SELECT min(id) FROM state)"
)
def edge_at_validity(spark, sf):
    """The edge with the smallest id of those that are alive."""
    intervals = samples.kept(spark, sf, "edge-values", lambda s, d: vl.attribute_intervals(edges(s, d)))
    alive = vl.snapshot_validity(intervals, q.ORDERS_T).agg(F.min("id")).first()[0]
    rows = vl.edge_at_validity(intervals, -1 if alive is None else alive, q.ORDERS_T)
    return _state(rows, "id", "src", "dst", "attributes")


@query(_ONE_USER)
def entity_at_delta(spark, sf):
    model = saved(spark, SnapshotGraph(user_snapshots_by_count(spark, sf)))
    return _state(model.entity_at_time("VERTEX", 7, q.USERS_T))


@query(_ONE_USER)
def entity_at_delta_unmaterialised(spark, sf):
    return _state(sn.entity_at_delta_unmaterialised(users(spark, sf), "VERTEX", 7, q.USERS_T))


# -- neighbours and activation -----------------------------------------------

_NEIGHBOURS = f"""
WITH {q.NATION_EDGES}, {q.lives('edges')}
SELECT DISTINCT CASE WHEN dst = 3 THEN src ELSE dst END AS id FROM lives
WHERE (src = 3 OR dst = 3) AND valid_from <= {_OHI} AND (valid_to IS NULL OR valid_to >= {_OLO})"""


@query(_NEIGHBOURS)
def neighbours_validity(spark, sf):
    return saved(spark, IntervalGraph.from_log(edges(spark, sf))).direct_neighbours(3, *q.ORDERS_SPAN)


@query(_NEIGHBOURS)
def neighbours_delta(spark, sf):
    model = saved(spark, SnapshotGraph.from_log(edges(spark, sf), every_seconds=90 * _DAY))
    return model.direct_neighbours(3, *q.ORDERS_SPAN)


@query(_NEIGHBOURS)
def neighbours_from_lives(spark, sf):
    """From a model that is not stored: all lives are looked through."""
    return vl.neighbours_validity(vl.attribute_intervals(edges(spark, sf)), 3, *q.ORDERS_SPAN)


@query(_NEIGHBOURS)
def neighbours_from_log(spark, sf):
    return sn.neighbours_delta(edges(spark, sf), 3, *q.ORDERS_SPAN)


def _first_sql(log: str, ctes: str, lo: str, hi: str, columns: str = "id") -> str:
    return f"""
WITH {ctes}, firsts AS (SELECT entity_type, id, min(ts) AS first FROM {log} WHERE action = 'CREATE' GROUP BY entity_type, id)
SELECT {columns} FROM firsts WHERE first >= {lo} AND first <= {hi}"""


@query(_first_sql("users", q.USERS, "TIMESTAMP '2024-01-02'", _T))
def activated_vertices_validity(spark, sf):
    return vl.activated_vertices_validity(vl.attribute_intervals(users(spark, sf)), "2024-01-02", q.USERS_T)


@query(_first_sql("edges", q.NATION_EDGES, _OLO, _OHI))
def activated_edges_validity(spark, sf):
    return vl.activated_edges_validity(vl.attribute_intervals(edges(spark, sf)), *q.ORDERS_SPAN)


@query(_first_sql("users", q.USERS, "TIMESTAMP '2024-01-02'", _T))
def activated_vertices_delta(spark, sf):
    return sn.activated_vertices_delta(users(spark, sf), "2024-01-02", q.USERS_T)


@query(_first_sql("edges", q.NATION_EDGES, _OLO, _OHI))
def activated_edges_delta(spark, sf):
    return sn.activated_edges_delta(edges(spark, sf), *q.ORDERS_SPAN)


_NET_CREATE = f"""
WITH {q.USERS}, lifecycle AS (
  SELECT entity_type, id, action, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) AS rn
  FROM users WHERE action <> 'UPDATE' AND ts >= {_LO} AND ts <= {_HI})
SELECT entity_type, id FROM lifecycle WHERE rn = 1 AND action = 'CREATE'"""


@query(_NET_CREATE)
def activated_net_create_validity(spark, sf):
    return IntervalGraph.from_log(users(spark, sf)).activated_entities(*q.USERS_SPAN, mode="net_create")


@query(_NET_CREATE)
def activated_net_create_delta(spark, sf):
    return sn.activated_delta(users(spark, sf), *q.USERS_SPAN, mode="net_create")


_BOTH_LOGS = f"{q.USERS}, {q.NATION_EDGES}, entries AS (SELECT entity_type, id, ts, action FROM users UNION ALL SELECT entity_type, id, ts, action FROM edges)"


@query(_first_sql("entries", _BOTH_LOGS, "TIMESTAMP '1998-06-01'", _T, "entity_type, id"))
def activated_entities(spark, sf):
    log = users(spark, sf).unionByName(edges(spark, sf))
    return IntervalGraph.from_log(log).activated_entities("1998-06-01", q.USERS_T)


@query(f"""
WITH {q.USERS}, {q.lives('users')}, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY valid_from, seq) AS rn FROM lives)
SELECT entity_type, id, valid_from, valid_to, seq FROM firsts WHERE rn = 1""")
def earliest_payload(spark, sf):
    rows = vl.earliest_payload(vl.attribute_intervals(users(spark, sf)))
    return rows.select("entity_type", "id", "valid_from", "valid_to", "seq")


# -- sweeps ------------------------------------------------------------------


_OFFSETS = tuple(range(-50, 901, 50))


@query(f"""
WITH {q.USERS}, {q.lives('users')},
places AS (SELECT ts, row_number() OVER (ORDER BY ts, seq) - 1 AS place, count(*) OVER () AS n FROM users),
asked AS (SELECT CAST(o AS INTEGER) AS "offset", ts FROM places JOIN (VALUES {", ".join(f"({o})" for o in _OFFSETS)}) v(o)
  ON place = n // 2 // 1000 * 1000 - 1 + o)
SELECT "offset", (SELECT count(*) FROM lives WHERE valid_from <= asked.ts AND (valid_to IS NULL OR valid_to > asked.ts)) AS found
FROM asked""")
def q5_snapshot_near_materialisation(spark, sf):
    return sweeps.snapshot_near_materialisation(users(spark, sf), 1000, _OFFSETS)


def _share_sql(log: str, firsts: str) -> str:
    return f"""
places AS (SELECT ts, row_number() OVER (ORDER BY ts, seq) - 1 AS place, count(*) OVER () AS n FROM {log}),
shares AS (SELECT CAST(i AS INTEGER) AS iteration, ts FROM range(21) r(i) JOIN places ON place = n // 21 * i),
firsts AS ({firsts})
SELECT model, iteration, (SELECT count(*) FROM firsts WHERE first <= shares.ts) AS found
FROM shares, (VALUES ('intervals'), ('snapshots')) m(model)"""


@query(
    f"WITH {q.NATION_EDGES},"
    + _share_sql(
        "edges",
        "SELECT CASE WHEN dst = 7 THEN src ELSE dst END AS id, min(ts) AS first FROM edges "
        "WHERE action = 'CREATE' AND (src = 7 OR dst = 7) GROUP BY 1",
    )
)
def q7_neighbours_by_share(spark, sf):
    return sweeps.neighbours_by_share(edges(spark, sf), 7)


@query(
    f"WITH {q.NATION_EDGES},"
    + _share_sql("edges", "SELECT id, min(ts) AS first FROM edges WHERE action = 'CREATE' GROUP BY id")
)
def q8_activated_by_share(spark, sf):
    return sweeps.activated_by_share(edges(spark, sf))


@query(f"""
WITH {q.NATION_CONTACTS}, {q.sessions(30)}, {q.EDGE_LOG},
ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM sessions UNION ALL SELECT dst, 0, 1 FROM sessions),
sums AS (SELECT id, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM ends GROUP BY id HAVING sum(o) > 0 AND sum(i) > 0),
ranked AS (SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS place, count(*) OVER () AS n FROM sums),
chosen AS (SELECT DISTINCT id, degree FROM ranked JOIN range(20) r(i) ON place = CAST(floor(i / 20 * (n - 1)) AS BIGINT)),
pairs AS (SELECT src AS id, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges)
SELECT model, id, degree, count(*) AS found FROM chosen JOIN pairs USING (id), (VALUES ('intervals'), ('snapshots')) m(model)
GROUP BY model, id, degree""")
def q1_neighbours_by_degree(spark, sf):
    sessions = tp.merge_contacts(samples.nation_contacts(spark, sf), 30 * _DAY)
    return sweeps.neighbours_by_degree(edges(spark, sf), sessions)


_SPACINGS = (100, 200, 300, 400, 500)


@query(f"""
WITH {q.USERS}, {q.state('users', q.USERS_T)}
SELECT CAST(s AS INTEGER) AS spacing, (SELECT count(*) FROM state WHERE id = 7) AS found
FROM (VALUES {", ".join(f"({s})" for s in _SPACINGS)}) v(s)""")
def entity_by_spacing(spark, sf):
    return sweeps.entity_by_spacing(users(spark, sf), "VERTEX", 7, _SPACINGS, q.USERS_T)


# -- timings -----------------------------------------------------------------

_TIMINGS = """timings AS (SELECT l_returnflag || '-' || l_linestatus AS file, l_linestatus AS function,
  CAST(l_quantity AS BIGINT) AS n_logs, l_extendedprice AS value FROM lineitem)"""


@query(f"WITH {_TIMINGS} SELECT file, round(regr_slope(value, n_logs) / max(value) * 1e6, 4) AS slope FROM timings GROUP BY file")
def scaling_slope(spark, sf):
    slopes = ms.scaling_slope(samples.timings(spark, sf))
    return slopes.select("file", F.round(F.col("slope") * 1e6, 4).alias("slope"))


@query(f"WITH {_TIMINGS} SELECT function, round(avg(value), 4) AS mean_value, count(*) AS runs FROM timings GROUP BY function")
def mean_runtime(spark, sf):
    return ms.mean_runtime(samples.timings(spark, sf)).withColumn("mean_value", F.round("mean_value", 4))
