"""Synthetic change logs over the supplied contacts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import changelog as cl
from ..operators import growing as gr
from ..operators import synthesis as sy
from ..operators import topology as tp
from ..plans import sweeps
from ..sources import samples, store
from ..storage import work_dir
from . import sql as q
from .logs import edges, users
from .registry import query

_LOGNORMAL = sy.Distribution("lognormal", 1, 0.4)
_UNIFORM = sy.Distribution("uniform", 1, 8)
_GAUSSIAN = sy.Distribution("gaussian", 4, 2)
_ZIPF = sy.Distribution("zipf", 50, 1.5)


def _unit(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _normal(seed: int, key: str) -> str:
    u, v = _unit(f"'{seed}|' || {key}"), _unit(f"'{seed}|' || {key} || '|angle'")
    return f"(sqrt(-2.0 * ln(1.0 - {u})) * cos({2 * 3.141592653589793} * {v}))"


def draw_sql(d: sy.Distribution, key: str, seed: int = 0) -> str:
    """The draw of a row as an expression."""
    if d.kind == "uniform":
        x = f"{d.first}::DOUBLE + {_unit(f"'{seed}|' || {key}")} * {d.second - d.first}::DOUBLE"
    elif d.kind == "gaussian":
        x = f"{d.first}::DOUBLE + {_normal(seed, key)} * {d.second}::DOUBLE"
    else:
        x = f"exp({d.first}::DOUBLE + {_normal(seed, key)} * {d.second}::DOUBLE)"
    return f"CAST(trunc({x}) AS BIGINT)"


def _draws(spark, sf, distribution):
    customers = samples.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return sy.draw_counts(customers, ["id"], distribution)


@query(f"SELECT c_custkey AS id, {draw_sql(_LOGNORMAL, 'c_custkey')} AS updates FROM customer")
def draw_counts_lognormal(spark, sf):
    return _draws(spark, sf, _LOGNORMAL)


@query(f"SELECT c_custkey AS id, {draw_sql(_GAUSSIAN, 'c_custkey')} AS updates FROM customer")
def draw_counts_gaussian(spark, sf):
    return _draws(spark, sf, _GAUSSIAN)


@query(f"SELECT c_custkey AS id, {draw_sql(sy.scaled_distribution(_UNIFORM, 3), 'c_custkey')} AS updates FROM customer")
def draw_counts_uniform_scaled(spark, sf):
    return _draws(spark, sf, sy.scaled_distribution(_UNIFORM, 3))


@query(f"""
WITH weights AS (SELECT k, pow(k, -1.5) AS w FROM range(1, 51) r(k)),
cumulated AS (SELECT k, sum(w) OVER (ORDER BY k) / (SELECT sum(w) FROM weights) AS high FROM weights),
draws AS (SELECT c_custkey AS id, {_unit("'0|' || c_custkey")} AS u FROM customer)
SELECT id, CAST(least(1 + (SELECT count(*) FROM cumulated WHERE high <= u), 50) AS BIGINT) AS updates FROM draws""")
def draw_counts_zipf(spark, sf):
    return _draws(spark, sf, _ZIPF)


_LARGE_ZIPF = sy.Distribution("zipf", 1_500_000, 0.75)


@query(f"""
WITH weights AS (SELECT k, pow(k::DOUBLE, -0.75) AS w FROM range(1, 1500001) r(k)),
cumulated AS (SELECT k, (sum(w) OVER (ORDER BY k) - w) / (SELECT sum(w) FROM weights) AS low FROM weights),
draws AS (SELECT c_custkey AS id, {_unit("'0|' || c_custkey")} AS u FROM customer)
SELECT id, CAST(k AS BIGINT) AS updates FROM draws ASOF JOIN cumulated ON u >= low""")
def draw_counts_zipf_large(spark, sf):
    """A maximum above a million."""
    return _draws(spark, sf, _LARGE_ZIPF)


def _sessions(spark, sf):
    return tp.with_edge_ids(tp.merge_contacts(samples.nation_contacts(spark, sf), 30 * samples.DAY))


def _vertices(spark, sf):
    return samples.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))


def _order_sql(mode: str, weight: str, key: str, seed: int) -> str:
    hashed = f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 15) AS BIGINT)"
    return {"positive": f"{weight}, {key}", "negative": f"{weight} DESC, {key}", "uniform": f"{hashed}, {key}"}[mode]


def _updates_sql(mode: str, d: sy.Distribution = _LOGNORMAL) -> str:
    order, edge_order = _order_sql(mode, "degree", "id", 0), _order_sql(mode, "weight", "edge_id", 1)
    return f"""{q.NATION_CONTACTS}, {q.sessions(30)},
ends AS (SELECT src AS id FROM sessions UNION ALL SELECT dst FROM sessions),
weighted AS (SELECT CAST(n_nationkey AS BIGINT) AS id, (SELECT count(*) FROM ends WHERE ends.id = n_nationkey) AS degree FROM nation),
vertex_rank AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM weighted),
vertex_draw AS (SELECT updates, row_number() OVER (ORDER BY updates, id) AS place
  FROM (SELECT id, {draw_sql(d, 'id')} AS updates FROM weighted)),
vertex_updates AS (SELECT id, degree, updates FROM vertex_rank JOIN vertex_draw USING (place)),
edge_weight AS (SELECT s.edge_id, s.src, s.dst, s.valid_from, s.valid_to,
    CAST(coalesce(a.updates, 0) + coalesce(b.updates, 0) AS BIGINT) AS weight
  FROM sessions s LEFT JOIN vertex_updates a ON a.id = s.src LEFT JOIN vertex_updates b ON b.id = s.dst),
edge_rank AS (SELECT *, row_number() OVER (ORDER BY {edge_order}) AS place FROM edge_weight),
edge_draw AS (SELECT updates, row_number() OVER (ORDER BY updates, edge_id) AS place
  FROM (SELECT edge_id, {draw_sql(d, 'edge_id', 1)} AS updates FROM sessions)),
edge_updates AS (SELECT edge_id, src, dst, valid_from, valid_to, weight, updates FROM edge_rank JOIN edge_draw USING (place))"""


@query(f"WITH {_updates_sql('positive')} SELECT id, degree, updates FROM vertex_updates")
def assign_vertex_updates(spark, sf):
    return sy.assign_vertex_updates(_vertices(spark, sf), _sessions(spark, sf), _LOGNORMAL)


@query(f"WITH {_updates_sql('negative')} SELECT id, degree, updates FROM vertex_updates")
def assign_vertex_updates_negative(spark, sf):
    return sy.assign_vertex_updates(_vertices(spark, sf), _sessions(spark, sf), _LOGNORMAL, "negative")


@query(f"WITH {_updates_sql('positive')} SELECT edge_id, weight FROM edge_weight")
def endpoint_weight(spark, sf):
    edges = _sessions(spark, sf)
    updates = sy.assign_vertex_updates(_vertices(spark, sf), edges, _LOGNORMAL)
    return sy.endpoint_weight(edges, updates).select("edge_id", "weight")


@query(f"WITH {_updates_sql('negative')} SELECT edge_id, weight, updates FROM edge_updates")
def assign_edge_updates(spark, sf):
    _, edges = sy.assign_updates(_vertices(spark, sf), _sessions(spark, sf), _LOGNORMAL, "negative")
    return edges.select("edge_id", "weight", "updates")


def _generate(spark, sf, distribution, mode):
    edges = samples.kept(spark, sf, "nation_sessions", _sessions)
    return sy.expand_changelog(*sy.assign_updates(_vertices(spark, sf), edges, distribution, mode))


def _root(spark, sf):
    """Where the logs generated from a folder of tables are kept for the session."""
    return f"{work_dir(spark)}/generated-{hashlib.md5(sf.encode()).hexdigest()}"


def generated_log(spark, sf, distribution=_LOGNORMAL, mode="positive"):
    path = store.changelog_path(_root(spark, sf), "nations", distribution, mode)
    return store.load_or_generate_changelog(spark, path, lambda: _generate(spark, sf, distribution, mode))


def _generated_sql(mode: str, d: sy.Distribution = _LOGNORMAL) -> str:
    """generated(seq, ts, action, entity_type, id, src, dst, k), the log of a mode and distribution."""
    return f"""{_updates_sql(mode, d)},
vertex_firsts AS (SELECT id, updates, 1.0::DOUBLE - pow(1.0::DOUBLE - {_unit("'0|' || id || '|first'")}, 1.0::DOUBLE / updates) AS first
  FROM vertex_updates WHERE updates > 0),
vertex_entries AS (SELECT 'VERTEX' AS entity_type, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, k, CAST(trunc(1000 * CASE WHEN k = 0 THEN first
    ELSE first + {_unit("'0|' || id || '|' || k")} * (1.0::DOUBLE - first) END) AS BIGINT) AS second
  FROM (SELECT *, unnest(range(updates)) AS k FROM vertex_firsts)),
edge_places AS (SELECT edge_id AS id, src, dst, updates AS n, epoch_us(valid_from) // 1000000 AS a, epoch_us(valid_to) // 1000000 AS z,
    unnest(range(0, greatest(updates, 0) + 2)) AS k FROM edge_updates),
edge_entries AS (SELECT 'EDGE' AS entity_type, id, src, dst, CASE WHEN k = 0 THEN a WHEN k = greatest(n, 0) + 1 THEN z
    ELSE a + CAST(trunc({_unit("'0|edge|' || id || '|' || k")} * (z - a)) AS BIGINT) END AS second,
    CASE WHEN k = 0 THEN 'CREATE' WHEN k = greatest(n, 0) + 1 THEN 'DELETE' ELSE 'UPDATE' END AS action, k FROM edge_places),
entries AS (SELECT entity_type, id, src, dst, second, CASE WHEN k = 0 THEN 'CREATE' ELSE 'UPDATE' END AS action, k FROM vertex_entries
  UNION ALL SELECT entity_type, id, src, dst, second, action, k FROM edge_entries),
generated AS (
  SELECT row_number() OVER (ORDER BY second, CASE action WHEN 'CREATE' THEN 0 WHEN 'UPDATE' THEN 1 ELSE 2 END, entity_type, id, k) - 1 AS seq,
    to_timestamp(second) AT TIME ZONE 'UTC' AS ts, action, entity_type, id, src, dst, k
  FROM entries)"""


@query(
    f"WITH {_generated_sql('positive')} SELECT seq, ts, action, entity_type, id, "
    "CASE WHEN action = 'DELETE' THEN '' ELSE 'update=' || k END AS attributes FROM generated"
)
def expand_changelog(spark, sf):
    return cl.flat(generated_log(spark, sf)).select("seq", "ts", "action", "entity_type", "id", "attributes")


# Settings of the sweeps against log size: five iterations of a log over the customers and suppliers, each longer.
_ITERATIONS = 5
_VERTEX = 10_000_007
_GAP = 1095


def _trade_edges(spark, sf):
    return tp.with_edge_ids(tp.merge_contacts(samples.trade_contacts(spark, sf), _GAP * samples.DAY))


def _generate_growing(spark, sf, distribution, mode):
    edges = samples.kept(spark, sf, "trade_edges", _trade_edges)
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return gr.growing_log(*gr.growing_updates(vertices, edges, distribution, mode, _ITERATIONS), _ITERATIONS)


def _base_sql(d: sy.Distribution, key: str, seed: int) -> str:
    return _unit(f"'{seed}|' || {key}") if d.kind == "uniform" else _normal(seed, key)


def _counts_sql(d: sy.Distribution) -> str:
    """n1, n2, ...: the draws of each iteration from the number z, never falling."""
    drawn = []
    for i in range(1, _ITERATIONS + 1):
        s = sy.scaled_distribution(d, i)
        x = f"{s.first}::DOUBLE + z * {s.second - s.first if s.kind == 'uniform' else s.second}::DOUBLE"
        drawn.append(f"CAST(trunc({f'exp({x})' if s.kind == 'lognormal' else x}) AS BIGINT)")
    return ", ".join(f"greatest(0, {', '.join(drawn[:i])}) AS n{i}" for i in range(1, _ITERATIONS + 1))


_SINCE = "CASE " + " ".join(f"WHEN n{i} > %s THEN {i}" for i in range(1, _ITERATIONS)) + f" ELSE {_ITERATIONS} END"


def _growing_sql(mode: str, d: sy.Distribution) -> str:
    """generated(seq, ts, action, entity_type, id, src, dst, k, iteration), the logs of all iterations."""
    order, edge_order = _order_sql(mode, "degree", "id", 0), _order_sql(mode, "weight", "edge_id", 1)
    several = "coalesce(" + ", ".join(f"CASE WHEN n{i} > 0 THEN n{i} END" for i in range(1, _ITERATIONS + 1)) + ")"
    return f"""{q.TRADE_CONTACTS}, {q.sessions(_GAP)},
ends AS (SELECT src AS id FROM sessions UNION ALL SELECT dst FROM sessions),
weighted AS (SELECT id, count(*) AS degree FROM ends GROUP BY id),
vertex_rank AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM weighted),
vertex_z AS (SELECT z, row_number() OVER (ORDER BY z, id) AS place FROM (SELECT id, {_base_sql(d, 'id', 0)} AS z FROM weighted)),
vertex_n AS (SELECT id, {_counts_sql(d)} FROM vertex_rank JOIN vertex_z USING (place)),
edge_weight AS (SELECT s.*, a.n1 + b.n1 AS weight FROM sessions s JOIN vertex_n a ON a.id = s.src JOIN vertex_n b ON b.id = s.dst),
edge_rank AS (SELECT *, row_number() OVER (ORDER BY {edge_order}) AS place FROM edge_weight),
edge_z AS (SELECT z, row_number() OVER (ORDER BY z, edge_id) AS place
  FROM (SELECT edge_id, {_base_sql(d, 'edge_id', 1)} AS z FROM sessions)),
edge_n AS (SELECT edge_id AS id, src, dst, epoch_us(valid_from) // 1000000 AS a, epoch_us(valid_to) // 1000000 AS z1, {_counts_sql(d)}
  FROM edge_rank JOIN edge_z USING (place)),
vertex_firsts AS (SELECT *, 1.0::DOUBLE - pow(1.0::DOUBLE - {_unit("'0|' || id || '|first'")}, 1.0::DOUBLE / {several}) AS first
  FROM vertex_n WHERE n{_ITERATIONS} > 0),
vertex_entries AS (SELECT 'VERTEX' AS entity_type, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, k, {_SINCE.replace('%s', 'k')} AS iteration,
    CAST(trunc(1000 * CASE WHEN k = 0 THEN first ELSE first + {_unit("'0|' || id || '|' || k")} * (1.0::DOUBLE - first) END) AS BIGINT) AS second,
    CASE WHEN k = 0 THEN 'CREATE' ELSE 'UPDATE' END AS action
  FROM (SELECT *, unnest(range(n{_ITERATIONS})) AS k FROM vertex_firsts)),
edge_updates AS (SELECT 'EDGE' AS entity_type, id, src, dst, k, {_SINCE.replace('%s', '(k - 1)')} AS iteration,
    a + CAST(trunc({_unit("'0|edge|' || id || '|' || k")} * (z1 - a)) AS BIGINT) AS second, 'UPDATE' AS action
  FROM (SELECT *, unnest(range(1, n{_ITERATIONS} + 1)) AS k FROM edge_n)),
entries AS (SELECT * FROM vertex_entries UNION ALL SELECT * FROM edge_updates
  UNION ALL SELECT 'EDGE', id, src, dst, 0, 1, a, 'CREATE' FROM edge_n
  UNION ALL SELECT 'EDGE', id, src, dst, 0, 1, z1, 'DELETE' FROM edge_n),
generated AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY second, CASE action WHEN 'CREATE' THEN 0 WHEN 'UPDATE' THEN 1 ELSE 2 END, entity_type, id, k) - 1 AS seq,
    to_timestamp(second) AT TIME ZONE 'UTC' AS ts, action, entity_type, id, src, dst, k, iteration
  FROM entries)"""


def _growing_log_path(spark, sf, distribution, mode):
    return store.changelog_path(_root(spark, sf), "trade", distribution, mode)


def _grid_sql(mode: str) -> str:
    counted = (
        f"WITH {_growing_sql(mode, _LOGNORMAL)} SELECT CAST(i AS INTEGER) AS iteration, action, count(*) AS entries "
        f"FROM range(1, {_ITERATIONS + 1}) r(i) JOIN generated ON iteration <= i GROUP BY ALL"
    )
    return f"SELECT '{mode}' AS mode, iteration, action, entries FROM ({counted})"


@query(" UNION ALL ".join(_grid_sql(mode) for mode in ("negative", "uniform")))
def persist_log_grid(spark, sf):
    """Sizes of the logs stored for two correlation modes and five iterations."""
    generate = lambda distribution, mode: _generate_growing(spark, sf, distribution, mode)
    modes = ("negative", "uniform")
    store.persist_log_grid(spark, _root(spark, sf), "trade", generate, _LOGNORMAL, modes, _ITERATIONS)
    # All logs of a mode are one stored table, so they are counted in one pass.
    tables = {mode: store.load_growing_runs(spark, _growing_log_path(spark, sf, _LOGNORMAL, mode)) for mode in modes}
    sizes = [gr.action_counts(table, _ITERATIONS).select(F.lit(mode).alias("mode"), "*") for mode, table in tables.items()]
    return sweeps.together(sizes)


def _growing_logs(spark, sf, settings):
    """Both stored models of each iteration of each setting (distribution, mode), by name and iteration."""
    logs = {}
    for name, (distribution, mode) in settings.items():
        path = _growing_log_path(spark, sf, distribution, mode)
        generate = lambda d=distribution, m=mode: _generate_growing(spark, sf, d, m)
        store.load_or_generate_growing_log(spark, path, generate, _ITERATIONS)
        for i, log in sweeps.growing_prepared(spark, path, f"{path}-models", _ITERATIONS).items():
            logs[f"{name}-{i}"] = log
    return logs


def _questions_sql(name: str, mode: str, d: sy.Distribution, half: str = "epoch") -> str:
    """log, model, entries, found, question: the four questions over all iterations of a setting."""
    begin = "0" if half == "epoch" else "low"
    return f"""SELECT '{name}-' || i AS log, model, entries, found, question FROM (
WITH {_growing_sql(mode, d)},
placed AS (SELECT i, seq, ts, row_number() OVER (PARTITION BY i ORDER BY seq) AS place, count(*) OVER (PARTITION BY i) AS n
  FROM range(1, {_ITERATIONS + 1}) r(i) JOIN generated ON iteration <= i),
asked AS (SELECT i, any_value(n) AS entries, any_value(ts) FILTER (WHERE place = n // 20) AS early,
  min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM placed GROUP BY i),
{q.lives('generated')},
born AS (SELECT entity_type, id, ts AS first, iteration FROM generated WHERE action = 'CREATE'),
alive AS (SELECT i, entity_type, id FROM asked JOIN lives ON valid_from <= early AND (valid_to IS NULL OR valid_to > early)
  JOIN born USING (entity_type, id) WHERE iteration <= i),
answers AS (
  SELECT i, 'neighbours' AS question, (SELECT count(DISTINCT CASE WHEN dst = {_VERTEX} THEN src ELSE dst END) FROM sessions
    WHERE src = {_VERTEX} OR dst = {_VERTEX}) AS found FROM asked
  UNION ALL SELECT i, 'snapshot', (SELECT count(*) FROM alive WHERE alive.i = asked.i) FROM asked
  UNION ALL SELECT i, 'entity', (SELECT count(*) FROM alive WHERE alive.i = asked.i AND entity_type = 'VERTEX' AND id = {_VERTEX}) FROM asked
  UNION ALL SELECT i, 'activated', (SELECT count(*) FROM born WHERE iteration <= asked.i
    AND epoch_us(first) <= {begin} + (high - {begin}) // 2) FROM asked)
SELECT i, entries, found, question, model FROM answers JOIN asked USING (i), (VALUES ('intervals'), ('snapshots')) m(model))"""


def _settings_sql(settings, question=None, half="epoch") -> str:
    rows = " UNION ALL ".join(_questions_sql(name, mode, d, half) for name, (d, mode) in settings.items())
    if question is None:
        return rows
    return f"SELECT log, model, entries, found FROM ({rows}) WHERE question = '{question}'"


_MODES = {mode: (_LOGNORMAL, mode) for mode in ("negative", "uniform", "positive")}
_KINDS = {d.kind: (d, "positive") for d in (_LOGNORMAL, _UNIFORM, _GAUSSIAN)}
_GROWING = {"lognormal": (_LOGNORMAL, "positive")}


@query(_settings_sql(_MODES))
def q9_correlation_modes(spark, sf):
    """The four questions over five growing logs generated with each correlation mode."""
    return sweeps.four_questions(_growing_logs(spark, sf, _MODES), _VERTEX)


@query(_settings_sql(_KINDS))
def q1_to_q4_distributions(spark, sf):
    """The four questions over five growing logs generated with each distribution."""
    return sweeps.four_questions(_growing_logs(spark, sf, _KINDS), _VERTEX)


@query(_settings_sql(_GROWING, "neighbours"))
def q1_neighbours_all_time(spark, sf):
    return sweeps.neighbours_all_time(_growing_logs(spark, sf, _GROWING), _VERTEX)


@query(_settings_sql(_GROWING, "snapshot"))
def q2_snapshot(spark, sf):
    return sweeps.snapshot_early(_growing_logs(spark, sf, _GROWING))


@query(_settings_sql(_GROWING, "entity"))
def q3_entity(spark, sf):
    return sweeps.entity_early(_growing_logs(spark, sf, _GROWING), "VERTEX", _VERTEX)


@query(_settings_sql(_GROWING, "activated", "span"))
def q4_activated(spark, sf):
    """Entities activated in the first half of the log's span."""
    return sweeps.activated_first_half(_growing_logs(spark, sf, _GROWING), "span")


def _given_sql(source: str, log: str, vertex: int, neighbours: str) -> str:
    return f"""WITH {source}, {q.lives(log)},
placed AS (SELECT ts, row_number() OVER (ORDER BY ts, seq) AS place, count(*) OVER () AS n FROM {log}),
asked AS (SELECT any_value(n) AS entries, any_value(ts) FILTER (WHERE place = n // 20) AS early, min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM placed),
born AS (SELECT min(epoch_us(ts)) AS first FROM {log} WHERE action = 'CREATE' GROUP BY entity_type, id),
alive AS (SELECT entity_type, id FROM lives, asked WHERE valid_from <= early AND (valid_to IS NULL OR valid_to > early)),
answers AS (SELECT 'neighbours' AS question, ({neighbours}) AS found
  UNION ALL SELECT 'snapshot', (SELECT count(*) FROM alive)
  UNION ALL SELECT 'entity', (SELECT count(*) FROM alive WHERE entity_type = 'VERTEX' AND id = {vertex})
  UNION ALL SELECT 'activated', (SELECT count(*) FROM born, asked WHERE first <= low + (high - low) // 2))
SELECT '{log}' AS log, model, entries, found, question FROM answers, asked, (VALUES ('intervals'), ('snapshots')) m(model)"""


@query(_given_sql(q.USERS, "users", 7, "SELECT 0"))
def q1_to_q4_users(spark, sf):
    """The four questions over the log of the users."""
    return sweeps.four_questions({"users": sweeps.prepared(users(spark, sf), keep=True)}, 7, "span")


@query(
    _given_sql(
        q.NATION_EDGES, "edges", 7, "SELECT count(DISTINCT CASE WHEN dst = 7 THEN src ELSE dst END) FROM sessions WHERE src = 7 OR dst = 7"
    )
)
def q1_to_q4_edges(spark, sf):
    """The four questions over the log of the contacts between nations."""
    return sweeps.four_questions({"edges": sweeps.prepared(edges(spark, sf), keep=True)}, 7, "span")
