"""Views and measures of a graph at one time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changelog as cl
from ..operators import diameter as dm
from ..operators import graph as g
from ..operators import synthesis as sy
from ..operators import topology as tp
from ..sources import samples
from . import sql as q
from .logs import edges
from .registry import query

# Nations as vertices with a name and a region, and the shipment edges alive at a time.
_GRAPH = f"""{q.NATION_EDGES}, {q.state('edges', q.ORDERS_T, 'arcs')},
vertices AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation),
arc_months AS (SELECT id, src, dst, substr(attributes, 7) AS month FROM arcs)"""


def nation_graph(spark, sf):
    name, region = F.col("n_name"), F.col("n_regionkey").cast("string")
    vertices = samples.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.create_map(F.lit("name"), name, F.lit("region"), region).alias("attributes"),
    )
    alive = cl.state_at(edges(spark, sf), q.ORDERS_T).select("id", "src", "dst", "attributes")
    return g.PropertyGraph(vertices, alive, q.ORDERS_T)


def sessions(spark, sf):
    return tp.merge_contacts(samples.nation_contacts(spark, sf), 30 * samples.DAY)



@query(f"WITH {_GRAPH} SELECT id, lower(name) AS value FROM vertices")
def map_vertices(spark, sf):
    mapped = g.map_vertices(nation_graph(spark, sf), F.lower(F.col("attributes")["name"]))
    return mapped.vertices.select("id", F.col("attributes").alias("value"))


@query(f"WITH {_GRAPH} SELECT id, src, dst, month || '/' || src AS value FROM arc_months")
def map_edges(spark, sf):
    value = F.concat(F.col("attributes")["month"], F.lit("/"), F.col("src").cast("string"))
    mapped = g.map_edges(nation_graph(spark, sf), value)
    return mapped.edges.select("id", "src", "dst", F.col("attributes").alias("value"))


@query(f"WITH {_GRAPH} SELECT id, dst AS src, src AS dst, month FROM arc_months")
def reverse_graph(spark, sf):
    flipped = g.reverse_graph(nation_graph(spark, sf)).edges
    return flipped.select("id", "src", "dst", F.col("attributes")["month"].alias("month"))


@query(
    f"WITH {_GRAPH} SELECT a.id, a.src, a.dst, a.month, s.name AS src_name, d.name AS dst_name FROM arc_months a "
    "LEFT JOIN vertices s ON s.id = a.src LEFT JOIN vertices d ON d.id = a.dst"
)
def triplets(spark, sf):
    return g.triplets(nation_graph(spark, sf)).select(
        "id",
        "src",
        "dst",
        F.col("attributes")["month"].alias("month"),
        F.col("src_attributes")["name"].alias("src_name"),
        F.col("dst_attributes")["name"].alias("dst_name"),
    )


@query(
    f"WITH {_GRAPH} SELECT a.id, a.src, a.dst FROM arc_months a JOIN vertices s ON s.id = a.src "
    "JOIN vertices d ON d.id = a.dst WHERE s.region < 3 AND d.region < 3 AND s.region <> d.region"
)
def subgraph(spark, sf):
    region = lambda c: F.col(c)["region"]
    part = g.subgraph(
        nation_graph(spark, sf),
        region("attributes").cast("int") < 3,
        region("src_attributes") != region("dst_attributes"),
    )
    return part.edges.select("id", "src", "dst")


_MESSAGES = f"""WITH {_GRAPH}, sent AS (
  SELECT a.dst AS id, s.region AS message FROM arc_months a JOIN vertices s ON s.id = a.src
  UNION ALL SELECT a.src, d.region FROM arc_months a JOIN vertices d ON d.id = a.dst)"""


@query(f"{_MESSAGES} SELECT id, CAST(sum(message) AS BIGINT) AS message FROM sent GROUP BY id")
def aggregate_messages(spark, sf):
    region = lambda c: F.col(c)["region"].cast("bigint")
    return g.aggregate_messages(
        nation_graph(spark, sf), F.sum, to_src=region("dst_attributes"), to_dst=region("src_attributes")
    )


@query(
    f"WITH {q.TRADE_CONTACTS}, ends AS (SELECT src AS id FROM contacts UNION SELECT dst FROM contacts) "
    "SELECT id, CASE WHEN c_name IS NULL THEN 'implicit' ELSE c_name END AS name FROM "
    "(SELECT id FROM ends UNION SELECT c_custkey FROM customer) LEFT JOIN customer ON c_custkey = id"
)
def implicit_vertices(spark, sf):
    vertices = samples.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name")).alias("attributes")
    )
    graph = g.implicit_vertices(g.PropertyGraph(vertices, samples.trade_contacts(spark, sf)))
    return graph.vertices.select("id", F.coalesce(F.col("attributes")["name"], F.lit("implicit")).alias("name"))


@query("SELECT c_custkey AS id FROM customer")
def local_vertices(spark, sf):
    vertices = samples.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name")).alias("attributes")
    )
    graph = g.implicit_vertices(g.PropertyGraph(vertices, samples.trade_contacts(spark, sf)))
    return g.local_vertices(graph).select("id")


@query(
    f"WITH {_GRAPH} SELECT a.id FROM arc_months a WHERE a.src IN (SELECT id FROM vertices WHERE region > 1) "
    "AND a.dst IN (SELECT id FROM vertices WHERE region > 1)"
)
def drop_dangling(spark, sf):
    graph = nation_graph(spark, sf)
    kept = graph.vertices.where(F.col("attributes")["region"].cast("int") > 1)
    none = F.lit(None).cast("bigint")
    state = kept.select(F.lit("VERTEX").alias("entity_type"), "id", none.alias("src"), none.alias("dst"), "attributes")
    state = state.unionByName(graph.edges.select(F.lit("EDGE").alias("entity_type"), "id", "src", "dst", "attributes"))
    return g.graph_of(state, drop_dangling=True).edges.select("id")


# -- measures ----------------------------------------------------------------

_SESSIONS = f"{q.NATION_CONTACTS}, {q.sessions(30)}"
_TRADE_ENDS = f"{q.TRADE_CONTACTS}, ends AS (SELECT src AS id, 1 AS o FROM contacts UNION ALL SELECT dst, 0 FROM contacts)"


@query(f"WITH {_TRADE_ENDS} SELECT id, count(*) AS degree FROM ends GROUP BY id")
def degrees(spark, sf):
    return g.degrees(samples.trade_contacts(spark, sf))


@query(f"WITH {_TRADE_ENDS} SELECT id, count(*) AS degree FROM ends WHERE o = 1 GROUP BY id")
def out_degrees(spark, sf):
    return g.out_degrees(samples.trade_contacts(spark, sf))


_SUMS = f"{_SESSIONS}, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM sessions UNION ALL SELECT dst, 0, 1 FROM sessions)"


@query(
    f"WITH {_SUMS} SELECT id, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM ends GROUP BY id HAVING sum(o) > 0 AND sum(i) > 0"
)
def in_out_degree_sum(spark, sf):
    return g.in_out_degree_sum(sessions(spark, sf))


@query(f"WITH {_TRADE_ENDS} SELECT id, count(*) AS degree FROM ends GROUP BY id")
def in_out_degree_sum_full(spark, sf):
    return g.in_out_degree_sum(samples.trade_contacts(spark, sf), "full_outer")


@query(f"""
WITH {_TRADE_ENDS}, counts AS (SELECT id, count(*) AS degree FROM ends GROUP BY id),
ranked AS (SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS place, count(*) OVER () AS n FROM counts)
SELECT id, degree FROM ranked WHERE place = (n - 1) // 2 OR place = n // 2""")
def degree_median(spark, sf):
    return g.degree_median(g.degrees(samples.trade_contacts(spark, sf)))


@query(
    f"WITH {_TRADE_ENDS}, v AS (SELECT count(DISTINCT id) AS n FROM ends), e AS (SELECT count(*) AS m FROM contacts) "
    'SELECT n AS "order", m AS size, round(m / n, 6) AS average_outdegree FROM v, e'
)
def graph_stats(spark, sf):
    vertices, contacts = tp.contacts_raw_graph(samples.trade_contacts(spark, sf))
    stats = g.graph_stats(g.PropertyGraph(vertices, contacts))
    return stats.withColumn("average_outdegree", F.round("average_outdegree", 6))


@query(f"WITH {q.TRADE_CONTACTS} SELECT src AS id, dst AS neighbour FROM contacts UNION SELECT dst, src FROM contacts")
def neighbour_ids(spark, sf):
    return g.neighbour_ids(samples.trade_contacts(spark, sf))


@query(f"""
WITH RECURSIVE {_GRAPH}, steps AS (SELECT DISTINCT src, dst FROM arc_months WHERE src <> dst),
walk AS (SELECT src, dst, 1 AS hops FROM steps
  UNION SELECT w.src, s.dst, w.hops + 1 FROM walk w JOIN steps s ON s.src = w.dst WHERE w.hops < 25),
shortest AS (SELECT src, dst, min(hops) AS hops FROM walk WHERE src <> dst GROUP BY src, dst)
SELECT CAST(coalesce(max(hops), 0) AS BIGINT) AS diameter FROM shortest""")
def hop_diameter(spark, sf):
    return dm.hop_diameter(nation_graph(spark, sf))


@query(f"""
WITH {q.NATION_EDGES}, {q.state('edges', q.ORDERS_T, 'a')}, {q.state('edges', '1998-07-01 00:00:00', 'b')}
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.attributes <> b.attributes""")
def compare_graphs(spark, sf):
    at = lambda t: cl.flat(cl.state_at(edges(spark, sf), t)).select("id", "src", "dst", "attributes")
    different = g.compare_graphs(at(q.ORDERS_T), at("1998-07-01"), ["id"])
    change = F.when(F.col("left_value").isNull(), "added").when(F.col("right_value").isNull(), "removed")
    return different.select("id", change.otherwise("changed").alias("change"))


@query(f"""
WITH {_TRADE_ENDS}, counts AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)
SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS position FROM counts""")
def sort_vertices_by_mode(spark, sf):
    return sy.ranked_by_mode(g.degrees(samples.trade_contacts(spark, sf)), "negative")
