"""Views and measures of a graph at one time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EDGE, VERTEX
from ..storage import stored
from .ordered import is_scan, rows_at_places


@dataclass(frozen=True)
class PropertyGraph:
    """vertices (id, attributes) and edges (id, src, dst, attributes)."""

    vertices: DataFrame
    edges: DataFrame
    as_of: Any = None


def graph_of(
    state: DataFrame, as_of=None, with_endpoints: bool = False, drop_dangling: bool = False
) -> PropertyGraph:
    """The graph of a state table.

    ``with_endpoints`` adds ends of edges that are no vertices of their own, with
    null attributes; ``drop_dangling`` drops edges that have such an end.
    """
    graph = PropertyGraph(
        state.where(F.col("entity_type") == VERTEX).select("id", "attributes"),
        state.where(F.col("entity_type") == EDGE).select("id", "src", "dst", "attributes"),
        as_of,
    )
    if drop_dangling:
        graph = replace(graph, edges=_between(graph.edges, graph.vertices))
    return implicit_vertices(graph) if with_endpoints else graph


def _ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge, from one scan."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def _between(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def implicit_vertices(graph: PropertyGraph) -> PropertyGraph:
    """Add the ends of edges that have no vertex row, with null attributes."""
    missing = _ends(graph.edges).distinct().join(graph.vertices.select("id"), "id", "left_anti")
    kind = dict(graph.vertices.dtypes)["attributes"]
    filled = missing.withColumn("attributes", F.lit(None).cast(kind))
    return replace(graph, vertices=graph.vertices.unionByName(filled))


def local_vertices(graph: PropertyGraph) -> DataFrame:
    """The vertices that are more than the end of an edge."""
    return graph.vertices.where(F.col("attributes").isNotNull())


def map_vertices(graph: PropertyGraph, value: Column) -> PropertyGraph:
    """Replace the attributes of every vertex by an expression of ``id`` and ``attributes``."""
    return replace(graph, vertices=graph.vertices.withColumn("attributes", value))


def map_edges(graph: PropertyGraph, value: Column) -> PropertyGraph:
    """Replace the attributes of every edge by an expression of its columns."""
    return replace(graph, edges=graph.edges.withColumn("attributes", value))


def reverse_graph(graph: PropertyGraph) -> PropertyGraph:
    """Flip every edge."""
    return replace(graph, edges=graph.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def triplets(graph: PropertyGraph) -> DataFrame:
    """Edges with the attributes of both ends; an end without a vertex gives null."""
    at = lambda end: graph.vertices.select(
        F.col("id").alias(end), F.col("attributes").alias(f"{end}_attributes")
    )
    joined = graph.edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return joined.select("id", "src", "dst", "attributes", "src_attributes", "dst_attributes")


def subgraph(
    graph: PropertyGraph, vertex_keep: Column | None = None, triplet_keep: Column | None = None
) -> PropertyGraph:
    """Vertices that pass ``vertex_keep``; edges that pass ``triplet_keep`` between them."""
    vertices = graph.vertices if vertex_keep is None else graph.vertices.where(vertex_keep)
    edges = graph.edges
    if triplet_keep is not None:
        edges = triplets(graph).where(triplet_keep).select(*graph.edges.columns)
    return replace(graph, vertices=vertices, edges=_between(edges, vertices))


def aggregate_messages(
    graph: PropertyGraph,
    merge: Callable[[Column], Column],
    to_src: Column | None = None,
    to_dst: Column | None = None,
) -> DataFrame:
    """Send a message per triplet to one or both ends and merge them per vertex.

    The messages are expressions of the triplet columns; null sends nothing. With
    a merge such as ``F.sum`` they are combined before they move.
    """
    sent = []
    if to_src is not None:
        sent.append(F.struct(F.col("src").alias("id"), to_src.alias("message")))
    if to_dst is not None:
        sent.append(F.struct(F.col("dst").alias("id"), to_dst.alias("message")))
    return (
        triplets(graph)
        .select(F.inline(F.array(*sent)))
        .where(F.col("message").isNotNull())
        .groupBy("id")
        .agg(merge(F.col("message")).alias("message"))
    )


# -- measures ----------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each vertex, in either direction; a loop counts twice."""
    return _ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """Outgoing edges per vertex, fewest first."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return counts.orderBy("degree", "id")


def in_out_degree_sum(edges: DataFrame, how: str = "inner") -> DataFrame:
    """Out-degree plus in-degree, fewest first.

    ``inner`` keeps vertices that have both kinds of edges, ``full_outer`` all.
    """
    if how not in ("inner", "full_outer"):
        raise ValueError("how must be 'inner' or 'full_outer'")
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    sides = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), one.alias("o"), zero.alias("i")),
                F.struct(F.col("dst").alias("id"), zero.alias("o"), one.alias("i")),
            )
        )
    )
    counts = sides.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    if how == "inner":
        counts = counts.where((F.col("o") > 0) & (F.col("i") > 0))
    return counts.select("id", (F.col("o") + F.col("i")).alias("degree")).orderBy("degree", "id")


def degree_median(degree: DataFrame) -> DataFrame:
    """The vertex in the middle by degree, or both middle ones of an even number."""
    if not is_scan(degree):
        # The places are found in several passes, and the degrees are made once for all of them.
        degree = stored(degree, "degrees")
    size = degree.count()
    middle = sorted({(size - 1) // 2, size // 2}) if size else []
    order = {"degree": F.col("degree"), "id": F.col("id")}
    return rows_at_places(degree, order, middle).select("id", "degree")


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """order, size and average out-degree (edges per vertex), in one row."""
    both = graph.vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(
        graph.edges.select(F.lit(0).alias("v"), F.lit(1).alias("e"))
    )
    counts = both.agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("order"), F.coalesce(F.sum("e"), F.lit(0)).alias("size")
    )
    return counts.select("order", "size", F.try_divide("size", "order").alias("average_outdegree"))


def neighbour_ids(edges: DataFrame) -> DataFrame:
    """Each vertex with each vertex it shares an edge with, as rows (id, neighbour)."""
    pairs = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("neighbour")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("neighbour")),
    )
    return edges.select(F.inline(pairs)).distinct()


def compare_graphs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two state tables that are missing on one side or differ.

    Both tables need comparable columns: see ``flat`` for attribute maps.
    """
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("left_value"))
    b = right.select(*keys, F.struct(*values).alias("right_value"))
    return a.join(b, keys, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
