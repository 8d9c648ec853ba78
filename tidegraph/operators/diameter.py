"""The hop diameter of a directed graph by searches from the few vertices that may decide it.

Every vertex has an upper bound on how far its farthest reachable vertex is. It is one
more than the largest bound of its successors; and where a vertex and a searched one
reach each other, both reach the same vertices, so it is at most its distance to the
searched one plus what that one's search has found. A vertex whose bound does not
exceed the longest distance found so far is never searched. Of the others, those with
the largest upper and with the smallest lower bound come first: ends make the longest
distance known, centres bring the upper bounds down.

Searches run 64 at a time: a vertex keeps one bit per source that has reached it, an
edge passes the bits on and they are OR-ed before they move. Several batches of 64
share each round, told apart by a number. No pair of vertices is ever a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Scratch
from .graph import PropertyGraph, degrees, implicit_vertices

_BITS = 64
# Sources of the first round, which finds bounds, and levels after which what is known is put together.
_FIRST, _COMPACT = 4, 8


@dataclass
class _Search:
    """(batch, id, bits, depth) of a search: who reached a vertex at which depth; and the depths that bits came to."""

    levels: list[DataFrame]
    farthest: dict[tuple[int, int], int] = field(default_factory=dict)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.levels)


def _search(arcs: DataFrame, sources: DataFrame, scratch: Scratch) -> _Search:
    """Breadth-first search along arcs (a, b) from all sources (batch, id, bits); a level is written once."""
    frontier = sources.withColumn("depth", F.lit(0))
    found = _Search([frontier])
    known, recent, depth = None, [frontier], 0
    while True:
        sent = arcs.join(frontier, arcs["a"] == frontier["id"]).groupBy("batch", F.col("b").alias("id"))
        sent = sent.agg(F.bit_or("bits").alias("bits"))
        parts = ([] if known is None else [known]) + [p.select("batch", "id", "bits") for p in recent]
        before = reduce(DataFrame.unionByName, parts).groupBy("batch", "id").agg(F.bit_or("bits").alias("had"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("bigint"))))
        new = sent.join(before, ["batch", "id"], "left").select("batch", "id", fresh.alias("bits")).where("bits <> 0")
        frontier = scratch.stored(new.withColumn("depth", F.lit(depth + 1)), "frontier")
        # A row per batch.
        reached = frontier.groupBy("batch").agg(F.bit_or("bits").alias("bits")).collect()
        if not reached:
            scratch.drop(frontier)
            scratch.drop(known)
            return found
        depth += 1
        for row in reached:
            for bit in range(_BITS):
                if row["bits"] >> bit & 1:
                    found.farthest[row["batch"], bit] = depth
        found.levels.append(frontier)
        recent.append(frontier)
        if len(recent) >= _COMPACT:
            old = known
            whole = reduce(DataFrame.unionByName, parts + [frontier.select("batch", "id", "bits")])
            known = scratch.stored(whole.groupBy("batch", "id").agg(F.bit_or("bits").alias("bits")), "known")
            scratch.drop(old)
            recent = []


def _raised(arcs: DataFrame, bounds: DataFrame, best: int, scratch: Scratch) -> DataFrame:
    """Bounds lowered to one more than the largest of the successors', until nothing changes that matters.

    A null bound is none. Only vertices that may still exceed ``best`` are looked at.
    """
    while True:
        of = bounds.select(F.col("id").alias("b"), F.col("upper").alias("next"))
        # One successor without a bound leaves none; max alone would pass over it.
        highest = F.when(F.count_if(F.col("next").isNull()) == 0, F.max("next") + 1).alias("through")
        through = arcs.join(of, "b").groupBy(F.col("a").alias("id")).agg(highest)
        lower = scratch.stored(
            bounds.where(F.col("upper").isNull() | (F.col("upper") > best))
            .join(through, "id")
            .where(F.col("through").isNotNull() & (F.col("upper").isNull() | (F.col("through") < F.col("upper"))))
            .select("id", "through"),
            "lower-bounds",
        )
        if lower.isEmpty():
            scratch.drop(lower)
            return bounds
        old = bounds
        better = F.coalesce(F.least("through", "upper"), "through", "upper").alias("upper")
        bounds = scratch.stored(
            bounds.join(lower, "id", "left").select("id", "degree", better, "lower", "searched"), "bounds"
        )
        scratch.drop(old, lower)


def _chosen(bounds: DataFrame, best: int, many: int) -> DataFrame:
    """(batch, id, bits) of the next sources: half of them by the largest upper bound, half by the smallest lower one."""
    may = bounds.where(~F.col("searched") & (F.col("upper").isNull() | (F.col("upper") > best)))
    busy = [F.col("degree").desc(), F.col("id")]
    ends = may.orderBy(F.col("upper").desc_nulls_first(), *busy).limit(many // 2).select("id")
    centres = may.orderBy(F.col("lower").asc_nulls_first(), *busy).limit(many // 2).select("id")
    # At most ``many`` rows, a parameter.
    place = F.row_number().over(Window.orderBy("id")) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % _BITS)
    return ends.unionByName(centres).distinct().withColumn("place", place).select(
        F.floor(F.col("place") / _BITS).cast("int").alias("batch"), "id", bit.alias("bits")
    )


def _through_searched(out: _Search, back: _Search, batches: int) -> tuple[DataFrame, DataFrame]:
    """(id, through) and (id, at_least): bounds of the vertices that a source reaches and that reach it.

    Above: the distance to the source plus its farthest. Below: that distance, and the source's farthest less the
    distance from it.
    """
    far: list[Column] = [
        F.array(*[F.lit(out.farthest.get((batch, bit), 0)) for bit in range(_BITS)]) for batch in range(batches)
    ]
    of_batch = F.element_at(F.array(*far), F.col("batch") + 1)
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)
    farthest = F.transform(set_bits, lambda b: F.element_at(of_batch, b + 1))

    def shared(mine: _Search, other: _Search) -> DataFrame:
        reached = other.rows().groupBy("batch", "id").agg(F.bit_or("bits").alias("reached"))
        both = mine.rows().join(reached, ["batch", "id"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("reached")))
        return both.where("bits <> 0")

    to_source, from_source = shared(back, out), shared(out, back)
    above = to_source.groupBy("id").agg(F.min(F.array_min(farthest) + F.col("depth")).alias("through"))
    below = to_source.select("id", F.col("depth").alias("at_least")).unionByName(
        from_source.select("id", (F.array_max(farthest) - F.col("depth")).alias("at_least"))
    )
    return above, below.groupBy("id").agg(F.max("at_least").alias("at_least"))


def hop_search(graph: PropertyGraph, batches: int = 16) -> tuple[int, int]:
    """The hop diameter, and from how many vertices a search was needed to know it."""
    spark = graph.edges.sparkSession
    with Scratch(spark) as scratch:
        arcs = graph.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        arcs = scratch.stored(arcs.distinct(), "arcs")
        turned = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        starts = arcs.groupBy(F.col("a").alias("id")).agg(F.lit(True).alias("goes"))
        whole = implicit_vertices(graph).vertices.select("id").distinct()
        bounds = (
            whole.join(degrees(arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "id", "left")
            .join(starts, "id", "left")
            .select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("goes").isNull(), 0).alias("upper"))
        )
        new = {"lower": F.lit(None).cast("int"), "searched": F.lit(False)}
        bounds = scratch.stored(bounds.withColumns(new), "bounds")
        best, searches, rounds = 0, 0, 0
        while True:
            bounds = _raised(arcs, bounds, best, scratch)
            # Few at first, since each round may settle many.
            many = min(_FIRST << max(rounds - 1, 0), _BITS * batches)
            sources = scratch.stored(_chosen(bounds, best, many), "sources")
            count = sources.count()
            if not count:
                return best, searches
            searches, rounds = searches + count, rounds + 1
            out, back = _search(arcs, sources, scratch), _search(turned, sources, scratch)
            best = max([best, *out.farthest.values()])
            above, below = _through_searched(out, back, -(-count // _BITS))
            old = bounds
            done = sources.select("id", F.lit(True).alias("now"))
            better = F.coalesce(F.least("through", "upper"), "through", "upper").alias("upper")
            bounds = scratch.stored(
                bounds.join(above, "id", "left").join(below, "id", "left").join(F.broadcast(done), "id", "left").select(
                    "id", "degree", better, F.greatest("lower", "at_least").alias("lower"), (F.col("searched") | F.coalesce("now", F.lit(False))).alias("searched")
                ),
                "bounds",
            )
            scratch.drop(old, sources, *out.levels, *back.levels)


def hop_diameter(graph: PropertyGraph, batches: int = 16) -> DataFrame:
    """Longest finite directed shortest path over all pairs of vertices, in hops."""
    longest, _ = hop_search(graph, batches)
    return graph.edges.sparkSession.range(1).select(F.lit(longest).cast("bigint").alias("diameter"))
