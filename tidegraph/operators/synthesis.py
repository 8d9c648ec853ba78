"""Synthetic change logs: how many updates an entity gets, and when."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attributes import hashed_unit, surrogate_id
from ..functions.times import epoch_seconds, floor_div, seconds_to_ts
from ..schema import CHANGELOG, CREATE, DELETE, EDGE, UPDATE, VERTEX, conform, no_attributes
from .graph import degrees
from .ordered import OrderedRows, dense_index, repeat_rows

_ZIPF_BLOCK = 4096


@dataclass(frozen=True)
class Distribution:
    """lognormal(mu, sigma), gaussian(mu, sigma), uniform(low, high) or zipf(maximum, exponent)."""

    kind: str
    first: float
    second: float


def scaled_distribution(base: Distribution, iteration: int) -> Distribution:
    """The distribution of an iteration: a gaussian's mean grows, else the second parameter."""
    if base.kind == "gaussian":
        return Distribution(base.kind, base.first * iteration, base.second)
    return Distribution(base.kind, base.first, base.second * iteration)


def _standard_normal(seed: int, keys: list[str]) -> Column:
    u = hashed_unit(F.lit(seed), *[F.col(k) for k in keys])
    v = hashed_unit(F.lit(seed), *[F.col(k) for k in keys], F.lit("angle"))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def draw_counts(
    df: DataFrame, keys: list[str], distribution: Distribution, seed: int = 0, name: str = "updates"
) -> DataFrame:
    """Add one whole number per row, drawn from a distribution and cut toward zero.

    The draw depends only on the seed and the keys of the row, not on how the rows
    are spread, so a repeated task draws the same.
    """
    a, b = float(distribution.first), float(distribution.second)
    unit = hashed_unit(F.lit(seed), *[F.col(k) for k in keys])
    if distribution.kind == "uniform":
        return df.withColumn(name, (F.lit(a) + unit * (b - a)).cast("bigint"))
    if distribution.kind == "gaussian":
        return df.withColumn(name, (F.lit(a) + _standard_normal(seed, keys) * b).cast("bigint"))
    if distribution.kind == "lognormal":
        return df.withColumn(name, F.exp(F.lit(a) + _standard_normal(seed, keys) * b).cast("bigint"))
    if distribution.kind == "zipf":
        return _zipf(df, unit, keys, int(a), b, name)
    raise ValueError(f"unknown distribution {distribution.kind!r}")


def _zipf(df: DataFrame, unit: Column, keys: list[str], maximum: int, exponent: float, name: str) -> DataFrame:
    """Invert the cumulative weights: draws and the lower bounds of the values are put in one order.

    Each draw takes the last bound before it, so there is no table that every task
    holds, and the maximum may be any number. Weights are summed in blocks, then blocks.
    """
    value, block = F.col("__value"), Window.partitionBy("__block")
    weights = df.sparkSession.range(1, maximum + 1).select(
        F.col("id").alias("__value"),
        F.floor((F.col("id") - 1) / _ZIPF_BLOCK).alias("__block"),
        F.pow(F.col("id").cast("double"), F.lit(-exponent)).alias("__weight"),
    )
    # A row per block of values: bounded by the parameter.
    sums = weights.groupBy("__block").agg(F.sum("__weight").alias("__sum"))
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "__block",
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__before"),
        F.sum("__sum").over(Window.partitionBy()).alias("__total"),
    )
    inside = block.orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    bounds = weights.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0.0)))
    bounds = bounds.join(sums, "__block").select(
        "__value", ((F.col("__before") + F.col("__inside")) / F.col("__total")).alias("__u"), F.lit(0).alias("__kind")
    )
    draws = df.withColumns({"__u": unit, "__kind": F.lit(1)})
    both = draws.unionByName(bounds, allowMissingColumns=True).withColumn("__all", F.lit(0))
    found = OrderedRows.of(both, ["__all"], ["__u", "__kind", "__value", *keys]).with_values(before={"__found": value})
    return found.rows().where("__kind = 1").select(*df.columns, F.col("__found").alias(name))


def _mode_order(mode: str, weight: str, key: str, seed: int) -> list[Column]:
    if mode == "positive":
        return [F.col(weight).asc(), F.col(key).asc()]
    if mode == "negative":
        return [F.col(weight).desc(), F.col(key).asc()]
    if mode == "uniform":
        return [surrogate_id(F.lit(seed), F.col(key)).asc(), F.col(key).asc()]
    raise ValueError("mode must be 'positive', 'negative' or 'uniform'")


def sort_by_mode(df: DataFrame, mode: str, weight: str = "degree", key: str = "id", seed: int = 0) -> DataFrame:
    """Rows by rising or falling weight, or in an order that has nothing to do with it."""
    return df.orderBy(*_mode_order(mode, weight, key, seed))


def ranked_by_mode(
    df: DataFrame, mode: str, weight: str = "degree", key: str = "id", seed: int = 0, name: str = "position"
) -> DataFrame:
    """Rows with their place in the order of ``mode``, counted from 0."""
    return dense_index(df, _mode_order(mode, weight, key, seed), name)


def _paired(df: DataFrame, weight: str, key: str, distribution: Distribution, mode: str, seed: int) -> DataFrame:
    """Give the k-th smallest draw to the k-th row in the order of ``mode``."""
    ranked = ranked_by_mode(df, mode, weight, key, seed, "__rank")
    drawn = draw_counts(df.select(key), [key], distribution, seed)
    draws = dense_index(drawn, ["updates", key], "__rank").select("__rank", "updates")
    return ranked.join(draws, "__rank").drop("__rank")


def assign_vertex_updates(
    vertices: DataFrame, edges: DataFrame, distribution: Distribution, mode: str = "positive", seed: int = 0
) -> DataFrame:
    """An update count per vertex, correlated with its degree; result (id, degree, updates)."""
    weighted = vertices.select("id").join(degrees(edges), "id", "left").fillna(0, "degree")
    return _paired(weighted, "degree", "id", distribution, mode, seed).select("id", "degree", "updates")


def endpoint_weight(edges: DataFrame, vertex_updates: DataFrame) -> DataFrame:
    """The update counts of both ends of each edge, added up; an unknown end counts 0."""
    at = lambda end: vertex_updates.select(F.col("id").alias(end), F.col("updates").alias(f"__{end}"))
    joined = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    weight = F.coalesce("__src", F.lit(0)) + F.coalesce("__dst", F.lit(0))
    return joined.select(*edges.columns, weight.alias("weight"))


def assign_edge_updates(
    edges: DataFrame,
    vertex_updates: DataFrame,
    distribution: Distribution,
    mode: str = "positive",
    seed: int = 0,
    key: str = "edge_id",
) -> DataFrame:
    """An update count per edge, correlated with those of its ends."""
    return _paired(endpoint_weight(edges, vertex_updates), "weight", key, distribution, mode, seed + 1)


def assign_updates(
    vertices: DataFrame, edges: DataFrame, distribution: Distribution, mode: str = "positive", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Update counts of vertices, then of edges, with one correlation mode for both."""
    vertex_updates = assign_vertex_updates(vertices, edges, distribution, mode, seed)
    return vertex_updates, assign_edge_updates(edges, vertex_updates, distribution, mode, seed)


def _offset(u: Column, low: Column, high: Column) -> Column:
    """A whole number in [low, high) from a number in [0, 1)."""
    return low + (u * (high - low)).cast("bigint")


def expand_changelog(
    vertex_updates: DataFrame,
    edge_updates: DataFrame,
    low_seconds: int = 0,
    high_seconds: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """A change log from update counts.

    A vertex with n > 0 gets n times in [low, high); the first is its CREATE, the
    others UPDATEs; it is never deleted. An edge has a CREATE at its start, its
    UPDATEs inside its interval and a DELETE at its end. Times are whole seconds.

    The first of n uniform times is drawn directly, as 1 - (1 - u)^(1/n), and the
    others uniformly after it. That has the distribution of n sorted draws, and no
    vertex's draws need to be brought together to be sorted.
    """
    k, n = F.col("k"), F.col("updates")
    unit = lambda *parts: hashed_unit(F.lit(seed), *parts)
    first = F.lit(1.0) - F.pow(F.lit(1.0) - unit(F.col("id"), F.lit("first")), F.lit(1.0) / n)
    share = F.when(k == 0, first).otherwise(first + unit(F.col("id"), k) * (F.lit(1.0) - first))
    low, high = (F.lit(s).cast("bigint") for s in (low_seconds, high_seconds))
    none = F.lit(None).cast("bigint")
    vertices = repeat_rows(vertex_updates, "updates", ["id"]).select(
        F.lit(VERTEX).alias("entity_type"),
        "id",
        none.alias("src"),
        none.alias("dst"),
        _offset(share, low, high).alias("second"),
        F.when(k == 0, CREATE).otherwise(UPDATE).alias("action"),
        "k",
    )
    start, stop = epoch_seconds(F.col("valid_from")), epoch_seconds(F.col("valid_to"))
    # 0 is the CREATE, 1..n are UPDATEs, n + 1 is the DELETE.
    last = F.col("__entries") - 1
    inside = _offset(unit(F.lit("edge"), F.col("edge_id"), k), start, stop)
    entries = edge_updates.withColumn("__entries", F.greatest(n, F.lit(0)) + 2)
    edges = repeat_rows(entries, "__entries", ["edge_id"]).select(
        F.lit(EDGE).alias("entity_type"),
        F.col("edge_id").alias("id"),
        "src",
        "dst",
        F.when(k == 0, start).when(k == last, stop).otherwise(inside).alias("second"),
        F.when(k == 0, CREATE).when(k == last, DELETE).otherwise(UPDATE).alias("action"),
        "k",
    )
    rows = vertices.unionByName(edges).select(
        seconds_to_ts(F.col("second")).alias("ts"),
        "action",
        "entity_type",
        "id",
        "src",
        "dst",
        F.when(F.col("action") == DELETE, no_attributes())
        .otherwise(F.create_map(F.lit("update"), k.cast("string")))
        .alias("attributes"),
        action_rank(F.col("action")).alias("__rank"),
        "k",
    )
    return conform(dense_index(rows, ["ts", "__rank", "entity_type", "id", "k"], "seq"), CHANGELOG)


def even_timestamps_per_row(df: DataFrame, amount: str, start: str, stop: str, keys: list[str]) -> DataFrame:
    """The rows of ``df``, each repeated for its own number of even instants."""
    first, last = epoch_seconds(F.col(start)), epoch_seconds(F.col(stop))
    step = floor_div(last - first, F.greatest(F.col(amount).cast("bigint") - 1, F.lit(1).cast("bigint")))
    repeated = repeat_rows(df, amount, keys, "position")
    return repeated.withColumn("ts", seconds_to_ts(first + F.col("position") * step))


def action_rank(action: Column) -> Column:
    """CREATE before UPDATE before DELETE, for entries at one time without a position."""
    return F.when(action == CREATE, 0).when(action == UPDATE, 1).otherwise(2)

