"""A uniform shuffle into shards of exact sizes, planned by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first: one row of
the matrix per partition, each from the multivariate hypergeometric law given the
room that is left. Rows are put in random order inside their partition, dealt out
by those counts, exchanged, and put in random order inside their shard. Given the
random orders, every assignment of rows to slots is equally likely.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import stored
from .common import join_counted, offsets_before, uniform

# Rows that one task puts in order inside a shard.
BIN_ROWS = 20_000
_EXACT = 500_000_000  # The library's sampler takes populations up to about this.


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from ``good + bad`` without replacement, at any size."""
    total = good + bad
    if total <= _EXACT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def log_weight(k):
        return -sum(map(math.lgamma, (k + 1, good - k + 1, draws - k + 1, bad - draws + k + 1)))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    width = math.sqrt(max(1.0, draws * p * (1 - p) * (total - draws) / (total - 1)))
    top = log_weight(mode)
    # Rejection below a flat middle with exponential tails: the law is log-concave,
    # so past one width from the mode it lies below the chord's exponential.
    reach = [min(int(width) + 1, max(mode - low, 1)), min(int(width) + 1, max(high - mode, 1))]
    rate = []
    for side, sign in ((0, -1), (1, 1)):
        at = mode + sign * reach[side]
        rate.append(max((top - log_weight(at)) / reach[side], 1e-12) if low <= at <= high else 1.0)
    areas = [1 / (1 - math.exp(-rate[0])), reach[0] + reach[1] + 1, 1 / (1 - math.exp(-rate[1]))]
    while True:
        part = rng.random() * sum(areas)
        if part < areas[1]:
            k, bound = mode - reach[0] + int(part), 0.0
        else:
            side = int(part >= areas[1] + areas[0])
            steps = int(rng.geometric(1 - math.exp(-rate[side]))) - 1
            k = mode + (-1 if side == 0 else 1) * (reach[side] + 1 + steps)
            bound = -rate[side] * steps
        if low <= k <= high and math.log(1 - rng.random()) <= log_weight(k) - top - bound:
            return int(k)


def communication_matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from partition p to shard s; shard sizes are at most one apart."""
    rng, total = np.random.default_rng(seed), sum(parts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(parts), shards), np.int64)
    for p, rows in enumerate(parts):
        left, free = rows, sum(room)
        for s in range(shards):
            free -= room[s]
            take = hypergeometric(rng, room[s], free, left)
            matrix[p, s] = take
            room[s] -= take
            left -= take
    return matrix


def hypergeometric_shards(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one apart and slots are a uniform permutation. The
    random orders come from hashes of ``keys`` (any types, nulls too); rows equal in
    all keys are interchangeable. Input columns called shard or slot are replaced.
    An empty table gives an empty result. All columns are written once to shared
    storage, which fixes the partitions that the matrix speaks of.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    local = (
        df.withColumn("__r1", F.xxhash64(F.lit(seed), *keys))
        .sortWithinPartitions("__r1", *keys)
        .withColumn("__place", F.monotonically_increasing_id())
        .drop("__r1")
    )
    rows = stored(local, "dealt").withColumns(
        {
            "__part": F.shiftright("__place", 33),
            "__index": F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)),
            "__r2": uniform(seed + 1, *keys),
        }
    )
    # One number per input partition.
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("__part").count().collect())
    total = sum(n for _, n in sizes)
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    bounds = [(p, np.cumsum(row).tolist()) for (p, _), row in zip(sizes, matrix)]
    plan = stored(spark.createDataFrame(bounds, "__part bigint, __bounds array<bigint>"), "matrix")
    bins = max(1, math.ceil(total / shards / BIN_ROWS))
    dealt = join_counted(rows, plan, ["__part"], "inner", limit=20_000).withColumns(
        {
            "shard": F.size(F.filter("__bounds", lambda b: b <= F.col("__index"))),
            "__bin": F.floor(F.col("__r2") * bins).cast("int"),
        }
    )
    dealt = dealt.drop("__bounds", "__place", "__part", "__index")
    start = offsets_before(dealt, ["shard"], "__bin", F.lit(1), "__start")
    inside = Window.partitionBy("shard", "__bin").orderBy("__r2", *keys)
    slots = join_counted(dealt.withColumn("__row", F.row_number().over(inside) - 1), start, ["shard", "__bin"], "inner")
    return slots.withColumn("slot", (F.col("__start") + F.col("__row")).cast("bigint")).select(
        *df.columns, "shard", "slot"
    )
