"""Values of earlier and later rows, and positions in an order, without a hot task.

A window over ``partitionBy(key)`` puts a whole key into one task. Here a key with
more than ``HOT_ROWS`` rows is cut into slices that follow the order of its rows;
the window runs inside each slice, and one small summary row per slice carries
the values across the cuts. Results are the same as those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored

# Rows of one key that a single task may sort. A task may meet several such keys, and rows weigh
# more in the windows of attributes: 1.8 million log rows of 25 keys took 520 MB in one of 8 tasks.
HOT_ROWS = 250_000

# Rows that a task gets where ``dealt`` says so, and buckets of keys for each hot key there can be.
TASK_ROWS, _BUCKETS = 250_000, 16

_SLICE = "__slice"


def _bare(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


@dataclass(frozen=True)
class OrderedRows:
    """Rows grouped by ``keys`` and put in ``order`` within each key.

    ``order`` must tell any two rows of a key apart. ``plain`` holds the ordinary
    keys; ``sliced`` the hot ones, or None when there are none.
    """

    plain: DataFrame
    sliced: DataFrame | None
    keys: list[str]
    order: list[str]
    # Whether a slice has one row per hot key, which bounds what the slices hand on.
    few_edges: bool = True

    @classmethod
    def of(
        cls, df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None
    ) -> "OrderedRows":
        hot_rows = hot_rows or HOT_ROWS
        if not is_scan(df):
            # It is read twice, for the sizes of the keys and for the rows.
            df = stored(df, "ordered-input")
        # Driver values: all rows, and those in hot keys.
        total = df.count()
        counts = _large_keys(df, keys, total, hot_rows)
        hot_total = counts.agg(F.sum("__rows")).first()[0] if counts is not None else None
        if not hot_total:
            return cls(dealt(df, total, *keys), None, list(keys), list(order))
        # At most (rows / hot_rows) keys, so this side is small enough to broadcast.
        hot = stored(counts.select(*keys), "hot-keys")
        match = _null_safe(df, hot, keys)
        sliced = (
            df.join(F.broadcast(hot), match, "left_semi")
            .repartitionByRange(int(hot_total // hot_rows) + 1, *keys, *order)
            .withColumn(_SLICE, F.spark_partition_id())
        )
        plain = dealt(df.join(F.broadcast(hot), match, "left_anti"), total - hot_total, *keys)
        return cls(plain, stored(sliced, "hot-rows"), list(keys), list(order))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> "OrderedRows":
        """Apply a row-wise change; it must keep the key and order columns."""
        if self.sliced is None:
            return replace(self, plain=change(self.plain))
        sliced = change(self.sliced)
        if _SLICE not in sliced.columns:
            raise ValueError("a change of ordered rows must keep all columns it does not replace")
        return replace(self, plain=change(self.plain), sliced=sliced)

    def within(self, *more_keys: str) -> "OrderedRows":
        """The same rows in the same order, grouped by further columns as well.

        The slices stay valid, since they follow the order. So does the
        partitioning of the rows: no further shuffle is needed.
        """
        return replace(self, keys=[*self.keys, *more_keys], few_edges=False)

    def with_values(
        self,
        lag: dict[str, Column] | None = None,
        lead: dict[str, Column] | None = None,
        before: dict[str, Column] | None = None,
        after: dict[str, Column] | None = None,
    ) -> "OrderedRows":
        """Add columns with values from other rows of the same key.

        ``lag``/``lead`` take the row just before/after, ``before``/``after`` the
        closest earlier/later row where the value is not null.
        """
        asked = (lag or {}, lead or {}, before or {}, after or {})
        plain = self._local(self.plain, self.keys, *asked)
        sliced = None if self.sliced is None else self._across_slices(*asked)
        return replace(self, plain=plain, sliced=sliced)

    def rows(self) -> DataFrame:
        if self.sliced is None:
            return self.plain
        return self.plain.unionByName(self.sliced.drop(_SLICE))

    def _local(self, df, keys, lag, lead, before, after) -> DataFrame:
        asc = Window.partitionBy(*keys).orderBy(*self.order)
        desc = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in self.order])
        earlier = asc.rowsBetween(Window.unboundedPreceding, -1)
        # Running frames over the reversed order: a frame that runs to the end of
        # the key would be evaluated anew for every row.
        later = desc.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {
                **{name: F.lag(c).over(asc) for name, c in lag.items()},
                **{name: F.lead(c).over(asc) for name, c in lead.items()},
                **{name: F.last(c, ignorenulls=True).over(earlier) for name, c in before.items()},
                **{name: F.last(c, ignorenulls=True).over(later) for name, c in after.items()},
            }
        )

    def _across_slices(self, lag, lead, before, after) -> DataFrame:
        asc = Window.partitionBy(*self.keys).orderBy(_SLICE)
        desc = Window.partitionBy(*self.keys).orderBy(F.col(_SLICE).desc())
        up_to, beyond = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (asc, desc))
        at = _bare(self.order)
        # One row per key and slice: what a slice hands to its neighbours.
        edges = (
            self.sliced.groupBy(*self.keys, _SLICE)
            .agg(
                F.count(F.lit(1)).alias("__rows"),
                *[F.max_by(F.struct(c.alias("v")), at).alias(f"__last_{n}") for n, c in lag.items()],
                *[F.min_by(F.struct(c.alias("v")), at).alias(f"__first_{n}") for n, c in lead.items()],
                *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__last_{n}") for n, c in before.items()],
                *[F.min_by(c, F.when(c.isNotNull(), at)).alias(f"__first_{n}") for n, c in after.items()],
            )
            .select(
                *self.keys,
                _SLICE,
                *[F.lag(f"__last_{n}").over(asc)["v"].alias(f"__in_{n}") for n in lag],
                *[F.lead(f"__first_{n}").over(asc)["v"].alias(f"__in_{n}") for n in lead],
                *[F.last(f"__last_{n}", True).over(up_to).alias(f"__in_{n}") for n in before],
                *[F.last(f"__first_{n}", True).over(beyond).alias(f"__in_{n}") for n in after],
            )
        )
        local = self._local(
            self.sliced,
            [*self.keys, _SLICE],
            {**lag, "__has_prev": F.lit(True)},
            {**lead, "__has_next": F.lit(True)},
            before,
            after,
        )
        edges = edges.withColumnsRenamed({c: f"__k_{c}" for c in [*self.keys, _SLICE]})
        match = F.lit(True)
        for c in [*self.keys, _SLICE]:
            match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        # At most one edge per slice and hot key, so this side is small; grouped by
        # further keys it has one for each of those too, and is joined like any table.
        joined = local.join(F.broadcast(edges) if self.few_edges else edges, match, "left")
        filled = joined.withColumns(
            {
                **{n: F.when(F.col("__has_prev"), F.col(n)).otherwise(F.col(f"__in_{n}")) for n in lag},
                **{n: F.when(F.col("__has_next"), F.col(n)).otherwise(F.col(f"__in_{n}")) for n in lead},
                **{n: F.coalesce(F.col(n), F.col(f"__in_{n}")) for n in (*before, *after)},
            }
        )
        added = [*lag, *lead, *before, *after]
        return filled.select(*[c for c in self.sliced.columns if c not in added], *added)


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df``, of about so many rows, dealt by ``columns`` to tasks of ``TASK_ROWS`` rows each.

    Spark joins parts of a shuffle up to a size in bytes as they are sent, which may be
    millions of narrow rows. Up to ``TASK_ROWS`` rows per core that is left to Spark.
    """
    if rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *columns)


def _large_keys(df: DataFrame, keys: list[str], total: int, hot_rows: int) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows and their ``__rows``; None when there are none for certain.

    Counting every key would hold as many keys in a task as it reads. So rows are counted
    in buckets of keys first, and keys only in the few buckets that are large enough.
    """
    if total <= hot_rows:
        return None
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS * -(-total // hot_rows)))
    sizes = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__rows"))
    # Driver values: at most (rows / hot_rows) buckets.
    large = [r["__bucket"] for r in sizes.where(F.col("__rows") > hot_rows).collect()]
    if not large:
        return None
    counts = df.where(bucket.isin(large)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.where(F.col("__rows") > hot_rows)


def is_scan(df: DataFrame) -> bool:
    """Whether a frame only filters and projects one stored table."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    match = F.lit(True)
    for c in keys:
        match = match & left[c].eqNullSafe(right[c])
    return match


def dense_index(
    df: DataFrame,
    order: list[str | Column],
    name: str = "position",
    keep: Callable[[DataFrame, str], DataFrame] = stored,
    weight: Column | None = None,
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``, which must be unique.

    The rows are range-partitioned and sorted once and stored that way, by ``keep``.
    A row's number is its place within its part plus the rows in all earlier parts,
    so no task sees more than its part. With a ``weight`` a row takes so many numbers
    and has the first of them.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # Part number in the upper bits, place within the part in the lower 33.
        .withColumn("__place", F.monotonically_increasing_id())
    )
    kept = keep(ranged, "ranged").withColumns(
        {"__part": F.shiftright("__place", 33), "__place": F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    # One row per part: bounded by the number of parts, not by the data.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("__part")
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    if weight is not None:
        earlier = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        # Dealt by range, parts that follow each other stay together and in order.
        kept = kept.repartitionByRange("__part").withColumn("__place", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    return (
        kept.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__offset") + F.col("__place")).cast("bigint"))
        .drop("__part", "__place", "__offset")
    )


# Rows that one task makes from one input row before the work is split.
_CHUNK = 100_000


def repeat_rows(
    df: DataFrame, times: str, keys: list[str] | None, name: str = "k"
) -> DataFrame:
    """Each row ``times`` times, numbered 0, 1, 2, ... in the column ``name``.

    A row with a large count is first split into chunks, so no array holds all its
    copies. With ``keys`` the chunks are spread over the tasks by them; without, a
    row's copies stay in its task and nothing is shuffled.
    """
    count, chunk = F.col(times).cast("bigint"), F.col("__chunk")
    last = (count - 1 - F.pmod(count - 1, F.lit(_CHUNK))) / _CHUNK
    chunks = df.where(count > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))
    )
    return (
        (chunks if keys is None else chunks.repartition(*keys, "__chunk"))
        .withColumn(name, F.explode(F.sequence(chunk * _CHUNK, F.least((chunk + 1) * _CHUNK, count) - 1)))
        .drop("__chunk")
    )


# Ranges that one pass tells apart, and rows of a range that are simply fetched.
_RANGES, _FEW = 1024, 1000


@dataclass
class _Range:
    """Rows with the values ``fixed`` of the first order columns and the next one in [low, high]."""

    fixed: tuple[int, ...]
    low: int
    high: int
    before: int
    rows: int
    places: list[int]

    def holds(self, names: list[str]) -> Column:
        match = F.lit(True)
        for name, value in zip(names, self.fixed):
            match = match & (F.col(name) == value)
        if len(self.fixed) < len(names):
            match = match & F.col(names[len(self.fixed)]).between(self.low, self.high)
        return match


def keys_at_places(
    df: DataFrame, order: list[Column], places: list[int], ranges: int | None = None, few: int | None = None
) -> dict[int, tuple[int, ...]]:
    """The values of ``order`` (whole numbers without nulls) of the rows at some places, counted from 0.

    Nothing is sorted or numbered: each pass counts the rows in ranges of the order and
    goes on inside those that hold a place, until few rows are left to fetch. A pass is
    a partial aggregate, and the driver sees ``ranges`` counts per place. Places beyond
    the rows are left out.
    """
    ranges, few = ranges or _RANGES, few or _FEW
    names = [f"__order_{i}" for i in range(len(order))]
    keys = df.select(*[c.cast("bigint").alias(n) for c, n in zip(order, names)])
    rows, low, high = keys.agg(F.count(F.lit(1)), F.min(names[0]), F.max(names[0])).first()
    wanted = sorted({p for p in places if 0 <= p < rows})
    open_ = [_Range((), low, high, 0, rows, wanted)] if wanted else []
    found: dict[int, tuple[int, ...]] = {}
    while open_:
        small = [r for r in open_ if r.rows <= few]
        if small:
            _fetch(keys, names, small, found)
        # A range of one value is cut by the next column of the order.
        large, narrow = [], []
        for r in open_:
            if r.rows <= few:
                continue
            if r.low < r.high:
                large.append(r)
            elif len(r.fixed) + 1 == len(names):
                found.update({p: (*r.fixed, r.low) for p in r.places})
            else:
                narrow.append(_Range((*r.fixed, r.low), 0, 0, r.before, r.rows, r.places))
        if narrow:
            _bound(keys, names, narrow)
        open_ = narrow + (_cut(keys, names, large, ranges) if large else [])
    return found


def _numbered(keys: DataFrame, names: list[str], ranges: list[_Range], value: Callable[[_Range], Column]) -> DataFrame:
    """Rows of the ranges with the range's number and a value."""
    number, amount = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for i, r in enumerate(ranges):
        number = F.when(r.holds(names), i).otherwise(number)
        amount = F.when(r.holds(names), value(r)).otherwise(amount)
    return keys.select(*names, number.alias("__range"), amount.alias("__value")).where(F.col("__range").isNotNull())


def _bound(keys: DataFrame, names: list[str], ranges: list[_Range]) -> None:
    for r in ranges:
        r.low, r.high = -(1 << 63), (1 << 63) - 1
    rows = _numbered(keys, names, ranges, lambda r: F.col(names[len(r.fixed)]))
    for row in rows.groupBy("__range").agg(F.min("__value").alias("low"), F.max("__value").alias("high")).collect():
        ranges[row["__range"]].low, ranges[row["__range"]].high = row["low"], row["high"]


def _cut(keys: DataFrame, names: list[str], ranges: list[_Range], parts: int) -> list[_Range]:
    width = [(r.high - r.low) // parts + 1 for r in ranges]
    # Integer division: a quotient of doubles is not exact above 2^53.
    part = {
        id(r): F.expr(f"cast((`{names[len(r.fixed)]}` - ({r.low})) div {w} as bigint)") for r, w in zip(ranges, width)
    }
    counts = _numbered(keys, names, ranges, lambda r: part[id(r)]).groupBy("__range", "__value").count().collect()
    out = []
    for i, (r, w) in enumerate(zip(ranges, width)):
        before = r.before
        for row in sorted((c for c in counts if c["__range"] == i), key=lambda c: c["__value"]):
            inside = [p for p in r.places if before <= p < before + row["count"]]
            if inside:
                low = r.low + row["__value"] * w
                out.append(_Range(r.fixed, low, min(low + w - 1, r.high), before, row["count"], inside))
            before += row["count"]
    return out


def _fetch(keys: DataFrame, names: list[str], ranges: list[_Range], found: dict[int, tuple[int, ...]]) -> None:
    rows = _numbered(keys, names, ranges, lambda r: F.lit(0).cast("bigint")).collect()
    for i, r in enumerate(ranges):
        mine = sorted(tuple(row[n] for n in names) for row in rows if row["__range"] == i)
        found.update({p: mine[p - r.before] for p in r.places})


def rows_at_places(df: DataFrame, order: dict[str, Column], places: list[int], name: str = "position") -> DataFrame:
    """The rows of ``df`` at some places of an order that tells rows apart, with their place."""
    found = keys_at_places(df, list(order.values()), places)
    match, place = F.lit(False), F.lit(None).cast("bigint")
    for p, key in found.items():
        here = F.lit(True)
        for c, value in zip(order.values(), key):
            here = here & (c.cast("bigint") == value)
        match, place = match | here, F.when(here, p).otherwise(place)
    return df.where(match).withColumn(name, place)
