"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies each of its documents is
due. The whole part is certain. For the words that are left a document's inclusion
probability is proportional to its size, scaled so that the expected words are those;
where that reaches one the document is certain too, and the others share the rest.
The free ones compete by Pareto order sampling: each gets the odds of its random
number over the odds of its inclusion, and the smallest values win, as many as fill
the target. The order is cut by words, because a mixture is measured in words: bins
of the ranking are added up, and only the bin in which the target falls is looked at
document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..operators.ordered import dense_index
from ..storage import stored
from .common import WORD, join_counted, offsets_before, uniform

WEIGHTS = (3, 1, 2)
# Documents that a ranking's bin holds on average; the square root of a source's if that is more.
BIN_ROWS = 512


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, docs, source_size, target) for a frame with ``source`` and ``size``.

    Sources in code point order, null last, weigh ``weights`` in turn. Together they
    get ``share`` times all sizes, none more than ``most`` times its own; what that
    leaves over goes to the others by weight. Sources are rows all along: only the
    common factor of the targets reaches the driver.
    """
    totals = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").cast("bigint").alias("source_size")
    )
    ranked = dense_index(
        totals, [F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("source")], "__rank"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", weight).withColumn("__most", most * F.col("source_size")), "sources")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    factor = 0.0
    while True:
        # Sources whose limit the factor reaches are full; the factor only rises.
        full = F.col("__most") <= factor * F.col("weight")
        used, open_weight = table.agg(
            F.sum(F.when(full, F.col("__most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        raised = max(0.0, total - used) / open_weight if open_weight else float("inf")
        if raised <= factor * (1 + 1e-12) or not open_weight:
            break
        factor = raised
    target = F.least(F.col("__most"), factor * F.col("weight")) if open_weight else F.col("__most")
    return stored(table.select("source", "docs", "source_size", target.cast("double").alias("target")), "targets")


def _due() -> Column:
    """Copies that each document of a source is due."""
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def _rest() -> Column:
    """Words that a source lacks once every document is taken as often as is certain for all."""
    return F.greatest(F.lit(0.0), F.col("target") - F.floor(_due()) * F.col("source_size"))


def inclusion_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored (source, __rate, __free): a document of up to ``__free`` words is included with probability
    ``__rate`` times its words, a longer one for certain.

    From the largest size down: as long as the rate that is left would exceed one, documents of
    that size are certain. Only sizes and their counts are ordered, at most the square root of
    twice the source's words of them.
    """
    counts = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("__n"))
    rows = join_counted(counts, targets, ["source"], "inner")
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    longer = falling.rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words, size = F.col("size").cast("double") * F.col("__n"), F.col("size")
    rate = (_rest() - F.coalesce(F.sum(words).over(longer), F.lit(0.0))) / F.sum(words * size).over(others)
    open_ = rows.withColumn("__rate", rate).where(F.col("__rate") * size < 1)
    return stored(open_.groupBy("source").agg(F.max_by("__rate", "size").alias("__rate"), F.max("size").alias("__free")), "rates")


def inclusion(size: Column) -> Column:
    """The inclusion probability of a document next to its source's rate; without words that of its source."""
    share = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("__rate") * size))
    return F.when(F.col("__rate").isNull() | (size == 0), F.col("__due")).when(size > F.col("__free"), 1.0).otherwise(share)


def _fill(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """In ranking order take what still fits; then one more if that comes nearer the target."""
    rows = pd.concat(groups).sort_values(["__rank_value", "doc_id", "size"], na_position="first")
    gap, taken = float(rows["__gap"].iloc[0]), []
    whole = (rows["size"] * rows["__n"]).tolist()
    for words in whole:
        taken.append(words <= gap)
        gap -= words if taken[-1] else 0
    left = [(words, i) for i, words in enumerate(whole) if not taken[i]]
    if left and min(left)[0] - gap < gap:
        taken[min(left)[1]] = True
    return rows[taken][["source", "doc_id", "size"]].assign(__won=True)


def pareto_mixture(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 23,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """All rows and columns of ``docs`` and what the mixture takes of each row.

    Adds ``__size`` (words; null text 0), ``__source_size``, ``__target`` (words of
    its source) and ``__copies`` (0 to ceil(most)). Reruns agree: the random numbers
    are hashes of the seed, doc_id and size. Rows equal in source, doc_id and size
    are taken alike. A null source is a source; a null doc_id is an ordinary value.
    Documents without words compete with the probability of the average word and weigh
    nothing. An empty table gives an empty result. A source ends within its smallest free
    document of its target: at the edge what does not fit is passed over, so there, in one
    bin of the ranking, short documents have better odds than their own. Texts do not move: what decides is joined to them, small sides by broadcast.
    """
    light = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size")
    )
    sizes = stored(light, "sizes")
    targets = source_targets(sizes, weights, share, most)

    rates = inclusion_rates(sizes, targets)
    due, rest = _due(), _rest()
    u = uniform(seed, "doc_id", "size")
    odds = (u / (1 - u)) / (F.col("__chance") / (1 - F.col("__chance")))
    bins = F.greatest(F.lit(1.0), F.ceil(F.col("docs") / F.greatest(F.lit(float(BIN_ROWS)), F.sqrt("docs"))))

    def ranked(df):
        df = join_counted(join_counted(df, targets, ["source"], "inner"), rates, ["source"])
        df = df.withColumn("__whole", F.floor(due)).withColumn("__due", due - F.col("__whole"))
        df = df.withColumn("__chance", inclusion(F.col("size")))
        # Certain documents come before all bins, together no more than the words that are left.
        certain = (F.col("__due") > 0) & (F.col("__chance") >= 1)
        value = F.when(F.col("__due") == 0, 1.0).when(certain, -1.0).otherwise(odds / (1 + odds))
        place = F.least(F.floor(F.col("__rank_value") * bins), bins - 1).cast("bigint")
        return df.withColumn("__rank_value", value).withColumn("__bin", F.when(certain, -1).otherwise(place))

    keys = ranked(sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("__n")))
    before = offsets_before(keys, ["source"], "__bin", F.col("size") * F.col("__n"), "__before")
    # The last bin that begins within the target: those before it are taken whole.
    edges = stored(
        join_counted(before, targets, ["source"], "inner")
        .where((F.col("__bin") >= 0) & (F.col("__before") <= rest))
        .groupBy("source")
        .agg(F.max("__bin").alias("__edge"), F.max(F.struct("__bin", (rest - F.col("__before")).alias("g")))["g"].alias("__gap")),
        "edges",
    )
    at_edge = join_counted(keys, edges, ["source"], "inner").where("__bin = __edge")
    id_type = docs.schema[doc_id].dataType
    won_type = T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("doc_id", id_type),
            T.StructField("size", T.LongType()),
            T.StructField("__won", T.BooleanType()),
        ]
    )
    won = stored(
        at_edge.select("source", "doc_id", "size", "__n", "__rank_value", "__gap")
        .groupBy("source")
        .applyInPandas(lambda pdf: _fill(iter([pdf])), won_type),
        "won",
    ).withColumnsRenamed({"source": "__source", "doc_id": "__doc_id", "size": "__size"})

    columns = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in columns.items()],
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words_in(F.col(text)).alias("size"),
    )
    rows = join_counted(ranked(rows), edges, ["source"])
    rows = rows.withColumnsRenamed({"source": "__source", "doc_id": "__doc_id", "size": "__size"})
    rows = join_counted(rows, won, ["__source", "__doc_id", "__size"])
    # Where all copies are certain, nothing is drawn, not even documents without words.
    bin_ = F.col("__bin")
    extra = F.when(F.col("__due") == 0, 0).when(bin_ < 0, 1).when(bin_ < F.col("__edge"), 1).when(F.col("__won"), 1).otherwise(0)
    return rows.select(
        *[F.col(n).alias(c) for c, n in columns.items()],
        "__size",
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        (F.col("__whole") + extra).cast("bigint").alias("__copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, each as often as it is taken, with the columns of ``docs``."""
    return (
        pareto_mixture(docs, **options)
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies"))))
        .where("__copy > 0")
        .select(*docs.columns)
    )
