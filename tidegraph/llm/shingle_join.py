"""Documents linked by the Jaccard similarity of their word shingles, by adaptive multi-match prefixes.

Shingles are put in one order for all documents, rare ones first. If two documents
are similar enough, the first l of the shingles they share stand within a prefix of
each, whose length grows with l. A document chooses its own l: a longer prefix costs
more entries to look through, and demands more shared ones before a pair is
compared. Pairs that share as many entries as the smaller l of the two are compared
exactly. A document whose entries, all partners together, are fewer than that is
never read again.

Frequencies come from a sketch of fixed size, which may only overestimate; any order
gives the same links. Pairs are never listed by shingle: documents of like size that
hold a shingle form a star around the one with the smallest digest. Since digests
order all documents alike, near copies find the same few centres in all their
shingles. Each is compared with its centres, and what is linked is joined by
union-find. Two documents that share an entry stand in one star. So where a star has
members that are not connected with its centre, these are compared with all of the
star, in blocks: shared entries of two blocks are one matrix product, and a task
gives back only links that join. No candidate is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import Scratch, stored
from .common import arrow_bytes, join_counted, trimmed
from .superminhash import intersections, joining_links, united

WORDS = 5
SIMILAR = 75  # Percent of the union that is shared.
# Counters of the sketch, and how many are sent in one piece.
COUNTERS, PIECE = 1 << 20, 1 << 12
LONGEST = 16  # The largest number of shared entries asked for.
# Entries of a shard on average, and the fewest shards: small inputs keep many cores busy too.
SHARD_ENTRIES, FEWEST_SHARDS = 1_000_000, 64
# Entries of a shingle above which it is spread over several shards.
HOT_ENTRIES = 2_000_000
BATCH_BYTES = 8_000_000  # Of texts, or of pairs of sets, that a worker looks at together.
CANDIDATE_IDS = 1_000_000  # Ids that a join may broadcast, 8 bytes each.
# Sets of a block and bytes of their shingles, on average.
BLOCK_SETS, BLOCK_BYTES = 512, 16_000_000
# Sets that may be linked are at most one class of sizes apart; a little wider than needed against rounding.
CLASS = math.log(100 / SIMILAR) * 1.001

_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts, sorted.

    Words are hashed together: a running sum of byte values times powers of an odd
    number gives each word's hash as a difference, moved back to power 0.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        rng = np.random.default_rng(8)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        lower = np.arange(256)
        lower[65:91] += 32
        self.values = self.values[lower]
        self.white = np.zeros(256, bool)
        self.white[[32, 9, 10, 11, 12, 13]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                step = np.full(size, _BASE, np.uint64)
                back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
                step[0] = back[0] = 1
                self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def __call__(self, text: bytes | None) -> np.ndarray:
        codes = np.frombuffer(text or b"", np.uint8)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = ~self.white[codes]
        turns = np.diff(inside)
        start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        if not len(start):
            return np.zeros(0, np.uint64)
        self._powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(self.values[codes] * self.up[: len(codes)], out=sums[1:])
            h = _mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
            size = min(self.words, len(h))
            total = h[: len(h) - size + 1].copy()
            for i in range(1, size):
                total = total * np.uint64(_BASE) + h[i : len(h) - size + 1 + i]
            return np.unique(_mixed(total + np.uint64(size)))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit digest that stands for the set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix(shingles: np.ndarray, counts: np.ndarray, usual: float, similar: int = SIMILAR) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set in the common order, and the number of shared entries it asks for."""
    n = len(shingles)
    often = counts[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((shingles, often))
    needed = -(-similar * n // 100)
    most = min(LONGEST, needed)
    entries = np.cumsum(np.maximum(often[order[: n - needed + most]] - usual, 0) + 1)
    lengths = n - needed + np.arange(1, most + 1)
    listed = entries[lengths - 1]
    # Looking through the entries, and comparing those documents that come up often enough.
    cost = listed + listed / np.arange(1, most + 1) * n / 8
    ask = int(np.argmin(cost)) + 1
    return shingles[order[: lengths[ask - 1]]], ask


def _bytes(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def document_sets(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, n, key), a row per document, and the pieces of the sketch (piece, part, counts)."""
    id_type = docs.schema[doc_id].dataType

    def read(batches):
        shingler, sketch = Shingler(), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sizes, keys, cells = [], [], []
            for value in _bytes(batch, "text"):
                found = shingler(value)
                sizes.append(len(found))
                keys.append(set_key(found))
                cells.append((found & np.uint64(COUNTERS - 1)).astype(np.int64))
            if cells:
                sketch += np.bincount(np.concatenate(cells), minlength=COUNTERS).astype(np.uint32)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
        pieces = [(i, p) for i, p in enumerate(sketch.reshape(-1, PIECE)) if p.any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(pieces), arrow_id),
                pa.nulls(len(pieces), pa.int64()),
                pa.nulls(len(pieces), pa.int64()),
                pa.array([i for i, _ in pieces], pa.int64()),
                pa.array([p.astype("<u4").tobytes() for _, p in pieces], pa.binary()),
            ],
            names,
        )

    arrow_id = to_arrow_type(id_type)
    names = ["doc_id", "n", "key", "piece", "counts"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        trimmed(read), f"doc_id {id_type.simpleString()}, n bigint, key bigint, piece bigint, counts binary"
    )
    kept = scratch.stored(rows.withColumn("part", F.spark_partition_id()), "document-sets")
    return (
        kept.where("piece IS NULL").select("doc_id", "n", "key"),
        kept.where("piece IS NOT NULL").select("piece", "part", "counts"),
    )


def sketch_counts(pieces: DataFrame) -> np.ndarray:
    """The sketch added up: COUNTERS numbers, whatever the size of the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, "<u8")
        for x in pdf["counts"]:
            total += np.frombuffer(x, "<u8" if len(x) == 8 * PIECE else "<u4")
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})

    schema = "piece bigint, part int, counts binary"
    # Some 256 parts at a time, so that no group grows with the number of parts.
    some = pieces.groupBy("piece", F.floor(F.col("part") / 256)).applyInPandas(lambda pdf: add(pdf), schema)
    total = np.zeros((COUNTERS // PIECE, PIECE), np.uint64)
    for row in some.groupBy("piece").applyInPandas(lambda pdf: add(pdf), schema).toLocalIterator():
        total[row["piece"]] = np.frombuffer(row["counts"], "<u8")
    return total.reshape(-1)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / CLASS).astype(np.uint64)


def bucket_stars(bucket: np.ndarray, key: np.ndarray, n: np.ndarray, ask: np.ndarray) -> dict[str, np.ndarray]:
    """Columns a, n_a, b, n, shared, least: the smallest key of each bucket with all of the bucket, itself too.

    A row per (a, b): ``shared`` buckets, and the ``least`` demand of any set in them.
    """
    order = np.lexsort((key, bucket))
    bucket, key, n, ask = bucket[order], key[order], n[order], ask[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    size = np.diff(np.r_[starts, len(bucket)])
    several = np.repeat(size > 1, size)
    at = np.repeat(starts, size)[several]
    least = np.repeat(np.minimum.reduceat(ask, starts) if len(starts) else ask, size)[several]
    a, n_a, b, n_b = key[at], n[at], key[several], n[several]
    order = np.lexsort((b, a))
    a, n_a, b, n_b, least = a[order], n_a[order], b[order], n_b[order], least[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return {
        "a": a[first],
        "n_a": n_a[first],
        "b": b[first],
        "n": n_b[first],
        "shared": np.diff(np.r_[first, len(a)]),
        "least": np.minimum.reduceat(least, first) if len(first) else least,
    }


def entry_stars(docs: DataFrame, text: str, counts: np.ndarray, shingles: int, scratch: Scratch) -> DataFrame:
    """Stored (a, n_a, b, n, shared, least): the stars of all shingles that several prefixes hold (see bucket_stars).

    A bucket holds the sets of two neighbouring classes of sizes that share a prefix
    entry. Entries travel packed, a row per batch and shard. A shard gives a row per
    member and centre, so there are never more rows than twice the entries.
    """
    spark = docs.sparkSession
    usual = shingles / COUNTERS
    shards = max(FEWEST_SHARDS, math.ceil(0.3 * shingles / SHARD_ENTRIES))
    sent = spark.sparkContext.broadcast(counts)
    hot = HOT_ENTRIES

    def entries(batches):
        shingler, often, seen = Shingler(), sent.value.astype(np.int64), set()
        for batch in batches:
            tokens, owners, keys, sizes, asks = [], [], [], [], []
            for value in _bytes(batch, "text"):
                found = shingler(value)
                key = set_key(found)
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                chosen, ask = prefix(found, often, usual)
                tokens.append(chosen)
                owners.append(np.full(len(chosen), len(keys), np.uint32))
                keys.append(key)
                sizes.append(len(found))
                asks.append(ask)
            if not keys:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            key_of, size_of, ask_of = np.array(keys, np.int64), np.array(sizes, np.uint32), np.array(asks, np.uint8)
            shard = (token >> np.uint64(32)).astype(np.int64) % shards
            # A shingle with very many entries goes to several shards.
            spread = often[(token & np.uint64(COUNTERS - 1)).astype(np.int64)] // hot
            shard = np.where(spread > 0, (shard + np.abs(key_of[owner]) % (spread + 1)) % shards, shard)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = []
            for part in np.split(order, cuts):
                mine, index = np.unique(owner[part], return_inverse=True)
                rows.append(
                    (
                        int(shard[part[0]]),
                        token[part].tobytes(),
                        index.astype("<u4").tobytes(),
                        key_of[mine].tobytes(),
                        size_of[mine].tobytes(),
                        ask_of[mine].tobytes(),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 5)],
                ["shard", "tokens", "owners", "keys", "sizes", "asks"],
            )

    packed = docs.select(F.col(text).alias("text")).mapInArrow(
        trimmed(entries), "shard bigint, tokens binary, owners binary, keys binary, sizes binary, asks binary"
    )

    def meet(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

        owners = column("owners", "<u4")
        token = np.concatenate(column("tokens", "<u8"))
        key, n, ask = (
            np.concatenate([values[o] for values, o in zip(column(name, kind), owners)])
            for name, kind in (("keys", "<i8"), ("sizes", "<u4"), ("asks", "u1"))
        )
        order = np.lexsort((key, n, token))
        token, key, n, ask = token[order], key[order], n[order].astype(np.int64), ask[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        token, key, n, ask = token[fresh], key[fresh], n[fresh], ask[fresh]
        # Neighbours by size within a shingle: near enough for a link?
        near = (token[1:] == token[:-1]) & (100 * n[:-1] >= SIMILAR * n[1:])
        apart = often_hot[(token & np.uint64(COUNTERS - 1)).astype(np.int64)]
        keep = np.r_[near, False] | np.r_[False, near] | apart
        token, key, n, ask, apart = token[keep], key[keep], n[keep], ask[keep].astype(np.int64), apart[keep]
        with np.errstate(over="ignore"):
            bucket = np.concatenate([_mixed(token + (size_class(n) + np.uint64(i)) * np.uint64(_BASE)) for i in (0, 1)])
        key, n, ask, apart = (np.concatenate([x, x]) for x in (key, n, ask, apart))
        columns = bucket_stars(bucket[~apart], key[~apart], n[~apart], ask[~apart])
        # Entries of shingles that several shards hold stay as they are.
        open_, none = int(apart.sum()), np.zeros(0, np.int64)
        rest = {"b": key[apart], "n": n[apart], "least": ask[apart], "bucket": bucket[apart].view(np.int64)}
        done = len(columns["a"])
        return pa.table(
            {
                c: pa.concat_arrays(
                    [
                        pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(done, pa.int64()),
                        pa.array(rest.get(c, none), pa.int64()) if c in rest else pa.nulls(open_, pa.int64()),
                    ]
                )
                for c in names
            }
        )

    often_hot = counts >= hot
    names = ["a", "n_a", "b", "n", "shared", "least", "bucket"]
    rows = scratch.stored(
        packed.groupBy("shard").applyInArrow(trimmed(meet), ", ".join(f"{c} bigint" for c in names)), "shard-stars"
    )
    spread = rows.where("bucket IS NOT NULL")
    centres = spread.groupBy(F.col("bucket").alias("of")).agg(
        F.min(F.struct("b", "n")).alias("c"), F.min("least").alias("low"), F.count_distinct("b").alias("size")
    )
    met = spread.join(centres.where("size > 1"), F.col("bucket") == F.col("of")).select(
        F.col("c.b").alias("a"), F.col("c.n").alias("n_a"), "b", "n", F.lit(1).cast("bigint").alias("shared"), F.col("low").alias("least")
    )
    both = rows.where("bucket IS NULL").drop("bucket").unionByName(met)
    whole = both.groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n").alias("n"), F.sum("shared").alias("shared"), F.min("least").alias("least")
    )
    stars = scratch.stored(whole, "stars")
    scratch.drop(rows)
    return stars


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def similar(shared, n, m):
    return 100 * shared >= SIMILAR * (n + m - shared)


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) that share as many prefix entries as the smaller demand and whose full sets are similar."""

    def common(x, y):
        return len(np.intersect1d(x, y, assume_unique=True))

    def compare(batches):
        for batch in batches:
            kept = []
            columns = [_sets(batch.column(c)) if c.startswith("body") else batch.column(c).to_pylist() for c in names]
            for x, y, head_x, head_y, ask_x, ask_y in zip(*columns):
                enough = common(x[:head_x], y[:head_y]) >= min(ask_x, ask_y)
                kept.append(enough and similar(common(x, y), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    names = [f"{c}_{side}" for c in ("body", "head", "ask") for side in ("a", "b")]
    ends = [
        bodies.select(F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("body", "head", "ask")])
        for c in ("a", "b")
    ]
    both = pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", *names)
    return both.mapInArrow(trimmed(compare), "a bigint, b bigint")


def block_links(star: DataFrame, labels: DataFrame, bodies: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect what is similar among the members of a star that are not connected with its centre.

    These are compared with each other and with the rest of the star. ``star``: (a, b, n).
    """
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("component"))
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("component_a"))
    named = join_counted(join_counted(star, of_b, ["b"]), of_a, ["a"]).select(
        "a", "b", "n", F.coalesce("component", "b").alias("component"), F.coalesce("component_a", "a").alias("of_centre")
    )
    named = named.withColumn("apart", F.col("component") != F.col("of_centre"))

    def blocks_of(side):
        return F.ceil(F.greatest(F.count_if(side) / BLOCK_SETS, F.sum(F.when(side, F.col("n") * 8)) / BLOCK_BYTES)).cast("int")

    # The centre itself needs no second look: all were compared with it.
    sizes = named.where("a <> b").groupBy("a").agg(
        blocks_of(F.col("apart")).alias("blocks"),
        F.coalesce(blocks_of(~F.col("apart")), F.lit(0)).alias("others"),
        F.count(F.lit(1)).alias("size"),
    )
    sizes = scratch.stored(sizes.where("size > 1 AND blocks > 0").drop("size"), "stars-apart")
    mine = join_counted(named.where("a <> b"), sizes, ["a"], "inner")
    place, blocks, others = F.xxhash64("b"), F.col("blocks"), F.col("others")
    own = F.when(F.col("apart"), F.pmod(place, blocks)).otherwise(blocks + F.pmod(place, others)).cast("int")
    last = F.when(F.col("apart"), blocks + others).otherwise(blocks) - 1
    dealt = mine.select("a", "b", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other")).select(
        "a", "b", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    filled = dealt.join(bodies, dealt["b"] == bodies["key"]).drop("key")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, head, ask = (table.column(c).to_numpy() for c in ("own", "head", "ask"))
        key, component = (table.column(c).to_numpy() for c in ("b", "component"))
        sets = _sets(table.column("body"))
        left, right = (np.flatnonzero(own == k) for k in (i, j))
        found = []
        if len(left) and len(right) and len(np.unique(component)) > 1:
            size = np.array([len(x) for x in sets])
            heads = [[sets[k][: head[k]] for k in side] for side in (left, right)]
            near = intersections(*heads) >= np.minimum(ask[left][:, None], ask[right][None, :])
            near &= component[left][:, None] != component[right][None, :]
            small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
            near &= 100 * small >= SIMILAR * large
            left, right, near = left[near.any(1)], right[near.any(0)], near[near.any(1)][:, near.any(0)]
            if near.size:
                shared = intersections([np.sort(sets[k]) for k in left], [np.sort(sets[k]) for k in right])
                near &= similar(shared, size[left][:, None], size[right][None, :])
                found = [(key[left[x]], key[right[y]]) for x, y in joining_links(near)]
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(("a", "b"))})

    return filled.groupBy("a", "i", "j").applyInArrow(trimmed(compare), "a bigint, b bigint")


def set_bodies(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, counts: np.ndarray, shingles: int) -> DataFrame:
    """(key, head, ask, body): the shingles of each wanted (doc_id, key), once; the first ``head`` are its prefix, both parts sorted."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def read(batches):
        shingler, often = Shingler(), sent.value.astype(np.int64)
        for batch in batches:
            keys, heads, asks, bodies = [], [], [], []
            for value in _bytes(batch, "text"):
                found = shingler(value)
                if not len(found):
                    continue
                chosen, ask = prefix(found, often, shingles / COUNTERS)
                keys.append(set_key(found))
                heads.append(len(chosen))
                asks.append(ask)
                rest = np.setdiff1d(found, chosen, assume_unique=True)
                bodies.append(np.concatenate([np.sort(chosen), rest]).astype("<u8").tobytes())
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((keys, heads, asks, bodies), types)], ["key", "head", "ask", "body"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = join_counted(rows, wanted.select("doc_id").distinct(), ["doc_id"], "left_semi", limit=CANDIDATE_IDS)
    named = rows.select("text").mapInArrow(trimmed(read), "key bigint, head bigint, ask bigint, body binary")
    # Rows that share a doc_id with a wanted one have other sets; repeated rows count once.
    return named.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A document's set holds the distinct shingles of five words (A-Z lower-cased,
    words parted by white space); fewer words are one shingle; a null, empty or blank
    text has none and is linked with nothing. Two documents are linked when their
    shared shingles are at least 75 percent of their union. Sets are told apart by
    64-bit digests, shingles by 64-bit hashes. Documents with equal sets are one
    until the end, so copies are never paired. Rows without doc_id take part; a
    component of such rows alone has a null id. Repeated rows stay, other columns
    are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch, arrow_bytes(spark, BATCH_BYTES):
        sets, pieces = document_sets(docs, doc_id, text, scratch)
        counts = sketch_counts(pieces)
        shingles = int(counts.sum())
        reps = scratch.stored(
            sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")),
            "distinct-sets",
        )
        stars = entry_stars(docs, text, counts, shingles, scratch)
        # Sets whose entries, all partners together, are as many as the least demand they can meet.
        able = stars.groupBy(F.col("b").alias("key")).agg(F.sum("shared").alias("s"), F.min("least").alias("least"))
        able = able.where("s >= least").select("key")
        wanted = scratch.stored(able.join(reps.select("key", "doc_id"), "key"), "wanted")
        bodies = scratch.stored(set_bodies(docs, doc_id, text, wanted, counts, shingles), "set-bodies")
        star = scratch.stored(stars.join(wanted.select(F.col("key").alias("b")), "b", "left_semi").drop("shared", "least"), "star")
        scratch.drop(stars, wanted)
        close = star.where("a <> b AND 100 * least(n, n_a) >= %d * greatest(n, n_a)" % SIMILAR).select("a", "b")
        links = scratch.stored(verified(close, bodies), "star-links")
        first = united(links, scratch)
        more = scratch.stored(block_links(star.select("a", "b", "n"), first, bodies, scratch), "block-links")
        scratch.drop(star, bodies, links)
        hung = first.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        labels = united(hung.unionByName(more), scratch)
        scratch.drop(first, more)
        named = reps.join(labels.withColumnRenamed("node", "key"), "key", "left")
        linked = scratch.stored(named.where("component IS NOT NULL OR rows > 1"), "linked-sets")
        root = F.coalesce("component", "key")
        lowest = linked.groupBy(root.alias("root")).agg(F.min("doc_id").alias("component_id"))
        of_key = linked.select("key", root.alias("root")).join(lowest, "root").select(
            "key", "component_id", F.lit(True).alias("__in")
        )
        of_key = scratch.stored(of_key, "components-of-sets")
        component = F.when(F.col("__in") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
        result = join_counted(sets, of_key, ["key"]).select(
            "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
        )
        return stored(result, "similar-documents")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns; rows equal in doc_id and text count once."""
    verdict = similar_documents(docs, doc_id, text).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")).alias("stays"),
    )
    marks = stored(
        verdict.where("rows > 1 OR stays = 0").select(
            F.col("doc_id").alias("__id"), F.lit(True).alias("__hit"), (F.col("stays") > 0).alias("__stays")
        ),
        "near-copies",
    )
    small = marks.count() <= CANDIDATE_IDS
    marked = docs.join(F.broadcast(marks) if small else marks, F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    single = marked.where("__hit IS NULL").select(*docs.columns)
    several = marked.where("__stays").dropDuplicates([doc_id, text]).select(*docs.columns)
    return single.unionByName(several)
