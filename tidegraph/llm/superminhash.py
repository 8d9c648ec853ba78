"""Near copies by SuperMinHash signatures, banding, exact verification and union-find.

Every element of a set draws, from its own hash, a random order of the signature's
slots and a random number for each rank: the slot of rank j is offered the value
j + r. A slot keeps the smallest offer. Since the ranks of one element differ, its
offers are correlated and two signatures agree in a share of slots that varies less
than with independent hashes. Offers of rank j are below j + 1, so once every slot
holds less than j + 1 no later rank can change it: long texts stop after one or two
ranks. All documents of a batch go through the ranks together.

Sets that share a band of slots share a bucket. Of a bucket one set is the centre,
the one that meets most others in all its buckets; it is compared with the full sets
of the rest, and what is connected is joined by union-find. So a group of m near copies
around one text costs m comparisons. Two other sets of a bucket both stand in the
centre's star. Where a star has sets that are not linked with its centre, these are
compared, as full sets, with all of the star, in blocks: the sizes of all
intersections of two blocks are one matrix product, and a task gives back only the
links that join them. No candidate is left out, and no row stands for a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import Scratch, stored
from .common import arrow_bytes, join_counted, trimmed

WORDS = 3
SIMILAR = 85  # Percent of the union that is shared.
# Of two sets that are just similar enough, 32 bands of 5 slots miss 7 in 1e9.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
# Bytes of text, or of pairs of texts, that a worker looks at together.
BATCH_BYTES = 8_000_000
# Elements that go through the ranks together; each has a permutation of SLOTS bytes.
ELEMENTS = 1 << 17
LOCAL_LINKS = 1 << 18  # Links joined by union-find at a time inside a task.
# Sets of a block and bytes of their elements, on average; columns of a matrix at a time.
BLOCK_SETS, BLOCK_BYTES, COLUMNS = 512, 16_000_000, 1 << 13

_ODD = 0x9E3779B97F4A7C15
_WHITE = (32, 9, 10, 11, 12, 13)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words, A-Z lower-cased.

    With fewer words the whole sequence is one element; without any there is none.
    """
    found = (text or b"").lower().translate(_TO_SPACE).split(b" ")
    found = [xxhash.xxh3_64_intdigest(w) for w in found if w]
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(found, np.uint64)
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        total = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            total = _mixed(total) * np.uint64(_ODD) + h[i : len(h) - size + 1 + i]
    return np.unique(_mixed(total + np.uint64(size)))


_TO_SPACE = bytes(32 if i in _WHITE else i for i in range(256))


def set_key(elements: np.ndarray) -> bytes:
    """A 128-bit digest that stands for the set."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signatures of several sets, a row each; empty sets have the largest values.

    A value holds the rank in its upper and the random number in its lower 32 bits.
    The permutations are those of Fisher and Yates, drawn only as far as needed.
    """
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    start = 0
    while start < len(sets):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), ELEMENTS, "right")))
        _fill(out[start:stop], np.concatenate(sets[start:stop]), sizes[start:stop])
        start = stop
    return out


def _fill(out: np.ndarray, elements: np.ndarray, sizes: np.ndarray) -> None:
    slots = out.shape[1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = out.reshape(-1)  # A view: rows of one array follow each other.
    order = None
    for rank in range(slots):
        if not len(elements):
            return
        with np.errstate(over="ignore"):
            bits = _mixed(elements + np.uint64((rank + 1) * _ODD & (1 << 64) - 1))
        drawn = rank + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if rank == 0:
            # The order is still 0, 1, 2, ...: the slot is the number drawn.
            slot = drawn
        else:
            at = np.arange(len(elements))
            slot = order[at, drawn].astype(np.int64)
            order[at, drawn] = order[:, rank]
        offer = np.uint64(rank << 32) | bits >> np.uint64(32)
        np.minimum.at(flat, owner * slots + slot, offer)
        open_ = (out >> np.uint64(32) > np.uint64(rank)).any(axis=1)
        keep = open_[owner]
        if rank == 0:
            # Only sets with some empty slot need permutations; these are small sets.
            elements, owner, drawn = elements[keep], owner[keep], drawn[keep]
            kind = np.uint8 if slots <= 256 else np.uint16
            order = np.tile(np.arange(slots, dtype=kind), (len(elements), 1))
            at = np.arange(len(elements))
            order[at, drawn] = 0
        elif not keep.all():
            elements, owner, order = elements[keep], owner[keep], order[keep]


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of the similarity of two sets from their signatures."""
    return float(np.mean(a == b))


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per set and band; equal slots of a band give equal keys."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = _mixed(key * np.uint64(_ODD) + parts[:, :, i])
    return key.view(np.int64)


def _bytes(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def signed_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, key, bands): the size of each row's set, its digest, and its keys of bands.

    A worker gives the bands of a set that it has just seen as null; some row of the set has them.
    """
    id_type = docs.schema[doc_id].dataType

    def sign(batches):
        for batch in batches:
            sets = [shingle_set(x) for x in _bytes(batch, "text")]
            keys = [set_key(s) for s in sets]
            first = {k: i for i, k in reversed(list(enumerate(keys))) if len(sets[i])}
            bands = dict(zip(first, band_keys(signatures([sets[i] for i in first.values()])).tolist() if first else []))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([bands.pop(k, None) for k in keys], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "key", "bands"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(sign), f"doc_id {id_type.simpleString()}, n bigint, key binary, bands array<bigint>")


def bucket_members(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored (bucket, key, n, score) of the buckets that hold at least two sets.

    The score of a set is the sum of its buckets' sizes: the text that many were
    copied from agrees with each of them more than they agree with each other.
    """
    entries = sets.select("key", "n", F.explode("bands").alias("bucket"))
    sizes = scratch.stored(
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes"
    )
    shared = scratch.stored(join_counted(entries, sizes, ["bucket"], "inner"), "shared-buckets")
    scores = shared.groupBy("key").agg(F.sum("size").alias("score"))
    members = scratch.stored(shared.drop("size").join(scores, "key"), "bucket-members")
    scratch.drop(sizes, shared)
    return members


def forest(links: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each task's links (a, b), every node below its smallest one, by union-find.

    A task keeps at most ``LOCAL_LINKS`` links at a time.
    """
    name = to_arrow_type(links.schema["a"].dataType)

    def roots(pairs):
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        return [(x, root(x)) for x in parent if root(x) != x]

    def join(batches):
        waiting, most = [], LOCAL_LINKS
        for batch in batches:
            waiting += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            if len(waiting) >= most:
                yield table(roots(waiting))
                waiting = []
        yield table(roots(waiting))

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], name) for i in (0, 1)], ["a", "b"])

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").mapInArrow(trimmed(join), f"a {kind}, b {kind}")


def united(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Stored (node, component) of every end of a link; the component is its smallest node.

    Tasks join their own links by union-find; what crosses tasks is joined by stars
    (each node hangs on the smallest it knows) until nothing changes. Every step is
    an aggregate by node, so a node with any number of links is never one group in
    memory. Each round drops the one before.
    """
    edges = scratch.stored(forest(links), "forest")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = scratch.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.stored(large.where("a <> b").distinct(), "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        before, edges = edges, scratch.stored(small.where("a <> b").distinct(), "edges")
        scratch.drop(before, lowest, large)
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    components = scratch.stored(hung.unionByName(roots), "components")
    scratch.drop(edges)
    return components


def stars(members: DataFrame) -> DataFrame:
    """(a, n_a, b, n): the centre of each bucket with the other sets of its buckets, each once."""
    best = F.max_by(F.struct("key", "n"), F.struct("score", "key"))
    centres = members.groupBy("bucket").agg(best.alias("c"))
    centres = centres.select(F.col("bucket").alias("of"), F.col("c.key").alias("a"), F.col("c.n").alias("n_a"))
    met = members.join(centres, (F.col("bucket") == F.col("of")) & (F.col("key") != F.col("a")))
    return met.select("a", "n_a", F.col("key").alias("b"), "n").distinct()


def similar(shared, n, m):
    return 100 * shared >= SIMILAR * (n + m - shared)


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. ``bodies``: (key, body), one row per set.

    The elements of b, which has few partners, move first; the centre a is split by adaptive execution if it has many.
    """

    def compare(batches):
        for batch in batches:
            kept = []
            for x, y in zip(_sets(batch.column("body_a")), _sets(batch.column("body_b"))):
                kept.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ends = [bodies.select(F.col("key").alias(c), F.col("body").alias(f"body_{c}")) for c in ("a", "b")]
    both = pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "body_a", "body_b")
    return both.mapInArrow(trimmed(compare), "a binary, b binary")


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``, as matrix products over what both blocks hold."""
    out = np.zeros((len(a), len(b)), np.float32)
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    places = [[np.searchsorted(common, x[np.isin(x, common, assume_unique=True)]) for x in block] for block in (a, b)]
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        # Counts up to 2^24 are exact in 32 bits, and a part of them even more so.
        both = [np.zeros((len(block), width), np.float32) for block in places]
        for matrix, block in zip(both, places):
            for i, at in enumerate(block):
                matrix[i, at[np.searchsorted(at, first) : np.searchsorted(at, first + width)] - first] = 1
        out += both[0] @ both[1].T
    return out


def joining_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """A few of the links (i, j) of a matrix that connect the same rows and columns as all of them."""
    rows, columns = linked.shape
    label = np.arange(rows + columns)
    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i]):
            x, y = label[i], label[rows + j]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
        if (label[:rows] == label[0]).all() and (label[rows:] == label[0]).all():
            break
    return out


def block_links(star: DataFrame, labels: DataFrame, bodies: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect what is similar among the sets of a star that its centre leaves apart.

    In each star those that are not of the centre's component are compared with each other and with the rest.
    """
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("component"))
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("component_a"))
    named = join_counted(join_counted(star, of_b, ["b"]), of_a, ["a"]).select(
        "a", "b", "n", F.coalesce("component", "b").alias("component"), F.coalesce("component_a", "a").alias("of_centre")
    )
    named = named.withColumn("apart", F.col("component") != F.col("of_centre"))
    sizes = named.groupBy("a").agg(
        *[
            F.ceil(F.greatest(F.count_if(side) / BLOCK_SETS, F.sum(F.when(side, F.col("n") * 8)) / BLOCK_BYTES))
            .cast("int").alias(name)
            for name, side in (("blocks", F.col("apart")), ("others", ~F.col("apart")))
        ],
        F.count(F.lit(1)).alias("size"),
    )
    sizes = scratch.stored(sizes.where("size > 1 AND blocks > 0").drop("size"), "stars-apart")
    mine = join_counted(named, sizes, ["a"], "inner")
    place = F.xxhash64("b")
    blocks, others = F.col("blocks"), F.coalesce("others", F.lit(0))
    own = F.when(F.col("apart"), F.pmod(place, blocks)).otherwise(F.pmod(place, others)).cast("int")
    # The block pairs (i, j) of a set, i <= j: blocks from ``blocks`` on are those of the centre's component.
    index = F.when(F.col("apart"), own).otherwise(blocks + own)
    partner = F.when(F.col("apart"), F.sequence(F.lit(0), blocks + others - 1)).otherwise(F.sequence(F.lit(0), blocks - 1))
    dealt = mine.select("a", "b", "component", index.alias("own"), F.explode(partner).alias("partner")).select(
        "a", "b", "component", "own", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j")
    )
    filled = dealt.join(bodies, dealt["b"] == bodies["key"]).select("a", "i", "j", "own", "b", "component", "body")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own = table.column("own").to_numpy()
        key, component, sets = table.column("b").to_pylist(), table.column("component").to_pylist(), _sets(table.column("body"))
        left, right = (np.flatnonzero(own == k).tolist() for k in (i, j))
        found = []
        if left and right and len(set(component)) > 1:
            number = {c: k for k, c in enumerate(set(component))}
            part = np.array([number[c] for c in component])
            size = np.array([len(x) for x in sets])
            shared = intersections([sets[k] for k in left], [sets[k] for k in right])
            linked = similar(shared, size[left][:, None], size[right][None, :])
            linked &= part[left][:, None] != part[right][None, :]
            found = [(key[left[x]], key[right[y]]) for x, y in joining_links(linked)]
        return pa.table({c: pa.array([f[k] for f in found], pa.binary()) for k, c in enumerate(("a", "b"))})

    return filled.groupBy("a", "i", "j").applyInArrow(trimmed(compare), "a binary, b binary")


def set_bodies(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(key, body): the sorted elements of each of the wanted (doc_id, key), once."""

    def name(batches):
        for batch in batches:
            sets = [shingle_set(x) for x in _bytes(batch, "text")]
            columns = [[set_key(s) for s in sets], [s.astype("<u8").tobytes() for s in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["key", "body"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = join_counted(rows, wanted.select("doc_id").distinct(), ["doc_id"], "left_semi")
    named = rows.select("text").mapInArrow(trimmed(name), "key binary, body binary")
    # Rows that share a doc_id with a wanted one have other sets; repeated rows count once.
    return named.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    A document's set holds the distinct shingles of three words (A-Z lower-cased,
    words parted by white space); fewer words are one shingle; a null, empty or
    blank text has none and is linked with nothing. Two documents are linked when
    their shared shingles are at least 85 percent of their union; each link is
    confirmed on the full sets. Shingles are told apart by 64-bit, sets by 128-bit
    digests. Documents with equal sets are one until the end, so copies are never
    paired. ``kept`` is doc_id = component_id. Rows without doc_id take part; a
    component of such rows alone has a null id, and they are kept. Repeated rows
    stay, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch, arrow_bytes(spark, BATCH_BYTES):
        sets = scratch.stored(signed_sets(docs, doc_id, text), "signed-sets")
        distinct = scratch.stored(
            sets.where("n > 0").groupBy("key").agg(
                F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"),
                F.first("bands", ignorenulls=True).alias("bands"),
            ),
            "distinct-sets",
        )
        members = bucket_members(distinct, scratch)
        wanted = members.select("key").distinct().join(distinct.select("key", "doc_id"), "key")
        wanted = scratch.stored(wanted, "wanted")
        star = scratch.stored(stars(members), "stars")
        bodies = scratch.stored(set_bodies(docs, doc_id, text, wanted), "set-bodies")
        scratch.drop(members, wanted)
        close = star.where("100 * least(n, n_a) >= %d * greatest(n, n_a)" % SIMILAR).select("a", "b")
        links = scratch.stored(verified(close, bodies), "star-links")
        first = united(links, scratch)
        more = scratch.stored(block_links(star, first, bodies, scratch), "block-links")
        scratch.drop(star, bodies)
        hung = first.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        labels = united(hung.unionByName(more), scratch)
        scratch.drop(first, links, more)
        named = distinct.select("key", "doc_id", "rows")
        named = named.join(labels.withColumnRenamed("node", "key"), "key", "left")
        linked = scratch.stored(named.where("component IS NOT NULL OR rows > 1"), "linked-sets")
        root = F.coalesce("component", "key")
        lowest = linked.groupBy(root.alias("root")).agg(F.min("doc_id").alias("component_id"))
        of_key = scratch.stored(
            linked.select("key", root.alias("root")).join(lowest, "root").select(
                "key", "component_id", F.lit(True).alias("__in")
            ),
            "components-of-sets",
        )
        component = F.when(F.col("__in"), F.col("component_id")).otherwise(F.col("doc_id"))
        result = join_counted(sets, of_key, ["key"]).select(
            "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
        )
        return stored(result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-copies")
