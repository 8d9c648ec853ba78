"""Removal of every byte that a long enough earlier repeat covers, by suffix arrays over shards.

A string of ``length`` bytes is given to the shard of its minimizer, the smallest
k-mer hash inside it; equal strings have equal minimizers, so a shard sees all
places of its strings. Only minimizers that occur more than once matter. Strings that
follow each other and share their minimizer travel as one segment. In a shard, equal
segments become one with its first place; the others are joined to one text, whose
suffix array and permuted common prefixes show which strings are equal. The first
place of each string stays, all its other places mark their bytes.

What a task already sees more than once it settles itself: of equal things in a
batch one goes to the shard. So no shard gets more of one thing than there are batches.
A passage that stands in many texts has other text at its edges each time, so a minimizer
there may have a distinct segment per text. Minimizers with many of them are found by
counting first; their strings travel one by one, each to the shard of its own digest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import dense_index
from ..storage import stored
from .common import join_counted, lean, trimmed
from .suffixes import permuted_prefixes, suffix_array

LENGTH = 100
K = 24  # Bytes of a minimizer.
SHARD_ENTRIES = 1_000_000
SHARD_BYTES = 6_000_000
HOT_SEGMENTS = 10_000  # Of one bucket of minimizers: above, its strings part ways.
HOT_BUCKETS = 1 << 16
DIGEST = 16  # Bytes of a string's digest.
COPY_IDS = 1_000_000  # Ids that a join may broadcast, 8 bytes each.
BROADCAST_BYTES = 48_000_000
_FIRST = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def minimizers(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Segments of a text: first and last start of strings with one minimizer, its place, its hash."""
    codes = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        power, width, total, covered, shift = codes.astype(np.uint64) + np.uint64(1), 1, None, 0, _BASE
        while covered < k:
            if k & width:
                # Put the longer part behind what is covered.
                total = power if total is None else total[: len(power) - covered] * shift + power[covered:]
                covered += width
            if covered < k:
                power = power[:-width] * shift + power[width:]
                shift, width = shift * shift, width * 2
        h = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    # The smallest upper half wins, the leftmost of equal ones.
    low = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    window, width = length - k + 1, 1
    while width * 2 <= window:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    rest = window - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return start, np.r_[start[1:], len(place)] - 1, place[start], h[place[start]]


def _split(shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []


_PLACES = "doc bigint, places binary"


def repeated_minimizers(rows: DataFrame, length: int, entries_per_shard: int = SHARD_ENTRIES) -> DataFrame:
    """Stored (doc, places): where in a document minimizers stand that occur more than once anywhere."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total * 2 / (length - K + 2) / entries_per_shard))

    def find(batches):
        for batch in batches:
            docs, places, hashes = [], [], []
            for i, data in enumerate(batch.column("text").to_pylist()):
                if len(data) >= length:
                    _, _, place, h = minimizers(data, length)
                    docs.append(np.full(len(place), i, np.int64))
                    places.append(place)
                    hashes.append(h)
            if not docs:
                continue
            doc = batch.column("doc").to_numpy()[np.concatenate(docs)]
            place, h = np.concatenate(places).astype(np.int32), np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            doc, place, h = doc[order], place[order], h[order]
            fresh = np.r_[True, h[1:] != h[:-1]]
            again = ~fresh | np.r_[~fresh[1:], False]
            out = []
            # Known to repeat: no shard has to say so. They are dealt out by document.
            own = np.flatnonzero(again)
            for part in _split((doc[own].view(np.uint64) % np.uint64(shards)).astype(np.int64)):
                part = own[part]
                out.append((int(doc[part[0]].view(np.uint64) % np.uint64(shards)), 1, b"", doc[part], place[part]))
            one = np.flatnonzero(fresh)
            for part in _split((h[one] >> np.uint64(32)).astype(np.int64) % shards):
                part = one[part]
                out.append((int(h[part[0]] >> np.uint64(32)) % shards, 0, h[part], doc[part], place[part]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int32()),
                    *[pa.array([bytes(x[j]) if j == 2 and x[1] else x[j].tobytes() for x in out], pa.binary()) for j in (2, 3, 4)],
                ],
                ["shard", "known", "hashes", "docs", "places"],
            )

    packed = rows.mapInArrow(trimmed(find), "shard bigint, known int, hashes binary, docs binary, places binary")

    def meet(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        doc_parts = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
        place_parts = [np.frombuffer(x, np.int32) for x in table.column("places").to_pylist()]
        hash_parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        none = [np.zeros(0, np.int64)]
        doc = np.concatenate([d for d, k in zip(doc_parts, known) if not k] + none)
        place = np.concatenate([p for p, k in zip(place_parts, known) if not k] + [np.zeros(0, np.int32)])
        h = np.concatenate([x for x, k in zip(hash_parts, known) if not k] + [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        doc, place, h = doc[order], place[order], h[order]
        equal = h[1:] == h[:-1]
        again = np.r_[equal, False] | np.r_[False, equal]
        doc = np.concatenate([doc[again], *[d for d, k in zip(doc_parts, known) if k]])
        place = np.concatenate([place[again], *[p for p, k in zip(place_parts, known) if k]])
        return _by_document(doc, place[:, None])

    return packed.groupBy("shard").applyInArrow(trimmed(meet), _PLACES)


def _by_document(doc: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    return pa.table(
        {
            "doc": pa.array(doc[np.r_[0, cuts]] if len(doc) else doc, pa.int64()),
            "places": pa.array([v.tobytes() for v in np.split(values, cuts)] if len(doc) else [], pa.binary()),
        }
    )


def _wanted_segments(batch: pa.RecordBatch, length: int):
    """(doc, first start, last start, hash, bytes) of segments of repeated minimizers, documents in order."""
    ids = batch.column("doc").to_numpy()
    texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
    for i in np.argsort(ids, kind="stable").tolist():
        data = texts[i]
        wanted = np.unique(np.frombuffer(b"".join(places[i]), np.int32))
        first, last, place, h = minimizers(data, length)
        keep = np.isin(place, wanted)
        for a, b, x in zip(first[keep].tolist(), last[keep].tolist(), h[keep].tolist()):
            yield ids[i], a, b, x, data[a : b + length]


def hot_buckets(marked: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Buckets of minimizers with many segments, distinct per batch, and the strings that these hold.

    Any choice gives the same result. At most a quarter of the buckets can have four times the average.
    """

    def count(batches):
        segments, strings = np.zeros(HOT_BUCKETS, np.int64), np.zeros(HOT_BUCKETS, np.int64)
        for batch in batches:
            distinct = {piece: x for _, _, _, x, piece in _wanted_segments(batch, length)}
            bucket = np.array([x % HOT_BUCKETS for x in distinct.values()], np.int64)
            sizes = np.array([len(piece) - length + 1 for piece in distinct], np.int64)
            np.add.at(segments, bucket, 1)
            np.add.at(strings, bucket, sizes)
        some = np.flatnonzero(segments)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(segments[some]), pa.array(strings[some])], ["bucket", "segments", "strings"]
        )

    counts = stored(
        marked.mapInArrow(trimmed(count), "bucket bigint, segments bigint, strings bigint")
        .groupBy("bucket")
        .agg(F.sum("segments").alias("segments"), F.sum("strings").alias("strings")),
        "segment-counts",
    )
    total = counts.agg(F.sum("segments")).first()[0] or 0
    hot = counts.where(F.col("segments") > max(HOT_SEGMENTS, 4 * total // HOT_BUCKETS)).select("bucket", "strings").collect()
    return np.array(sorted(r[0] for r in hot), np.int64), sum(r[1] for r in hot)


def segment_shards(marked: DataFrame, length: int, shards: int, hot: np.ndarray, hot_shards: int) -> DataFrame:
    """(shard, ...): segments of repeated minimizers, packed by shard; and the places a batch has settled itself.

    Of hot minimizers digests of single strings are packed, by ``hot_shards`` shards behind the others.
    """
    busy = set(hot.tolist())

    def cut(batches):
        for batch in batches:
            found, settled, parted, apart = {}, [], {}, set()
            # The first place of a segment in a batch is that of the smallest document.
            for doc_id, a, b, x, piece in _wanted_segments(batch, length):
                if piece in found or piece in apart:
                    settled.append((doc_id, a, b))
                elif x % HOT_BUCKETS in busy:
                    apart.add(piece)
                    for j in range(b - a + 1):
                        digest = hashlib.blake2b(piece[j : j + length], digest_size=DIGEST).digest()
                        if digest in parted:
                            settled.append((doc_id, a + j, a + j))
                        else:
                            parted[digest] = (doc_id, a + j)
                else:
                    found[piece] = (x, doc_id, a)
            out = []
            if found:
                pieces = list(found)
                h = np.array([v[0] for v in found.values()], np.uint64)
                doc = np.array([v[1] for v in found.values()], np.int64)
                start = np.array([v[2] for v in found.values()], np.int32)
                size = np.array([len(p) for p in pieces], np.int32)
                for part in _split((h >> np.uint64(32)).astype(np.int64) % shards):
                    out.append(
                        (
                            int(h[part[0]] >> np.uint64(32)) % shards,
                            0,
                            h[part].tobytes(),
                            doc[part].tobytes(),
                            start[part].tobytes(),
                            size[part].tobytes(),
                            b"".join([pieces[i] for i in part.tolist()]),
                        )
                    )
            if parted:
                digests = np.frombuffer(b"".join(parted), np.uint64).reshape(-1, 2)
                doc = np.array([v[0] for v in parted.values()], np.int64)
                start = np.array([v[1] for v in parted.values()], np.int32)
                for part in _split((digests[:, 0] % np.uint64(hot_shards)).astype(np.int64)):
                    at = shards + int(digests[part[0], 0] % np.uint64(hot_shards))
                    out.append((at, 2, digests[part].tobytes(), doc[part].tobytes(), start[part].tobytes(), b"", b""))
            if settled:
                doc = np.array([x[0] for x in settled], np.int64)
                spans = np.array([x[1:] for x in settled], np.int32)
                for part in _split((doc.view(np.uint64) % np.uint64(shards)).astype(np.int64)):
                    at = int(doc[part[0]].view(np.uint64) % np.uint64(shards))
                    out.append((at, 1, b"", doc[part].tobytes(), spans[part].tobytes(), b"", b""))
            if out:
                types = [pa.int64(), pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["shard", "known", "hashes", "docs", "starts", "sizes", "bytes"]
    return marked.mapInArrow(
        trimmed(cut), "shard bigint, known int, hashes binary, docs binary, starts binary, sizes binary, bytes binary"
    )


def later_places(segments: list[bytes], h: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
    """(doc, first, last): runs of starts of strings that stand earlier elsewhere among the segments.

    Equal segments count by their first place, all others wholly. Segments alone
    with their minimizer share no string with another. The rest become one text.
    """
    order = np.lexsort((start, doc))
    first, spans = {}, []
    for i in order.tolist():
        if segments[i] in first:
            spans.append((doc[i], start[i], start[i] + len(segments[i]) - length))
        else:
            first[segments[i]] = i
    index = np.array(list(first.values()), np.int64)
    values, inverse, count = np.unique(h[index], return_inverse=True, return_counts=True)
    index = index[count[inverse] > 1]  # Still ordered by place.
    if len(index):
        sizes = np.array([len(segments[i]) for i in index])
        joined = np.frombuffer(b"".join([segments[i] for i in index]), np.uint8)
        owner = np.repeat(np.arange(len(index)), sizes)
        text = np.ones(len(joined) + len(index) + 1, np.uint16)  # 1 parts segments
        text[np.arange(len(joined)) + owner] = joined.astype(np.uint16) + 2
        text[-1] = 0
        begin = np.cumsum(sizes + 1) - sizes - 1
        array = suffix_array(text, 258)
        before, shared = permuted_prefixes(text, array)
        # Strings in order; a string that shares enough with the one before it is the same.
        usable = np.zeros(len(text), bool)
        offset = np.zeros(len(text), np.int64)
        segment = np.zeros(len(text), np.int64)
        spot = np.arange(len(joined)) + owner
        offset[spot] = np.arange(len(joined)) - (begin - np.arange(len(index)))[owner]
        segment[spot] = owner
        usable[spot] = offset[spot] + length <= sizes[owner]
        row = array[usable[array]]
        if len(row):
            fresh = shared[row] < length
            fresh[0] = True
            group = np.cumsum(fresh) - 1
            # Segments are numbered by place; places inside one rise with the offset.
            of_doc, at = doc[index][segment[row]], start[index][segment[row]] + offset[row]
            rank = np.lexsort((at, of_doc, group))
            earliest = np.r_[True, group[rank][1:] != group[rank][:-1]]
            later = rank[~earliest]
            spans += list(zip(of_doc[later], at[later], at[later]))
    return _runs(spans)


def later_strings(digests: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(doc, first, last) of every string but the first of each digest."""
    order = np.lexsort((start, doc, digests[:, 1], digests[:, 0]))
    digests = digests[order]
    later = order[np.r_[False, (digests[1:] == digests[:-1]).all(axis=1)]]
    return np.stack([doc[later], start[later], start[later]], axis=1)


def _runs(spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Sorted (doc, first, last) with neighbours joined."""
    if not spans:
        return np.zeros((0, 3), np.int64)
    spans = np.array(spans, np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    fresh = np.r_[True, (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > spans[:-1, 2] + 1)]
    begins = np.flatnonzero(fresh)
    return np.stack([spans[begins, 0], spans[begins, 1], np.maximum.reduceat(spans[:, 2], begins)], axis=1)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs`` with ``__spans``, the removed byte ranges (array of from, to), sorted and apart.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a
    smaller doc_id (null is smallest) or further left. Bytes are those of the UTF-8
    text, null is empty, no string crosses documents. Ids are whole numbers. Equal rows of
    one doc_id are treated alike and none of them counts as earlier than another; where
    rows of one doc_id differ in text, that with the smaller SHA-256 of its text is earlier.
    Other columns are kept, an empty table gives an empty result.
    """
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_FIRST))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = lean(docs).select(key.alias("doc"), body.alias("text"))
    # Later copies of whole texts go whole, and out of the way.
    digests = stored(
        rows.where(F.length("text") >= length).select("doc", F.sha2("text", 256).alias("digest")), "text-digests"
    )
    # Texts of one doc_id get numbers in their place, which keep the order. Mostly there are none.
    by_doc = digests.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    numbers = None
    if not by_doc.where("a <> b").isEmpty():
        numbers = dense_index(digests.distinct(), ["doc", "digest"], "number")
        rows = _numbered(rows, F.col("doc"), F.col("text"), numbers).where(F.col("__number").isNotNull())
        rows = rows.select(F.col("__number").alias("doc"), "text")
        digests = numbers.select(F.col("number").alias("doc"), "digest")
    firsts = stored(
        digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies"
    )
    copies = stored(
        join_counted(digests, firsts, ["digest"], "inner").where("doc <> first").select("doc").distinct(), "later-copies"
    )
    distinct = join_counted(rows, copies, ["doc"], "left_anti", limit=COPY_IDS)
    places = stored(
        repeated_minimizers(distinct, length).groupBy("doc").agg(F.collect_list("places").alias("places")), "places"
    )
    amount = places.agg(F.sum(F.aggregate("places", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)))).first()[0]
    shards = max(1, math.ceil((amount or 0) / 4 * (1.4 * length) / SHARD_BYTES))
    marked = _join_packed(distinct, places, "inner", amount or 0)
    hot, strings = hot_buckets(marked, length)
    hot_shards = max(1, math.ceil(strings * (DIGEST + 12) / SHARD_BYTES))
    packed = segment_shards(marked, length, shards, hot, hot_shards)

    def meet(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        columns = {c: table.column(c).to_pylist() for c in ("hashes", "docs", "starts", "sizes", "bytes")}
        segments, hs, ds, ss, spans, alone = [], [], [], [], [], []
        for i, settled in enumerate(known.tolist()):
            doc = np.frombuffer(columns["docs"][i], np.int64)
            start = np.frombuffer(columns["starts"][i], np.int32)
            if settled == 2:
                alone.append((np.frombuffer(columns["hashes"][i], np.uint64).reshape(-1, 2), doc, start.astype(np.int64)))
                continue
            if settled:
                spans.append(np.c_[doc, start.reshape(-1, 2).astype(np.int64)])
                continue
            end = np.cumsum(np.frombuffer(columns["sizes"][i], np.int32)).tolist()
            data = columns["bytes"][i]
            segments += [data[a:b] for a, b in zip([0, *end], end)]
            hs.append(np.frombuffer(columns["hashes"][i], np.uint64))
            ds.append(doc)
            ss.append(start.astype(np.int64))
        if segments:
            spans.append(later_places(segments, np.concatenate(hs), np.concatenate(ds), np.concatenate(ss), length))
        if alone:
            spans.append(later_strings(*(np.concatenate(c) for c in zip(*alone))))
        runs = _runs([tuple(x) for part in spans for x in part.tolist()])
        return _by_document(runs[:, 0], runs[:, 1:].astype(np.int32))

    runs = stored(
        packed.groupBy("shard").applyInArrow(trimmed(meet), _PLACES).groupBy("doc").agg(F.collect_list("places").alias("places")),
        "runs",
    )
    whole = copies.select("doc", F.lit(None).cast("array<binary>").alias("places"), F.lit(True).alias("whole"))
    packed_runs = stored(
        runs.withColumn("whole", F.lit(False)).unionByName(whole).select("doc", F.struct("places", "whole").alias("found")),
        "removals",
    )
    amount = runs.agg(F.sum(F.aggregate("places", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)))).first()[0]
    if numbers is None:
        keyed = docs.withColumn("doc__key", key)
    else:
        keyed = _numbered(docs, key, body, numbers).withColumnRenamed("__number", "doc__key")
    found = packed_runs.withColumnRenamed("doc", "found__key")
    joined = _join_on(keyed, found, "doc__key", "found__key", "left", (amount or 0) + 40 * copies.count())
    return joined.select(*docs.columns, F.col("found").alias("__found"))


def _numbered(rows: DataFrame, doc: Column, body: Column, numbers: DataFrame) -> DataFrame:
    """``rows`` with ``__number``, the place of their text among all, null for texts that have none."""
    places = numbers.withColumnsRenamed({"doc": "__of", "digest": "__digest", "number": "__number"})
    match = (doc == F.col("__of")) & (F.sha2(body, 256) == F.col("__digest"))
    return rows.join(places, match, "left").drop("__of", "__digest")


def _join_on(left: DataFrame, right: DataFrame, a: str, b: str, how: str, amount: int) -> DataFrame:
    """Broadcast the right side only if its bytes, counted before, are few."""
    return left.join(F.broadcast(right) if amount <= BROADCAST_BYTES else right, left[a] == right[b], how).drop(b, a)


def _join_packed(rows: DataFrame, places: DataFrame, how: str, amount: int) -> DataFrame:
    right = places.withColumnRenamed("doc", "place_doc")
    joined = rows.join(
        F.broadcast(right) if amount <= BROADCAST_BYTES else right, rows["doc"] == right["place_doc"], how
    )
    return joined.select("doc", "text", "places")


def removed_ranges(found: dict | None, size: int, length: int) -> list[tuple[int, int]]:
    """The byte ranges to remove from a text of ``size`` bytes, from what the shards say of it."""
    if not found:
        return []
    if found["whole"]:
        return [(0, size)] if size >= length else []
    runs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in found["places"]])
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    begin, end = runs[:, 0], np.minimum(runs[:, 1] + length, size)
    reach = np.maximum.accumulate(end)
    fresh = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[fresh].tolist(), reach[np.r_[fresh[1:] - 1, len(reach) - 1]].tolist()))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of from, to) and kept (the remaining bytes) of every row."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = repeated_spans(docs.select(doc_id, text), doc_id, text, length)

    def apply(batches):
        for batch in batches:
            out = []
            for data, found in zip(batch.column("text").to_pylist(), batch.column("__found").to_pylist()):
                data = data or b""
                ranges = removed_ranges(found, len(data), length)
                cuts = [0, *[x for r in ranges for x in r], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                spans = [{"from": a, "to": b} for a, b in ranges]
                out.append((len(data), len(data) - len(kept), len(ranges), spans, kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
    return rows.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), "__found"
    ).mapInArrow(
        trimmed(apply),
        f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "spans array<struct<from:bigint,to:bigint>>, kept binary",
    )
