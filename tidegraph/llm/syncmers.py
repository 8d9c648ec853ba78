"""Document fingerprints from closed syncmers.

A k-mer of a text is an anchor if the smallest of its s-mers, by hash, is its first
or its last. That depends on the k-mer alone, so a shared stretch of text has the
same anchors wherever it stands, at the same distances. A fingerprint keeps the
anchors with the smallest hashes and their places; two fingerprints are alike as far
as they share anchors in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import lean, trimmed

K, S, ANCHORS = 8, 3, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _mers(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each stretch of ``size`` codes, built by doubling."""
    power, width, total, covered, shift = codes, 1, None, 0, _BASE
    # total covers the first ``covered`` codes of each stretch; power covers ``width``.
    while True:
        if size & width:
            if total is None:
                total = power
            else:
                total = total[: len(power) - covered] * shift + power[covered : covered + len(total)][: len(power) - covered]
            covered += width
        if covered == size:
            return total
        power = power[:-width] * shift + power[width:]
        shift, width = shift * shift, width * 2


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text, in the order of the text.

    A text shorter than ``k`` is one anchor as a whole; a longer one without any
    syncmer has its k-mer with the smallest hash; an empty text has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(codes) < k:
        return (np.zeros(min(len(codes), 1), np.int64), _mixed(_mers(codes, len(codes))) if len(codes) else codes)
    with np.errstate(over="ignore"):
        inner = _mixed(_mers(codes, s))
        window, low, width = k - s + 1, inner, 1
        while width * 2 <= window:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        rest = window - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        whole = _mixed(_mers(codes, k))
        at = np.flatnonzero((inner[: len(low)] == low) | (inner[window - 1 :] == low))
        if not len(at):
            at = np.array([int(np.argmin(whole))])
        return at, whole[at]


def fingerprint(text: str, size: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (smallest first) and places of at most ``size`` anchors; the same anchor's later places hash anew."""
    with np.errstate(over="ignore"):
        at, hashes = anchors(text)
        order = np.argsort(hashes, kind="stable")
        hashes, at = hashes[order], at[order]
        fresh = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        turn = np.arange(len(hashes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hashes)), 0))
        hashes = np.where(turn > 0, _mixed(hashes + turn.astype(np.uint64) * _BASE), hashes)
    hashes, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    return hashes[:size], at[first[:size]].astype(np.uint32)


def encoded(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hexadecimal digits of hash and of place for each anchor."""
    return np.stack(print_, axis=1).astype(">u4").tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = ANCHORS) -> float:
    """Anchors shared in the same order over all anchors, estimated from the smallest hashes of both; 0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    seen = shared <= union[-1]
    i, j = i[seen], j[seen]
    # The longest run of shared anchors whose places rise in both.
    rising: list[int] = []
    for place in b[1][j[np.argsort(a[1][i], kind="stable")]].tolist():
        k = bisect_left(rising, place)
        rising[k : k + 1] = [place]
    return len(rising) / len(union)


def edited(text: str, next_text: str) -> str:
    """The last half replaced by as much of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + next_text[:half]


def syncmer_anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All anchors of all texts: a row (doc_id, position, hash) for each; null and empty texts have none."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def find(batches):
        for batch in batches:
            for i, value in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                at, hashes = anchors((value or b"").decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(np.full(len(at), i))),
                        pa.array(at.astype(np.int64)),
                        pa.array(hashes.astype(np.int64)),
                    ],
                    ["doc_id", "position", "hash"],
                )

    return lean(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        trimmed(find), f"doc_id {id_type}, position bigint, hash bigint"
    )


def _stretches(spark: SparkSession, keys: DataFrame, buckets: int):
    """A function from ids to stretches of the id order: each id's own, and for the first of a stretch also the one before.

    The driver holds the bounds of the stretches, some numbers per shuffle partition.
    """
    probabilities = [float(i) / buckets for i in range(1, buckets)]
    bounds = keys.agg(F.percentile_approx("__key", probabilities or [0.5], 20 * buckets)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))
    own = F.pandas_udf(lambda key: pd.Series(np.searchsorted(bounds, key.to_numpy(), "right")), T.LongType())
    firsts = keys.groupBy(own("__key").alias("b")).agg(F.min("__key").alias("first")).orderBy("b").collect()
    ahead = {r["first"]: firsts[i - 1]["b"] for i, r in enumerate(firsts)}
    starts = np.array(list(ahead), np.int64)
    targets = np.array(list(ahead.values()), np.int64)

    def places(key: pd.Series) -> pd.Series:
        values = key.to_numpy()
        mine = np.searchsorted(bounds, values, "right")
        is_first = np.isin(values, starts)
        return pd.Series(
            [
                [m] if not f else [m, int(targets[np.searchsorted(starts, v)])]
                for v, m, f in zip(values.tolist(), mine.tolist(), is_first.tolist())
            ]
        )

    return F.pandas_udf(places, T.ArrayType(T.LongType()))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next text is that of the next row by doc_id (whole numbers; null
    first; of one doc_id by text), after the last the first. Null texts are empty.
    Two empty texts are alike (1), an empty and another text are not (0). Other
    columns are ignored; an empty table gives an empty result. Texts move once, to
    where their neighbours in the order of ids are.
    """
    spark = docs.sparkSession
    rows = lean(docs).select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_FIRST)).alias("__key"),
        F.col(text).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = _stretches(spark, rows.select("__key"), 4 * parts)
    dealt = (
        rows.select("doc_id", "__key", "text", F.posexplode(places("__key")).alias("__ahead", "__stretch"))
        .repartition(parts, "__stretch")
        .sortWithinPartitions("__stretch", "__ahead", "__key", "text")
    )

    def compare(batches):
        stretch = last = None
        for batch in batches:
            out = []
            for id_, at, ahead, raw in zip(
                batch.column("doc_id").to_pylist(),
                batch.column("__stretch").to_pylist(),
                batch.column("__ahead").to_pylist(),
                batch.column("text").cast(pa.binary()).to_pylist(),
            ):
                if ahead and last is None:
                    continue  # Only the first of the rows from the next stretch is wanted.
                value = (raw or b"").decode("utf-8", "replace")
                print_ = fingerprint(value)
                if last is not None:
                    old_id, old, old_print = last
                    new = edited(old, value)
                    new_print = fingerprint(new)
                    out.append(
                        (
                            old_id,
                            len(old),
                            hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(),
                            encoded(old_print),
                            encoded(new_print),
                            likeness(old_print, new_print),
                            likeness(old_print, print_),
                        )
                    )
                stretch, last = at, None if ahead else (id_, value, print_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names
            )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.select("doc_id", "__stretch", "__ahead", "text").mapInArrow(
        trimmed(compare),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
