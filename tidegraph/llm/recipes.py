"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes says so. Each chunk has an
identifier, a digest of its bytes. All distinct chunks are moved once to prove that
no identifier stands for two different chunks; if one does, the next longer digest
is taken and proved again. From then on a text is the ordered list of its chunks'
identifiers, some hundredth of its bytes, and only these lists are compared.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import stored
from .common import join_counted, lean, trimmed

WIDTHS = (16, 32, 64)
MEAN_BITS, LEAST, MOST = 11, 256, 65_536
_WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def normalised(text: bytes | None) -> bytes:
    """Every run of white space as one space; null is empty."""
    return _WHITE.sub(b" ", text or b"")


def chunks_of(data: bytes, gear: np.ndarray) -> list[bytes]:
    """``data`` cut by content into pieces of ``LEAST`` to ``MOST`` bytes, the last one maybe shorter."""
    h = gear[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        moved = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += moved
    ends = np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + 1
    pieces, start = [], 0
    for end in [*ends.tolist(), len(data)]:
        while end - start > MOST:
            pieces.append(data[start : start + MOST])
            start += MOST
        if end - start >= LEAST or end == len(data) and end > start:
            pieces.append(data[start:end])
            start = end
    return pieces


def _gear() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def _bytes(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def chunk_table(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(chunk_id, chunk): the chunks of all texts, each once per batch."""

    def cut(batches):
        gear = _gear()
        for batch in batches:
            found = {}
            for value in _bytes(batch, "text"):
                for piece in chunks_of(normalised(value), gear):
                    found[piece] = identifier(piece, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.values(), pa.binary()), pa.array(found.keys(), pa.binary())], ["chunk_id", "chunk"]
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(trimmed(cut), "chunk_id binary, chunk binary")


def recipe_table(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, text_sha256, recipe): the identifiers of a text's chunks in order, one after the other."""
    id_type = docs.schema[doc_id].dataType

    def recipes(batches):
        gear = _gear()
        for batch in batches:
            texts = [normalised(x) for x in _bytes(batch, "text")]
            lists = [b"".join(identifier(c, width) for c in chunks_of(t, gear)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array(lists, pa.binary()),
                ],
                ["doc_id", "text_sha256", "recipe"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(recipes), f"doc_id {id_type.simpleString()}, text_sha256 string, recipe binary")


def verified_width(docs: DataFrame, text: str, widths: tuple[int, ...] = WIDTHS) -> int:
    """The first digest width at which every identifier stands for one chunk only, found by comparing the bytes."""
    for width in widths:
        distinct = chunk_table(docs, text, width).distinct()
        if distinct.groupBy("chunk_id").count().where("count > 1").isEmpty():
            return width
    raise ValueError(f"different chunks share an identifier of {widths[-1]} bytes")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", widths: tuple[int, ...] = WIDTHS
) -> DataFrame:
    """A row per document with the document that stands for its text.

    Returns doc_id, keep_id (smallest doc_id of the equal texts), group_size (rows),
    kept, text_sha256 (of the text with each run of white space as one space).
    Null texts are empty, and all empty texts are equal. A null doc_id is never a
    keep_id unless the whole group has none. Of repeated rows with the keep_id, one
    is kept. Other columns are ignored; an empty table gives an empty result.
    """
    width = verified_width(lean(docs), text, widths)
    rows = stored(recipe_table(docs, doc_id, text, width), "recipes")
    groups = stored(
        rows.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"),
        "recipe-groups",
    )
    # Only rows of groups have a partner; a group of any size is a row there.
    joined = join_counted(rows, groups, ["recipe"])
    listed = joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        "text_sha256",
        "recipe",
    )
    # Repeated rows with one doc_id: one of them counts as the first.
    repeated = listed.groupBy("doc_id", "keep_id", "group_size", "text_sha256", "recipe").agg(
        F.count(F.lit(1)).alias("__n")
    )
    return repeated.select(
        "doc_id",
        "keep_id",
        "group_size",
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).alias("__copy"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; one row of each text."""
    groups = stored(exact_groups(docs, doc_id, text), "exact-groups")
    per_id = groups.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept_rows")
    )
    changed = stored(per_id.where("rows > 1 OR kept_rows = 0"), "changed-documents")
    # The marks have names of their own: the documents may have any columns.
    marks = changed.select(
        F.col("doc_id").alias("__id"), F.lit(True).alias("__hit"), (F.col("kept_rows") > 0).alias("__some")
    )
    small = marks.count() <= 2_000_000  # At most 20 bytes a row, so some 40 MB.
    marked = docs.join(F.broadcast(marks) if small else marks, F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    single = marked.where("__hit IS NULL").select(*docs.columns)
    # Rows that share a doc_id: settled by their texts, of which few are left.
    several = marked.where("__some").withColumn("__sha", F.sha2(_one_space(F.col(text)), 256))
    several = several.dropDuplicates(["__id", "__sha"])
    heads = groups.where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    several = several.join(
        heads, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi"
    )
    return single.unionByName(several.select(*docs.columns))


def _one_space(text):
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))
