"""Alignment of two tokenizers' tokens by lockstep merging of their byte ends.

Both tokenizers cut the same bytes. Where a token of A and one of B end together is a
cut; the tokens between two cuts are a group. The ends of A and of B are two ascending
lists per document, and finding what they share is a merge. All documents of a batch
are merged at once: a state vector holds for each of them a place in A and one in B;
a step compares all ends, emits the links of those that agree and moves the pointers
that are behind; documents that are finished are taken out of the vector. A long text
is several lanes of the vector, since a merge may be cut at any byte offset.

The number of links of a pair of ids in the whole corpus is counted from blocks of
documents, each of which sends a pair once; the counts come back to the blocks in the
same way, so no row ever stands for a single token.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from ..storage import Scratch, stored
from .common import arrow_bytes, release, trimmed
from .tokens import has_long_white

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k", "piece_bpe_32k"
BLOCK_BYTES = 4_000_000  # Of text in a block of documents; a longer text is a block of its own.
LANE_BYTES = 2_048  # Of a lane of the merge.


def exact_tokenizer() -> Tokenizer:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{BYTE_MODEL}.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_table(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Printable bytes stand for themselves in an entry, the others for the characters from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    table = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        table[i] = bytes(byte_of[c] for c in entry)
    return table


def piece_table(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


class Encoders:
    """Both tokenizers, loaded once per worker, and the bytes of their ids."""

    def __init__(self):
        with open(public_tokenizers.path(f"{BYTE_MODEL}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{PIECE_MODEL}.model"))
        self.exact: Tokenizer | None = None
        in_order = {i: b for b, i in ranks.items()}
        self.bytes_a = [in_order.get(i, b"") for i in range(max(in_order) + 1)]
        self.bytes_b = piece_table(self.pieces)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = (_decimals(len(t)) for t in (self.bytes_a, self.bytes_b))

    def ids(self, text: str) -> list[int]:
        """A's ids of a space and the text.

        The fast library has the same vocabulary and rules but cannot look through
        white space of a million characters; there the exact one does the work.
        """
        if has_long_white(text):
            self.exact = self.exact or exact_tokenizer()
            return self.exact.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)

    def both(self, raw: bytes | None) -> tuple[list[int], list[int]]:
        """The ids of A and of B; none where the text is empty or either does not give back its bytes."""
        if not raw:
            return [], []
        text = raw.decode("utf-8", "replace")
        a, b = self.ids(text), self.pieces.encode(text)
        whole = b" " + raw
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return [], []
        return a, b


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1 with room for one more byte, and their numbers."""
    texts = np.array([str(i) for i in range(n)], "S")
    width = texts.dtype.itemsize + 1
    digits = np.zeros((n, width), np.uint8)
    digits[:, :-1] = texts.view(np.uint8).reshape(n, -1)
    return digits, np.char.str_len(texts).astype(np.int64)


def lanes(ends: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lane_bytes: int) -> np.ndarray:
    """For every lane of every document, the place in ``ends`` from which on they are above the lane's first byte.

    ``ends``: ends of all tokens, document after document; ``starts``: where a document's tokens begin, and the
    end of all; ``sizes``: bytes of each document. Lanes of a document follow each other.
    """
    counts = np.maximum(-(-sizes // lane_bytes), 1)
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * lane_bytes
    # One ascending list: every document's ends are moved beyond those of the documents before.
    shift = np.concatenate([[0], np.cumsum(sizes + 1)])
    moved = ends + np.repeat(shift[:-1], np.diff(starts))
    return np.searchsorted(moved, shift[doc] + first, "right")


def lockstep(ends_a, ends_b, starts_a, starts_b, sizes, lane_bytes: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` of the tokens that end together, in order.

    Every step moves, in each unfinished lane, the pointer that is behind, or both and emits a link.
    """
    at_a, at_b = (lanes(e, s, sizes, lane_bytes) for e, s in ((ends_a, starts_a), (ends_b, starts_b)))
    stop_a, stop_b = np.append(at_a[1:], len(ends_a)), np.append(at_b[1:], len(ends_b))
    found_a, found_b = [], []
    while True:
        going = (at_a < stop_a) & (at_b < stop_b)
        if not going.all():
            # Finished lanes leave the state.
            at_a, at_b, stop_a, stop_b = at_a[going], at_b[going], stop_a[going], stop_b[going]
        if not len(at_a):
            break
        a, b = ends_a[at_a], ends_b[at_b]
        link = a == b
        if link.any():
            found_a.append(at_a[link])
            found_b.append(at_b[link])
        at_a = at_a + (a <= b)
        at_b = at_b + (b <= a)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(found_a)
    return found_a[order], found_b[order]


def _starts(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def _ends(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(lengths[ids])])
    return total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))


class Aligned:
    """The tokens of several texts, their links and their groups."""

    def __init__(self, encoders: Encoders, texts: list[bytes | None], lane_bytes: int = LANE_BYTES):
        self.encoders = encoders
        pairs = [encoders.both(x) for x in texts]
        self.starts = [_starts([p[k] for p in pairs]) for k in (0, 1)]
        self.ids = [np.fromiter((i for p in pairs for i in p[k]), np.int64, self.starts[k][-1]) for k in (0, 1)]
        tables = (encoders.lengths_a, encoders.lengths_b)
        self.ends = [_ends(i, s, t) for i, s, t in zip(self.ids, self.starts, tables)]
        sizes = np.array([len(x) + 1 if p[0] else 0 for x, p in zip(texts, pairs)], np.int64)
        self.links = lockstep(*self.ends, *self.starts, sizes, lane_bytes)
        # The links of document d are those from bounds[d] to bounds[d + 1].
        self.bounds = np.searchsorted(self.links[0], self.starts[0])

    def groups(self) -> list[bytes]:
        """The groups of each document: ids of A parted by commas, a bar, ids of B, and so on after a semicolon."""
        n = [len(i) for i in self.ids]
        # A group is known by the link that ends it; a token by the first link at or after it.
        of = [np.searchsorted(link, np.arange(k)) for link, k in zip(self.links, n)]
        per = [np.bincount(g, minlength=len(self.links[0])) for g in of]
        before = [np.concatenate([[0], np.cumsum(p)]) for p in per]
        place_a = np.arange(n[0]) + before[1][of[0]]
        place_b = np.arange(n[1]) + before[0][of[1] + 1]
        width = max(t[0].shape[1] for t in (self.encoders.text_a, self.encoders.text_b))
        digits = np.zeros((n[0] + n[1], width), np.uint8)
        lengths = np.zeros(n[0] + n[1], np.int64)
        last = [np.zeros(k, bool) for k in n]
        for k, (place, (table, size)) in enumerate(
            zip((place_a, place_b), (self.encoders.text_a, self.encoders.text_b))
        ):
            digits[place, : table.shape[1]] = table[self.ids[k]]
            lengths[place] = size[self.ids[k]]
            last[k][self.links[k]] = True
            digits[place, lengths[place]] = np.where(last[k], ord("|;"[k]), ord(","))
        text = digits[np.arange(width) < (lengths + 1)[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        cut = ends[self.starts[0] + self.starts[1]]
        # Without the separator after the last group.
        return [text[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def aligned_blocks(docs: DataFrame, doc_id: str, text: str, lane_bytes: int = LANE_BYTES) -> DataFrame:
    """A row per block of documents: block, for each document doc_ids, n_a, n_b, n_groups and groups_sha256,
    the block's distinct id pairs with the number of their links, and of each document's links the pairs they are.
    """
    id_type = docs.schema[doc_id].dataType
    arrow_id = to_arrow_type(id_type)

    def align(batches):
        encoders, part, k = None, TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoders = encoders or Encoders()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = Aligned(encoders, texts, lane_bytes)
            n = [np.diff(s) for s in found.starts]
            pair = found.ids[0][found.links[0]] << 32 | found.ids[1][found.links[1]]
            distinct, index, counts = np.unique(pair, return_inverse=True, return_counts=True)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
            columns = [
                ("block", part | k, pa.int64()),
                ("doc_ids", batch.column("doc_id").to_pylist(), pa.list_(arrow_id)),
                ("n_a", n[0], pa.list_(pa.int64())),
                ("n_b", n[1], pa.list_(pa.int64())),
                ("n_links", np.diff(found.bounds), pa.list_(pa.int64())),
                ("groups_sha256", digests, pa.list_(pa.string())),
                ("pairs", distinct, pa.list_(pa.int64())),
                ("counts", counts, pa.list_(pa.int64())),
                ("links", index.astype("<u2" if len(distinct) < 1 << 16 else "<u4").tobytes(), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for _, v, t in columns], [c for c, _, _ in columns])
            k += 1

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = id_type.simpleString()
    return rows.mapInArrow(
        trimmed(align),
        f"block bigint, doc_ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, "
        "groups_sha256 array<string>, pairs array<bigint>, counts array<bigint>, links binary",
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of the corpus hold an id pair (A's id times 2^32 plus B's), and whether
    no pair with the same id of B has more."""
    sent = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = sent.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("links"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("links").alias("most"))
    best = counts.join(highest, b_id == F.col("b"))
    return best.select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_tokenizers(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lane_bytes: int = LANE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The alignment of every row's tokens, and the counts of linked id pairs (a_id, b_id, links, best).

    The first has a row per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the most links
    of all pairs with its id of B), count_sum (over links, the corpus-wide links of their pair), groups_sha256 (of
    the groups as text). Texts that are null or empty or that either tokenizer does not give back byte by byte have
    no tokens: zeros and an empty digest. No token has no bytes, so each cut is one link. Repeated rows and null ids
    stay as they are, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    kind = id_type.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        n_pairs = row["n_pairs"].as_py()
        links, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
        at = found.column("pos").to_numpy()
        links[at] = found.column("links").to_numpy()
        best[at] = found.column("best").to_numpy(zero_copy_only=False)
        index = np.frombuffer(row["links"].as_py(), "<u2" if n_pairs < 1 << 16 else "<u4")
        n = row["n_links"].values.to_numpy()
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[0], np.cumsum(v[index])]) for v in (best, links)]
        values = [
            row["doc_ids"].values,
            row["n_a"].values,
            row["n_b"].values,
            pa.array(n, pa.int64()),
            pa.array(n, pa.int64()),
            *[pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums],
            row["groups_sha256"].values,
        ]
        release()
        return pa.table(dict(zip(names, values)))

    with Scratch(spark) as scratch, arrow_bytes(spark, BLOCK_BYTES):
        blocks = scratch.stored(aligned_blocks(docs, doc_id, text, lane_bytes), "aligned-blocks")
        counts = stored(pair_counts(blocks), "linked-pairs")
        asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair"))
        told = asked.join(counts, "pair").select(F.col("block").alias("asked_by"), "pos", "links", "best")
        kept = blocks.withColumn("n_pairs", F.size("pairs")).drop("pairs", "counts")
        fields = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"
        rows = kept.groupBy("block").cogroup(told.groupBy("asked_by")).applyInArrow(score, fields)
        rows = stored(rows, "alignments")
    a_id = F.shiftright("pair", 32)
    return rows, counts.select(
        a_id.alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "links", "best"
    )
