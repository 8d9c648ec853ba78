"""Token counts of texts of any length by overlap resynchronisation.

Short texts are encoded whole. A long text is cut into chunks that overlap. Each is
encoded with offsets, and neighbours are spliced where both begin a pre-token at the
same place far enough from the left chunk's end. From there on both agree with the
encoding of the whole text: pre-tokens are found from left to right without looking
back, so what follows a common beginning depends only on what follows it, and up to
there the left chunk has seen all that a pre-token or a special string can look at.
If the overlap holds no such place, it is doubled, and at last the left chunk itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import lean, trimmed

# Code points in a chunk and in the first overlap. The guard is more than any
# pre-token or special string looks ahead: 13 code points of the special string.
CHUNK, OVERLAP, GUARD = 16_384, 256, 32
MODEL = "byte_bpe_50k"
# The special string of the vocabulary and its id: fixed values.
SPECIAL = {"<|endoftext|>": 50256}


# White space in a row that the fast library is not asked to look through: it gives up at about a million.
LONG_WHITE = 100_000
_RUNS = re.compile(r"\s++")


def has_long_white(text: str) -> bool:
    return len(text) > LONG_WHITE and any(m.end() - m.start() > LONG_WHITE for m in _RUNS.finditer(text))


def load_tokenizer(path: str | None = None) -> Tokenizer:
    return Tokenizer.from_file(path or public_tokenizers.path(f"{MODEL}.json"))


def load_fast(path: str | None = None) -> tiktoken.Encoding:
    """The same vocabulary and rules in a library that encodes whole texts several times as fast."""
    with open(path or public_tokenizers.path(f"{MODEL}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        MODEL, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(SPECIAL)
    )


def _encoded(tokenizer: Tokenizer, text: str, start: int) -> tuple[list[int], dict[int, int]]:
    """Ids, and for each place in the whole text where a pre-token begins the index of its first id."""
    encoding = tokenizer.encode(text, add_special_tokens=False)
    begins, last = {}, -1
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:
            begins[start + at] = i
        last = -1 if word is None else word
    return encoding.ids, begins


def spliced_ids(
    tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD
) -> list[int]:
    """The ids of the whole text, encoded in overlapping chunks."""
    if len(text) <= chunk:
        return tokenizer.encode(text, add_special_tokens=False).ids
    done: list[int] = []
    left_start, left_end = 0, chunk
    ids, begins = _encoded(tokenizer, text[:left_end], 0)
    first = 0  # index in ids from which on they are not yet in done
    while left_end < len(text):
        right_end = min(len(text), left_end + chunk)
        width = overlap
        while True:
            right_start = left_end - width
            if right_start <= left_start:
                # Not even the whole left chunk has a common beginning: encode it again with as much
                # text once more behind it, so that all that is encoded adds up to a few times the text.
                left_end = min(len(text), left_end + max(chunk, left_end - left_start))
                # Ids before the splice are final; the left chunk began at a true pre-token.
                ids, begins = _encoded(tokenizer, text[left_start:left_end], left_start)
                break
            right_ids, right_begins = _encoded(tokenizer, text[right_start:right_end], right_start)
            common = [p for p in right_begins if right_start < p <= left_end - guard and p in begins]
            common = [p for p in common if begins[p] >= first]
            if common:
                splice = min(common)
                done += ids[first : begins[splice]]
                ids, begins, first = right_ids, right_begins, right_begins[splice]
                # The right chunk is true from the splice on; begin there if it must be joined later.
                ids, first = ids[first:], 0
                begins = {p: i - right_begins[splice] for p, i in begins.items() if p >= splice}
                left_start, left_end = splice, right_end
                break
            width *= 2
    return done + ids[first:]


def counter(chunk: int = CHUNK) -> Callable[[str], int]:
    """Counts a text's tokens; loads what it needs on first use."""
    fast, exact = load_fast(), []

    def count(text: str) -> int:
        if len(text) <= chunk:
            return len(fast.encode(text, allowed_special="all"))
        if not exact:
            exact.append(load_tokenizer())
        return len(spliced_ids(exact[0], text, chunk))

    return count


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = CHUNK
) -> DataFrame:
    """A row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Special strings inside a text are tokens of their own, as the library has it by
    default; no token is added. A null text is empty and has 0 tokens. Bytes that
    are no UTF-8 count as the replacement character. Repeated rows and null ids stay
    as they are, other columns are ignored, an empty table gives an empty result.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def count(batches):
        tokens = None
        for batch in batches:
            tokens = tokens or counter(chunk)
            raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = [tokens(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return lean(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        trimmed(count), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
