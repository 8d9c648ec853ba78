"""Packing by deficit round-robin over source queues, each window filled to the target proportions.

Each source is a queue of tokens. Every window of ``length`` tokens takes from each
queue its share; the fraction of a token that a queue is owed is its deficit and is
carried to the next window. The deficits need no running state: token t of a queue
of W tokens is due at time (t + 1/2) / W, windows are ``length`` tokens each in the
order of these times, and what any window takes follows from the queues' totals
alone. So a window means the same in every task, and deficits carry across
windows and partitions alike. All queues run dry together, in the last window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import stored
from .common import join_counted, lean, offsets_before, trimmed
from .tokens import has_long_white, load_fast, load_tokenizer, spliced_ids

LENGTH = 1024
END = 0  # The id after each document.
# Queues of a schedule. More sources than that share queues by hash, one after the other.
QUEUES = 4096
# A longer text is encoded in chunks, which bounds what the encoder holds.
WHOLE = 1_000_000
# Numbers of a block of windows or tokens by queues, and tokens that a task cuts at a time.
CELLS = 500_000
RUN_TOKENS = 200_000
# Times that are guessed before a window's end is found by bisection.
GUESSES = 12


def tokenised(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Stored rows (doc_id, source, part, start, tokens, ids): ids as little-endian unsigned 16-bit numbers.

    ``start`` counts the source's tokens earlier in the same part. Written once,
    so that parts and starts stay what they are.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def encode(batches):
        part, started, fast, exact = TaskContext.get().partitionId(), {}, None, None
        for batch in batches:
            fast = fast or load_fast()
            starts, lengths, ids = [], [], []
            sources = batch.column("source").to_pylist()
            for name, raw in zip(sources, batch.column("text").cast(pa.binary()).to_pylist()):
                value = (raw or b"").decode("utf-8", "replace")
                if len(value) > WHOLE:
                    exact = exact or load_tokenizer()
                    found = spliced_ids(exact, value)
                elif has_long_white(value):
                    exact = exact or load_tokenizer()
                    found = exact.encode(value, add_special_tokens=False).ids
                else:
                    found = fast.encode(value, allowed_special="all")
                found.append(END)
                starts.append(started.get(name, 0))
                started[name] = starts[-1] + len(found)
                lengths.append(len(found))
                ids.append(np.array(found, np.uint16).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sources, pa.string()),
                    pa.array([part] * len(ids), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "source", "part", "start", "tokens", "ids"],
            )

    rows = lean(docs).select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    )
    schema = f"doc_id {id_type}, source string, part bigint, start bigint, tokens bigint, ids binary"
    return stored(rows.mapInArrow(trimmed(encode), schema), "tokens")


def due(times: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each time and queue: the queue's tokens due by then."""
    return np.floor(times[:, None] * totals + 0.5).astype(np.int64)


def taken_before(windows: np.ndarray, totals: np.ndarray, length: int) -> np.ndarray:
    """For each window and queue: the queue's tokens in all earlier windows."""
    all_tokens = int(totals.sum())
    goal = np.minimum(windows.astype(np.int64) * length, all_tokens)
    low = np.maximum(0.0, (goal - len(totals) - 1) / all_tokens)
    high = (goal + len(totals) + 1) / all_tokens
    counts = np.zeros((len(goal), len(totals)), np.int64)
    live, guess, turn, tied = np.arange(len(goal)), goal / all_tokens, 0, []
    while len(live):
        # What is missing tells where to look next; bisection ends what that does not find.
        near = (turn < GUESSES) & (low[live] < guess) & (guess < high[live])
        at = np.where(near, guess, (low[live] + high[live]) / 2)
        open_ = (low[live] < at) & (at < high[live])
        tied.append(live[~open_])
        live, at, turn = live[open_], at[open_], turn + 1
        found = due(at, totals)
        over = found.sum(axis=1) - goal[live]
        counts[live[over == 0]] = found[over == 0]
        high[live[over > 0]] = at[over > 0]
        low[live[over < 0]] = at[over < 0]
        live, guess = live[over != 0], (at - over / all_tokens)[over != 0]
    # Tokens that fall due at the very same time go by the order of the queues.
    rows = np.concatenate([*tied, np.zeros(0, np.int64)])
    if len(rows):
        base = due(low[rows], totals)
        missing = (goal[rows] - base.sum(axis=1))[:, None]
        jump = due(high[rows], totals) - base
        earlier = np.cumsum(jump, axis=1) - jump
        counts[rows] = base + np.clip(missing - earlier, 0, jump)
    return np.minimum(counts, totals)


def touched(queue: np.ndarray, start: np.ndarray, end: np.ndarray, totals: np.ndarray, length: int):
    """First and last window that tokens ``start`` to ``end`` (not included) of a queue can fall in.

    All tokens due earlier are counted, so only tokens due at the very same time leave more than one window open.
    """
    first, last = np.empty(len(queue), np.int64), np.empty(len(queue), np.int64)
    step = max(1, CELLS // len(totals))
    for i in range(0, len(queue), step):
        part = slice(i, i + step)
        total = totals[queue[part]]
        rank = due((start[part] + 0.5) / total * (1 - 1e-12), totals).sum(axis=1)
        first[part] = np.maximum(-(-rank // length) - 1, 0)
        rank = due((end[part] - 0.5) / total * (1 + 1e-12), totals).sum(axis=1)
        last[part] = np.maximum(rank - 1, 0) // length
    return first, np.minimum(last, (int(totals.sum()) - 1) // length)


def schedule_pieces(queue: np.ndarray, place: np.ndarray, tokens: np.ndarray, totals: np.ndarray, length: int):
    """Cut documents, given by queue and place in it, at the windows: (row, start, end, window, offset) arrays.

    A document of a rare queue is spread over many windows, so a run of its tokens is
    one token and only the windows of these are looked at. Runs are taken ``RUN_TOKENS``
    tokens at a time, windows ``CELLS`` numbers at a time: the memory follows the tokens.
    """
    # Of a queue with a token in each window a run may be as long as it likes.
    most = np.where(int(totals.sum()) > totals[queue] * length, 1, RUN_TOKENS)
    row, done = 0, 0
    while row < len(queue):
        rows, begins, ends, room = [], [], [], RUN_TOKENS
        while row < len(queue) and room > 0:
            take = min(room, int(tokens[row]) - done)
            begin = np.arange(done, done + take, most[row], dtype=np.int64)
            rows.append(np.full(len(begin), row, np.int64))
            begins.append(begin)
            ends.append(np.minimum(begin + most[row], done + take))
            room, done = room - take, done + take
            if done == tokens[row]:
                row, done = row + 1, 0
        of = np.concatenate(rows)
        begin, end = place[of] + np.concatenate(begins), place[of] + np.concatenate(ends)
        yield _cut_runs(of, begin, end, queue, place, tokens, totals, length)


def _cut_runs(of, begin, end, queue, place, tokens, totals, length: int) -> np.ndarray:
    """The pieces that begin in the runs ``begin`` to ``end`` of the documents ``of``."""
    first, last = touched(queue[of], begin, end, totals, length)
    count = last - first + 1
    run = np.repeat(np.arange(len(of)), count)
    window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    order = np.argsort(window, kind="stable")
    run, window = run[order], window[order]
    windows, at = np.unique(window, return_index=True)
    step = max(1, CELLS // len(totals) // 2)
    found = [np.zeros((5, 0), np.int64)]
    for i in range(0, len(windows), step):
        part = slice(at[i], at[i + step] if i + step < len(windows) else len(window))
        r, w = run[part], window[part]
        edges = np.unique(np.r_[windows[i : i + step], windows[i : i + step] + 1])
        before = taken_before(edges, totals, length)
        inside = np.cumsum(before, axis=1) - before  # of earlier queues, all windows before
        here, row = np.searchsorted(edges, w), of[r]
        q = queue[row]
        start = np.maximum(place[row], before[here, q])
        stop = np.minimum(place[row] + tokens[row], before[here + 1, q])
        offset = inside[here + 1, q] - inside[here, q] + start - before[here, q]
        keep = (stop > start) & (begin[r] <= start) & (start < end[r])
        found.append(np.stack([row, start - place[row], stop - place[row], w, offset])[:, keep])
    return np.concatenate(found, axis=1)


def pack_mixture(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    length: int = LENGTH,
    queues: int = QUEUES,
) -> DataFrame:
    """A row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``END``; its pieces hold each id once. Every
    sequence but the last has exactly ``length`` tokens, and each queue's part of it
    is within some tokens of its target, its share of all tokens. A null text is
    empty (one token), a null source is a source. Repeated rows are packed like others.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = tokenised(docs, doc_id, source, text)
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "totals")
    many = totals.count() > queues
    slot = F.pmod(F.xxhash64("source"), F.lit(queues)) if many else F.row_number().over(Window.orderBy("source")) - 1
    table = totals.withColumn("queue", slot.cast("int"))
    earlier = Window.partitionBy("queue").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    table = stored(table.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))), "queues")
    # At most ``queues`` numbers.
    sums = {r[0]: r[1] for r in table.groupBy("queue").agg(F.sum("total")).collect()}
    order = sorted(sums)
    index, weights = {q: i for i, q in enumerate(order)}, np.array([sums[q] for q in order], np.int64)
    before = offsets_before(rows, ["source"], "part", F.col("tokens"), "__before")
    placed = join_counted(join_counted(rows, table, ["source"], "inner"), before, ["source", "part"], "inner")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            queue = np.array([index[q] for q in batch.column("queue").to_pylist()], np.int64)
            place, tokens = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "tokens"))
            ids = [np.frombuffer(x, "<u2").astype("<u4") for x in batch.column("ids").to_pylist()]
            for row, start, end, window, offset in schedule_pieces(queue, place, tokens, weights, length):
                crc = [zlib.crc32(ids[r][a:b]) for r, a, b in zip(row.tolist(), start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        batch.column("source").take(pa.array(row)),
                        pa.array(start),
                        pa.array(end - start),
                        pa.array(crc, pa.int64()),
                        pa.array(tokens[row]),
                        pa.array(window),
                        pa.array(offset),
                    ],
                    names,
                )

    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, " + ", ".join(f"{c} bigint" for c in names[2:])
    return placed.select(
        "doc_id", "source", "queue", (F.col("base") + F.col("__before") + F.col("start")).alias("place"), "tokens", "ids"
    ).mapInArrow(trimmed(cut), schema)
