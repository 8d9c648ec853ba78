"""A small corpus with every odd case, and plain Python answers to compare with."""

from __future__ import annotations

import random

from pyspark.sql import types as T

# Columns of the corpus: two as the operators need, others with names the operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("size", "kept", "shard", "key", "n", "token", "component", "part")],
    ]
)


def texts(seed: int = 1, words: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(400)] + ["É", "ßü", "日本"]

    def prose(n):
        return " ".join(rnd.choices(vocabulary, k=n))

    passage = prose(40)
    base = prose(words)
    near = []
    for i in range(8):
        parts = base.split(" ")
        parts[rnd.randrange(len(parts))] = f"changed{i}"
        near.append(" ".join(parts))
    return [
        *[prose(rnd.randint(1, words)) for _ in range(25)],
        None,
        "",
        "   \n\t",
        "one",
        "one",
        "ONE",
        "a b c d e",
        "A  b\nc d e",
        base,
        base,
        base.replace(" ", "  "),
        *near,
        *[f"{prose(30)} {passage} {prose(30)}" for _ in range(4)],
        passage + " " + passage,
        "x" * 700,
        "<|endoftext|> inside <|endoftext|>",
        prose(3000),
    ]


def rows(seed: int = 1):
    """Distinct ids in no order, sources of unlike sizes with a null one."""
    all_texts = texts(seed)
    ids = random.Random(seed + 1).sample(range(10_000), len(all_texts))
    sources = ["s0", "s1", None, "s0", "s2", "s0"]
    return [
        (i, t, "en", sources[k % len(sources)], None if t is None else len(t), *["clash"] * 8)
        for k, (i, t) in enumerate(zip(ids, all_texts))
    ]


def frame(spark, data=None, partitions: int = 4):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(partitions)


def shingle_sets(data) -> dict[int, frozenset]:
    sets = {}
    for doc_id, text, *_ in data:
        words = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    return sets


def similar_components(data) -> dict[int, int]:
    sets = shingle_sets(data)
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                linked = shared and 100 * shared >= 75 * len(sets[a] | sets[b])
                if linked and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def covered_bytes(data, length: int) -> dict[int, list[bool]]:
    seen, marks = set(), {}
    for doc_id, text, *_ in sorted(data, key=lambda r: r[0]):
        body = (text or "").encode()
        mark = [False] * len(body)
        for i in range(len(body) - length + 1):
            piece = body[i : i + length]
            if piece in seen:
                mark[i : i + length] = [True] * length
            seen.add(piece)
        marks[doc_id] = mark
    return marks
