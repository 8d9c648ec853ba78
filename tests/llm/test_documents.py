"""Operators on documents against plain Python, odd cases included."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tidegraph.llm import mixing, packing, recipes, repeats, sharding, shingle_join, suffixes, syncmers, tokens

from . import corpus


@pytest.fixture(scope="module")
def data():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return corpus.frame(spark, data)


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


@pytest.fixture(scope="module")
def twice(spark, data):
    """Every third row again, and some rows without doc_id."""
    loose = [(None, t, *rest) for _, t, *rest in data[:3]]
    return corpus.frame(spark, data + data[::3] + loose)


def ids_of(text):
    return tokens.load_tokenizer().encode(text or "", add_special_tokens=False).ids


# Fingerprints


def test_anchors_depend_on_their_kmer_alone():
    shared = "the quick brown fox jumps over the lazy dog again and again"
    a, b = syncmers.anchors("first " + shared), syncmers.anchors("a longer beginning " + shared)
    tail = set(zip((a[0] - 6).tolist(), a[1].tolist()))
    other = set(zip((b[0] - 19).tolist(), b[1].tolist()))
    assert {x for x in tail if x[0] >= 0} == {x for x in other if x[0] >= 0}


def test_anchors_are_closed_syncmers():
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    at = set(syncmers.anchors(text)[0].tolist())
    with np.errstate(over="ignore"):
        inner = [int(syncmers._mixed(syncmers._mers(_codes(text[i : i + syncmers.S]), syncmers.S))[0]) for i in range(len(text) - syncmers.S + 1)]
    width = syncmers.K - syncmers.S
    expected = {
        i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + width + 1]) in (inner[i], inner[i + width])
    }
    assert at == expected


def _codes(text):
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)


def test_edited_fingerprints(docs, data):
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(docs).collect()}
    ordered = sorted(data, key=lambda r: r[0])
    assert len(got) == len(data)
    for (i, text, *_), (_, following, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following, row = text or "", following or "", got[i]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        prints = [syncmers.fingerprint(t) for t in (text, changed, following)]
        assert row["fingerprint"] == syncmers.encoded(prints[0])
        assert row["edited_fingerprint"] == syncmers.encoded(prints[1])
        assert row["near_edited"] == syncmers.likeness(prints[0], prints[1])
        assert row["near_next"] == syncmers.likeness(prints[0], prints[2])
        if len(text) > 100:
            assert row["near_edited"] > 0.15


def test_fingerprints_of_odd_tables(empty, twice):
    assert syncmers.edited_fingerprints(empty).count() == 0
    assert syncmers.edited_fingerprints(twice).count() == twice.count()
    assert syncmers.likeness(syncmers.fingerprint(""), syncmers.fingerprint("")) == 1.0
    assert syncmers.likeness(syncmers.fingerprint(""), syncmers.fingerprint("a")) == 0.0
    assert syncmers.syncmer_anchors(twice).count() > 0


# Tokens


@pytest.mark.parametrize("chunk,overlap", [(64, 40), (200, 33), (1000, 64)])
def test_spliced_ids_are_those_of_the_whole_text(data, chunk, overlap):
    tokenizer = tokens.load_tokenizer()
    odd = [" " * 300 + "a" * 300 + "'ll" * 100 + "<|endoftext|>" * 30 + "\n\n\n  x" * 40, "<|endof" * 60 + "é" * 90]
    for text in [r[1] for r in data if r[1]] + odd:
        assert tokens.spliced_ids(tokenizer, text, chunk, overlap) == ids_of(text)


def test_token_counts(docs, data, empty, twice):
    got = {r["doc_id"]: r for r in tokens.token_counts(docs, chunk=500).collect()}
    for i, text, *_ in data:
        n = len(ids_of(text))
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (n, len((text or "").encode()))
        assert got[i]["over_limit"] == (n > 1024)
    assert tokens.token_counts(empty).count() == 0
    assert tokens.token_counts(twice).count() == twice.count()


# Mixing


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and left * weight[s] / free > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else left * weight[s] / free for s in sizes}
        full |= more


def test_mixture_meets_its_targets(docs, data):
    got = mixing.pareto_mixture(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in data:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    taken = Counter()
    for row in got:
        assert row["__size"] == len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
        assert row["__source_size"] == sizes[row["source"]]
        assert row["__target"] == pytest.approx(targets[row["source"]])
        assert 0 <= row["__copies"] <= 2 and row["shard"] == "clash"
        taken[row["source"]] += row["__copies"] * row["__size"]
    assert len(got) == len(data)
    # What is promised: half of the smallest document that is left over, so at most half of the largest.
    largest = {s: max(r["__size"] for r in got if r["source"] == s) for s in targets}
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2
    key = lambda rows: sorted((r["doc_id"], r["__copies"]) for r in rows)
    assert key(got) == key(mixing.pareto_mixture(docs.repartition(7)).collect())


def test_mixture_of_odd_tables(empty, twice):
    assert mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(twice)
    assert mixed.columns == twice.columns
    copies = mixing.pareto_mixture(twice).groupBy("doc_id", "source", "__size").agg({"__copies": "min", "*": "count"})
    assert copies.count() > 0


def test_pareto_sampling_is_fair(spark):
    """Over many seeds each of equal documents is taken about as often as it is due."""
    rows_ = [(i, "a b c d", "en", "s0" if i < 40 else "s1", 7, *["clash"] * 8) for i in range(60)]
    frame = corpus.frame(spark, rows_, 2)
    taken = Counter()
    for seed in range(6):
        for r in mixing.pareto_mixture(frame, seed=seed).collect():
            taken[r["doc_id"]] += r["__copies"]
    share = sum(taken[i] for i in range(40)) / 6 / 40
    assert 1.0 <= share <= 2.0 and len({taken[i] for i in range(40)}) > 1


def plain_chances(sizes, words):
    """Probability of each size in proportion to it, up to one, that adds up to the words."""
    certain = set()
    while True:
        free = [s for s in sizes if s not in certain]
        rate = (words - sum(s for s in sizes if s in certain)) / sum(s * s for s in free)
        more = {s for s in free if rate * s >= 1}
        if not more:
            return {s: 1.0 if s in certain else rate * s for s in sizes}
        certain |= more


def test_inclusion_follows_the_sizes(spark):
    """Of one source, half of whose words are taken twice: long documents more often, the longest always."""
    sizes = [1, 2, 4] * 1500 + [3000] * 2 + [2500] + [9000]
    rows_ = [(i, "w " * n, "en", "s0", 7, *["clash"] * 8) for i, n in enumerate(sizes)]
    chance = plain_chances(sizes, sum(sizes) / 2)
    assert chance[9000] == 1 and chance[1] < chance[2] < chance[4] < 1
    got = mixing.pareto_mixture(corpus.frame(spark, rows_, 2), seed=5).collect()
    copies = defaultdict(list)
    for row in got:
        copies[row["__size"]].append(row["__copies"] - 1)
    assert copies[9000] == [1]
    for n in (1, 2, 4):
        drawn, p, rows_n = sum(copies[n]), chance[n], len(copies[n])
        # Five standard errors, and what one of the long documents more or less lets in.
        moved = sum(s * (1 - chance[s]) for s in (2500, 3000, 3000))
        assert abs(drawn / rows_n - p) <= 5 * (p * (1 - p) / rows_n) ** 0.5 + moved / sum(s for s in sizes if s <= 4)
    # What is promised: half of the largest document that may be left over.
    assert abs(sum(r["__size"] * r["__copies"] for r in got) - 1.5 * sum(sizes)) <= 3000 / 2


# Removal of repeats


def test_suffix_arrays_and_prefixes(monkeypatch):
    rng = np.random.default_rng(2)
    for turn in range(300):
        monkeypatch.setattr(suffixes, "MANY_SYMBOLS", 1 if turn % 2 else 2048)
        symbols = int(rng.integers(1, 5))
        s = np.r_[np.tile(rng.integers(1, symbols + 1, rng.integers(0, 25)), rng.integers(1, 4)), 0].astype(np.uint16)
        listed = s.tolist()
        order = sorted(range(len(listed)), key=lambda i: listed[i:])
        array = suffixes.suffix_array(s, symbols + 1)
        assert array.tolist() == order
        before, shared = suffixes.permuted_prefixes(s, array)
        for a, b in zip(order, order[1:]):
            common = next(k for k in range(len(listed)) if listed[a + k] != listed[b + k])
            assert (before[b], shared[b]) == (a, common)


@pytest.mark.parametrize("length", [100, 40])
def test_repeats(docs, data, length, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs, length=length).collect()}
    marks = corpus.covered_bytes(data, length)
    assert len(got) == len(data)
    for i, text, *_ in data:
        body, mark = (text or "").encode(), marks[i]
        kept = bytes(b for b, m in zip(body, mark) if not m)
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        row = got[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(body), sum(mark), spans)
        assert bytes(row["kept"]) == kept and len(row["spans"]) == spans


def test_repeats_of_a_passage_in_many_contexts(spark, monkeypatch):
    """Every document has text of its own around one passage; no shard gets the segments of all of them."""
    rnd = random.Random(8)

    def noise(n):
        return "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    passage = noise(150)
    rows_ = [(i, f"{noise(120)}{passage}{noise(120)}", *[None] * 11) for i in range(300)]
    rows_ += [(900, rows_[3][1][40:330], *[None] * 11)]  # Two whole contexts again.
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", 20)
    seen = []
    plain = repeats.segment_shards

    def kept(*given):
        packed = plain(*given)
        sizes = packed.where("known <> 1").selectExpr("shard", "length(docs) div 8 AS n").groupBy("shard").sum("n")
        seen.extend(r[1] for r in sizes.collect())
        return packed

    monkeypatch.setattr(repeats, "segment_shards", kept)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(corpus.frame(spark, rows_)).collect()}
    assert got == {i: sum(m) for i, m in corpus.covered_bytes(rows_, 100).items()}
    assert max(seen) < 300


def test_repeats_without_broadcasts(docs, data, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(repeats, "COPY_IDS", 0)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.without_repeats(docs).collect()}
    assert got == {i: sum(m) for i, m in corpus.covered_bytes(data, 100).items()}


def test_repeats_of_ids_with_several_texts(spark):
    """Rows of one doc_id with other text are other documents, the one with the smaller digest first."""
    rnd = random.Random(4)
    a, b, shared = ("".join(rnd.choices("abcdefgh ", k=300)) for _ in range(3))
    later = sorted([b + shared, shared + a[:120]], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows_ = [(n, t, *[None] * 11) for n, t in [(1, a), (5, a), *[(5, t) for t in later], (7, later[0]), (7, later[0]), (9, "short"), (9, None)]]
    # Numbered in the order that is stated, the rest is the plain rule.
    order = sorted({(n, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for n, t, *_ in rows_}, key=lambda x: x[:2])
    marks = corpus.covered_bytes([(i, t, *[None] * 11) for i, (_, _, t) in enumerate(order)], 100)
    want = {(n, len(t), sum(marks[i])) for i, (n, _, t) in enumerate(order)}
    got = repeats.without_repeats(corpus.frame(spark, rows_)).collect()
    assert len(got) == len(rows_)
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got} == want
    assert (5, 300, 300) in want and all(r["n_removed"] < r["n_bytes"] for r in got if r["doc_id"] == 5 and r["n_bytes"] > 300)


def test_repeats_of_odd_tables(empty, twice):
    assert repeats.without_repeats(empty).count() == 0
    assert repeats.without_repeats(twice).count() == twice.count()


# Packing


def check_packed(rows_, data, length=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    totals = Counter()
    for i, text, _, source, *_ in data:
        ids = np.array(ids_of(text) + [0], "<u4")
        totals[source] += len(ids)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    whole = sum(totals.values())
    for s, rs in sequences.items():
        at, by_source = 0, Counter()
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            by_source[r["source"]] += r["length"]
        if s < len(sequences) - 1:
            assert at == length
            for source, n in totals.items():
                assert abs(by_source[source] - length * n / whole) <= len(totals)
        else:
            assert at == whole - length * s


def test_packing(docs, data):
    check_packed(packing.pack_mixture(docs).collect(), data)
    check_packed(packing.pack_mixture(docs.repartition(9), length=64).collect(), data, 64)


def test_packing_with_fewer_queues_than_sources(docs, data):
    rows_ = packing.pack_mixture(docs, queues=2).collect()
    assert sum(r["length"] for r in rows_) == sum(len(ids_of(t)) + 1 for _, t, *_ in data)


def test_packing_of_odd_tables(empty, twice):
    assert packing.pack_mixture(empty).count() == 0
    total = packing.pack_mixture(twice).selectExpr("sum(length) AS n", "max(offset) AS o").first()
    assert total["n"] == sum(len(ids_of(r["text"])) + 1 for r in twice.collect()) and total["o"] < 1024


def test_a_rare_source_costs_its_tokens_alone(monkeypatch):
    """Many sources of one document beside a large one: all pieces, and no array of all windows."""
    rnd = random.Random(4)
    totals = np.array([40_000_000] + [rnd.choice([7, 60, 61]) for _ in range(300)], np.int64)
    queue = np.r_[np.arange(1, 301), [0] * 5]
    tokens = np.r_[totals[1:], [300, 1, 5000, 90, 7]]
    place = np.r_[np.zeros(300, np.int64), [0, 12_345_678, 999, 39_999_000, 39_999_993]]
    tracemalloc.start()
    pieces = np.concatenate(list(packing.schedule_pieces(queue, place, tokens, totals, 1024)), axis=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert_tokens_once(pieces, tokens)
    # Against the table of all windows, on totals that it suits; runs and blocks of few numbers.
    monkeypatch.setattr(packing, "CELLS", 100)
    monkeypatch.setattr(packing, "RUN_TOKENS", 50)
    totals = np.array([9000, 3, 40, 40, 1, 500, 40], np.int64)
    queue, tokens = np.array([0, 0, 1, 2, 3, 4, 5, 6, 0]), np.array([4000, 4999, 3, 40, 40, 1, 500, 40, 1])
    place = np.array([0, 4000, 0, 0, 0, 0, 0, 0, 8999])
    pieces = np.concatenate(list(packing.schedule_pieces(queue, place, tokens, totals, 32)), axis=1)
    assert_tokens_once(pieces, tokens)
    table = packing.taken_before(np.arange(-(-9624 // 32) + 1), totals, 32)
    taken = np.diff(table, axis=0)
    for row, start, end, window, offset in pieces.T.tolist():
        q = queue[row]
        assert table[window, q] <= place[row] + start and place[row] + end <= table[window + 1, q]
        assert offset == taken[window, :q].sum() + place[row] + start - table[window, q]
        # A piece is as long as window and document allow.
        assert start == 0 or place[row] + start == table[window, q]


def assert_tokens_once(pieces, tokens):
    held = [[] for _ in tokens]
    for row, start, end, *_ in pieces.T.tolist():
        held[row] += range(start, end)
    assert [sorted(x) for x in held] == [list(range(n)) for n in tokens.tolist()]


def test_windows_take_each_token_once_at_any_totals():
    rng = np.random.default_rng(5)
    for _ in range(30):
        totals = rng.integers(1, 3000, rng.integers(1, 30))
        windows = np.arange(-(-int(totals.sum()) // 64) + 1)
        taken = packing.taken_before(windows, totals, 64)
        assert (np.diff(taken, axis=0) >= 0).all() and (taken[-1] == totals).all()
        assert (taken.sum(axis=1) == np.minimum(windows * 64, totals.sum())).all()
        assert (np.abs(taken - np.outer(taken.sum(axis=1), totals / totals.sum())) <= len(totals)).all()


# Similarity join


@pytest.mark.parametrize("broadcast", [True, False])
def test_similar_documents(docs, data, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(shingle_join, "CANDIDATE_IDS", 0)
        monkeypatch.setattr(shingle_join, "HOT_ENTRIES", 2)
        monkeypatch.setattr(shingle_join, "SHARD_ENTRIES", 200)
    got = {r["doc_id"]: r for r in shingle_join.similar_documents(docs).collect()}
    sets, labels = corpus.shingle_sets(data), corpus.similar_components(data)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == labels


@pytest.mark.parametrize("centres", [True, False])
def test_blocks_find_every_link(docs, data, centres, monkeypatch):
    """Blocks of two sets lose nothing, not even where no set was compared with its centre before."""
    monkeypatch.setattr(shingle_join, "BLOCK_SETS", 2)
    if not centres:
        # Stars under other names, and no known component: the former centre is a member like the rest.
        real = shingle_join.block_links
        monkeypatch.setattr(
            shingle_join, "block_links",
            lambda star, labels, *rest: real(star.selectExpr("~a AS a", "b", "n"), labels.limit(0), *rest),
        )
        monkeypatch.setattr(shingle_join, "verified", lambda pairs, bodies: pairs.limit(0))
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.similar_documents(docs).collect()}
    assert got == corpus.similar_components(data)


def group_of_near_copies(m, edits, n=120, seed=3):
    """A text that is not in the table, and ``m`` copies with ``edits`` words of their own."""
    rng = np.random.default_rng(seed)
    base = [f"word{i}" for i in range(n)]
    rows = []
    for k in range(m):
        words = list(base)
        for e, at in enumerate(rng.choice(n, edits, replace=False)):
            words[at] = f"own{k}x{e}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("edits", [2, 4])
def test_stars_of_near_copies_grow_with_their_number(spark, edits, monkeypatch):
    """Candidate rows of a group of near copies grow in proportion, and its links are those of brute force."""
    found = {}
    for m in (40, 160):
        rows = group_of_near_copies(m, edits)
        sizes = []
        real = shingle_join.entry_stars
        with monkeypatch.context() as patch:
            def counted(*args):
                stars = real(*args)
                sizes.append(stars.count())
                return stars

            patch.setattr(shingle_join, "entry_stars", counted)
            frame = spark.createDataFrame(rows, "doc_id bigint, text string")
            got = {r["doc_id"]: r["component_id"] for r in shingle_join.similar_documents(frame).collect()}
        found[m] = sizes[0]
        assert got == corpus.similar_components(rows)
    assert found[160] < 7 * found[40]


def test_near_copies_of_odd_tables(docs, data, empty, twice):
    assert shingle_join.similar_documents(empty).count() == 0
    assert shingle_join.similar_documents(twice).count() == twice.count()
    labels = corpus.similar_components(data)
    kept = shingle_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(labels.values())
    again = [r["doc_id"] for r in shingle_join.without_near_copies(twice).collect() if r["doc_id"] is not None]
    assert sorted(again) == sorted(set(again))


# Sharding


def test_shards(docs, data):
    rows_ = sharding.hypergeometric_shards(docs, ["doc_id"], 7).collect()
    slots = defaultdict(list)
    for r in rows_:
        slots[r["shard"]].append(r["slot"])
    sizes = sorted(len(s) for s in slots.values())
    assert len(rows_) == len(data) and sizes[-1] - sizes[0] <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_tables(empty, twice, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 3)
    assert sharding.hypergeometric_shards(empty, ["doc_id"]).count() == 0
    rows_ = sharding.hypergeometric_shards(twice, ["doc_id", "text"], 4).collect()
    assert sorted(Counter(r["shard"] for r in rows_).values())[0] >= len(rows_) // 4
    assert len({(r["shard"], r["slot"]) for r in rows_}) == len(rows_) == twice.count()


def test_communication_matrix_and_its_law(monkeypatch):
    m = sharding.communication_matrix([5, 0, 12, 3], 3, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 12, 3] and m.sum(axis=0).tolist() == [7, 7, 6]
    rng = np.random.default_rng(4)
    exact = [sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)]
    monkeypatch.setattr(sharding, "_EXACT", 0)
    own = [sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)]
    assert abs(np.mean(exact) - np.mean(own)) < 0.2 and abs(np.std(exact) - np.std(own)) < 0.15
    assert np.std([sharding.hypergeometric(rng, 10**12, 10**12, 10**12) for _ in range(300)]) < 10**6


# Exact duplicates


def test_exact_groups(docs, data):
    groups = defaultdict(list)
    for i, text, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    got = {r["doc_id"]: r for r in recipes.exact_groups(docs).collect()}
    assert len(got) == len(data)
    for text, ids in groups.items():
        for i in ids:
            assert got[i].asDict() == {
                "doc_id": i,
                "keep_id": min(ids),
                "group_size": len(ids),
                "kept": i == min(ids),
                "text_sha256": hashlib.sha256(text.encode()).hexdigest(),
            }


def test_identifiers_are_widened_until_they_are_proven(docs, monkeypatch):
    assert recipes.verified_width(docs, "text", (1, 16)) == 16
    with pytest.raises(ValueError):
        recipes.verified_width(docs, "text", (1,))


def test_chunks_make_up_the_text():
    gear = recipes._gear()
    for data_ in (b"", b"a", b"a" * 200_000, np.random.default_rng(1).bytes(50_000)):
        pieces = recipes.chunks_of(data_, gear)
        assert b"".join(pieces) == data_ and all(len(p) <= recipes.MOST for p in pieces)


def test_exact_copies_of_odd_tables(docs, data, empty, twice):
    assert recipes.exact_groups(empty).count() == 0
    assert recipes.without_copies(empty).count() == 0
    kept = recipes.without_copies(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in recipes.exact_groups(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    again = recipes.without_copies(twice)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in again.collect()]
    assert len(texts) == len(set(texts)) == len(want)


def test_a_long_pre_token_is_encoded_in_linear_work():
    """Text without a boundary is joined in doubling steps; what follows it is spliced as ever."""

    class Counting:
        def __init__(self):
            self.inner, self.seen = tokens.load_tokenizer(), 0

        def encode(self, text, **options):
            self.seen += len(text)
            return self.inner.encode(text, **options)

    for n in (50_000, 200_000):
        text = "one two " * 30 + "x" * n + " and some words more" * 50
        counted = Counting()
        got = tokens.spliced_ids(counted, text, chunk=1024)
        assert got == counted.inner.encode(text, add_special_tokens=False).ids
        assert counted.seen < 12 * len(text)
