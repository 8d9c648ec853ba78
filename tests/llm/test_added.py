"""Near copies by SuperMinHash, lockstep alignment and Merkle manifests against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidegraph.llm import alignment, merkle, packing, superminhash, tokens
from tidegraph.storage import Scratch, work_dir

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


def left_behind(spark):
    """Tables in the work folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in system.listStatus(place)} if system.exists(place) else set()


# Signatures


def plain_signature(elements, slots):
    """One element after the other, each with a whole permutation of its own."""
    out = [None] * slots
    for x in elements.tolist():
        order = list(range(slots))
        for rank in range(slots):
            bits = int(superminhash._mixed(np.array([x + (rank + 1) * superminhash._ODD & (1 << 64) - 1], np.uint64))[0])
            drawn = rank + ((bits & 0xFFFFFFFF) * (slots - rank) >> 32)
            order[rank], order[drawn] = order[drawn], order[rank]
            offer = rank << 32 | bits >> 32
            if out[order[rank]] is None or offer < out[order[rank]]:
                out[order[rank]] = offer
    return out


@pytest.mark.parametrize("slots", [7, 40])
def test_signatures_stop_early_and_lose_nothing(slots):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 5, 0, 30, 400, 3000)]
    got = superminhash.signatures(sets, slots)
    for elements, row in zip(sets, got.tolist()):
        if len(elements):
            assert row == plain_signature(elements, slots)
        else:
            assert set(row) == {(1 << 64) - 1}


def test_agreement_varies_less_than_with_independent_hashes():
    rng = np.random.default_rng(4)
    slots, errors = 64, []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 40, dtype=np.uint64)  # Fewer elements than slots: there the gain is largest.
        a, b = superminhash.signatures([pool[:32], pool[8:]], slots)
        errors.append(superminhash.agreement(a, b) - 24 / 40)
    independent = 0.6 * 0.4 / slots
    assert abs(np.mean(errors)) < 3 * (independent / 300) ** 0.5
    assert np.var(errors) < 0.8 * independent


def linked(data, words=3, similar=85):
    """Set sizes and components by comparing all pairs."""
    sets = {}
    for doc_id, text, *_ in data:
        found = [w for w in (text or "").encode().lower().translate(bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))).split(b" ") if w]
        sets[doc_id] = frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()
    label, changed = {d: d for d in sets}, True
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]) > 0]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return {d: (len(s), label[d]) for d, s in sets.items()}


def edited_copies(seed=6):
    """A text and copies of it that each change one word, so that copies are less alike than copy and text; chains."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for length, copies, edits in ((60, 40, 1), (200, 12, 4), (90, 6, 2)):
        base = rnd.choices(words, k=length)
        out.append(base)
        for _ in range(copies):
            copy = list(base)
            for at in rnd.sample(range(length), edits):
                copy[at] = f"x{rnd.randrange(10**6)}"
            out.append(copy)
    chain = rnd.choices(words, k=100)
    for _ in range(15):
        chain = list(chain)
        chain[rnd.randrange(100)] = f"y{rnd.randrange(10**6)}"
        out.append(chain)
    page = rnd.choices(words, k=50)
    out += [page + rnd.choices(words, k=25) for _ in range(15)]  # Alike, but not enough.
    return [" ".join(x) for x in out]


def test_near_copies(spark, docs, data):
    got = {r["doc_id"]: r for r in superminhash.near_copies(docs).collect()}
    want = linked(data)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


@pytest.mark.parametrize("sets,columns", [(3, 7), (512, 1 << 13)])
def test_groups_of_near_copies(spark, monkeypatch, sets, columns):
    monkeypatch.setattr(superminhash, "BLOCK_SETS", sets)
    monkeypatch.setattr(superminhash, "COLUMNS", columns)
    texts = edited_copies()
    ids = random.Random(1).sample(range(1000), len(texts))
    data = list(zip(ids, texts))
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    before = left_behind(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_copies(df).collect()}
    assert got == linked(data)
    assert len(left_behind(spark) - before) == 1  # The result alone.


def test_intersections_and_joining_links(monkeypatch):
    monkeypatch.setattr(superminhash, "COLUMNS", 5)
    rng = np.random.default_rng(8)
    a, b = ([np.unique(rng.integers(0, 60, n, dtype=np.uint64)) for n in sizes] for sizes in ((5, 30, 1), (40, 2, 20, 9)))
    assert superminhash.intersections(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for _ in range(50):
        linked = rng.random((6, 9)) < rng.random() / 3
        few = superminhash.joining_links(linked)
        assert all(linked[i, j] for i, j in few) and len(few) < 15

        def parts(pairs):
            label = list(range(15))
            for _ in label:
                for i, j in pairs:
                    label[i] = label[6 + j] = min(label[i], label[6 + j])
            return label

        assert parts(few) == parts(np.argwhere(linked).tolist())


def test_pairs_of_a_group_grow_with_the_group(spark):
    """A text and m copies of it: the pairs that are compared grow with m, not with its square."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(3000)}" for _ in range(80)]

    def compared(m):
        copies = [base] + [[f"z{i}" if k == i % 80 else w for k, w in enumerate(base)] for i in range(m)]
        df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(copies)], "doc_id bigint, text string")
        with Scratch(spark) as scratch:
            sets = scratch.stored(superminhash.signed_sets(df, "doc_id", "text"), "sets")
            members = superminhash.bucket_members(sets, scratch)
            return superminhash.stars(members).count()

    few, many = compared(40), compared(160)
    assert few <= 4 * 40 and many <= 8 * few  # The square would be 16 times as many.


def test_union_find_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "LOCAL_LINKS", 5)
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)]
    rnd.shuffle(links)
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
        got = {r["node"]: r["component"] for r in superminhash.united(df, scratch).collect()}
        none = superminhash.united(df.where("a < 0"), scratch)
        assert none.count() == 0
    want = {x: x for link in links for x in link}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {x: c for x, c in want.items() if any(x != y and want[y] == c for y in want)}


def test_near_copies_of_odd_tables(spark, empty, data):
    assert superminhash.near_copies(empty).count() == 0
    loose = [(None, t, *rest) for _, t, *rest in data[:3]]
    again = corpus.frame(spark, data + data[::3] + loose)
    got = superminhash.near_copies(again)
    assert got.count() == again.count()
    want = linked(data)
    for r in got.where("doc_id IS NOT NULL").collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    two = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "e f g h")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in superminhash.near_copies(two).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


# Alignment


def plain_alignment(encoders, texts):
    """Token by token."""
    exact, rows, pairs = alignment.exact_tokenizer(), [], Counter()
    table = alignment.byte_table(exact)
    for text in texts:
        a, b = [], []
        if text:
            a = exact.encode(" " + text, add_special_tokens=False).ids
            b = encoders.pieces.encode(text)
            whole = (" " + text).encode()
            if b"".join(table[i] for i in a) != whole or b"".join(encoders.bytes_b[i] for i in b) != whole:
                a, b = [], []
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((table, a), (encoders.bytes_b, b))]
        links = [(i, ends[1].index(e)) for i, e in enumerate(ends[0]) if e in ends[1]]
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append("|".join(",".join(map(str, ids)) for ids in (a[x : i + 1], b[y : j + 1])))
            x, y = i + 1, j + 1
        rows.append((len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links], ";".join(groups)))
        pairs.update(rows[-1][3])
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return [
        (na, nb, ng, len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for na, nb, ng, links, g in rows
    ], pairs


ODD = ["▁ a", "a▁", "<|endoftext|>", "<s> </s> <unk> <0x41>", "  two  spaces ", " ​﻿", "日本語 ﬁ ｆｕｌｌ", "🙂🙂 é", "\x00\x01", "'ll we've"]


@pytest.mark.parametrize("lane_bytes", [3, 64, 2048])
def test_alignment(spark, data, lane_bytes):
    rows = [(r[0], r[1]) for r in data] + [(20_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found, counts = alignment.align_tokenizers(df, lane_bytes=lane_bytes)
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    want, pairs = plain_alignment(alignment.Encoders(), [t for _, t in rows])
    assert got == dict(zip([i for i, _ in rows], want))
    assert {(r["a_id"], r["b_id"]): r["links"] for r in counts.collect()} == dict(pairs)


def test_alignment_does_not_depend_on_blocks(spark, docs, monkeypatch):
    whole = sorted(map(tuple, alignment.align_tokenizers(docs)[0].collect()))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, alignment.align_tokenizers(docs)[0].collect())) == whole


def test_both_libraries_have_one_vocabulary():
    encoders = alignment.Encoders()
    assert alignment.byte_table(alignment.exact_tokenizer())[: len(encoders.bytes_a)] == encoders.bytes_a
    long = " " * 1_200_000 + "x"
    assert encoders.ids(long) == alignment.exact_tokenizer().encode(" " + long, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    n = 999_999
    df = spark.createDataFrame([(1, "a", " " * n), (2, "a", "\t" * n)], "doc_id bigint, source string, text string")
    sums = packing.pack_mixture(df).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    exact = tokens.load_tokenizer()
    want = {1: len(exact.encode(" " * n, add_special_tokens=False).ids) + 1, 2: len(exact.encode("\t" * n, add_special_tokens=False).ids) + 1}
    assert {r[0]: (r[1], r[2]) for r in sums} == {d: (k, k) for d, k in want.items()}


def test_alignment_of_odd_tables(spark, empty, data):
    assert alignment.align_tokenizers(empty)[0].count() == 0
    again = corpus.frame(spark, data + data[::3] + [(None, t, *rest) for _, t, *rest in data[:3]])
    assert alignment.align_tokenizers(again)[0].count() == again.count()


# Manifests


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def plain_manifest(rows, fields, changed):
    """(order, leaf, subroot, root, proof, folded, verified) of every row; rows are dicts with source and doc_id."""
    leaf = [digest(*[plain_field(r[c]) for c in fields]) for r in rows]
    other = [digest(*[plain_field(changed(r)[c]) for c in fields]) for r in rows]
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r["source"], []).append(i)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf[i]))
        trees[s] = plain_tree([leaf[i] for i in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for place, i in enumerate(groups[s]):
            proof, node = [], other[i]
            for levels, at in ((trees[s], place), (top, rank)):
                for level in levels[:-1]:
                    first = at - at % 3
                    run = level[first : first + 3]
                    proof += [h for k, h in enumerate(run) if k != at - first]
                    node = digest(*[node if k == at - first else h for k, h in enumerate(run)])
                    at //= 3
            root = top[-1][0]
            out.append((rows[i]["doc_id"], leaf[i], trees[s][-1][0], root, digest(*proof), node, node == root))
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def without_lines(r):
    hit = zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"-") % 2 == 0
    return {**r, "text": r["text"].replace("\n", "")} if hit and r["text"] is not None else r


def manifest_of(df, unit=merkle.UNIT):
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")) % 2 == 0
    shorter = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified_manifest(df, FIELDS, "source", "doc_id", {"text": shorter}, unit)


@pytest.mark.parametrize("unit", [3, 9, merkle.UNIT])
def test_manifest(spark, unit):
    rnd = random.Random(unit)
    sources = [None, "", "é", "z", *[f"s{i}" for i in range(12)]]
    rows = [
        (i, rnd.choice(["a\nb", "plain", None, "", "ü\n\n"]) , "en" if i % 4 else None,
         "hot" if i % 3 == 0 else rnd.choice(sources), rnd.choice([None, i]))
        for i in rnd.sample(range(5000), 130)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    before = left_behind(spark)
    got = sorted(tuple(r) for r in manifest_of(df, unit).collect())
    assert got == sorted(plain_manifest([r.asDict() for r in df.collect()], FIELDS, without_lines))
    assert {r[-1] for r in got} == {True, False}
    assert len(left_behind(spark) - before) == 1


def test_manifest_of_odd_tables(spark, docs, empty, data):
    assert manifest_of(empty).count() == 0 and manifest_of(empty).columns == manifest_of(docs).columns
    one = corpus.frame(spark, data[:1])
    (row,) = manifest_of(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    again = corpus.frame(spark, data + data[::3] + [(None, t, *rest) for _, t, *rest in data[:3]])
    rows = [r.asDict() for r in again.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in manifest_of(again, 9).collect()), key=key)
    assert got == sorted(plain_manifest(rows, FIELDS, without_lines), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 100])
def test_places_in_the_append_log(n):
    """The closed form against nodes that are appended when their last leaf has arrived."""
    top = merkle.height(n)
    log = []
    for leaf in range(n):
        log.append((0, leaf))
        for h in range(1, top + 1):
            last = leaf == n - 1
            if (leaf + 1) % 3**h == 0 or last:
                log.append((h, leaf // 3**h))
    level, index = np.array(log).T
    places = merkle.postorder(level, index, np.full(len(log), n), top)
    assert places.tolist() == list(range(len(log)))


@pytest.mark.parametrize("n", [1, 2, 9, 10, 27, 50])
def test_paths_of_a_subtree_are_those_of_its_leaves(n):
    leaves, top = [merkle.node_digest([bytes([i])]) for i in range(n)], merkle.height(n) + 1
    log = merkle.append_log(leaves, top)
    each = [merkle.path_text(log, i, n, top) + "|above" for i in range(n)]
    assert merkle.subtree_paths(log, n, top, "above") == each


def test_any_change_of_leaf_or_sibling_is_seen():
    leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(23)]
    top = merkle.height(23)
    log = merkle.append_log(leaves, top)
    root = log[-1].decode()
    for i, leaf in enumerate(leaves):
        path = merkle.path_text(log, i, 23, top)
        assert merkle.folded(leaf.decode(), path) == root
        assert merkle.folded(hashlib.sha256(leaf).hexdigest(), path) != root
        for digest_ in path.replace("|", ",").split(","):
            if digest_ != merkle.OWN:
                assert merkle.folded(leaf.decode(), path.replace(digest_, digest_[::-1])) != root


def test_nodes_of_the_log(spark, docs):
    with Scratch(spark) as scratch:
        rows = docs.select("doc_id", "source", merkle.leaf_digest(*FIELDS).alias("d"))
        manifest = merkle.build_manifest(rows, F.col("d"), "source", "doc_id", scratch, unit=9)
        nodes = manifest.nodes().where("layer = 0").collect()
        for tree in manifest.roots.collect():
            mine = sorted((r["place"], r["digest"]) for r in nodes if r["tree"] == tree["tree"])
            leaves = manifest.leaves.where(f"tree = {tree['tree']}").orderBy("index").collect()
            n = len(leaves)
            log = merkle.append_log([r["digest"].encode() for r in leaves], merkle.height(n))
            assert mine == [(p, log[p].decode()) for p, _ in mine]  # Units' nodes stand where the whole log has them.
            if n <= 9:
                assert len(mine) == len(log)
