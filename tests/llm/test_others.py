"""Toxicity, dialogues, components and the pipeline."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import types as T
from tidegraph.llm import catalogue, components, perspectives, toxicity

from . import corpus

BAD = ["vile", "nasty", "horrid", "awful"]


def toxic_corpus(n=900, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        said = rnd.choices(words, k=30) + (rnd.choices(BAD, k=3) if toxic else [])
        rnd.shuffle(said)
        rows.append((i, " ".join(said), "en", "s0", 1, *["clash"] * 8))
        if i % 2 == 0 or rnd.random() < 0.2:
            labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_frames(spark):
    rows, labels = toxic_corpus()
    return corpus.frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_rows_held_out(toxic_frames):
    docs, labels = toxic_frames
    model = toxicity.train_toxicity(docs, labels)
    right = total = 0
    for r in toxicity.toxicity_scores(docs, model).where("held_out").collect():
        total += 1
        right += r["predicted"] == (r["doc_id"] % 6 == 0)
    assert total > 100 and right / total > 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sum(r["doc_id"] % 6 == 0 for r in kept.collect()) < 10


def test_labels_held_out_are_not_learnt(spark, toxic_frames):
    docs, labels = toxic_frames
    held = toxicity.held_out(labels["doc_id"])
    flipped = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int")).where(held).unionByName(labels.where(~held))
    assert toxicity.train_toxicity(docs, flipped) == toxicity.train_toxicity(docs, labels)


def test_toxicity_of_odd_tables(spark, toxic_frames):
    docs, labels = toxic_frames
    none = toxicity.train_toxicity(docs, labels.limit(0))
    odd = corpus.frame(spark, corpus.rows()[:40] + [(None, None, None, None, None, *[None] * 8)] * 2)
    scores = toxicity.toxicity_scores(odd, none).collect()
    assert len(scores) == 42 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in scores)
    model = toxicity.train_toxicity(docs, labels)
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(odd, model).collect())
    assert toxicity.train_toxicity(docs.limit(0), labels).weights == {}
    unsure = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    assert toxicity.train_toxicity(docs, unsure).weights


def test_negative_risk_is_not_followed():
    """With an overstated prior the clean loss would fall below zero; scores stay finite and in order."""
    toxic, clean = [[0]] * 50, [[0]] * 10 + [[1]] * 90
    weights, bias = toxicity.fit_nnpu(toxic, clean, 2, prior=0.4, steps=300)
    assert np.isfinite(weights).all() and weights[0] > weights[1]


TURNS = "conv_id bigint, turn int, role string, text string, rendered string, perspective string"


def rendered(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["conv_id"], r["perspective"]].append(r)
    return {k: sorted(v, key=lambda r: r["position"]) for k, v in out.items()}


def test_perspectives(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "BLOCK", 2)
    said = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (1, 4, "cy", "ok")]
    said += [(2, 0, "system", "alone"), (3, None, None, ""), (None, 0, "ann", "x"), (1, 1, "ann", "hi")]
    frame = spark.createDataFrame([(*s, "clash", "clash") for s in said], TURNS)
    got = rendered(perspectives.rotate_perspectives(frame).collect())
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (3, "unknown"), (None, "ann")}
    for (conv, view), rows in got.items():
        whole = "".join(r["rendered"] for r in rows)
        assert [r["position"] for r in rows] == list(range(len(rows)))
        for r in rows:
            assert whole[r["start_char"] : r["end_char"]] == r["rendered"]
            assert r["trained"] == (r["speaker"] == view)
            message = r["rendered"].split("|>\n", 1)[1][: -len("<|end|>\n")]
            if r["trained"]:
                assert r["role"] == "assistant"
                assert whole[r["mask_start"] : r["mask_end"]] == message + "<|end|>"
            else:
                assert r["mask_start"] is None and r["mask_end"] is None
                assert r["role"] == ("system" if r["speaker"] == "system" else "user")
                assert r["role"] == "system" or f"<|user name={r['speaker']}|>" in r["rendered"]
    assert len(got[1, "ann"]) == 6
    assert perspectives.rotate_perspectives(frame.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(70)] + [(7, 7)]
    links += [(500, 500 + i) for i in range(1, 60)]
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components.connected_components(frame).collect()} == label
    assert components.connected_components(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, labels = toxic_corpus(420)
    shifted = [(i + 1000, *rest) for i, *rest in corpus.rows()]
    plain = spark.createDataFrame(rows + shifted, corpus.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn int, role string, text string").write.parquet(
        f"{path}/conversations.parquet"
    )
    return str(path)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        rows = after.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "toxicity":
            assert sum(i < 1000 and i % 6 == 0 for i in ids) < 8
            assert sum(i < 1000 and i % 6 != 0 for i in ids) > 340
        if name == "exact_dedup":
            assert len({" ".join((r["text"] or "").split()) for r in rows}) == len(rows) or any(r["text"] for r in rows)
        if name == "near_dedup":
            assert ids == set(corpus.similar_components([(r["doc_id"], r["text"]) for r in before]).values())
        before = rows
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_pipeline_runs(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_every_query_runs_on_small_tables(spark, folder):
    for name, run in catalogue.QUERIES.items():
        frame = run(spark, folder)
        assert isinstance(frame.schema, T.StructType) and frame.count() > 0, name
