"""Updates of an edge without length are stored and modelled as one run, and read as the entries they are."""

import pytest
from pyspark.sql import functions as F
from tidegraph.catalogue import synthetic
from tidegraph.operators import changelog as cl, growing, ordered
from tidegraph.operators.synthesis import Distribution
from tidegraph.plans import sweeps
from tidegraph.sources import store
from tidegraph.storage import new_path, passing, stored

from .helpers import at
from .test_growing import _work

ITERATIONS = 3


def made(spark, distribution=Distribution("gaussian", 3, 2)):
    """Most edges end as they start, and some entities have no updates at first."""
    rows = [(i, i % 5, 9 + i % 3, at(500 * (i // 3)), at(500 * (i // 3) + (900 if i % 7 == 0 else 0))) for i in range(1, 40)]
    edges = spark.createDataFrame(
        rows, "edge_id BIGINT, src BIGINT, dst BIGINT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ"
    )
    vertices = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 9, 10, 11)], "id BIGINT")
    return growing.growing_updates(vertices, edges, distribution, "positive", ITERATIONS)


@pytest.fixture(scope="module")
def grown(spark):
    vertices, edges = made(spark)
    path = new_path(spark, "growing")
    before = len(_work(spark))
    logs = store.load_or_generate_growing_log(spark, path, lambda: growing.growing_log(vertices, edges, ITERATIONS), ITERATIONS)
    assert len(_work(spark)) == before + 1  # What it took to make the log is gone.
    return path, logs, vertices, edges


def test_runs_are_fewer_than_entries_and_give_all_of_them(spark, grown):
    path, logs, vertices, edges = grown
    counts = {r["edge_id"]: [r[f"n{i}"] for i in (1, 2, 3)] for r in edges.collect()}
    whole = logs[3].collect()
    assert spark.read.parquet(path).count() < 0.7 * len(whole)
    # Numbered without a gap in the order of the log, the same for every iteration.
    assert [e["seq"] for e in sorted(whole, key=lambda e: e["seq"])] == list(range(len(whole)))
    rank = {"CREATE": 0, "UPDATE": 1, "DELETE": 2}
    order = lambda e: (e["ts"], rank[e["action"]], e["entity_type"], e["id"], int(e["attributes"].get("update", -1)))
    assert [e["seq"] for e in sorted(whole, key=order)] == list(range(len(whole)))
    for i, log in logs.items():
        of_edges = log.where("entity_type = 'EDGE'").collect()
        found = {e: sorted(int(x["attributes"]["update"]) for x in of_edges if x["id"] == e and x["action"] == "UPDATE") for e in counts}
        assert found == {e: list(range(1, n[i - 1] + 1)) for e, n in counts.items()}
        sizes = {r["action"]: r["count"] for r in log.groupBy("action").count().collect()}
        counted = growing.action_counts(store.load_growing_runs(spark, path), ITERATIONS).where(F.col("iteration") == i)
        assert {r["action"]: r["entries"] for r in counted.collect()} == sizes
    every = store.load_growing_log(spark, path)
    for i, log in logs.items():
        assert cl.flat(growing.log_of(every, i)).exceptAll(cl.flat(log)).count() == 0
        assert growing.log_of(every, i).count() == log.count()


def test_models_from_runs_are_those_of_the_entries(spark, grown):
    path, logs, _, _ = grown
    kept = spark.read.parquet(path)
    found = sweeps.growing_prepared(spark, path, f"{path}-models", ITERATIONS)
    assert store.load_growing_intervals(spark, f"{path}-models").where("entries > 1").count() > 0 < kept.where("held IS NOT NULL").count()
    entries = stored(store.load_growing_log(spark, path), "one-by-one")
    store.save_growing_models(entries, f"{path}-alone", ITERATIONS)
    assert store.load_growing_sizes(spark, f"{path}-alone") == store.load_growing_sizes(spark, f"{path}-models")
    alone = store.load_growing_models(spark, f"{path}-alone", entries, ITERATIONS)
    assert growing.log_places(kept, ITERATIONS, 7) == growing.log_places(entries, ITERATIONS, 7)
    # One iteration between two others; the logs of all are compared with models of their own in test_growing.
    for i in (2,):
        intervals, lives, model, actions = alone[i]
        mine = found[i].models["intervals"]
        same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))
        assert same(mine.intervals, intervals) and same(mine.ends, lives)
        snapshots = found[i].models["snapshots"]
        assert same(snapshots.model.index, model.index) and same(snapshots.ends, actions)
        assert same(cl.flat(snapshots.model.states), cl.flat(model.states))


def test_a_count_is_drawn_once(spark):
    """Each count was nested in all later ones, so expressions doubled with every iteration."""
    vertices = spark.createDataFrame([(i, i) for i in range(4)], "id BIGINT, __rank BIGINT")
    base = spark.createDataFrame([(i, i - 1.5) for i in range(4)], "__rank BIGINT, __base DOUBLE")
    counts = growing._counts(vertices, base, Distribution("lognormal", 1, 0.4), 9)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("EXP(") <= 9
    assert all(r["n1"] <= r["n5"] <= r["n9"] for r in counts.collect())


def test_weighted_places(spark):
    rows = stored(spark.createDataFrame([(i, 1 + i % 4) for i in range(60)], "a BIGINT, w BIGINT").repartition(5), "weighted")
    found = {r["a"]: r["p"] for r in ordered.dense_index(rows, ["a"], "p", stored, F.col("w")).collect()}
    assert found == {i: sum(1 + j % 4 for j in range(i)) for i in range(60)}


def test_tables_in_passing_are_dropped(spark):
    before = len(_work(spark))
    with passing(spark):
        stored(spark.range(3), "gone")
        with passing(spark):
            stored(spark.range(3), "gone")
        assert len(_work(spark)) == before + 1
    assert len(_work(spark)) == before
    kept = stored(spark.range(3), "kept")
    assert kept.count() == 3 and len(_work(spark)) == before + 1


def test_sizes_of_the_logs_come_from_the_stored_runs(spark, grown, monkeypatch):
    _, _, vertices, edges = grown
    monkeypatch.setattr(synthetic, "_ITERATIONS", ITERATIONS)
    monkeypatch.setattr(synthetic, "_root", lambda *_: root)
    root = new_path(spark, "grid")
    monkeypatch.setattr(synthetic, "_generate_growing", lambda *_: growing.growing_log(vertices, edges, ITERATIONS))
    found = {(r["mode"], r["iteration"], r["action"]): r["entries"] for r in synthetic.persist_log_grid(spark, "x").collect()}
    want = {
        (mode, i, r["action"]): r["count"]
        for mode in ("negative", "uniform")
        for i, log in grown[1].items()
        for r in log.groupBy("action").count().collect()
    }
    assert found == want
