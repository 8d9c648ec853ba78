"""Snapshots are kept as runs, so what they take does not grow with their number."""

import pytest

from tidegraph.catalogue import models
from tidegraph.operators import changelog as cl, snapshots
from tidegraph.plans.temporal_graph import SnapshotGraph
from tidegraph.sources import store
from tidegraph.storage import new_path

from .helpers import as_state, at, log_of, random_log, replay, vertex


def static(spark, entities=30, busy=120):
    """Many vertices that never change beside one that does at every entry."""
    rows = [vertex(i, 0, "CREATE", i, a="1", b=str(i)) for i in range(entities)]
    return log_of(spark, rows + [vertex(entities + i, 1 + i, "UPDATE", 0, a=str(i)) for i in range(busy)])


@pytest.mark.parametrize("every", [1, 3])
def test_stored_states_grow_with_the_log_and_not_with_the_snapshots(spark, every):
    log = static(spark)
    model = snapshots.snapshots_by_count(log, every)
    path = new_path(spark, "runs")
    store.save_snapshots(model, path)
    kept = store.load_snapshots(spark, path)
    states = kept.states.count()
    assert states > 1000 and spark.read.parquet(f"{path}/states").count() <= 3 * log.count() < states
    assert sorted(map(repr, cl.flat(kept.states).select(*cl.flat(model.states).columns).collect())) == sorted(
        map(repr, cl.flat(model.states).collect())
    )


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_blocks_of_any_size_give_the_same_states(spark, block, monkeypatch):
    monkeypatch.setattr(snapshots, "_block_size", lambda *_: block)
    entries = random_log(4, entities=4, per_entity=8)
    model = snapshots.snapshots_by_count(log_of(spark, entries), 5)
    found = {}
    for r in model.states.collect():
        found.setdefault(r["snapshot_no"], []).append(r)
    index = {r["snapshot_no"]: r for r in model.index.collect()}
    ordered = sorted(entries, key=lambda e: (e[1], e[0]))
    assert len(index) == -(-len(ordered) // 5)
    for no in index:
        assert as_state(found.get(no, [])) == replay(ordered[: 5 * (no + 1)], at(10_000)), no


def test_an_empty_log_and_a_model_of_states_alone_are_stored(spark):
    empty = log_of(spark, [vertex(0, 0, "CREATE", 1)]).where("id > 1")
    for spacing in ({"every_seconds": 5}, {"every_actions": 5}):
        path = new_path(spark, "empty")
        SnapshotGraph.from_log(empty, **spacing).save(path)
        assert SnapshotGraph.load(spark, path).snapshot_at_time(at(9)).count() == 0
    model = snapshots.snapshots_by_count(static(spark, 3, 9), 4)
    path = new_path(spark, "states")
    store.save_snapshots(snapshots.Snapshots(model.states, model.index, model.log), path)
    assert store.load_snapshots(spark, path).states.count() == model.states.count() > 0


def test_text_of_a_state_is_made_once_for_all_its_snapshots(spark, monkeypatch):
    log = static(spark, 3, 40)
    monkeypatch.setattr(models, "users", lambda *_: log)
    every = snapshots.snapshots_by_count
    monkeypatch.setattr(snapshots, "snapshots_by_count", lambda log, _: every(log, 5))
    found = models.snapshots_by_count(spark, "x")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Top down: the states are repeated after their text is made.
    assert 0 < plan.index("explode(sequence(") < plan.index("array_join(")
    want = cl.flat(every(log, 5).states).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
