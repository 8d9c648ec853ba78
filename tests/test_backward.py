"""States out of later snapshots must equal a plain replay, and read little of the log."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import snapshots
from tidegraph.operators.backward import between, undo_entries, undo_logs
from tidegraph.plans.temporal_graph import SnapshotGraph
from tidegraph.schema import STATE, conform
from tidegraph.storage import new_path, stored

from .helpers import as_state, at, edge, labelled, log_of, random_log, replay, vertex
from .test_differential import times


def kept(model):
    return replace(
        model, states=stored(model.states, "test"), index=stored(model.index, "test"), undo=stored(model.undo, "test")
    )


@pytest.mark.parametrize("mode", ["merge", "replace"])
@pytest.mark.parametrize("spacing", [{"every_seconds": 4}, {"every_actions": 9}])
def test_nearest_equals_replay(spark, mode, spacing):
    entries = random_log(2, entities=4, per_entity=8)
    graph = SnapshotGraph.from_log(log_of(spark, entries), attributes=mode, hot_rows=9, backward=True, **spacing)
    model = kept(graph.model)
    for t, rows in labelled((t, snapshots.snapshot_nearest(model, t)) for t in times(entries)[::3]):
        assert as_state(rows) == replay(entries, t, mode), t


@pytest.mark.parametrize("mode", ["merge", "replace"])
def test_backward_from_the_end(spark, mode):
    entries = random_log(3)
    log = log_of(spark, entries)
    undo = stored(undo_entries(log, mode, hot_rows=7), "test")
    model = snapshots.snapshots_by_count(log, 10_000, mode)
    state, last = stored(conform(model.states, STATE), "test"), model.index.first()
    asked = ((t, undo_logs(state, undo.where(between(last, t)))) for t in times(entries)[::2])
    for t, rows in labelled(asked):
        assert as_state(rows) == replay(entries, t, mode), t


def test_undo_rows_of_a_small_log(spark):
    entries = [
        vertex(0, 1, "CREATE", 7, a="1"),
        vertex(1, 1, "UPDATE", 7, a="2", b="3"),
        vertex(2, 5, "DELETE", 7),
        edge(3, 5, "CREATE", 1, 7, 8),
        edge(4, 6, "CREATE", 1, 7, 9, a="4"),
        edge(5, 6, "UPDATE", 2, 7, 9, a="5"),
    ]
    rows = undo_entries(log_of(spark, entries)).collect()
    found = {(r["seq"], r["id"], r["key"]): (r["present"], r["src"], r["dst"], r["value"]) for r in rows}
    assert len(found) == len(rows)
    assert found == {
        (0, 7, None): (False, None, None, None),
        (0, 7, "a"): (False, None, None, None),
        (1, 7, "a"): (True, None, None, "1"),
        (1, 7, "b"): (False, None, None, None),
        (2, 7, None): (True, None, None, None),
        (2, 7, "a"): (True, None, None, "2"),
        (2, 7, "b"): (True, None, None, "3"),
        (3, 1, None): (False, None, None, None),
        (4, 1, None): (True, 7, 8, None),
        (4, 1, "a"): (False, None, None, None),
    }


def test_a_snapshot_inside_an_instant(spark):
    # The second snapshot lies between two entries of one instant; a value comes and goes in it.
    entries = [
        vertex(0, 0, "CREATE", 1, a="1"),
        vertex(1, 9, "UPDATE", 1, a="2"),
        vertex(2, 10, "UPDATE", 1, a="3"),
        vertex(3, 10, "CREATE", 2),
        vertex(4, 10, "UPDATE", 1, a="2"),
        vertex(5, 10, "DELETE", 2),
    ]
    graph = SnapshotGraph.from_log(log_of(spark, entries), every_actions=4, backward=True)
    for s in (6, 9, 10):
        assert as_state(graph.snapshot_at_time(at(s))) == replay(entries, at(s)), s


def test_nearest_reads_at_most_half_a_spacing(spark):
    entries = [vertex(i, i, "CREATE" if i % 8 < 4 else "UPDATE", i % 4, a=str(i)) for i in range(64)]
    model = kept(SnapshotGraph.from_log(log_of(spark, entries), every_seconds=16, backward=True).model)
    for s in (22, 25):
        snapshot = snapshots.closest_snapshot(model.index, at(s)).first()
        later = snapshot["snapshot_ts"] > at(s)
        assert later == (s >= 24)
        if later:
            used = model.undo.where(between(snapshot, at(s))).select("seq").distinct()
            assert used.count() <= 8
        assert as_state(snapshots.snapshot_nearest(model, at(s))) == replay(entries, at(s))


def test_stored_model_goes_back_over_pushed_down_times(spark):
    entries = random_log(4)
    path = new_path(spark, "backward")
    SnapshotGraph.from_log(log_of(spark, entries), every_seconds=6, backward=True).save(path)
    graph = SnapshotGraph.load(spark, path)
    snapshot = graph.model.index.orderBy("snapshot_ts").first()
    t = at(4)
    assert as_state(graph.snapshot_at_time(t)) == replay(entries, t)
    plan = graph.model.undo.where(between(snapshot, t))._jdf.queryExecution().toString()
    assert "GreaterThan(ts," in plan and "LessThanOrEqual(ts," in plan
    # Without the table the model answers forward.
    plain = new_path(spark, "forward")
    SnapshotGraph.from_log(log_of(spark, entries), every_seconds=6).save(plain)
    loaded = SnapshotGraph.load(spark, plain)
    assert loaded.model.undo is None
    assert as_state(loaded.snapshot_at_time(t)) == replay(entries, t)


def test_empty_log(spark):
    graph = SnapshotGraph.from_log(log_of(spark, [vertex(0, 0, "CREATE", 1)]).where(F.lit(False)), every_seconds=5, backward=True)
    assert graph.snapshot_at_time(at(3)).count() == 0
