"""Both models must equal a plain replay of the log, whole sets at every time."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import changelog, snapshots, validity
from tidegraph.storage import stored
from tidegraph.plans.temporal_graph import IntervalGraph, SnapshotGraph

from .helpers import activated, as_state, at, labelled, log_of, neighbours, net_created, random_log, replay

MICRO = dt.timedelta(microseconds=1)


def times(entries):
    marks = sorted({e[1] for e in entries})
    return [marks[0] - MICRO, *marks, marks[-1] + MICRO, marks[len(marks) // 2] + MICRO]


@pytest.fixture(scope="module", params=[1])
def entries(request):
    return random_log(request.param)


def check(entries, query, marks, mode="merge"):
    for t, rows in labelled((t, query(t)) for t in marks):
        assert as_state(rows) == replay(entries, t, mode), t


@pytest.mark.parametrize("mode", ["merge", "replace"])
@pytest.mark.parametrize("hot_rows", [None, 7])
def test_intervals_equal_replay(spark, entries, mode, hot_rows):
    model = IntervalGraph.from_log(log_of(spark, entries), mode, hot_rows)
    model.intervals = stored(model.intervals, "test")
    check(entries, model.snapshot_at_time, times(entries)[::2], mode)


@pytest.mark.parametrize("mode", ["merge", "replace"])
@pytest.mark.parametrize("spacing", [{"every_seconds": 3}, {"every_actions": 7}, {"every_actions": 1000}])
def test_snapshots_equal_replay(spark, entries, mode, spacing):
    log = log_of(spark, entries)
    model = SnapshotGraph.from_log(log, attributes=mode, hot_rows=9, **spacing).model
    model = replace(model, states=stored(model.states, "test"), index=stored(model.index, "test"))
    check(entries, SnapshotGraph(model).snapshot_at_time, times(entries)[::4], mode)


def test_replayed_log_equals_replay(spark, entries):
    log = log_of(spark, entries)
    for mode in ("merge", "replace"):
        check(entries, lambda t: changelog.state_at(log, t, mode), times(entries)[::6], mode)


def test_entities_of_both_models(spark, entries):
    log = log_of(spark, entries)
    model = IntervalGraph(stored(validity.attribute_intervals(log), "test"))
    other = SnapshotGraph.from_log(log, every_actions=11).model
    other = replace(other, states=stored(other.states, "test"), index=stored(other.index, "test"))
    asked = [(t, e) for t in times(entries)[1::9] for e in [("EDGE", 0), ("VERTEX", 1), ("EDGE", 99)]]
    for query in (
        model.entity_at_time,
        SnapshotGraph(other).entity_at_time,
        lambda kind, id_, t: snapshots.entity_at_delta_unmaterialised(log, kind, id_, t),
    ):
        for (t, key), rows in labelled(((t, e), query(*e, t)) for t, e in asked):
            assert as_state(rows) == {k: v for k, v in replay(entries, t).items() if k == key}


def test_interval_queries_of_both_models(spark, entries):
    log = log_of(spark, entries)
    merged = stored(validity.attribute_intervals(log), "test")
    replaced = stored(validity.validity_intervals(log), "test")
    spans = [(at(lo), at(hi)) for lo, hi in [(0, 3), (5, 5), (4, 11), (19, 40)]]
    asked = [(v, *span) for v in (0, 2) for span in spans]
    for query in (
        lambda *a: validity.neighbours_validity(merged, *a),
        lambda *a: validity.neighbours_validity(replaced, *a),
        lambda *a: snapshots.neighbours_delta(log, *a),
    ):
        for key, rows in labelled((a, query(*a)) for a in asked):
            assert {r["id"] for r in rows} == neighbours(entries, *key)
    for query, want in (
        (lambda *a: validity.activated_validity(merged, *a), activated),
        (lambda *a: validity.activated_validity(replaced, *a), activated),
        (lambda *a: snapshots.activated_delta(log, *a), activated),
        (lambda *a: validity.activated_validity(merged, *a, "net_create"), net_created),
        (lambda *a: snapshots.activated_delta(log, *a, "net_create"), net_created),
    ):
        for span, rows in labelled((s, query(*s)) for s in spans):
            assert {(r["entity_type"], r["id"]) for r in rows} == want(entries, *span)


def test_no_effect_of_row_order_or_partitions(spark, entries):
    t = at(11)
    for parts in (1, 5):
        log = log_of(spark, entries).orderBy(F.rand(3)).repartition(parts)
        assert as_state(IntervalGraph.from_log(log).snapshot_at_time(t)) == replay(entries, t)
        assert as_state(SnapshotGraph.from_log(log, every_actions=13).snapshot_at_time(t)) == replay(entries, t)


def test_validation_finds_the_same_entries_when_sliced(spark, entries):
    log = log_of(spark, entries)
    plain = {tuple(r) for r in changelog.validate_changelog(log, strict=True).collect()}
    sliced = {tuple(r) for r in changelog.validate_changelog(log, strict=True, hot_rows=5).collect()}
    assert plain and plain == sliced
