"""Models of one log with several spacings."""

from tidegraph.operators import changelog as cl, snapshots
from tidegraph.plans.temporal_graph import SnapshotGraph

from .helpers import log_of, random_log


def test_several_spacings_number_the_log_once(spark, monkeypatch):
    log = log_of(spark, random_log(6, entities=4, per_entity=8))
    spacings, calls = [1, 5, 7, 5], []
    index, held = snapshots.indexed_log, snapshots._held
    alone = [snapshots.snapshots_by_count(log, every) for every in spacings]
    monkeypatch.setattr(snapshots, "indexed_log", lambda df: calls.append("index") or index(df))
    monkeypatch.setattr(snapshots, "_held", lambda *a: calls.append("held") or held(*a))
    graphs = SnapshotGraph.each_from_log(log, spacings)
    assert calls == ["index", "held"] and len(graphs) == len(spacings)
    for graph, want in zip(graphs, alone):
        for part in ("states", "index", "log"):
            got, expected = getattr(graph.model, part), getattr(want, part)
            if part != "index":
                got, expected = cl.flat(got), cl.flat(expected)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())), part


def test_an_empty_log_has_no_states_at_any_spacing(spark):
    empty = log_of(spark, random_log(6, entities=2, per_entity=2)).where("id > 9")
    assert [g.model.states.count() for g in SnapshotGraph.each_from_log(empty, [1, 3])] == [0, 0]
