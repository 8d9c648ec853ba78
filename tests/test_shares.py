"""The one-pass sweeps over shares of a log give what the stored models answer at every share."""

import pytest
from tidegraph.operators.changelog import log_bounds
from tidegraph.plans import sweeps
from tidegraph.plans.temporal_graph import IntervalGraph, SnapshotGraph
from tidegraph.storage import new_path

from .test_limits import contacts_log

PARTS = 4


@pytest.fixture(scope="module")
def asked(spark):
    log = contacts_log(spark, 120)
    models = {"intervals": IntervalGraph.from_log(log), "snapshots": SnapshotGraph.from_log(log, every_actions=50)}
    for name, model in models.items():
        path = new_path(spark, name)
        model.save(path)
        models[name] = type(model).load(spark, path)
    return log, models, log_bounds(log).first()["min_ts"], sweeps._share_times(log, PARTS)


def test_neighbours_by_share(asked):
    log, models, low, times = asked
    got = {(r["model"], r["iteration"]): r["found"] for r in sweeps.neighbours_by_share(log, 104, PARTS).collect()}
    want = {
        (name, i): model.direct_neighbours(104, low, t).count()
        for name, model in models.items()
        for i, t in enumerate(times)
    }
    assert got == want and any(got.values())


def test_activated_by_share(asked):
    log, models, low, times = asked
    got = {(r["model"], r["iteration"]): r["found"] for r in sweeps.activated_by_share(log, PARTS).collect()}
    want = {
        (name, i): model.activated_entities(low, t).count()
        for name, model in models.items()
        for i, t in enumerate(times)
    }
    assert got == want and any(got.values())
