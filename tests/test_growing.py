"""Logs that grow by iterations, places in an order, diameters by few searches, and what stored models read."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tidegraph.operators import changelog as cl
from tidegraph.operators import diameter, growing, measures, ordered, snapshots, validity
from tidegraph.operators.graph import PropertyGraph
from tidegraph.operators.synthesis import Distribution
from tidegraph.plans import sweeps
from tidegraph.plans.temporal_graph import IntervalGraph, SnapshotGraph
from tidegraph.sources import contacts, store
from tidegraph.storage import Scratch, new_path, work_dir

from .helpers import at, log_of, random_log, replay, as_state
from .test_limits import contacts_log

ITERATIONS = 3


@pytest.fixture(scope="module", params=["positive", "negative", "uniform"])
def grown(spark, request):
    edges = spark.createDataFrame(
        [(i, i % 5, 9 + i % 3, at(2000 * i), at(2000 * i + 700 * (i % 4))) for i in range(1, 40)],
        "edge_id BIGINT, src BIGINT, dst BIGINT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ",
    )
    vertices = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 9, 10, 11, 77)], "id BIGINT")
    d = Distribution("lognormal", 0.5, 0.5)
    updates = growing.growing_updates(vertices, edges, d, request.param, ITERATIONS)
    path = new_path(spark, "growing")
    logs = store.load_or_generate_growing_log(spark, path, lambda: growing.growing_log(*updates, ITERATIONS), ITERATIONS)
    return path, logs, updates, request.param


def test_every_iteration_extends_the_one_before(spark, grown):
    path, logs, (vertices, edges), mode = grown
    sizes = []
    for i, log in logs.items():
        assert cl.validate_changelog(log, strict=True).count() == 0
        updates = vertices.agg(F.sum(f"n{i}")).first()[0] + edges.agg(F.sum(f"n{i}")).first()[0]
        assert log.count() == updates + 2 * 39
        sizes.append(log.count())
        if i > 1:
            assert cl.flat(logs[i - 1]).exceptAll(cl.flat(log)).count() == 0
    assert sizes == sorted(set(sizes))
    if mode != "uniform":
        order = F.col("degree") if mode == "positive" else F.col("degree").desc()
        counts = [r["n1"] for r in vertices.orderBy(order, "id").collect()]
        assert counts == sorted(counts) and counts[0] < counts[-1]


def test_models_of_all_iterations_equal_those_of_each_log(spark, grown):
    path, logs, _, mode = grown
    if mode != "negative":
        return  # One mode is enough: the models do not know how a log was made.
    found = sweeps.growing_prepared(spark, path, f"{path}-models", ITERATIONS)
    for i, log in logs.items():
        alone = sweeps.prepared(log)
        assert (found[i].entries, found[i].early, found[i].low, found[i].high) == (alone.entries, alone.early, alone.low, alone.high)
        of_one = alone.models["intervals"].intervals
        of_all = found[i].models["intervals"].intervals.select(*of_one.columns)
        assert of_one.exceptAll(of_all).count() == 0 and of_all.exceptAll(of_one).count() == 0
        mine, theirs = found[i].models["snapshots"].model, alone.models["snapshots"].model
        assert sorted(map(tuple, mine.index.collect())) == sorted(map(tuple, theirs.index.collect()))
        assert sorted(map(repr, cl.flat(mine.states).select(*cl.flat(theirs.states).columns).collect())) == sorted(
            map(repr, cl.flat(theirs.states).collect())
        )
        for name, model in found[i].models.items():
            other = alone.models[name]
            for t in (alone.early, at(30_000)):
                assert as_state(model.snapshot_at_time(t)) == as_state(other.snapshot_at_time(t))
                assert as_state(model.entity_at_time("EDGE", 3, t)) == as_state(other.entity_at_time("EDGE", 3, t))
            ids = lambda df: sorted(r["id"] for r in df.collect())
            assert ids(model.direct_neighbours(9, at(0), at(40_000))) == ids(other.direct_neighbours(9, at(0), at(40_000)))
            assert ids(model.activated_entities(at(100), at(30_000))) == ids(other.activated_entities(at(100), at(30_000)))


@pytest.mark.parametrize("ranges,few", [(2, 1), (7, 3), (1024, 1000)])
def test_keys_at_places(spark, ranges, few):
    rnd = random.Random(ranges)
    rows = [(rnd.choice([5, 5, 5, -(10**17), 10**17, rnd.randrange(100)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a BIGINT, b BIGINT").repartition(4)
    order, places = sorted(rows), [0, 1, 150, 151, 298, 299, 300, -1]
    got = ordered.keys_at_places(df, [F.col("a"), F.col("b")], places, ranges, few)
    assert got == {p: order[p] for p in places if 0 <= p < 300}
    assert ordered.keys_at_places(df.where("a > 0 AND a < 0"), [F.col("a")], [0]) == {}


def test_places_are_found_without_writing(spark):
    log = contacts_log(spark)
    before = sorted(f.getPath().getName() for f in _work(spark))
    assert cl.nth_log_timestamp(log).count() == 1 and cl.log_timestamp_quantiles(log, 5).count() == 5
    assert sorted(f.getPath().getName() for f in _work(spark)) == before


def _work(spark):
    place = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)


# -- diameter ----------------------------------------------------------------


def graph_of(spark, arcs):
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(arcs)], "id BIGINT, src BIGINT, dst BIGINT")
    nothing = F.lit(None).cast("map<string,string>")
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("attributes", nothing)
    return PropertyGraph(vertices, edges.withColumn("attributes", nothing))


def plain_diameter(arcs):
    after, longest = {}, 0
    for a, b in arcs:
        after.setdefault(a, set()).add(b)
    for s in {x for arc in arcs for x in arc}:
        seen, level, depth = {s}, {s}, 0
        while level:
            level = {w for v in level for w in after.get(v, ())} - seen
            seen |= level
            depth += bool(level)
        longest = max(longest, depth)
    return longest


@pytest.mark.parametrize("kind", ["path", "two-way path", "star", "two-way star"])
def test_few_searches_settle_a_path_and_a_star(spark, kind):
    n = 16
    arcs = [(i, i + 1) for i in range(n - 1)] if "path" in kind else [(0, i) for i in range(1, n)]
    if "two-way" in kind:
        arcs += [(b, a) for a, b in arcs]
    before = len(_work(spark))
    longest, searches = diameter.hop_search(graph_of(spark, arcs))
    assert longest == plain_diameter(arcs) and 0 < searches < n // 2
    assert len(_work(spark)) == before  # Every round has been dropped.


@pytest.mark.parametrize("seed", [1, 2])
def test_diameter_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    arcs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(4)] + [(104, 100)]
    longest, searches = diameter.hop_search(graph_of(spark, arcs), 1)
    assert longest == plain_diameter(arcs) and searches < len({x for arc in arcs for x in arc})


# -- what stored models read -------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Paths of the files that a scan of a stored table reads, partitions and filters applied."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def jobs_of(spark, action):
    group = f"test-{time.time()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        action()
        executions = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return executions


@pytest.fixture(scope="module")
def kept(spark):
    log = contacts_log(spark)
    out = {}
    for name, model in (("intervals", IntervalGraph.from_log(log)), ("snapshots", SnapshotGraph.from_log(log, every_actions=91))):
        path = new_path(spark, name)
        model.save(path)
        out[name] = (path, type(model).load(spark, path))
    return log, out


def test_one_entity_needs_no_job_before_its_query(spark, kept):
    log, models = kept
    model = models["snapshots"][1]
    for when in ("1999-01-01", "2000-01-03", "2005-06-07", "2030-01-01"):
        assert jobs_of(spark, lambda: model.entity_at_time("EDGE", 200, when)) == []
        got = model.entity_at_time("EDGE", 200, when)
        assert as_state(got) == as_state(snapshots.entity_at_delta_unmaterialised(log, "EDGE", 200, when))
    plan = plan_of(model.entity_at_time("EDGE", 200, "2005-06-07"))
    assert "PartitionFilters: [isnotnull(snapshot_no" in plan and "ubquery" in plan.split("PartitionFilters")[1]
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_entries_of_an_entity_are_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 50)
    log = contacts_log(spark)
    path = new_path(spark, "model")
    SnapshotGraph.from_log(log, every_actions=90).save(path)
    model = store.load_snapshots(spark, path)
    mine = snapshots._entries_of(model, "EDGE", 17)
    assert mine.count() == log.where("id = 17").count() > 0
    assert len(files_read(model.entries)) > 8 and len(files_read(mine)) == 1


def test_a_time_prunes_on_both_sides(spark, kept):
    intervals = kept[1]["intervals"][1].intervals
    early = files_read(validity._around(intervals, "2002-06-01"))
    assert early and all(f"start_year={y}" not in f for f in early for y in range(2003, 2020))
    assert all(f"end_year={y}" not in f for f in early for y in range(2000, 2002))
    assert len(early) < len(files_read(intervals))


@pytest.mark.parametrize("name", ["intervals", "snapshots"])
def test_first_activations_are_a_scan(spark, kept, name):
    log, models = kept
    model = models[name][1]
    for span in ((None, None), ("2001-01-01", "2002-03-01"), (None, "2000-02-01"), ("2009-01-01", None), ("2001-01-01", "2000-01-01")):
        got = sorted(map(tuple, model.activated_entities(*span).collect()))
        assert got == sorted(map(tuple, snapshots.activated_delta(log, *span).collect()))
    plan = plan_of(model.activated_entities("2001-01-01", "2002-03-01"))
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert "first_year" in plan.split("PartitionFilters")[1]


def test_lives_of_several_activations(spark):
    entries = random_log(3)
    log = log_of(spark, entries)
    for model in (IntervalGraph.from_log(log), SnapshotGraph.from_log(log, every_actions=7)):
        path = new_path(spark, "model")
        model.save(path)
        stored_model = type(model).load(spark, path)
        for t in (at(0), at(5), at(17)):
            assert as_state(stored_model.snapshot_at_time(t)) == replay(entries, t)
            for kind, id_ in (("VERTEX", 1), ("EDGE", 0)):
                want = {k: v for k, v in replay(entries, t).items() if k == (kind, id_)}
                assert as_state(stored_model.entity_at_time(kind, id_, t)) == want
        want = sorted(map(tuple, model.activated_entities(at(3), at(15)).collect()))
        assert sorted(map(tuple, stored_model.activated_entities(at(3), at(15)).collect())) == want


def test_bytes_of_stored_models(spark, kept):
    paths = {name: path for name, (path, _) in kept[1].items()}
    rows = {(r["model"], r["part"]): r for r in measures.stored_bytes(spark, paths).collect()}
    assert {p for m, p in rows if m == "snapshots"} == {"states", "index", "log", "ends", "entries", "firsts"}
    assert {p for m, p in rows if m == "intervals"} == {"intervals", "ends", "firsts"}
    assert all(r["bytes"] > 0 and r["files"] > 0 for r in rows.values())
    assert rows["snapshots", "states"]["bytes"] > rows["snapshots", "index"]["bytes"]


def test_rejected_contact_lines(spark, tmp_path):
    lines = ["1|2|3", " 4 |5| -6", "", "x|2|3", "1|2.5|3", "1|2|99999999999999999999", "1|2", "1|2|3|4", "1||3", "   "]
    (tmp_path / "contacts.txt").write_text("\n".join(lines))
    good, rejected = contacts.read_contact_lines(spark, str(tmp_path), "|")
    assert sorted(map(tuple, good.collect())) == [(1, 2, 3), (4, 5, -6)]
    assert sorted(map(tuple, rejected.collect())) == sorted(
        [("x|2|3", "bad_source"), ("1|2.5|3", "bad_target"), ("1|2|99999999999999999999", "bad_time"), ("1|2", "too_few_fields"),
         ("1|2|3|4", "too_many_fields"), ("1||3", "bad_target")]
    )


def test_scratch_tables_are_dropped(spark):
    before = len(_work(spark))
    with Scratch(spark) as scratch:
        a = scratch.stored(spark.range(5), "a")
        scratch.stored(a, "b")
        scratch.drop(a, None)
        assert len(_work(spark)) == before + 1
    assert len(_work(spark)) == before
