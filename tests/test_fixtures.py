"""Fixed inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import attributes as att
from tidegraph.functions import intervals as iv
from tidegraph.functions import times as tm
from tidegraph.operators import changelog as cl
from tidegraph.operators import graph as g
from tidegraph.operators.diameter import hop_diameter
from tidegraph.operators import measures, ordered, snapshots, synthesis, topology, validity
from tidegraph.plans.temporal_graph import IntervalGraph, SnapshotGraph
from tidegraph.schema import ENTITY, INTERVALS
from tidegraph.sources import changelog_text, contacts, store
from tidegraph.storage import new_path

from .helpers import as_state, at, edge, labelled, log_of, vertex

HOUR = 3600
T = {i: i * HOUR for i in range(1, 9)}


def ids(df):
    return {r["id"] for r in df.collect()}


# -- interval model ----------------------------------------------------------


@pytest.fixture(scope="module")
def colours(spark):
    rows = [
        ("VERTEX", 1, None, None, at(T[1]), at(T[2]), 0, {"color": "red"}),
        ("VERTEX", 1, None, None, at(T[2]), at(T[3]), 1, {"color": "orange"}),
        ("VERTEX", 2, None, None, at(T[1]), at(T[4]), 2, {"color": "red"}),
        ("EDGE", 1003, 1, 2, at(T[1]), at(T[2]), 3, {"relation": "brother"}),
        ("EDGE", 1003, 1, 2, at(T[2]), at(T[3]), 4, {"relation": "sister"}),
    ]
    return IntervalGraph(spark.createDataFrame(rows, INTERVALS))


def test_snapshot_of_intervals(colours):
    state = as_state(colours.snapshot_at_time(at(T[2])))
    assert state == {
        ("VERTEX", 1): (None, None, {"color": "orange"}),
        ("VERTEX", 2): (None, None, {"color": "red"}),
        ("EDGE", 1003): (1, 2, {"relation": "sister"}),
    }


def test_neighbours_are_closed_at_the_end(colours):
    asked = {(v, t): colours.direct_neighbours(v, at(T[t]), at(T[t])) for v in (1, 2) for t in (3, 4)}
    found = {k: {r["id"] for r in rows} for k, rows in labelled(asked.items())}
    assert found == {(1, 3): {2}, (1, 4): set(), (2, 3): {1}, (2, 4): set()}


def test_entities_are_half_open(colours):
    asked = {
        (kind, i, t): colours.entity_at_time(kind, i, at(T[t]))
        for kind, i in [("VERTEX", 1), ("EDGE", 1003)]
        for t in (1, 2, 3, 4)
    }
    found = {k: [list(r["attributes"].values()) for r in rows] for k, rows in labelled(asked.items())}
    assert found == {
        ("VERTEX", 1, 1): [["red"]], ("VERTEX", 1, 2): [["orange"]], ("VERTEX", 1, 3): [], ("VERTEX", 1, 4): [],
        ("EDGE", 1003, 1): [["brother"]], ("EDGE", 1003, 2): [["sister"]], ("EDGE", 1003, 3): [], ("EDGE", 1003, 4): [],
    }


# -- snapshot model ----------------------------------------------------------


def test_number_of_snapshots(spark):
    five = log_of(spark, [vertex(i, i * 100, "UPDATE" if i else "CREATE", 1, n=str(i)) for i in range(5)])
    assert snapshots.snapshots_by_count(five, 4).index.count() == 2
    assert snapshots.snapshots_by_count(five, 10).index.count() == 1
    assert validity.validity_intervals(five).count() == 5


def test_empty_window_repeats_the_state(spark):
    entries = [vertex(i, s, "UPDATE" if i else "CREATE", 1, n=str(i)) for i, s in enumerate([0, 1, 4, 5])]
    model = snapshots.snapshots_by_time(log_of(spark, entries), 2)
    states = {r["snapshot_no"]: r["attributes"]["n"] for r in model.states.collect()}
    assert states == {0: "1", 1: "1", 2: "3"}


def test_no_entry_is_lost_when_the_log_starts_late(spark):
    entries = [vertex(i, s, "CREATE", i) for i, s in enumerate([10, 105, 109, 111, 210])]
    model = snapshots.snapshots_by_time(log_of(spark, entries), 100)
    counts = {r["snapshot_no"]: r["count"] for r in model.states.groupBy("snapshot_no").count().collect()}
    assert counts == {0: 3, 1: 4, 2: 5}
    assert {e[1] for e in as_state(SnapshotGraph(model).snapshot_at_time(at(109)))} == {0, 1, 2}


def test_closest_and_latest_snapshot(spark):
    index = spark.createDataFrame(
        [(0, at(0), 5), (1, at(10), 9)], "snapshot_no BIGINT, snapshot_ts TIMESTAMP_NTZ, snapshot_seq BIGINT"
    )
    closest = lambda s: snapshots.closest_snapshot(index, at(s)).first()["snapshot_no"]
    assert [closest(6), closest(1), closest(5)] == [1, 0, 0]
    assert snapshots.latest_snapshot_before(index, at(9)).first()["snapshot_no"] == 0
    assert snapshots.latest_snapshot_before(index, at(-1)).first() is None


def test_apply_logs(spark):
    before = log_of(spark, [vertex(0, 0, "CREATE", 1, a="0"), vertex(1, 0, "CREATE", 2), edge(2, 0, "CREATE", 8, 1, 2)])
    more = log_of(
        spark,
        [vertex(3, 1, "UPDATE", 1, a="1"), vertex(4, 2, "UPDATE", 1, b="2"), vertex(5, 2, "CREATE", 3, c="3"), vertex(6, 3, "DELETE", 2)],
    )
    state = as_state(cl.apply_logs(cl.create_graph_from_logs(before), more))
    assert state == {
        ("VERTEX", 1): (None, None, {"a": "1", "b": "2"}),
        ("VERTEX", 3): (None, None, {"c": "3"}),
        ("EDGE", 8): (1, 2, {}),
    }


# -- change-log algebra ------------------------------------------------------

PAIRS = [
    (("UPDATE", 0), ("DELETE", 1), ("DELETE", {})),
    (("CREATE", 0), ("DELETE", 1), ("DELETE", {})),
    (("UPDATE", 0), ("UPDATE", 1), ("UPDATE", {"c": "red"})),
    (("CREATE", 0), ("UPDATE", 1), ("CREATE", {"c": "red"})),
    (("DELETE", 0), ("UPDATE", 0), ("DELETE", {})),
    (("DELETE", 0), ("CREATE", 1), ("CREATE", {"c": "red"})),
]


def test_squash_pairs(spark):
    entries = []
    for i, (first, second, _) in enumerate(PAIRS):
        entries.append(vertex(2 * i, first[1], first[0], i, **({} if first[0] == "DELETE" else {"c": "blue"})))
        entries.append(vertex(2 * i + 1, second[1], second[0], i, **({} if second[0] == "DELETE" else {"c": "red"})))
    for mode in ("merge", "replace"):
        rows = cl.squash_entities(log_of(spark, entries), mode).collect()
        found = {r["id"]: (r["action"], dict(r["attributes"])) for r in rows}
        assert found == {i: want for i, (_, _, want) in enumerate(PAIRS)}
        # A CREATE keeps its time, UPDATEs take the latest.
        times = {r["id"]: r["ts"] for r in rows}
        assert times[3] == at(0) and times[2] == at(1)


def test_violations(spark):
    actions = {
        1: ["CREATE", "CREATE"], 2: ["CREATE", "DELETE", "DELETE"], 3: ["UPDATE"], 4: ["DELETE"],
        5: ["CREATE", "DELETE", "UPDATE"], 6: ["CREATE", "DELETE", "CREATE", "UPDATE"],
    }
    entries, seq = [], 0
    for id_, steps in actions.items():
        for s, action in enumerate(steps):
            entries.append(vertex(seq, s, action, id_))
            seq += 1
    entries += [vertex(90, 0, "CREATE", 7), vertex(91, 1, "DELETE", 7), vertex(92, 1, "UPDATE", 7)]
    found = {(r["id"], r["reason"]) for r in cl.validate_changelog(log_of(spark, entries)).collect()}
    assert found == {
        (1, "create_while_alive"), (2, "delete_after_delete"), (3, "update_without_create"),
        (4, "delete_without_create"), (5, "update_after_delete"),
    }
    strict = {r["id"] for r in cl.validate_changelog(log_of(spark, entries), strict=True).collect()}
    assert strict == {1, 2, 3, 4, 5, 6}


def test_one_id_for_two_edges(spark):
    entries = [edge(i, i, "UPDATE" if i else "CREATE", 1, *(2, 3) if i < 5 else (4, 5)) for i in range(10)]
    log = log_of(spark, entries)
    assert cl.grouped_logs(log).first()["entries"] == 10
    assert ids(cl.conflicting_ends(log)) == {1}


def test_activation_table(spark):
    entries = [
        vertex(0, 2, "CREATE", 1), vertex(1, 8, "DELETE", 1), vertex(2, 5, "CREATE", 2), vertex(3, 10, "DELETE", 2),
        edge(4, 4, "CREATE", 1, 1, 2), edge(5, 7, "DELETE", 1, 1, 2),
    ]
    log = log_of(spark, entries)
    intervals = validity.attribute_intervals(log)
    table = {
        (0, 3): {("VERTEX", 1)}, (5, 7): {("VERTEX", 2)}, (3, 4): {("EDGE", 1)},
        (0, 4): {("VERTEX", 1), ("EDGE", 1)}, (4, 7): {("VERTEX", 2), ("EDGE", 1)},
        (0, 10): {("VERTEX", 1), ("VERTEX", 2), ("EDGE", 1)},
    }
    for query in (
        lambda a, b: validity.activated_validity(intervals, at(a), at(b)),
        lambda a, b: snapshots.activated_delta(log, at(a), at(b)),
    ):
        for span, rows in labelled((s, query(*s)) for s in table):
            assert {tuple(r[c] for c in ENTITY) for r in rows} == table[span]


def test_neighbour_table(spark):
    log = log_of(
        spark,
        [edge(0, T[1], "CREATE", 100, 1, 2), edge(1, T[3], "DELETE", 100, 1, 2), edge(2, T[2], "CREATE", 200, 1, 3),
         edge(3, T[4], "UPDATE", 200, 1, 3)],
    )
    intervals = validity.attribute_intervals(log)
    table = {
        (1, 1, 1): {2}, (1, 2, 2): {2, 3}, (1, 2, 3): {2, 3}, (1, 4, 4): {3}, (2, 1, 1): {1}, (2, 1, 3): {1},
        (2, 4, None): set(), (3, 1, 1): set(), (3, 1, 2): {1},
    }
    bound = lambda i: None if i is None else at(T[i])
    for query in (
        lambda v, a, b: validity.neighbours_validity(intervals, v, bound(a), bound(b)),
        lambda v, a, b: snapshots.neighbours_delta(log, v, bound(a), bound(b)),
    ):
        for key, rows in labelled((k, query(*k)) for k in table):
            assert {r["id"] for r in rows} == table[key], key


def test_edge_of_one_instant(spark):
    log = log_of(spark, [edge(0, 5, "CREATE", 1, 1, 2), edge(1, 5, "DELETE", 1, 1, 2)])
    model = IntervalGraph.from_log(log)
    for t in (5, 6):
        assert as_state(model.snapshot_at_time(at(t))) == {}
    for neighbours in (model.direct_neighbours, lambda *a: snapshots.neighbours_delta(log, *a)):
        assert ids(neighbours(1, at(5), at(5))) == {2}
        assert ids(neighbours(1, at(6), None)) == set()


def test_merge_and_replace(spark):
    log = log_of(spark, [vertex(0, 1, "CREATE", 1, a="1", b="1"), vertex(1, 2, "UPDATE", 1, b="2")])
    for mode, want in {"merge": {"a": "1", "b": "2"}, "replace": {"b": "2"}}.items():
        for model in (IntervalGraph.from_log(log, mode), SnapshotGraph.from_log(log, every_actions=1, attributes=mode)):
            assert as_state(model.snapshot_at_time(at(2)))["VERTEX", 1][2] == want


def test_empty_log(spark):
    log = log_of(spark, [])
    for model in (
        IntervalGraph.from_log(log),
        SnapshotGraph.from_log(log, every_actions=3),
        SnapshotGraph.from_log(log, every_seconds=3),
    ):
        assert as_state(model.snapshot_at_time(at(1))) == {}


# -- graph view --------------------------------------------------------------


def test_dangling_and_implicit(spark):
    log = log_of(spark, [vertex(0, 0, "CREATE", 1), vertex(1, 0, "CREATE", 2), edge(2, 0, "CREATE", 8, 1, 2), vertex(3, 1, "DELETE", 2)])
    model = IntervalGraph.from_log(log)
    assert ids(model.graph_at(at(1)).edges) == {8}
    assert ids(model.graph_at(at(1), drop_dangling=True).edges) == set()
    whole = model.graph_at(at(1), with_endpoints=True)
    assert ids(whole.vertices) == {1, 2} and ids(g.local_vertices(whole)) == {1}
    assert ids(model.vertices()) == {1} and ids(model.edges()) == {8}
    assert model.triplets().first()["dst_attributes"] is None
    assert model.reverse().edges.first()["src"] == 2


def chain(spark):
    edges = spark.createDataFrame(
        [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 2), (5, 5, 5), (6, 1, 3)], "id BIGINT, src BIGINT, dst BIGINT"
    ).withColumn("attributes", F.create_map(F.lit("w"), F.col("id").cast("string")))
    vertices = spark.range(1, 7).withColumn("attributes", F.create_map(F.lit("v"), F.col("id").cast("string")))
    return g.PropertyGraph(vertices, edges)


def test_measures(spark):
    graph = chain(spark)
    degree = {r["id"]: r["degree"] for r in g.degrees(graph.edges).collect()}
    assert degree == {1: 2, 2: 3, 3: 3, 4: 2, 5: 2}
    assert [(r["id"], r["degree"]) for r in g.out_degrees(graph.edges).collect()] == [(2, 1), (3, 1), (4, 1), (5, 1), (1, 2)]
    assert {r["id"] for r in g.in_out_degree_sum(graph.edges).collect()} == {2, 3, 4, 5}
    assert {r["id"] for r in g.in_out_degree_sum(graph.edges, "full_outer").collect()} == {1, 2, 3, 4, 5}
    assert {r["id"] for r in g.degree_median(g.degrees(graph.edges)).collect()} == {5}
    assert tuple(g.graph_stats(graph).first()) == (6, 6, 1.0)
    # 1 reaches 4 in two hops, 2 reaches 4 in two, 4 reaches 3 in two.
    assert hop_diameter(graph, 1).first()["diameter"] == 2


def test_diameter_needs_several_batches(spark):
    n = 150
    edges = spark.range(n - 1).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    graph = g.PropertyGraph(
        spark.range(n).withColumn("attributes", F.lit(None).cast("map<string,string>")), edges.where("src < 12 or src > 140")
    )
    assert hop_diameter(graph, 1).first()["diameter"] == 12


def test_messages_and_subgraph(spark):
    graph = chain(spark)
    sums = g.aggregate_messages(graph, F.sum, to_dst=F.col("src_attributes")["v"].cast("int"))
    assert {r["id"]: r["message"] for r in sums.collect()} == {2: 5, 3: 3, 4: 3, 5: 5}
    part = g.subgraph(graph, F.col("id") < 4, F.col("attributes")["w"] != "6")
    assert ids(part.vertices) == {1, 2, 3} and ids(part.edges) == {1, 2}
    assert g.map_edges(graph, F.col("src")).edges.where("attributes <> src").count() == 0
    other = g.map_vertices(graph, F.col("id") * 2).vertices
    assert other.where("attributes <> id * 2").count() == 0


# -- contacts ----------------------------------------------------------------

# A file of contacts, source target year.
CONTACTS = """1 2 2012,3 4 2012,5 2 2012,5 6 2012,2 6 2012,1 2 2013,1 6 2013,7 8 2013,7 9 2013,3 8 2013,3 4 2013,4 8 2013,
10 11 2013,11 9 2013,5 2 2013,5 6 2013,2 6 2013,8 9 2013"""


def test_contacts_file(spark, tmp_path):
    path = tmp_path / "contacts.txt"
    path.write_text("\n".join(line.strip() for line in CONTACTS.split(",")) + "\n")
    rows = contacts.read_contacts(spark, str(path), " ")
    assert rows.count() == 18
    for hot_rows in (None, 1):
        sizes = [topology.merge_contacts(rows, th, "time", hot_rows).count() for th in (0, 1, 2)]
        assert sizes == [18, 13, 13]
        sweep = topology.threshold_sweep(rows, [1, 2], "time", hot_rows).collect()
        assert [(r["threshold"], r["edges"]) for r in sweep] == [(0, 18), (1, 13), (2, 13)]
    merged = {(r["src"], r["dst"], r["valid_from"]) for r in topology.merge_contacts(rows, 1, "time").collect()}
    assert {(4, 8, 2013), (8, 9, 2013)} <= merged
    vertices, _ = topology.contacts_raw_graph(rows)
    assert vertices.count() == 11


def test_sessions_of_a_hot_pair(spark):
    times = [0, 1, 2, 50, 51, 100, 101, 102, 103, 200, 201, 202]
    rows = spark.createDataFrame([(1, 2, t) for t in times] + [(3, 4, 7)] * 3, "src BIGINT, dst BIGINT, time BIGINT")
    want = {(1, 2, 0, 2, 3), (1, 2, 50, 51, 2), (1, 2, 100, 103, 4), (1, 2, 200, 202, 3), (3, 4, 7, 7, 3)}
    for hot_rows in (None, 2, 3, 5):
        assert {tuple(r) for r in topology.merge_contacts(rows, 10, "time", hot_rows).collect()} == want


# -- ordered rows ------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [1, 4, 100])
def test_values_across_slices(spark, hot_rows):
    rows = [(k, i, None if i % 3 else i) for k, n in ((1, 40), (2, 3), (None, 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "k INT, i INT, v INT").repartition(5)
    found = (
        ordered.OrderedRows.of(df, ["k"], ["i"], hot_rows)
        .with_values(lag={"p": F.col("v")}, lead={"n": F.col("v")}, before={"b": F.col("v")}, after={"a": F.col("v")})
        .rows()
        .collect()
    )
    assert len(found) == len(rows)
    for k, n in ((1, 40), (2, 3), (None, 11)):
        mine = sorted((r for r in found if r["k"] == k), key=lambda r: r["i"])
        values = [r["v"] for r in mine]
        for i, r in enumerate(mine):
            assert r["p"] == (values[i - 1] if i else None)
            assert r["n"] == (values[i + 1] if i + 1 < n else None)
            assert r["b"] == next((v for v in reversed(values[:i]) if v is not None), None)
            assert r["a"] == next((v for v in values[i + 1 :] if v is not None), None)


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    numbered = ordered.dense_index(df.repartitionByRange(6, "x"), ["x"])
    assert numbered.where("x <> position").count() == 0 and numbered.count() == 1000


def test_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_CHUNK", 4)
    df = spark.createDataFrame([(1, 9), (2, 0), (3, 4), (4, 1)], "id BIGINT, n BIGINT")
    rows = sorted((r["id"], r["k"]) for r in ordered.repeat_rows(df, "n", ["id"]).collect())
    assert rows == [(i, k) for i, n in ((1, 9), (3, 4), (4, 1)) for k in range(n)]


# -- text --------------------------------------------------------------------


def test_text_round_trip(spark):
    entries = [
        vertex(0, 0, "CREATE", 1, color="red", size="3"), vertex(1, 1, "UPDATE", 1, note=""),
        edge(2, 2, "CREATE", 5, 1, 2), edge(3, 3, "DELETE", 5, 1, 2),
    ]
    path = new_path(spark, "text")
    changelog_text.write_changelog_tsv(log_of(spark, entries), path)
    log, rejected = changelog_text.read_changelog_tsv(spark, path)
    assert rejected.count() == 0
    back = [(*tuple(r)[:7], dict(r["attributes"])) for r in log.orderBy("seq").collect()]
    assert back == entries


def test_bad_lines(spark):
    ok = "2020-01-01T00:00:00Z\tCREATE\tVERTEX:1"
    lines = {
        ok: None, f"{ok}\t": None, f"{ok}\ta:b\tc:": None, f"{ok}\ta:b\ta:c": None,
        "2020-01-01T00:00:00Z\tCREATE": "too_few_fields", "": "too_few_fields",
        "2020-01-01\tCREATE\tVERTEX:1": "bad_timestamp", "2020-13-01T00:00:00Z\tCREATE\tVERTEX:1": "bad_timestamp",
        "2020-01-01T00:00:00Z\tDROP\tVERTEX:1": "bad_action", "2020-01-01T00:00:00Z\tCREATE\tVERTEX:x": "bad_entity",
        "2020-01-01T00:00:00Z\tCREATE\tEDGE:1:2": "bad_entity", f"{ok}\ta:b:c": "bad_attributes",
        f"{ok}\tplain": "bad_attributes", f"{ok}\ta:b\t\tc:d": "bad_attributes",
    }
    df = spark.createDataFrame([(line,) for line in lines], "value STRING")
    entries, rejected = changelog_text.parse_lines(df)
    assert {r["value"]: r["reason"] for r in rejected.collect()} == {k: v for k, v in lines.items() if v}
    maps = [dict(r["attributes"]) for r in entries.collect()]
    assert sorted(maps, key=repr) == sorted([{}, {}, {"a": "b", "c": ""}, {"a": "c"}], key=repr)


def test_separators_are_stripped(spark):
    log = log_of(spark, [vertex(0, 0, "CREATE", 1, **{"a:b": "x\ty:z\nw"})])
    line = changelog_text.log_lines(log).first()["value"]
    assert line == "1970-01-01T00:00:00Z\tCREATE\tVERTEX:1\tab:xyzw"


# -- scalar functions --------------------------------------------------------


def test_interval_predicates(spark):
    spans = {"12": (1, 2), "13": (1, 3), "14": (1, 4), "23": (2, 3), "24": (2, 4), "34": (3, 4), "45": (4, 5)}
    c = lambda name: [tm.instant(at(T[i])) for i in spans[name]]
    checks = [
        (iv.overlaps(*c("13"), *c("24")), True), (iv.overlaps(*c("23"), *c("12")), True),
        (iv.overlaps(*c("23"), *c("34")), True), (iv.overlaps(*c("13"), *c("45")), False),
        (iv.contains_instant(*c("12"), at(T[1])), True), (iv.contains_instant(*c("12"), at(T[2])), True),
        (iv.half_open_contains(*c("12"), at(T[2])), False), (iv.left_open_contains(*c("12"), at(T[1])), False),
        (iv.contains_interval(*c("12"), *c("12")), True), (iv.contains_interval(*c("14"), *c("23")), True),
        (iv.contains_interval(*c("13"), *c("24")), False), (iv.contains_interval(*c("12"), *c("34")), False),
    ]
    row = spark.range(1).select(*[check.alias(f"c{i}") for i, (check, _) in enumerate(checks)]).first()
    assert list(row) == [want for _, want in checks]


def test_times(spark):
    rows = tm.even_timestamps(spark, 5, at(0), at(240)).orderBy("position").collect()
    assert [r["ts"] for r in rows] == [at(60 * i) for i in range(5)]
    assert tm.even_timestamps(spark, 1, at(7), at(99)).first()["ts"] == at(7)
    # Both sides of a change of the clocks in the session's zone.
    text = spark.createDataFrame([("2024-03-10 02:30:00.000001",), ("1969-12-31 23:59:59.5",)], "t STRING")
    ts = F.col("t").cast("timestamp_ntz")
    assert text.where(tm.micros_to_ts(tm.epoch_micros(ts)) != ts).count() == 0
    assert [r[0] for r in text.select(tm.epoch_seconds(ts)).collect()] == [1710037800, -1]


def test_attribute_functions(spark):
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2", "c": "3"})], "x MAP<STRING,STRING>, y MAP<STRING,STRING>")
    row = df.select(att.merge_attributes(F.col("x"), F.col("y")), att.attributes_text(F.col("x"))).first()
    assert dict(row[0]) == {"a": "1", "b": "2", "c": "3"} and row[1] == "a=1;b=1"


# -- synthesis, storage, measures --------------------------------------------


def test_sort_by_degree(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id BIGINT, degree BIGINT")
    order = lambda mode: [r["id"] for r in synthesis.sort_by_mode(df, mode).collect()]
    assert order("positive") == [1, 2, 3] and order("negative") == [3, 2, 1]
    assert sorted(order("uniform")) == [1, 2, 3]


def test_generated_log_is_legal_and_correlated(spark):
    edges = spark.createDataFrame(
        [(i, i % 4, 9, at(1000 * i), at(1000 * i + 500)) for i in range(1, 25)],
        "edge_id BIGINT, src BIGINT, dst BIGINT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ",
    )
    vertices = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 9, 77)], "id BIGINT")
    d = synthesis.Distribution("uniform", 0, 20)
    by_vertex, by_edge = synthesis.assign_updates(vertices, edges, d)
    ranked = [(r["degree"], r["updates"]) for r in by_vertex.orderBy("degree", "id").collect()]
    assert len(ranked) == 6 and ranked[0][0] == 0 and [u for _, u in ranked] == sorted(u for _, u in ranked)
    log = synthesis.expand_changelog(by_vertex, by_edge)
    assert cl.validate_changelog(log, strict=True).count() == 0
    assert log.where("action = 'DELETE'").count() == 24 == log.where("entity_type = 'EDGE' and action = 'CREATE'").count()
    assert log.count() == sum(u for _, u in ranked) + 48 + by_edge.agg(F.sum("updates")).first()[0]
    path = store.changelog_path(new_path(spark, "logs"), "test", d)
    calls = []
    for _ in range(2):
        kept = store.load_or_generate_changelog(spark, path, lambda: calls.append(1) or log)
    assert len(calls) == 1
    assert kept.count() == log.count()


def test_zipf_covers_every_row(spark):
    drawn = synthesis.draw_counts(spark.range(2000), ["id"], synthesis.Distribution("zipf", 30, 1.2))
    low, high, n = drawn.agg(F.min("updates"), F.max("updates"), F.count("updates")).first()
    assert (low, n) == (1, 2000) and high <= 30


def test_scaling_slope(spark):
    # Published timings of one query over growing logs, and their known normalised slope.
    points = [(49668, 461), (83591, 891), (115538, 1143), (148223, 1781), (181965, 1892)]
    df = spark.createDataFrame([("f", n, float(ms)) for n, ms in points], "file STRING, n_logs BIGINT, value DOUBLE")
    assert abs(measures.scaling_slope(df).first()["slope"] - 6.020e-06) < 1e-9


def test_plans_read_only_what_they_need(spark):
    log = log_of(spark, [vertex(i, i, "CREATE", i, a="1") for i in range(5)])
    path = new_path(spark, "intervals")
    IntervalGraph.from_log(log).save(path)
    model = IntervalGraph.load(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    neighbours = plan(model.direct_neighbours(3, at(1), at(2)))
    assert "LessThanOrEqual(valid_from" in neighbours and "attributes" not in neighbours
    built = plan(validity.attribute_intervals(log))
    assert built.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in built
    assert "SinglePartition" not in plan(validity.validity_intervals(log))
