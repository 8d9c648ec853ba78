"""Things that must not grow with the data, and stores that must survive an interrupted run."""

import datetime as dt

from pyspark.sql import functions as F
from tidegraph.operators import snapshots, synthesis, validity
from tidegraph.plans.temporal_graph import IntervalGraph, SnapshotGraph
from tidegraph.schema import CHANGELOG
from tidegraph.sources import store
from tidegraph.storage import new_path, stored, work_dir

START = dt.datetime(2000, 1, 1)


def log_of(spark, rows):
    return spark.createDataFrame(rows, CHANGELOG)


def busy_entity(spark, n=200):
    """One vertex whose every entry writes a key of its own."""
    rows = [(i, START + dt.timedelta(seconds=i), "UPDATE" if i else "CREATE", "VERTEX", 1, None, None, {f"k{i}": "v"}) for i in range(n)]
    names = CHANGELOG.fieldNames()
    order = ["seq", "ts", "action", "entity_type", "id", "src", "dst", "attributes"]
    return log_of(spark, [tuple(dict(zip(order, r))[c] for c in names) for r in rows])


def test_a_hot_entity_with_a_key_per_entry_is_not_broadcast(spark):
    log = stored(busy_entity(spark), "busy")
    plain = validity.attribute_intervals(log)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sliced = validity.attribute_intervals(log, hot_rows=20)
        plan = sliced._jdf.queryExecution().executedPlan().toString()
        by_key = [line for line in plan.splitlines() if "LeftOuter" in line and "key#" in line]
        assert by_key and not any("Broadcast" in line for line in by_key)
        assert sorted(map(repr, sliced.collect())) == sorted(map(repr, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_an_interval_may_span_millions_of_windows(spark):
    rows = [
        {"seq": 0, "ts": START, "action": "CREATE", "entity_type": "VERTEX", "id": 1, "attributes": {}},
        {"seq": 1, "ts": START + dt.timedelta(days=30), "action": "CREATE", "entity_type": "VERTEX", "id": 2, "attributes": {}},
    ]
    log = log_of(spark, [tuple(r.get(c) for c in CHANGELOG.fieldNames()) for r in rows])
    states = snapshots._every(
        log.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp"))), "__at", 1_000_000,
        int(log.select(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]), 30 * 86_400, "replace", None,
    )
    assert states.count() == 30 * 86_400 + 2
    assert dict(states.dtypes)["snapshot_no"] == "bigint"


def test_zipf_has_no_largest_maximum(spark):
    drawn = synthesis.draw_counts(spark.range(500), ["id"], synthesis.Distribution("zipf", 2_000_000, 1.0))
    values = [r["updates"] for r in drawn.collect()]
    assert len(values) == 500 and min(values) >= 1 and max(values) > 100_000 and max(values) <= 2_000_000


def test_a_half_written_store_is_replaced(spark):
    path = new_path(spark, "broken")
    log = busy_entity(spark, 5)
    log.limit(2).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)
    assert store.load_or_generate_changelog(spark, path, lambda: log).count() == 5
    assert store.load_or_generate_changelog(spark, path, lambda: log.limit(0)).count() == 5


def test_the_work_folder_is_shared(spark):
    assert work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def contacts_log(spark, n=400):
    rows = []
    for i in range(n):
        ends = {"src": i % 40, "dst": 100 + i % 7}
        at = START + dt.timedelta(days=10 * i)
        rows.append({"seq": 2 * i, "ts": at, "action": "CREATE", "entity_type": "EDGE", "id": i, "attributes": {"a": "b"}, **ends})
        rows.append({"seq": 2 * i + 1, "ts": at + dt.timedelta(days=9), "action": "DELETE", "entity_type": "EDGE", "id": i, **ends})
    return stored(log_of(spark, [tuple(r.get(c) for c in CHANGELOG.fieldNames()) for r in rows]), "contacts-log")


def test_stored_models_answer_by_vertex_and_by_end_year(spark):
    log = contacts_log(spark)
    for fresh in (IntervalGraph.from_log(log), SnapshotGraph.from_log(log, every_actions=100)):
        path = new_path(spark, "model")
        fresh.save(path)
        kept = type(fresh).load(spark, path)
        for vertex in (3, 104, 999):
            for span in ((None, None), (START + dt.timedelta(days=400), START + dt.timedelta(days=900))):
                want = sorted(r["id"] for r in fresh.direct_neighbours(vertex, *span).collect())
                assert sorted(r["id"] for r in kept.direct_neighbours(vertex, *span).collect()) == want
        asked = kept.direct_neighbours(3)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(vertex,3)" in asked
        for days in (0, 5, 365, 3000, 3995, 9000):
            at = START + dt.timedelta(days=days)
            want = sorted(map(repr, fresh.snapshot_at_time(at).collect()))
            assert sorted(map(repr, kept.snapshot_at_time(at).collect())) == want
    stored_intervals = IntervalGraph.from_log(log)
    path = new_path(spark, "intervals")
    stored_intervals.save(path)
    plan = IntervalGraph.load(spark, path).snapshot_at_time("2009-06-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(end_year" in plan and ">= 2009" in plan
