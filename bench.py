"""Time the temporal queries on stored models, and the building of the models.

Prints one JSON line. The log holds customers and suppliers as vertices and their
order contacts as edges; building and asking are timed apart.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegraph.catalogue import QUERIES
from tidegraph.operators import graph as g
from tidegraph.operators.changelog import nth_log_timestamp
from tidegraph.operators import topology as tp
from tidegraph.plans.temporal_graph import IntervalGraph, SnapshotGraph
from tidegraph.sources import samples
from tidegraph.storage import clear, new_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
SUPPLIER = 10_000_007
CUSTOMER = 56
MIDDLE = "1998-06-01"


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidegraph-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def once(name, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def query(name, make):
        """Mean of repeated runs after one to warm up; every row is produced."""
        make().write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        for _ in range(RUNS):
            make().write.format("noop").mode("overwrite").save()
        seconds[name] = round((time.perf_counter() - start) / RUNS, 3)

    log = once("build_log", lambda: samples.stored_log(spark, SF_DIR, "trade"))
    entries = log.count()
    interval_path, snapshot_path = new_path(spark, "intervals"), new_path(spark, "snapshots")
    once("build_intervals", lambda: IntervalGraph.from_log(log).save(interval_path))
    once(
        "build_snapshots", lambda: SnapshotGraph.from_log(log, every_actions=entries // 10).save(snapshot_path)
    )
    models = {
        "intervals": IntervalGraph.load(spark, interval_path),
        "snapshots": SnapshotGraph.load(spark, snapshot_path),
    }
    # As the published runs ask: at a twentieth of the log.
    early = nth_log_timestamp(log, 20).first()["ts"]
    low, half = log.agg(F.min("ts"), F.min("ts") + (F.max("ts") - F.min("ts")) / 2).first()
    for name, model in models.items():
        query(f"q1_neighbours_{name}", lambda: model.direct_neighbours(SUPPLIER))
        query(f"q2_snapshot_{name}", lambda: model.snapshot_at_time(early))
        query(f"q3_entity_{name}", lambda: model.entity_at_time("VERTEX", CUSTOMER, early))
        query(f"q4_activated_{name}", lambda: model.activated_entities(low, half))
        query(f"q7_neighbours_half_{name}", lambda: model.direct_neighbours(SUPPLIER, low, half))
    query("q5_snapshot_late_snapshots", lambda: models["snapshots"].snapshot_at_time(MIDDLE))
    query("merge_contacts", lambda: tp.merge_contacts(samples.trade_contacts(spark, SF_DIR), 90 * samples.DAY))
    query("threshold_sweep", lambda: QUERIES["threshold_sweep"](spark, SF_DIR))
    query("degrees", lambda: g.degrees(samples.trade_contacts(spark, SF_DIR)))
    query("validity_intervals", lambda: QUERIES["validity_intervals"](spark, SF_DIR))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "log_entries": entries,
            }
        )
    )
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
