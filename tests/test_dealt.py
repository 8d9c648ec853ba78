"""Tasks get a bounded number of rows, and large keys are found without counting every key."""

import pytest

from pyspark.sql import functions as F
from tidegraph.operators import ordered, topology

from .helpers import at


def contacts(spark, n=400):
    rows = [(i % 20, 100 + i % 7, at(60 * (i // 2))) for i in range(n)] + [(None, 100, at(0)), (1, None, at(5)), (None, 100, at(9))]
    return spark.createDataFrame(rows, "src BIGINT, dst BIGINT, ts TIMESTAMP_NTZ")


def test_sessions_are_made_in_tasks_of_so_many_rows(spark, monkeypatch):
    found = contacts(spark)
    want = sorted(map(repr, topology.merge_contacts(found, 600).collect()))
    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    members = topology.contacts_in_sessions(found, 600)
    assert members.rdd.getNumPartitions() == -(-members.count() // 10) > 30
    assert sorted(map(repr, topology.sessions_of(members).collect())) == want


def test_few_rows_are_left_to_spark(spark):
    rows = spark.range(100)
    assert ordered.dealt(rows, 100, "id") is rows


@pytest.mark.parametrize("hot_rows", [1, 5, 30, 1000])
def test_large_keys_are_those_of_an_exact_count(spark, hot_rows):
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.floor(F.sqrt("id"))).alias("k"), (F.col("id") % 2).alias("l"), "id")
    counts = rows.groupBy("k", "l").count().where(F.col("count") > hot_rows).collect()
    found = ordered._large_keys(rows, ["k", "l"], 500, hot_rows)
    assert sorted(map(repr, ([] if found is None else [tuple(r) for r in found.collect()]))) == sorted(map(repr, map(tuple, counts)))


def test_only_keys_of_large_buckets_are_counted(spark):
    rows = spark.range(2000).select((F.col("id") % 500).alias("k"), "id")
    assert ordered._large_keys(rows, ["k"], 2000, 400) is None
