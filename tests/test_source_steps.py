"""Joins and maps of the logs made from the supplied tables."""

from pyspark.sql import functions as F
from tidegraph.functions.attributes import attributes_of
from tidegraph.sources import samples

from .helpers import at


def tables(spark, path):
    rows = {
        "customer": ([(1, 10), (2, 11), (2, 12), (3, None), (None, 13)], "c_custkey BIGINT, c_nationkey INT"),
        "supplier": ([(5, 20), (6, 21), (6, 20), (None, 22)], "s_suppkey BIGINT, s_nationkey INT"),
        "orders": ([(7, 1), (7, 2), (8, 3), (9, None), (None, 1)], "o_orderkey BIGINT, o_custkey BIGINT"),
        "lineitem": (
            [(7, 5, at(1)), (7, 5, at(1)), (7, 6, None), (8, 6, at(2)), (9, 5, at(3)), (None, 5, at(4)), (7, None, at(5))],
            "l_orderkey BIGINT, l_suppkey BIGINT, l_shipdate TIMESTAMP_NTZ",
        ),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return {name: data for name, (data, _) in rows.items()}


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_line_items_are_not_moved_by_customer(spark, tmp_path):
    data = tables(spark, str(tmp_path))
    found = samples.nation_contacts(spark, str(tmp_path))
    want = {
        (cn, sn, day)
        for ok, sk, day in data["lineitem"]
        for o, ck in data["orders"]
        for c, cn in data["customer"]
        for s, sn in data["supplier"]
        if None not in (ok, sk, o, ck, c, s) and (ok, ck, sk) == (o, c, s)
    }
    rows = [tuple(r) for r in found.collect()]
    assert len(want) > 8 and len(rows) == len(want) and set(rows) == want
    joins = [n for n in _nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    by_customer = [n.toString() for n in joins if "c_custkey" in n.condition().toString()]
    assert len(joins) == 3 and len(by_customer) == 1 and "l_orderkey" not in by_customer[0]


def test_maps_without_gaps_are_not_filtered(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (None, None)], "a BIGINT, b STRING")
    found = rows.select("a", "b", attributes_of(a=F.col("a"), b=F.col("b")).alias("map"))
    for r in found.collect():
        assert r["map"] == {k: str(r[k]) for k in "ab" if r[k] is not None}
    assert "CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString()
