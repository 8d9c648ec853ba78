"""The vertices in the middle by degree, from degrees that are made once."""

from tidegraph.operators import graph as g


def test_degrees_are_made_once_for_all_passes(spark):
    edges = spark.createDataFrame([(i % 7, 10 + i % 4) for i in range(60)], "src BIGINT, dst BIGINT")
    median = g.degree_median(g.degrees(edges))
    # What finds the places reads a stored table; without it every pass would count the edges anew.
    plan = median._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Exchange" not in plan and "Aggregate" not in plan
    counted = sorted((r["degree"], r["id"]) for r in g.degrees(edges).collect())
    assert sorted((r["degree"], r["id"]) for r in median.collect()) == sorted({counted[(len(counted) - 1) // 2], counted[len(counted) // 2]})
    assert g.degree_median(g.degrees(edges.where("src < 0"))).count() == 0
