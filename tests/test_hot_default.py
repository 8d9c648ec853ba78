"""The size from which a key is cut into slices, without being asked for another."""

from pyspark.sql import functions as F

from tidegraph.operators.ordered import OrderedRows


def test_a_key_of_some_hundred_thousand_rows_is_sliced(spark):
    rows = OrderedRows.of(spark.range(300_000).select(F.lit(1).alias("key"), "id"), ["key"], ["id"])
    assert rows.sliced is not None and rows.sliced.select("__slice").distinct().count() > 1
    assert rows.with_values(lag={"before": F.col("id")}).rows().where("before = id - 1 OR (id = 0 AND before IS NULL)").count() == 300_000
