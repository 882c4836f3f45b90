from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skeinwork import queries
from skeinwork.operators import gas
from skeinwork.storage import settle, with_row_index


def test_registry():
    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["vertex", "distance"] and got.count() > 0


def test_row_index(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v"), (F.col("id") % 7).alias("w")).repartition(5)
    got = with_row_index(df, ["v"])
    assert [(r["v"], r["row_index"]) for r in got.orderBy("v").collect()] == [(k, k) for k in range(1000)]
    assert with_row_index(df.limit(0), ["v"]).count() == 0
    assert sorted(r["row_index"] for r in with_row_index(df, ["w"]).collect()) == list(range(1000))


def test_own_program(spark):
    """Widest paths: the extension point takes any scatter, gather and apply."""
    widest = gas.Program(lambda d, w: F.least(d, w), F.max, F.greatest)
    edges = spark.createDataFrame([(0, 1, 5), (0, 2, 2), (1, 2, 4), (2, 3, 9)], "src long, dst long, weight long")
    start = spark.createDataFrame([(0, 100)], "vertex long, value long")
    assert rows(gas.run(widest, edges, start)) == [(0, 100), (1, 5), (2, 4), (3, 4)]
    assert rows(settle(edges, "t")) == rows(edges)
