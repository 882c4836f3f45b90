import duckdb
import pytest
from conftest import rows

from skeinwork import queries
from skeinwork import streaming
from skeinwork.operators import generate, levels, updates
from skeinwork.plans import sweep
from skeinwork.sources import sinks

SF = "/root/testdata/sf0.001"


def test_sweep(spark):
    got = sweep.run_sweep(spark, generate.PRESETS["smoke"])
    assert [(r["status"], r["final_edges"], r["reached"]) for r in got] == [("PASS", 15, 16), ("PASS", 28, 15), ("PASS", 95, 18)]
    assert sweep.run_case(spark, generate.PRESETS["smoke"][1], dry_run=True)["status"] == "DRY_RUN"
    assert sweep.run_case(spark, generate.PRESETS["smoke"][1], skip_verify=True)["status"] == "PERF_ONLY"
    with pytest.raises(ValueError):
        sweep.run_case(spark, generate.PRESETS["smoke"][1], dry_run=True, skip_verify=True)
    assert "tiny" in sinks.report("r", {"runs": spark.createDataFrame([("tiny",)], "case string")})


def test_streams_equal_batch(spark, tmp_path):
    ops = [(i, i * 7 % 5, i * 3 % 4, i % 3 % 2) for i in range(60)]
    schema = "seq long, src long, dst long, typ tinyint"
    for k in range(3):
        spark.createDataFrame(ops[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "u"))
    q = streaming.live_edges(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable(), q.stop()
    assert rows(spark.table("live")) == rows(updates.replay(None, spark.createDataFrame(ops, schema)))
    store = levels.Store(batch=20)
    s = streaming.LevelStream(store)
    batch = lambda k: spark.createDataFrame([(a, b, 1, 2 * t - 1) for _, a, b, t in ops[20 * k : 20 * k + 20]], "src long, dst long, weight long, diff long")
    for k in (0, 1, 1, 2):
        s.add(batch(k), k)
    import pyspark.sql.functions as F

    whole = levels.state(batch(0).withColumn("batch", F.lit(1).cast("long")).union(batch(1).withColumn("batch", F.lit(2).cast("long"))).union(batch(2).withColumn("batch", F.lit(3).cast("long"))), store)
    assert sorted((t, *r) for t, x in s.levels.items() for r in rows(x)) == rows(whole)


def test_windows(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    assert streaming.rates(e, width="1 day").agg({"events": "sum"}).first()[0] == e.count()
    assert streaming.sessions(e, "user_id").agg({"events": "sum"}).first()[0] == e.count()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None if x is None else str(x)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.execute(queries.SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    b = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == b
