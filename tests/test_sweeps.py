import json
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import compare, gas, generate, records
from skeinwork.plans import sweep
from skeinwork.sources import files

CASE = generate.PRESETS["smoke"][0]


def hang(spark):
    """A job that never ends by itself."""
    spark.range(8).select(F.udf(lambda x: time.sleep(60) or x, "long")("id")).write.format("noop").mode("overwrite").save()
    return {"status": "PASS"}


def test_a_case_that_hangs_is_cut(spark):
    began = time.monotonic()
    row = sweep.limited(spark, lambda: hang(spark), "stuck", 3)
    assert (row["case"], row["status"], row["exit_code"]) == ("stuck", "TIMEOUT", 124) and 3 <= row["wall_seconds"] < 30 and time.monotonic() - began < 30
    assert not spark.sparkContext.getJobTags() and spark.range(5).count() == 5  # later jobs aren't touched
    good = sweep.limited(spark, lambda: {"status": "PASS", "case": "x"}, "x", 30)
    assert good["exit_code"] == 0 and good["error"] is None


def test_sweep_rules(spark, monkeypatch):
    said = iter(["PASS", "TIMEOUT", "PASS", "FAIL", "PASS"])
    monkeypatch.setattr(sweep, "run_case", lambda spark, case, **o: {"case": case.name, "status": next(said)})
    assert [r["status"] for r in sweep.run_sweep(spark, [CASE] * 5)] == ["PASS", "TIMEOUT"]
    assert [(r["status"], r["exit_code"]) for r in sweep.run_sweep(spark, [CASE] * 3, continue_on_fail=True)] == [("PASS", 0), ("FAIL", 1), ("PASS", 0)]

    def broken(spark, case, **o):
        raise RuntimeError("no device\nmore")

    monkeypatch.setattr(sweep, "run_case", broken)
    row = sweep.run_sweep(spark, [CASE, CASE])
    assert [(r["status"], r["exit_code"], r["error"]) for r in row] == [("FAIL", 1, "no device")]
    assert sweep.goes_on({"status": "PASS", "exit_code": 1})


def test_edge_files(spark, tmp_path):
    (tmp_path / "a.edges").write_text("0 -> 1\n1 -> 2\n0 -> a\n")
    (tmp_path / "b.edges").write_text("0 => 1\n")
    got = sweep.run_edge_files(spark, [f"file://{tmp_path}/{f}" for f in ("b.edges", "gone.edges", "a.edges")], 0, 2)
    assert [(r["case"], r["status"], r["exit_code"], r["reached"]) for r in got] == [("b.edges", "FAIL", 1, None), ("gone.edges", "FAIL", 1, None), ("a.edges", "PASS", 0, 4)]
    assert len(sweep.run_edge_files(spark, [f"file://{tmp_path}/{f}" for f in ("b.edges", "a.edges")], 0, 2, continue_on_fail=False)) == 1


def test_wrong_results_fail(spark, monkeypatch):
    right = gas.sssp
    monkeypatch.setattr(gas, "sssp", lambda *a: right(*a).withColumn("distance", F.col("distance") + (F.col("vertex") == 3).cast("long")))
    assert sweep.run_case(spark, CASE)["status"] == "FAIL"


# -- statistics ----------------------------------------------------------------------------


def percentile(values, q):
    at = (len(values) - 1) * q
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


@pytest.mark.parametrize("partitions", ["1", "6"])
def test_percentiles(spark, partitions):
    """One large group, equal values, small groups and null keys, over several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        r = random.Random(7)
        data = [("hot", r.gauss(0, 5)) for _ in range(900)] + [("equal", 2.5)] * 300 + [("few", 1.0), ("few", 4.0), ("one", 3.0), (None, 8.0), (None, 9.0), ("none", None)] + [("mixed", float(r.randrange(4))) for _ in range(101)]
        got = {x["k"]: x for x in records.stats(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == {"hot", "equal", "few", "one", None, "mixed"}
    for k, x in got.items():
        v = sorted(b for a, b in data if a == k)
        assert (x["count"], x["minimum"], x["maximum"]) == (len(v), v[0], v[-1])
        for name, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9)):
            assert abs(x[name] - percentile(v, q)) < 1e-12, (k, name)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert records.stats(df, ["k"], "v").count() == 0
    whole = records.stats(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double"), [], "v").first()
    assert (whole["count"], whole["median"]) == (2, 2.0)


def test_nested_summary(spark):
    r = spark.createDataFrame([("c\"1", "a", False, True, 3.0), ("c\"1", "a", False, True, 5.0), ("c\"1", "b", True, True, 1.0)], "case_id string, system string, warmup boolean, correct boolean, ms double")
    groups = spark.createDataFrame([("c\"1", s, k, 2, 0, 2, 2, True, [], True, 4.0) for k, s in enumerate("ab")], "case_id string, system string, ord int, runs_total long, warmups long, measured_runs long, correct_runs long, identity_ok boolean, blockers array<string>, claim_eligible boolean, median_ms double")
    inputs = spark.createDataFrame([("runs.jsonl", "00ff")], "path string, sha256 string")
    got = json.loads(records.summary_json(groups, records.rank(groups), records.metric_stats(r, ["ms"]), inputs).first()["json"])
    assert got["groups"]["a"]["statistics"]["ms"]["median"] == 4.0 and got["groups"]["b"]["statistics"] == {}
    assert got["ranking"]["winner"] == "a" and got["inputs"] == {"runs.jsonl": "00ff"}
    assert "ms" in records.named_metrics(r.withColumnRenamed("ms", "own_ms"), {"own_ms": "ms", "absent": "x"}).columns


# -- files -------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    for folder, name, text in (("x", "a.log", "1\n2\n3\n"), ("x", "b.log", "4\n"), ("y", "a.log", "5\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    import os

    os.utime(tmp_path / "x" / "a.log", (2_000_000_000, 2_000_000_000))
    found = files.listing(spark, f"file://{tmp_path}", "*.log")
    assert {(r["folder"][-1], r["name"]) for r in files.newest(found, ["folder"]).collect()} == {("x", "a.log"), ("y", "a.log")}
    expected = found.select("path").union(spark.createDataFrame([("gone.log",)], "path string"))
    assert rows(files.missing(expected, found)) == [("gone.log",)]
    with pytest.raises(FileNotFoundError, match="gone.log"):
        files.need_all(expected, found)
    files.need_all(found.select("path"), found)
    lines = spark.createDataFrame([("f", k, f"l{k}") for k in range(1, 6)] + [("g", 1, "only")], "file string, line_no long, value string")
    assert rows(files.head(lines, 2)) == [("f", 1, "l1"), ("f", 2, "l2"), ("g", 1, "only")]
    assert rows(files.tail(lines, 2)) == [("f", 4, "l4"), ("f", 5, "l5"), ("g", 1, "only")]


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (None, 1, "d"), (1, None, "e")], "k long, at long, v string")
    assert rows(compare.last_per_key(df, ["k"], "at")) == [(None, 1, "d"), (1, 7, "b"), (2, None, "c")]
