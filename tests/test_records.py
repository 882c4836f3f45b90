import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import compare, records
from skeinwork.sources import has_key, read_records, read_selection

SYSTEMS = ("a", "b", "c")
M = records.METRICS[0]


def load(spark, tmp_path, recs, cases=("x",)):
    (tmp_path / "r.jsonl").write_text("\n\n".join(map(json.dumps, recs)) + "\n")
    (tmp_path / "s.json").write_text(json.dumps({"cases": [{"case_id": c, "graph_sha256": "g", "bfs_source": 0} for c in cases]}, indent=1))
    return read_records(spark, str(tmp_path / "r.jsonl"), [M]), read_selection(spark, str(tmp_path / "s.json"))


def rec(system="a", ms=1.0, case="x", **more):
    return {"case_id": case, "system": system, "correct": True, "graph_sha256": "g", "source": 0, "performance_claim_eligible": True, "source_states": {}, "host_sha256": "h", M: ms} | more


def test_percentiles(spark):
    got = records.stats(spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double"), ["k"], "v").first()
    assert got["minimum"] == 1 and abs(got["p10"] - 1.3) < 1e-12 and got["median"] == 2.5 and abs(got["p90"] - 3.7) < 1e-12


def test_missing_system_fails_closed(spark, tmp_path):
    r, s = load(spark, tmp_path, [{k: v for k, v in rec().items() if k != "system"}])
    with pytest.raises(Exception, match="fail closed"):
        records.summarize(r, s, SYSTEMS).collect()


def test_unknown_case_and_bad_line(spark, tmp_path):
    r, s = load(spark, tmp_path, [rec(case="y")])
    with pytest.raises(Exception, match="unknown case"):
        records.summarize(r, s, SYSTEMS).collect()
    (tmp_path / "bad.jsonl").write_text('{"case_id": 1}\n{oops\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        read_records(spark, str(tmp_path / "bad.jsonl"), [M]).collect()


def test_gates_and_ranking(spark, tmp_path):
    recs = [rec(s, float(k)) for s in SYSTEMS for k in range(1, 11)] + [rec("other")] + [rec("a", 9.0, "y", performance_claim_eligible=None, performance_valid=True)]
    r, s = load(spark, tmp_path, recs, ("x", "y", "unused"))
    g = records.summarize(r, s, SYSTEMS, present=has_key(F.col("raw"), "performance_claim_eligible"))
    by = {(x["case_id"], x["system"]): x for x in g.collect()}
    assert len(by) == 6 and by["x", "a"]["claim_eligible"] and by["x", "a"]["median_ms"] == 5.5
    assert by["y", "a"]["blockers"] == ["measured_runs=1<10", "performance_claim_not_eligible"]
    assert by["y", "b"]["blockers"] == ["measured_runs=0<10", "performance_claim_not_eligible", "source_provenance_missing_or_dirty", "artifact_pair_not_unique", "comparable_resident_batch_end_to_end_missing"]
    ranks = records.rank(g)
    assert rows(ranks) == [("x", True, "a", 5.5), ("y", False, None, None)]
    assert records.all_eligible(ranks).first()[0] is False and records.all_eligible(ranks.limit(0)).first()[0] is False
    assert records.ignored_records(r, SYSTEMS).first()[0] == 1
    assert json.loads(records.summary_json(g, ranks).where("case_id = 'x'").first()["json"])["ranking"]["winner"] == "a"


def test_identity_provenance_and_null_hash(spark, tmp_path):
    recs = [rec("a", host_sha256=None), rec("a"), rec("b", graph_sha256="other"), rec("c", source_states={"m": {"commit": None, "tracked_dirty": False}}), rec("c", warmup=True, host_sha256="z")]
    r, s = load(spark, tmp_path, recs)
    b = {x["system"]: x for x in records.summarize(r, s, SYSTEMS, minimum=1).collect()}
    assert b["a"]["blockers"] == ["artifact_pair_not_unique"] and b["b"]["blockers"] == ["input_identity_mismatch"]
    assert b["c"]["blockers"] == ["source_provenance_missing_or_dirty"] and b["c"]["warmups"] == 1
    strict = {x["system"]: x["blockers"] for x in records.summarize(r, s, SYSTEMS, minimum=1, strict=True).collect()}
    assert "source_provenance_missing_or_dirty" in strict["b"]


def test_pairs(spark):
    chain = spark.createDataFrame([("x", "PASS", "4", "3", "1.5", "2.5"), ("z", "FAIL", "4", "3", "", "2")], "case string, status string, vertices string, final_edges string, update_ms string, compute_e2e_ms string")
    level = spark.createDataFrame([("x", "PASS", "4", "3", "2", "1", "0"), ("w", "PASS", "1", "1", "0", "0", "0")], "case string, status string, vertices string, input_edges string, kernel_e2e_ms string, maint_ms string, conv_ms string")
    got = compare.paired(compare.common_pairs(chain, level), chain, level).collect()
    assert len(got) == 1 and got[0]["chain_total_ms"] == 4 and got[0]["chain_over_level_kernel"] == 2 and got[0]["notes"] == ""
    pairs = spark.createDataFrame([tuple(vars(compare.parse_pair(p)).values()) for p in ("z=w:l", "q=r")], "chain_case string, level_case string, label string")
    by = {r["label"]: r for r in compare.paired(pairs, chain, level).collect()}
    assert by["l"]["notes"] == "chain not PASS" and by["l"]["chain_total_ms"] is None and by["l"]["chain_over_level_kernel"] is None
    assert by["q_vs_r"]["notes"] == "missing chain case; missing level case; chain not PASS; level not PASS"
    with pytest.raises(ValueError):
        compare.parse_pair("nope")


def test_snapshot_diff(spark):
    s = "k string, v string, w string"
    a = spark.createDataFrame([("1", "5", "x"), ("2", "7", "y"), ("3", "a", None)], s)
    b = spark.createDataFrame([("1", "5.25", "x"), ("3", "b", None), ("4", "1", "z")], s)
    got = {r["k"]: r for r in compare.snapshot_diff(a, b, ["k"], ["v"], "t").collect()}
    assert {k: (r["state"], r["delta_v"]) for k, r in got.items()} == {"1": ("changed", "0.250"), "2": ("removed", ""), "3": ("unchanged", ""), "4": ("added", "")}
    text = {r["k"]: r for r in compare.snapshot_diff(a, b, ["k"], ["v", "w"], "t", text=True).collect()}
    assert text["3"]["state"] == "changed" and text["3"]["delta_v"] == "a -> b" and text["3"]["delta_w"] == " -> "
    assert rows(compare.by_state(compare.snapshot_diff(a, a, ["k"], ["v"], "t"))) == [("unchanged", 3)]
    keyed = spark.createDataFrame([("1", "old", 0), ("1", "new", 1)], "k string, v string, n int")
    assert compare.last_per_key(keyed, ["k"], "n").first()["v"] == "new" and compare.first_per_key(keyed, ["k"], "n").first()["v"] == "old"
