import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork import functions as fn
from skeinwork import sources
from skeinwork.operators import generate, status, updates
from skeinwork.sources import reports, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids_and_numbers(spark):
    for text, base, want in (("ff", "16", 255), ("0x1f", "auto", 31), ("1f", "auto", 31), ("10", "auto", 10), ("10", "16", 16)):
        assert one(spark, fn.parse_id(F.lit(text), base)) == want
    with pytest.raises(Exception, match="invalid id"):
        one(spark, fn.parse_id(F.lit("zz"), "16"))
    for text, want in (("-0x10", -16), ("7", 7), ("0b11", 3), ("0o17", 15), ("07", None), ("x", None)):
        assert one(spark, fn.integer_literal(F.lit(text))) == want
    assert one(spark, fn.ratio(F.lit(1.0), F.lit(0.0))) is None and one(spark, fn.number(F.lit("x"))) is None
    assert [one(spark, fn.delta_text(F.lit(a), F.lit(b))) for a, b in (("1", "3"), ("1", "1.5"), ("", "1"))] == ["2", "0.500", ""]
    assert fn.six_digits(1023.0) == "1023" and fn.six_digits(None) == ""


def test_files_round_trip(spark, tmp_path):
    c = generate.PRESETS["smoke"][1]
    s, u = generate.build(spark, c)
    sinks.write_graph(c.vertices, s, u, str(tmp_path / "g"))
    head, s2, u2 = sources.read_graph(spark, str(tmp_path / "g"))
    assert head == {"vertices": 16, "static": 16, "updates": 12} and rows(s2) == rows(s) and rows(u2) == rows(u)
    final = updates.replay(s, u)
    sinks.write_result(final, str(tmp_path / "r"))
    assert "0 -> a" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert rows(sources.read_result(spark, str(tmp_path / "r"))) == rows(final)
    sinks.write_edges(updates.with_weight(final), str(tmp_path / "e"))
    got = sources.read_level_edges(spark, str(tmp_path / "e"), batch=10)
    assert rows(got.select("src", "dst")) == rows(final) and got.agg(F.max("batch")).first()[0] == 3
    sinks.write_distances(spark.createDataFrame([(0, 0), (1, None)], "vertex long, distance long"), str(tmp_path / "d"))
    assert rows(sources.read_tsv(spark, str(tmp_path / "d"), ["vertex", "distance_after_supersteps", "more"])) == [("0", "0", ""), ("1", "INF", "")]
    assert sources.read_tsv(spark, str(tmp_path / "none"), ["a"]).count() == 0


def test_edge_file_errors(spark, tmp_path):
    (tmp_path / "a.edges").write_text("0x10 2 # c\n\n# only\n1 2 3 -1\n")
    assert rows(sources.read_level_edges(spark, str(tmp_path / "a.edges")).select("src", "dst", "weight", "diff")) == [(1, 2, 3, -1), (16, 2, 1, 1)]
    for text, message in (("1\n", "missing dst"), ("1 2 3 4 5\n", "extra token"), ("1 x\n", "invalid integer")):
        (tmp_path / "b.edges").write_text(text)
        with pytest.raises(Exception, match=message):
            sources.read_level_edges(spark, str(tmp_path / "b.edges")).collect()
    (tmp_path / "c.result").write_text("1 -> 2\nbad\n")
    with pytest.raises(Exception, match="c.result:2"):
        sources.read_result(spark, str(tmp_path / "c.result")).collect()
    with pytest.raises(Exception, match="limits"):
        sources.check_native(spark.createDataFrame([(1, 2, 70000, 1)], "src int, dst int, weight int, diff int"), 10).collect()


LOGS = {"case.env": "case=t1\nvertices=16\nskip_update=0\n# c\nvertices=17\n", "update.log": "check result passed\ntime is 1.5 ms\nthroughput is 0.1 M updates per second\n", "convert.log": "converted_edges=24\n",
        "compute.log": "Device[0]: program successful!\ne2e: 0.25 ms;  Throught: 0.1 MTEPS\nProcessed edges: 32; Graph edges: 24\n", "wall_time.tsv": "wall_seconds\t1.5\n"}


@pytest.mark.parametrize("change, want", [({}, "PASS"), ({"compute.log": LOGS["compute.log"] + "This iteration has 3 errors\n"}, "FAIL"), ({"case.env": "dry_run=1\n"}, "DRY_RUN"), ({"case.env": "skip_verify=1\n"}, "FAIL"),
    ({"case.env": "skip_verify=1\n", "compute.log": LOGS["compute.log"] + "Skipping hardware result verification\n"}, "PERF_ONLY"), ({"update.log": None}, "FAIL"), ({"update.log": None, "case.env": "skip_update=1\n"}, "PASS")])
def test_chain_status(spark, tmp_path, change, want):
    for name, text in (LOGS | change).items():
        if text is not None:
            (tmp_path / name).write_text(text)
    files = {"env": "case.env", "update": "update.log", "convert": "convert.log", "compute": "compute.log", "wall": "wall_time.tsv"}
    texts = sources.case_texts(spark, [str(tmp_path)], files)
    row = status.summarize_chain(texts.withColumn("env", sources.env_map(F.col("env")))).first()
    assert row["status"] == want and row["wall_seconds"] == "1.5"
    if not change:
        assert (row["case"], row["vertices"], row["update_ms"], row["compute_mteps"], row["graph_edges"]) == ("t1", "17", "1.5", "0.1", "24")
        assert one(spark, sources.env_first(F.lit(LOGS["case.env"]), "vertices")) == "16"


@pytest.mark.parametrize("log, env, want", [
    ("x\nPARTITIONED_CSR_E2E_BATCH overflow=0 vertices=1\nPARTITIONED_CSR_E2E_SMOKE PASS vertices=16 errors=0 vertices=17\n", {}, ("PASS", "PARTITIONED_CSR_E2E_SMOKE", "17")),
    ("PARTITIONED_CSR_E2E_BATCH overflow=1 vertices=1\n", {}, ("UNSUPPORTED_CAPACITY", "PARTITIONED_CSR_E2E_BATCH", "1")), ("nothing", {"dry_run": "1"}, ("DRY_RUN", "", "")), (None, {}, ("FAIL", "", ""))])
def test_level_status(spark, log, env, want):
    df = spark.createDataFrame([("/r/c1", env, None, log)], "dir string, env map<string, string>, wall string, log string")
    row = status.summarize_levels(df).first()
    assert (row["status"], row["scenario_tag"], row["vertices"]) == want and row["case"] == "c1"


def test_rank_summary_and_small_helpers(spark):
    df = spark.createDataFrame([("/r/c", "case=q\n", "vertices=16 static=16 updates=8 final=24", None, LOGS["update.log"], LOGS["convert.log"], LOGS["compute.log"])], "dir string, manifest string, generate string, wall string, update string, convert string, compute string")
    row = status.summarize_rank(df).first()
    assert (row["case"], row["status"], row["final_edges"]) == ("q", "PASS", "24")
    assert status.shifted_banks("[x]\n[connectivity]\nsp=a:HBM[0]\nsp=b:HBM[3]\n", 1) == "sp=a:HBM[1]\nsp=b:HBM[4]\n"
    g = status.guarded(spark.createDataFrame([("f", 1, "#ifdef A"), ("f", 2, ""), ("f", 3, "lab:"), ("f", 4, "lab:")], "file string, line_no int, value string"), "lab")
    assert [r["guarded"] for r in g.orderBy("line_no").collect()] == [True, False]
    assert sinks.markdown([{"a": 1.0, "b": "x|y"}], ["a", "b"]).splitlines()[2] == "| 1 | x\\|y |" and sinks.markdown([], ["a"]) == "No rows.\n"


def lines(spark, text, file="f_routed.rpt"):
    return spark.createDataFrame([(file, k, v) for k, v in enumerate(text.split("\n"), 1)], "file string, line_no int, value string")


def test_reports(spark):
    link = '<ENTRY> {"type": "t", "buildStep": {"name": "n", "commandLine": "c", "iniFiles": [{"path": "p", "content": "[connectivity]\\nnk=k:2:a.b\\nsp=cu.m0:BANK[1]\\nslr=cu:S0\\nsc=a:b\\n#x=1\\nzz=1"}]}} </ENTRY><ENTRY>{bad</ENTRY><ENTRY>{"buildSummary": {"target": "hw", "kernels": [{"base": {"name": "k"}, "cuNames": ["k_1", "k_2"]}]}}</ENTRY>'
    e = reports.link_entries(spark.createDataFrame([("s", link)], "file string, text string"))
    assert rows(reports.commands(e)) == [("s", "t", "n", "c")]
    c = {r["kind"]: r for r in reports.connectivity(e).collect()}
    assert (c["nk"]["kernel"], c["nk"]["count"], c["nk"]["connections"]) == ("k", "2", "a.b") and (c["sp"]["cu"], c["sp"]["port"], c["sp"]["target"]) == ("cu", "m0", "BANK[1]")
    assert (c["slr"]["cu"], c["slr"]["target"], c["sc"]["connections"]) == ("cu", "S0", "a:b") and len(c) == 4
    k = reports.kernels(e).first()
    assert (k["kernel"], k["cu_count"], k["cu_names"], k["xo_file"]) == ("k", 2, "k_1.k_2", "")
    est = lines(spark, "Design Name:  d\nTarget Clock: 300MHz\nKernel Summary\nKernel Name  Type\n---\nk  c  t  lib  2\nArea Information\nCompute Unit  x\nk_1  k  k  1.0  2  3  4  5\nk_1  k  m  1  2  3  x  5")
    assert reports.estimate_meta(est).first()["target_clock_mhz"] == "300" and reports.estimate_kernels(est).first()["compute_units"] == "2"
    a = reports.areas(est).collect()
    assert len(a) == 1 and (a[0]["ff"], a[0]["uram"], a[0]["is_top_module"]) == (1, 5, "yes")
    u = reports.utilisation(lines(spark, "| Design State : Routed |\n| Name | LUT |\n|  k_1 | 10 [ 0.5%] | 2 [1%] | 3 | 4 [<0.1%] | 5 [1%] | 6 [1%] |")).first()
    assert (u["stage"], u["design_state"], u["name"], u["indent"], u["is_cu"], u["lut"], u["lut_pct"], u["reg"], u["reg_pct"]) == ("routed", "Routed", "k_1", 2, "yes", "10", "0.5", "3", "")
    r = reports.regions(lines(spark, "| CLB | 1 | 2 | 3 | 4 | 5 | 6 |\n| Other | 1 | 2 | 3 | 4 | 5 | 6 |")).collect()
    assert len(r) == 1 and r[0]["slr2_pct"] == "6"
    t = reports.timing(lines(spark, "WNS(ns) TNS(ns) WHS(ns)\n----\n-0.1 0 0 10 0.02 0 0 10 0.1 0 0 5\n1 1 1 1 1 1 1 1 1 1 1 1")).first()
    assert t["wns_ns"] == "-0.1" and t["tpws_total_endpoints"] == "5"
    files = spark.createDataFrame([("/a/x_util_placed.rpt",), ("/b/util_routed.rpt",), ("/c/x_util_routed.rpt",)], "path string")
    assert reports.pick_stage(files, "util").first()["path"] == "/c/x_util_routed.rpt" and reports.pick_timing(files).first()["path"] == "/c/x_util_routed.rpt"


def test_discovery(spark, tmp_path):
    for p in ("a/x.rpt", "evidence/y.rpt", "b/evidence/z.rpt", "b/evidence.rpt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("q")
    got = sources.discover(spark, str(tmp_path), "*.rpt")
    assert [r["path_from_root"] for r in got.orderBy("path").collect()] == ["a/x.rpt", "b/evidence.rpt"]
    (tmp_path / "a/c.sssp.edges").write_text("1 2")
    assert len(sources.edge_files(spark, [str(tmp_path / "e")], [str(tmp_path)])) == 2


def test_sinks_write_ordered_parts(spark, tmp_path):
    edges = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("src"), F.col("id").alias("dst"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_edges(edges, str(tmp_path / "e"), weight=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "e").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert len(parts) > 1 and lines == [f"{s} {d}" for s, d in rows(edges)]
    got = sources.read_level_edges(spark, str(tmp_path / "e"), batch=300)
    by_file = got.groupBy("file").agg(F.count("*").alias("n"), F.max("batch").alias("batches")).collect()
    assert sum(r["n"] for r in by_file) == 4000 and all(r["batches"] == -(-r["n"] // 300) for r in by_file)
    # a batch holds neighbouring lines
    assert got.groupBy("file", "batch").agg((F.max("line_no") - F.min("line_no") + 1 - F.count("*")).alias("gap")).where("gap <> 0").count() == 0


def test_padding(spark):
    logs = spark.createDataFrame([("8", "5"), ("5", "5"), ("4", "5"), ("", "5"), (None, "5")], "p string, g string")
    assert [tuple(r) for r in logs.select(*status.padding(F.col("p"), F.col("g"))).collect()] == [(3, "PADDED"), (0, "EXACT"), (-1, "SHORT"), (None, "UNKNOWN"), (None, "UNKNOWN")]
