import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork import sources
from skeinwork.operators import generate
from skeinwork.sources import ranges, sinks


@pytest.mark.parametrize("step", [1, 3, 7, 64, 1 << 20])
def test_every_line_once_whatever_the_ranges(tmp_path, step):
    for k, raw in enumerate((b"", b"\n", b"a", b"a\nbb\n\nccc", b"\n\nx\r\n" + b"y" * 40 + b"\nz\n")):
        path = tmp_path / f"f{k}"
        path.write_bytes(raw)
        got = [line for at in range(0, len(raw), step) for line in ranges.lines_of(str(path), at, min(at + step, len(raw)))]
        want = raw.split(b"\n")
        assert got == (want[:-1] if want[-1] == b"" else want)


def test_lines_longer_than_a_read(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "READ_BYTES", 5)
    raw = b"1 2\n" + b"3" * 23 + b"\n4 5\n"
    (tmp_path / "f").write_bytes(raw)
    got = [line for at in range(0, len(raw), 6) for line in ranges.lines_of(str(tmp_path / "f"), at, min(at + 6, len(raw)))]
    assert got == raw.split(b"\n")[:-1]


def test_equal_to_the_readers_by_lines(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.edges").write_text("0x10 2 # c\n\n# only\n1 2 3 -1\n" * 50)
    (tmp_path / "e" / "b.edges").write_text("7 8 0b11\n9 -5 0o17 2")
    (tmp_path / "e" / "_skip").write_text("x")
    path = str(tmp_path / "e")
    want = rows(sources.read_level_edges(spark, path).select("src", "dst", "weight", "diff"))
    got = ranges.read(spark, path, "edges", rangeBytes=64)
    assert rows(got.select("src", "dst", "weight", "diff")) == want and got.rdd.getNumPartitions() > 20
    assert rows(ranges.read(spark, f"file://{path}/b*", "edges").select("src", "dst")) == [(7, 8), (9, -5)]
    named = spark.read.format("exchange").schema("dst long, file string").option("layout", "edges").load(path)
    assert named.columns == ["dst", "file"] and named.where(F.col("file").endswith("b.edges")).count() == 2
    (tmp_path / "r").write_text("0 -> a\n\n 1f->0x2 \n")
    for base in ("16", "auto"):
        assert rows(ranges.read(spark, str(tmp_path / "r"), "result", base=base).select("src", "dst")) == [(0, 10), (31, 2)]


def test_graphs(spark, tmp_path):
    c = generate.PRESETS["smoke"][1]
    s, u = generate.build(spark, c)
    sinks.write_graph(c.vertices, s, u, str(tmp_path / "g"))
    head, static, updates = ranges.read_graphs(spark, str(tmp_path / "g"), rangeBytes=10)
    assert rows(head.drop("file")) == [(16, 16, 12)]
    assert rows(static.drop("file")) == rows(s) and rows(updates.drop("file")) == rows(u)


def test_native_defaults():
    read = lambda line: ranges.native_edge(line, 100)
    assert read("1 2") == (1, 2, 1, 1) and read("1 2 3 -4") == (1, 2, 3, -4) and read(" 1 2 # 9") == (1, 2, 1, 1)
    # a weight that isn't a number ends the line; so does what follows one without a gap
    assert read("1 2 x 7 8 9") == (1, 2, 1, 1) and read("1 2 3x 7 8") == (1, 2, 3, 1) and read("1 2 0x10") == (1, 2, 0, 1)
    assert read("") is None and read("name 1 2") is None and read("99999999999999999999 1") is None
    for line, message in (("1", "missing dst"), ("1 x", "missing dst"), ("1 2 3 4 5", "extra"), ("1 100", "vertex"), ("-1 2", "vertex"), ("1 2 65536", "weight"), ("1 2 -1", "weight"), ("1 2 3 40000", "diff")):
        with pytest.raises(ValueError, match=message):
            read(line)


def test_errors_name_file_and_line(spark, tmp_path):
    path = tmp_path / "bad.edges"
    for text, layout, message in (("1 2\n# c\n\n1 2 3\n1 x\n", "edges", ":5: .*1 x"), ("1 2\n\n3\n", "native", ":3: missing dst"), ("1 -> 2\nbad\n", "result", ":2: invalid edge line"), ("1 2 99999999999999999999\n", "edges", "64 bits")):
        path.write_text(text)
        for step in (2, 1000):
            with pytest.raises(Exception, match="bad.edges" + message if message[0] == ":" else message):
                ranges.read(spark, str(path), layout, rangeBytes=step).collect()
    with pytest.raises(Exception, match="unknown layout"):
        ranges.read(spark, str(path), "other").collect()
    with pytest.raises(Exception, match="no such long columns"):
        spark.read.format("exchange").schema("src string").load(str(path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        ranges.read(spark, str(tmp_path / "nowhere"), "edges").collect()


def test_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "zero").write_text("")
    for name in ("none", "zero"):
        assert rows(ranges.read(spark, str(tmp_path / name), "edges")) == []
