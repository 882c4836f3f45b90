"""Edge files read by byte ranges: a Python data source, so that one large file is read by many tasks.

``spark.read.format("exchange").option("layout", ...).load(path)`` after ``register``;
``path`` is a file, a folder or a pattern on any file system that pyarrow can open.

=========  ==================================================  ==========================
layout     lines                                               columns
=========  ==================================================  ==========================
result     ``src -> dst``, hexadecimal by default (``base``)   src, dst
edges      ``src dst [weight [diff]] [# comment]``, literals   src, dst, weight, diff
           in decimal, 0x, 0o or 0b notation
native     the same in decimal, as the native store reads it   src, dst, weight, diff
graph      ``V E U``, then static edges, then updates          a, b, c (null if absent)
=========  ==================================================  ==========================

All layouts also have file, range (its first byte) and own (a line's number in its
range, from 1).  A schema that is given chooses among these columns by name.  Blank
lines are skipped, but for ``graph``, whose line numbers count.  A malformed line
raises with its file and line number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructType

#: Bytes of a range, and of a read; rows of an Arrow batch.
RANGE_BYTES, READ_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 1 << 16
PLACE = "file string, range long, own long"
COLUMNS = {"result": ("src", "dst"), "edges": ("src", "dst", "weight", "diff"), "native": ("src", "dst", "weight", "diff"), "graph": ("a", "b", "c")}
LONGS = range(-(1 << 63), 1 << 63)
HEX_EDGE = re.compile(r"\s*([0-9a-fA-FxX]+)\s*->\s*([0-9a-fA-FxX]+)\s*")
DECIMAL = re.compile(r"\s*([+-]?[0-9]+)")

Edge = tuple[int | None, ...]


def long_of(text: str, base: int) -> int:
    if "_" in text:  # Python's own notation, not the files'
        raise ValueError(f"invalid integer {text}")
    value = int(text, base)
    if value not in LONGS:
        raise ValueError(f"{text} doesn't fit 64 bits")
    return value


def result_edge(line: str, base: str) -> Edge | None:
    if not line.strip():
        return None
    m = HEX_EDGE.fullmatch(line)
    if not m:
        raise ValueError("invalid edge line")
    ids = []
    for text in m.groups():
        text = text.lower()
        is_hex = base == "16" or base == "auto" and bool(re.search("^0x|[a-f]", text))
        ids.append(long_of(text, 16 if is_hex else 10))
    return tuple(ids)


def level_edge(line: str) -> Edge | None:
    words = line.split("#", 1)[0].split()
    if not words:
        return None
    if len(words) < 2:
        raise ValueError("missing dst")
    if len(words) > 4:
        raise ValueError("extra token")
    return tuple([long_of(w, 0) for w in words] + [1] * (4 - len(words)))


def native_edge(line: str, vertices: int) -> Edge | None:
    """Numbers are read one after another, as far as they go; what isn't a weight or a diff counts as 1.

    A line that doesn't start with a number is skipped; after a weight that isn't a
    number nothing more of the line is read.  Unsigned numbers wrap, and are then
    outside the store's limits.
    """
    line, at, got = line.split("#", 1)[0], 0, []
    for signed in (False, False, False, True):
        m = DECIMAL.match(line, at)
        value = int(m[1]) if m else None
        if m is None or not (value in LONGS if signed else abs(value) < 1 << 64):
            break
        got.append(value if signed else value % (1 << 64))
        at = m.end()
    if not got:
        return None
    if len(got) == 1:
        raise ValueError("missing dst")
    if len(got) == 4 and line[at:].strip():
        raise ValueError("extra token")
    src, dst, weight, diff = got + [1] * (4 - len(got))
    for bad, what in ((max(src, dst) >= vertices, "vertex id"), (weight > 65535, "weight"), (not -32768 <= diff <= 32767, "diff")):
        if bad:
            raise ValueError(f"{what} outside the store's limits")
    return src, dst, weight, diff


def graph_line(line: str) -> Edge:
    words = line.split()
    if not 2 <= len(words) <= 3:
        raise ValueError("invalid line")
    return tuple([long_of(w, 10) for w in words] + [None] * (3 - len(words)))


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path in Hadoop's notation, and the path there."""
    if "://" in path:
        return pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return pa.fs.LocalFileSystem(), re.sub("^file:", "", path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Name and size of a file, or of all files below a folder, or of those that match a pattern of the last part of the path."""
    fs, at = opened(path)
    pattern = None
    if re.search(r"[*?]", at):
        at, _, name = at.rpartition("/")
        pattern = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in name))
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    prefix = path[: len(path.rstrip("/")) - len(at.rstrip("/"))] if pattern is None else path[: path.rindex(at)]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=pattern is None))
    inside = [(f.path[len(at.rstrip("/")) + 1 :], f) for f in found if f.is_file]
    shown = [(name, f) for name, f in inside if not any(p[0] in "._" for p in name.split("/")) and (pattern is None or pattern.fullmatch(name))]
    return sorted((prefix + f.path, f.size) for _, f in shown)


def lines_of(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range of bytes, without their line ends; the last one is read to its end, beyond the range if need be."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        # a line begins at ``start`` if the byte before ends one
        f.seek(max(0, start - 1))
        here, rest, skip = max(0, start - 1), b"", start > 0
        while here < end:
            more = f.read(READ_BYTES)
            parts = (rest + more).split(b"\n") if more else [rest, b""]
            rest = parts.pop()
            for line in parts:
                if here >= end:
                    return
                here += len(line) + 1
                if skip:
                    skip = False
                elif more or line:
                    yield line
            if not more:
                return


def line_number(path: str, offset: int) -> int:
    """The number of the line at an offset; only a malformed line makes a task read what lies before it."""
    fs, at = opened(path)
    n = 1
    with fs.open_input_file(at) as f:
        while offset > 0 and (raw := f.read(min(READ_BYTES, offset))):
            n += raw.count(b"\n")
            offset -= len(raw)
    return n


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class ExchangeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.layout = options.get("layout", "edges")
        self.path = options["path"]
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.base, self.vertices = options.get("base", "16"), int(options.get("vertices", 1 << 63))
        if self.base not in ("10", "16", "auto"):
            raise ValueError(f"unknown base: {self.base}")
        self.names = [f.name for f in schema.fields]
        known = {*COLUMNS[self.layout], "file", "range", "own"}
        wrong = [f.name for f in schema.fields if f.name not in known or (f.name != "file" and not isinstance(f.dataType, LongType))]
        if wrong:
            raise ValueError(f"layout {self.layout} has no such long columns: {', '.join(wrong)}")

    def partitions(self) -> list[Range]:
        return [Range(file, at, min(at + self.step, size)) for file, size in files_of(self.path) for at in range(0, size, self.step)]

    def parser(self) -> Callable[[str], Edge | None]:
        return {"result": lambda x: result_edge(x, self.base), "edges": level_edge, "native": lambda x: native_edge(x, self.vertices), "graph": graph_line}[self.layout]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        parse, columns = self.parser(), COLUMNS[self.layout]
        rows: list[Edge] = []
        own: list[int] = []

        def batch() -> pa.RecordBatch:
            values = {c: [r[k] for r in rows] for k, c in enumerate(columns) if c in self.names}
            places = {"file": pa.array([partition.file] * len(rows), pa.string()), "range": pa.array([partition.start] * len(rows), pa.int64()), "own": pa.array(own, pa.int64())}
            return pa.RecordBatch.from_arrays([places[n] if n in places else pa.array(values[n], pa.int64()) for n in self.names], self.names)

        for number, raw in enumerate(lines_of(partition.file, partition.start, partition.end), 1):
            text = raw.decode("utf-8", "replace")
            try:
                edge = parse(text)
            except ValueError as e:
                raise ValueError(f"{partition.file}:{self.place(partition, number)}: {e}: {text[:200]}") from None
            if edge is None:
                continue
            rows.append(edge)
            own.append(number)
            if len(rows) == BATCH_ROWS:
                yield batch()
                rows, own = [], []
        if rows:
            yield batch()

    def place(self, partition: Range, number: int) -> int:
        """The number in the file of a line of a range."""
        if partition.start == 0:
            return number
        before = line_number(partition.file, partition.start - 1)
        return before + number


class ExchangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self) -> str:
        layout = self.options.get("layout", "edges")
        if layout not in COLUMNS:
            raise ValueError(f"unknown layout: {layout}")
        return ", ".join(f"{c} long" for c in COLUMNS[layout]) + f", {PLACE}"

    def reader(self, schema: StructType) -> ExchangeReader:
        return ExchangeReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExchangeSource)


def read(spark: SparkSession, path: str, layout: str, **options: object) -> DataFrame:
    """Lines of a layout (see above); options: base, vertices, rangeBytes."""
    register(spark)
    return spark.read.format("exchange").options(layout=layout, **options).load(path)


def read_graphs(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers (file, vertices, static, updates), static edges (file, src, dst) and updates (file, seq, src, dst, typ) of ``V E U`` files.

    Ranges number their own lines; the counts of the ranges before them, one row
    each, make these the lines of the file.
    """
    rows = read(spark, path, "graph", **options)
    counts = rows.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("range")) - F.col("n")).drop("n")
    head = rows.where("range = 0 AND own = 1").select("file", F.col("a").alias("vertices"), F.col("b").alias("static"), F.col("c").alias("updates"))
    at = F.col("own") + F.col("before") - 2
    placed = rows.join(before, ["file", "range"]).withColumn("at", at).where("at >= 0").join(head, "file")
    static = placed.where(F.col("at") < F.col("static")).select("file", F.col("a").alias("src"), F.col("b").alias("dst"))
    updates = placed.where((F.col("at") >= F.col("static")) & (F.col("at") < F.col("static") + F.col("updates")))
    return head, static, updates.select("file", (F.col("at") - F.col("static")).alias("seq"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").cast("tinyint").alias("typ"))
