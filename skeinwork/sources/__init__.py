"""Readers: each returns a DataFrame; malformed input raises when it is read, with file and line where that is possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork import schema
from skeinwork.functions import integer_literal, parse_id
from skeinwork.storage import with_row_index

#: Folders whose files are never reports.
EXCLUDED = ("evidence", ".tmp_doc", "phase6_results", "__pycache__")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 1), value of text files.

    Blocks of a file are numbered on their own and shifted by the counts of the blocks
    before them, so a large file is read in parallel.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    return raw.withColumn("own", own).join(before, ["file", "block"]).select("file", (F.col("own") + F.col("before")).alias("line_no"), "value")


def _fail(what: str) -> Column:
    return F.raise_error(F.concat(F.col("file"), F.lit(":"), F.col("line_no"), F.lit(f": {what}: "), F.col("value")))


def read_result(spark: SparkSession, path: str, base: str = "16") -> DataFrame:
    """src, dst of ``src -> dst`` lines (hexadecimal by default); blank lines are skipped."""
    pattern = r"^\s*([0-9a-fA-FxX]+)\s*->\s*([0-9a-fA-FxX]+)\s*$"
    rows = lines(spark, path).where(F.trim("value") != "")
    value = F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(_fail("invalid edge line"))
    return rows.select(*[parse_id(F.regexp_extract(value, pattern, k), base).alias(c) for k, c in ((1, "src"), (2, "dst"))])


def read_level_edges(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """src, dst, weight, diff of ``src dst [weight [diff]] [# comment]`` lines, with file and line_no; batch if its size is given."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    rows = lines(spark, path).withColumn("__t", text).where(F.col("__t") != "").withColumn("__w", F.split("__t", r"\s+"))
    n = F.size("__w")
    good = F.when(n < 2, _fail("missing dst").cast("boolean")).when(n > 4, _fail("extra token").cast("boolean")).otherwise(True)

    def token(k: int, default: int | None = None) -> Column:
        t = F.get("__w", F.lit(k))
        value = F.coalesce(integer_literal(t), _fail("invalid integer").cast("bigint"))
        return value if default is None else F.when(t.isNull(), F.lit(default).cast("bigint")).otherwise(value)

    out = rows.where(good).select("file", "line_no", token(0).alias("src"), token(1).alias("dst"), token(2, 1).alias("weight"), token(3, 1).alias("diff"))
    if batch:
        # blank and comment lines don't count; rows are numbered over all files at once, in parallel
        placed = with_row_index(out, ["file", "line_no"], "__index")
        first = placed.groupBy("file").agg(F.min("__index").alias("__first"))
        out = placed.join(first, "file").withColumn("batch", (F.floor((F.col("__index") - F.col("__first")) / batch) + 1).cast("long")).select(*out.columns, "batch")
    return out


def check_native(edges: DataFrame, vertices: int) -> DataFrame:
    """The limits of the native store: ids under ``vertices``, 16-bit unsigned weight, 16-bit diff; a row outside raises."""
    ok = (F.col("src").between(0, vertices - 1)) & (F.col("dst").between(0, vertices - 1)) & F.col("weight").between(0, 65535) & F.col("diff").between(-32768, 32767)
    return edges.where(F.when(ok, True).otherwise(F.raise_error(F.lit("edge outside the store's limits")).cast("boolean")))


def read_graph(spark: SparkSession, path: str) -> tuple[dict[str, int], DataFrame, DataFrame]:
    """Header (vertices, static, updates), static edges and updates of one ``V E U`` file."""
    rows = lines(spark, path)
    head = rows.where(F.col("line_no") == 1).first()
    v, e, u = map(int, head["value"].split())
    w = F.split(F.trim("value"), r"\s+")
    parts = rows.where(F.col("line_no") > 1).select("line_no", *[F.get(w, F.lit(k)).cast("bigint").alias(c) for k, c in enumerate(("src", "dst", "typ"))])
    static = parts.where(F.col("line_no") <= e + 1).select("src", "dst")
    updates = parts.where((F.col("line_no") > e + 1) & (F.col("line_no") <= e + u + 1)).select((F.col("line_no") - (e + 2)).alias("seq"), "src", "dst", F.col("typ").cast("tinyint").alias("typ"))
    return {"vertices": v, "static": e, "updates": u}, static, updates


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Text columns of a TSV with header; a missing path has no rows, a missing column is ""."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    got = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return got.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in got.columns else F.lit("").alias(c) for c in columns])


def env_map(text: Column) -> Column:
    """k=v lines as a map: comments and lines without = are skipped, the last of equal keys counts."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    pairs = F.transform(kept, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def env_first(text: Column, key: str) -> Column:
    """The value of the first line of a key, or null."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.startswith(f"{key}="))
    return F.regexp_replace(F.get(kept, 0), "^[^=]*=", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole files; bytes that aren't ASCII become U+FFFD."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return raw.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "�"))


def case_texts(spark: SparkSession, dirs: Sequence[str], files: dict[str, str]) -> DataFrame:
    """One row for each run folder (dir) with the text of each named file (column -> file name), null where it is missing."""
    base = spark.createDataFrame([(d.rstrip("/"),) for d in dirs], "dir string")
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f"{d.rstrip('/')}/{f}" for d in dirs for f in files.values()]
    there = [p for p in paths if fs(q := spark._jvm.org.apache.hadoop.fs.Path(p)).exists(q)]
    if not there:
        return base.select("dir", *[F.lit(None).cast("string").alias(c) for c in files])
    texts = read_texts(spark, there)
    name, folder = F.element_at(F.split("file", "/"), -1), F.element_at(F.split("file", "/"), -2)
    columns = [F.max(F.when(F.col("name") == f, F.col("text"))).alias(c) for c, f in files.items()]
    each = texts.select(folder.alias("folder"), name.alias("name"), "text").groupBy("folder").agg(*columns)
    return base.withColumn("folder", F.element_at(F.split("dir", "/"), -1)).join(each, "folder", "left").select("dir", *files)


def read_records(spark: SparkSession, path: str, metrics: Sequence[str], hashes: Sequence[str] = ("host_sha256", "xclbin_sha256")) -> DataFrame:
    """Measurement records (JSON lines, blank lines skipped) and their raw text; a malformed line raises with its place."""
    more = ", ".join([f"{m} double" for m in metrics] + [f"{h} string" for h in hashes])
    rows = lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema.RECORD}, {more}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("r", parsed)
    good = F.when(F.col("r.__bad").isNotNull(), _fail("invalid JSON").cast("boolean")).otherwise(True)
    return rows.where(good).select("r.*", F.col("value").alias("raw")).drop("__bad")


def has_key(raw: Column, key: str) -> Column:
    """Whether a JSON object has a key, null value or not."""
    return F.array_contains(F.json_object_keys(raw), key)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """case_id, expected_sha256, expected_source."""
    got = spark.read.schema(schema.SELECTION).option("multiLine", True).json(path)
    return got.select(F.explode("cases").alias("c")).select("c.case_id", F.col("c.graph_sha256").alias("expected_sha256"), F.col("c.bfs_source").alias("expected_source"))


def discover(spark: SparkSession, root: str, pattern: str, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """path, size_bytes, mtime, sha256 of files below ``root`` by name pattern; folders named in ``excluded`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "")
    folders = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in excluded]))
    return files.where(F.coalesce(keep, F.lit(True))).select("path", below.alias("path_from_root"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])


def edge_files(spark: SparkSession, explicit: Sequence[str], roots: Sequence[str], ending: str = ".sssp.edges") -> list[str]:
    """Explicit paths, then each root's */*ending in order; each once."""
    found = list(explicit)
    for r in roots:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{r.rstrip('/')}/*/*{ending}")
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        found += sorted(s.getPath().toString() for s in status or [])
    return list(dict.fromkeys(found))
