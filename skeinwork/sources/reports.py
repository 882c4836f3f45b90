"""Build reports: link summaries, estimates, utilisation and timing tables.  Input: (file, text) or (file, line_no, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: row and column names of the reports
RESOURCES = ("lut", "lut_as_mem", "reg", "bram", "uram", "dsp")
REGION_ROWS = ("CLB", "CLB LUTs", "LUT as Logic", "LUT as Memory", "CLB Registers", "Block RAM Tile", "URAM", "DSPs")
STAGES = ("routed", "placed", "synthed")
CONNECTION_KEYS = ("nk", "sp", "slr", "stream_connect", "sc")
TIMING = ("wns_ns", "tns_ns", "tns_failing_endpoints", "tns_total_endpoints", "whs_ns", "ths_ns", "ths_failing_endpoints", "ths_total_endpoints", "wpws_ns", "tpws_ns", "tpws_failing_endpoints", "tpws_total_endpoints")
TIMING_REPORTS = ("dr_timing_summary.rpt", "hw_bb_locked_timing_summary_postroute_physopted.rpt", "hw_bb_locked_timing_summary_routed.rpt")

ENTRY = """struct<type: string,
  buildStep: struct<name: string, commandLine: string, iniFiles: array<struct<path: string, content: string>>>,
  buildSummary: struct<target: string, binaryContainer: struct<base: struct<name: string, file: string>>,
    kernels: array<struct<type: string, base: struct<name: string, file: string>, cuNames: array<string>>>>>"""


def _or_empty(*columns: Column) -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in columns]


def link_entries(texts: DataFrame) -> DataFrame:
    """source, e: the JSON objects between <ENTRY> tags; malformed ones are skipped."""
    blobs = F.regexp_extract_all("text", F.lit(r"(?s)<ENTRY>\s*(.*?)\s*</ENTRY>"), 1)
    rows = texts.select(F.col("file").alias("source"), F.posexplode(blobs).alias("entry_no", "blob"))
    return rows.select("source", "entry_no", F.from_json("blob", ENTRY).alias("e")).where(F.col("e").isNotNull())


def commands(entries: DataFrame) -> DataFrame:
    c = F.coalesce("e.buildStep.commandLine", F.lit(""))
    t, n = _or_empty(F.col("e.type"), F.col("e.buildStep.name"))
    return entries.where(c != "").select("source", t.alias("entry_type"), n.alias("step_name"), c.alias("command"))


def connectivity(entries: DataFrame) -> DataFrame:
    """Connection lines of the settings files, split by kind."""
    ini = entries.select("source", F.explode("e.buildStep.iniFiles").alias("i"))
    raw = ini.select("source", F.coalesce("i.path", F.lit("")).alias("ini_path"), F.explode(F.transform(F.split("i.content", "\n"), lambda x: F.trim(x))).alias("raw"))
    raw = raw.where(~F.col("raw").startswith("#") & F.col("raw").contains("="))
    kind, value = F.trim(F.substring_index("raw", "=", 1)), F.trim(F.regexp_replace("raw", "^[^=]*=", ""))
    rows = raw.withColumns({"kind": kind, "v": value}).where(F.col("kind").isin(*CONNECTION_KEYS))
    part = lambda c, sep, k: F.split_part(c, F.lit(sep), F.lit(k))
    after = F.when(F.col("v").contains(":"), F.regexp_replace("v", "^[^:]*:", "")).otherwise("")
    head = part(F.col("v"), ":", 1)
    of = lambda k, x: F.when(F.col("kind") == k, x)
    port = F.when(head.contains("."), F.regexp_replace(head, r"^[^.]*\.", "")).otherwise("")
    none = F.lit("")
    return rows.select(
        "source", "ini_path", "kind", F.coalesce(of("nk", head), none).alias("kernel"), F.coalesce(of("sp", part(head, ".", 1)), of("slr", head), none).alias("cu"), F.coalesce(of("sp", port), none).alias("port"),
        F.when(F.col("kind").isin("sp", "slr"), after).otherwise("").alias("target"), F.coalesce(of("nk", part(F.col("v"), ":", 2)), none).alias("count"),
        F.when(F.col("kind") == "nk", part(F.col("v"), ":", 3)).when(F.col("kind").isin("sc", "stream_connect"), F.col("v")).otherwise("").alias("connections"), "raw",
    )


def kernels(entries: DataFrame) -> DataFrame:
    rows = entries.select("source", F.col("e.buildSummary").alias("s")).where(F.col("s").isNotNull()).select("source", "s", F.explode("s.kernels").alias("k"))
    names = F.coalesce("k.cuNames", F.array().cast("array<string>"))
    t, bn, bf, kn, xo, kt = _or_empty(*map(F.col, ("s.target", "s.binaryContainer.base.name", "s.binaryContainer.base.file", "k.base.name", "k.base.file", "k.type")))
    return rows.select("source", t.alias("target"), bn.alias("binary_name"), bf.alias("binary_file"), kn.alias("kernel"), xo.alias("xo_file"), F.size(names).alias("cu_count"), F.array_join(names, ".").alias("cu_names"), kt.alias("kernel_type"))


def sticky(lines: DataFrame, header: Column, name: str) -> DataFrame:
    """``lines`` with the last non-null ``header`` seen so far in the file."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(w))


def estimate_meta(lines: DataFrame) -> DataFrame:
    after = lambda key: F.max(F.when(F.col("value").startswith(f"{key}:"), F.trim(F.regexp_replace("value", "^[^:]*:", ""))))
    rows = lines.groupBy(F.col("file").alias("source")).agg(after("Design Name").alias("design_name"), after("Target Device").alias("target_device"), F.replace(after("Target Clock"), F.lit("MHz"), F.lit("")).alias("target_clock_mhz"), after("Total number of kernels").alias("total_kernels"))
    return rows.select("source", *[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns[1:]])


def _estimate(lines: DataFrame, section: str, first: str) -> DataFrame:
    v = F.trim("value")
    heads = F.when(v == "Kernel Summary", "kernel").when(v == "Timing Information (MHz)", "timing").when(v == "Area Information", "area")
    rows = sticky(lines, heads, "section").where((F.col("section") == section) & heads.isNull() & ~v.rlike("^-*$") & ~v.startswith(first))
    return rows.withColumn("p", F.split(v, r"\s{2,}"))


def estimate_kernels(lines: DataFrame) -> DataFrame:
    rows = _estimate(lines, "kernel", "Kernel Name").where(F.size("p") >= 5)
    return rows.select(F.col("file").alias("source"), "line_no", *[F.col("p")[k].alias(c) for k, c in enumerate(("kernel", "type", "target", "opencl_library", "compute_units"))])


def areas(lines: DataFrame) -> DataFrame:
    """Area rows: the last five columns are numbers, cut to integers."""
    rows = _estimate(lines, "area", "Compute Unit").where(F.size("p") >= 8)
    numbers = {c: F.element_at("p", k).try_cast("double") for k, c in zip(range(-5, 0), ("ff", "lut", "dsp", "bram", "uram"), strict=True)}
    rows = rows.withColumns(numbers).dropna(subset=list(numbers))
    top = F.when(F.col("p")[1] == F.col("p")[2], "yes").otherwise("no")
    return rows.select(F.col("file").alias("source"), "line_no", F.col("p")[0].alias("compute_unit"), F.col("p")[1].alias("kernel"), F.col("p")[2].alias("module"), *[F.col(c).cast("bigint").alias(c) for c in numbers], top.alias("is_top_module"))


def stage(file: Column) -> Column:
    """routed, placed or synthed, by the file's name; else ""."""
    name = F.element_at(F.split(file, "/"), -1)
    out = F.lit("")
    for s in reversed(STAGES):
        out = F.when(name.contains(s), s).otherwise(out)
    return out


def _with_state(lines: DataFrame) -> DataFrame:
    v = F.col("value")
    said = F.when(v.contains("| Design State :"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(v, "^[^:]*:", "")), r"^\|+|\|+$", "")))
    rows = sticky(lines, said, "design_state")
    return rows.withColumn("design_state", F.coalesce("design_state", F.lit("")))


def utilisation(lines: DataFrame) -> DataFrame:
    """Rows ``| name | value [ pct%] | ...`` with indentation and resource columns."""
    cells = F.split("value", r"\|")
    rows = _with_state(lines).where(F.col("value").startswith("|") & F.col("value").contains("[")).withColumn("c", F.slice(cells, 2, F.size(cells) - 2)).where(F.size("c") >= 7)
    name = F.trim(F.col("c")[0])
    rows = rows.withColumn("name", name).where(~F.col("name").isin("", "Name"))
    indent = F.length(F.col("c")[0]) - F.length(F.ltrim(F.col("c")[0]))
    cu = F.when(F.col("name").rlike("_([1-9]|[1-5][0-9]|6[0-4])$"), "yes").otherwise("no")
    out = [F.col("file").alias("source"), "line_no", stage(F.col("file")).alias("stage"), "design_state", "name", indent.alias("indent"), cu.alias("is_cu")]
    for k, r in enumerate(RESOURCES, 1):
        both = r"([0-9.]+)\s*\[\s*([0-9.<>]+)%\]"
        value = F.regexp_extract(F.col("c")[k], both, 1)
        out += [F.when(value != "", value).otherwise(F.regexp_extract(F.col("c")[k], "([0-9.]+)", 1)).alias(r), F.regexp_extract(F.col("c")[k], both, 2).alias(f"{r}_pct")]
    return rows.select(*out)


def regions(lines: DataFrame) -> DataFrame:
    cells = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = _with_state(lines).where(F.col("value").startswith("|")).withColumn("c", F.slice(cells, 2, F.size(cells) - 2)).where((F.size("c") == 7) & F.get("c", F.lit(0)).isin(*REGION_ROWS))
    names = ("site_type", "slr0", "slr1", "slr2", "slr0_pct", "slr1_pct", "slr2_pct")
    return rows.select(F.col("file").alias("source"), "line_no", stage(F.col("file")).alias("stage"), "design_state", *[F.col("c")[k].alias(c) for k, c in enumerate(names)])


def timing(lines: DataFrame) -> DataFrame:
    """The first numeric row of twelve columns within five lines after the WNS/TNS/WHS header; one row for each file."""
    v = F.col("value")
    header = v.contains("WNS(ns)") & v.contains("TNS(ns)") & v.contains("WHS(ns)")
    near = Window.partitionBy("file").orderBy("line_no").rowsBetween(-5, -1)
    rows = lines.withColumns({"after": F.bool_or(header).over(near), "p": F.split(F.trim(v), r"\s+")})
    fit = F.coalesce(F.col("after"), F.lit(False)) & (F.size("p") >= 12) & F.get("p", F.lit(0)).rlike(r"^-?\d+(\.\d+)?$")
    states = _with_state(lines).groupBy("file").agg(F.max_by("design_state", "line_no").alias("design_state"))
    first = rows.groupBy("file").agg(F.min_by(F.when(fit, F.col("p")), F.when(fit, F.col("line_no"))).alias("p"))
    return first.join(states, "file").select(F.col("file").alias("source"), "design_state", *[F.coalesce(F.get("p", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(TIMING)])


def pick(files: DataFrame, names: list[str]) -> DataFrame:
    """Of files (path), the best one: the earliest of ``names`` that a file's name equals or ends with after _, then the last path."""
    name = F.element_at(F.split("path", "/"), -1)
    order = F.lit(None).cast("int")
    for k, n in reversed(list(enumerate(names))):
        order = F.when((name == n) | name.endswith(f"_{n}"), k).otherwise(order)
    return files.withColumn("prio", order).where(F.col("prio").isNotNull()).orderBy("prio", F.desc("path")).limit(1)


def pick_stage(files: DataFrame, stem: str) -> DataFrame:
    return pick(files, [f"{stem}_{s}.rpt" for s in STAGES])


def pick_timing(files: DataFrame) -> DataFrame:
    """As ``pick``; without a known name, the last path of all."""
    known = pick(files, list(TIMING_REPORTS))
    rest = files.withColumn("prio", F.lit(len(TIMING_REPORTS)))
    return known.unionByName(rest).orderBy("prio", F.desc("path")).limit(1)
