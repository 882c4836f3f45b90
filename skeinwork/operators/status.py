"""Run summaries from logs and settings: extraction by pattern, then a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import first_match, number

# fixed values: what the logs say
NUMBER = r"([0-9.eE+-]+)"
PATTERNS = {
    "wall_seconds": ("wall", r"wall_seconds\s+([0-9.]+)"),
    "converted_edges": ("convert", r"converted_edges=([0-9]+)"),
    "update_ms": ("update", rf"time is {NUMBER} ms"),
    "update_mups": ("update", rf"throughput is {NUMBER} M updates per second"),
    "compute_e2e_ms": ("compute", rf"e2e: {NUMBER} ms"),
    "compute_mteps": ("compute", rf"Throught: {NUMBER} MTEPS"),
    "processed_edges": ("compute", r"Processed edges: ([0-9]+)"),
    "graph_edges": ("compute", r"Graph edges: ([0-9]+)"),
}
RANK_PATTERNS = {
    "vertices": ("generate", r"vertices=([0-9]+)"),
    "static_edges": ("generate", r"static=([0-9]+)"),
    "update_edges": ("generate", r"updates=([0-9]+)"),
    "final_edges": ("generate", r"final=([0-9]+)"),
    "compute_vertices": ("compute", r"vertex num: ([0-9]+)"),
    "compute_edges": ("compute", r"edge num: ([0-9]+)"),
}
UPDATE_OK, PROGRAM_OK, SKIPPED = "check result passed", "Device[0]: program successful!", "Skipping hardware result verification"
MISMATCH, ITERATION_ERRORS = r"error: mismatch on destination vertex", r"This iteration has [1-9][0-9]* errors"
RESULT_TAG = "PARTITIONED_CSR_E2E_"
LEVEL_FIELDS = ("vertices", "input_edges", "batch_edges", "source_count", "hot_edges", "cold_edges", "traversed_edges", "maint_ms", "conv_ms", "kernel_e2e_ms", "kernel_mteps", "errors")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _env(key: str, default: str = "") -> Column:
    return F.coalesce(F.col("env")[key], F.lit(default))


def chain_status(update: Column, compute: Column, converted: Column, processed: Column, mismatches: Column, dry_run: Column, skip_update: Column, skip_verify: Column) -> Column:
    """DRY_RUN, PERF_ONLY, PASS or FAIL.  A run that skips verification never passes; it needs the log to say so."""
    base = (skip_update | update.contains(UPDATE_OK)) & (converted != "")
    ran = compute.contains(PROGRAM_OK) & (mismatches == 0)
    return (
        F.when(dry_run & (converted != ""), "DRY_RUN")
        .when(skip_verify, F.when(base & ran & compute.contains(SKIPPED), "PERF_ONLY").otherwise("FAIL"))
        .when(base & ran & (processed != ""), "PASS")
        .otherwise("FAIL")
    )


def summarize_chain(cases: DataFrame) -> DataFrame:
    """Summary of shortest-path runs: cases (dir, env map, wall, update, convert, compute texts; missing files are null)."""
    found = {k: first_match(_text(c), p) for k, (c, p) in PATTERNS.items()}
    wrong = F.regexp_count(_text("compute"), F.lit(MISMATCH)) + F.regexp_count(_text("compute"), F.lit(ITERATION_ERRORS))
    rows = cases.withColumns(found | {"mismatch_count": wrong})
    status = chain_status(_text("update"), _text("compute"), F.col("converted_edges"), F.col("processed_edges"), F.col("mismatch_count"), _env("dry_run", "0") == "1", _env("skip_update", "0") == "1", _env("skip_verify", "0") == "1")
    name = F.coalesce(F.col("env")["case"], F.element_at(F.split("dir", "/"), -1))
    own = [_env(k).alias(k) for k in ("vertices", "static_edges", "update_edges", "final_edges", "source", "supersteps")]
    return rows.select(name.alias("case"), status.alias("status"), "wall_seconds", *own, *list(found)[1:], F.col("mismatch_count").cast("string").alias("mismatch_count"), F.col("dir").alias("result_dir"))


def summarize_rank(cases: DataFrame) -> DataFrame:
    """Summary of rank runs: cases (dir, manifest, generate, wall, update, convert, compute texts)."""
    found = {k: first_match(_text(c), p) for k, (c, p) in (RANK_PATTERNS | PATTERNS).items()}
    named = first_match(_text("manifest"), "^case=(.+)$")
    name = F.when(named != "", named).otherwise(first_match(_text("generate"), r"case=([^\s]+)"))
    ok = _text("update").contains(UPDATE_OK) & (F.col("converted_edges") != "") & _text("compute").contains(PROGRAM_OK) & (F.col("processed_edges") != "")
    rows = cases.withColumns(found)
    return rows.select(name.alias("case"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), *found, F.col("dir").alias("result_dir"))


def result_line(log: Column, tag: str = RESULT_TAG) -> Column:
    """The first tagged line with a PASS or FAIL word, else the first tagged line, else null."""
    lines = F.filter(F.split(log, "\r\n|\r|\n"), lambda x: x.startswith(tag))
    final = F.filter(lines, lambda x: F.exists(F.slice(F.split(F.trim(x), r"\s+"), 2, 1 << 20), lambda w: w.isin("PASS", "FAIL")))
    return F.coalesce(F.get(final, 0), F.get(lines, 0))


def summarize_levels(cases: DataFrame, tag: str = RESULT_TAG) -> DataFrame:
    """Summary of levelled-store runs: cases (dir, env map, wall, log texts)."""
    from skeinwork.functions import tokens_to_map

    words = F.split(F.trim("__line"), r"\s+")
    marks = F.filter(F.slice(words, 2, 1 << 20), lambda w: w.isin("PASS", "FAIL"))
    rows = cases.withColumn("__line", result_line(_text("log"), tag)).withColumns({"__kv": tokens_to_map(F.coalesce("__line", F.lit(""))), "__mark": F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(marks, F.array().cast("array<string>"))), -1)})
    said = F.coalesce(F.col("__mark"), F.col("__kv")["status"], F.lit("FAIL"))
    status = F.when(_env("dry_run", "0") == "1", "DRY_RUN").when((said == "FAIL") & _text("log").rlike(r"\boverflow=1\b"), "UNSUPPORTED_CAPACITY").otherwise(said)
    name = F.coalesce(F.col("env")["case"], F.element_at(F.split("dir", "/"), -1))
    fields = [F.coalesce(F.col("__kv")[k], F.lit("")).alias(k) for k in LEVEL_FIELDS]
    return rows.select(name.alias("case"), status.alias("status"), F.coalesce(F.get(words, 0), F.lit("")).alias("scenario_tag"), first_match(_text("wall"), PATTERNS["wall_seconds"][1]).alias("wall_seconds"), *fields, _env("args").alias("args"), F.col("dir").alias("result_dir"))


def idle(last: Column, now: Column, seconds: int) -> Column:
    """Whether the newest activity is at least ``seconds`` before now."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) >= seconds * 1_000_000


def shifted_banks(ini: str, by: int) -> str:
    """Lines after [connectivity] with memory banks 0-3 moved up by ``by``; from the highest down, so none moves twice."""
    import re

    body = ini.split("[connectivity]", 1)[-1].lstrip("\n")
    return re.sub(r"HBM\[([0-3])\]", lambda m: f"HBM[{int(m[1]) + by}]", body)


def guarded(lines: DataFrame, label: str, directive: str = "#ifdef", within: int = 2) -> DataFrame:
    """Lines (file, line_no, value) with ``label`` and whether a directive stands at most ``within`` lines above."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(-within, -1)
    near = F.coalesce(F.bool_or(F.col("value").contains(directive)).over(w), F.lit(False))
    return lines.withColumn("guarded", near).where(F.col("value").contains(label))


def padding(processed: Column, graph: Column) -> tuple[Column, Column]:
    """Edges that a device processed beyond the graph's (it pads partitions), and EXACT, PADDED, SHORT or, where a count is missing, UNKNOWN."""
    more = number(processed.cast("string")).cast("long") - number(graph.cast("string")).cast("long")
    return more, F.when(more.isNull(), "UNKNOWN").when(more < 0, "SHORT").when(more == 0, "EXACT").otherwise("PADDED")
