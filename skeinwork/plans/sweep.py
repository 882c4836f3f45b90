"""Workload -> update -> export -> compute -> verify -> summary, for a list of cases."""

from __future__ import annotations

import functools
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skeinwork import sources
from skeinwork.operators import gas, generate, updates
from skeinwork.storage import settle

COLUMNS = ["case", "status", "wall_seconds", "vertices", "static_edges", "update_edges", "final_edges", "source", "supersteps", "reached", "max_distance", "mismatch_count", "update_ms", "compute_e2e_ms"]


def run_case(spark: SparkSession, case: generate.Case, *, dry_run: bool = False, skip_verify: bool = False) -> dict[str, object]:
    """One summary row.  Compute always reads what the update stage wrote.

    Status: DRY_RUN (only the update stage), PERF_ONLY (result not verified), PASS or FAIL.
    """
    if dry_run and skip_verify:
        raise ValueError("dry_run and skip_verify exclude each other")
    began = time.monotonic()
    static, ops = generate.build(spark, case)
    row: dict[str, object] = dict.fromkeys(COLUMNS)
    row |= {"case": case.name, "vertices": case.vertices, "source": case.source, "supersteps": case.supersteps, "status": "FAIL"}
    row |= updates.counts(static, ops).first().asDict()
    at = time.monotonic()
    final = settle(updates.with_weight(updates.replay(static, ops), case.weight), "export")
    final.count()
    row["update_ms"] = 1000 * (time.monotonic() - at)
    if dry_run:
        return row | {"status": "DRY_RUN", "wall_seconds": time.monotonic() - began}
    at = time.monotonic()
    reached = settle(gas.sssp(final, case.source, case.supersteps), "distances")
    n, far = reached.agg(F.count(F.lit(1)), F.max("distance")).first()
    row |= {"compute_e2e_ms": 1000 * (time.monotonic() - at), "reached": n, "max_distance": far}
    if skip_verify:
        return row | {"status": "PERF_ONLY", "wall_seconds": time.monotonic() - began}
    # proven from the edges and distances alone
    wrong = sum(gas.certificate(final, reached, case.source, case.supersteps, case.weight).first())
    return row | {"mismatch_count": wrong, "status": "PASS" if not wrong else "FAIL", "wall_seconds": time.monotonic() - began}


def limited(spark: SparkSession, work: Callable[[], dict[str, object]], name: str, seconds: float | None = None) -> dict[str, object]:
    """The row that ``work`` gives, with exit_code, wall_seconds and error; its Spark jobs are cut after ``seconds``.

    Exit codes: 0, 1 (status FAIL, or an error: the row then says FAIL), 124 (cut: the
    row says TIMEOUT).  Jobs carry a tag of their own, so those of others go on.
    """
    tag, over, late = f"case-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not over.wait(wait):
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)  # again and again, as the driver goes from job to job
            wait = 0.2

    watcher = threading.Thread(target=watch, daemon=True)
    began = time.monotonic()
    spark.sparkContext.addJobTag(tag)
    spark.sparkContext.setInterruptOnCancel(True)  # tasks that hang, too, else they would keep their cores
    if seconds is not None:
        watcher.start()
    try:
        row = work() | {"error": None}
    except Exception as e:
        row = dict.fromkeys(COLUMNS) | {"case": name, "status": "TIMEOUT" if late.is_set() else "FAIL", "error": str(e).partition("\n")[0][:500]}
    finally:
        over.set()
        if seconds is not None:
            watcher.join()
        spark.sparkContext.removeJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(False)
    code = {"FAIL": 1, "TIMEOUT": 124}.get(str(row["status"]), 0)
    return row | {"exit_code": code, "wall_seconds": time.monotonic() - began}


def goes_on(row: dict[str, object], continue_on_fail: bool = False) -> bool:
    """Whether a sweep goes on after a case: what its summary says counts, whatever its exit code."""
    return continue_on_fail or row["status"] in ("PASS", "PERF_ONLY", "DRY_RUN")


def run_sweep(spark: SparkSession, cases: Iterable[generate.Case], *, continue_on_fail: bool = False, seconds: float | None = None, **options: bool) -> list[dict[str, object]]:
    """Rows of the cases in order, each with ``seconds`` at most; stops after the first that fails or is cut, unless told to go on."""
    rows = []
    for case in cases:
        rows.append(limited(spark, functools.partial(run_case, spark, case, **options), case.name, seconds))
        if not goes_on(rows[-1], continue_on_fail):
            break
    return rows


def run_edge_file(spark: SparkSession, path: str, source: int, supersteps: int, weight: int) -> dict[str, object]:
    """One summary row of a file of ``src -> dst`` lines: distances, proven by their certificate."""
    edges = settle(updates.with_weight(sources.read_result(spark, path), weight), "edges")
    at = time.monotonic()
    reached = settle(gas.sssp(edges, source, supersteps), "distances")
    n, far = reached.agg(F.count(F.lit(1)), F.max("distance")).first()
    took = 1000 * (time.monotonic() - at)
    wrong = sum(gas.certificate(edges, reached, source, supersteps, weight).first())
    row = {"case": path.rsplit("/", 1)[-1], "status": "FAIL" if wrong else "PASS", "final_edges": edges.count(), "source": source, "supersteps": supersteps, "reached": n, "max_distance": far, "mismatch_count": wrong, "compute_e2e_ms": took}
    return dict.fromkeys(COLUMNS) | row


def run_edge_files(spark: SparkSession, paths: Iterable[str], source: int, supersteps: int, weight: int = 1, *, continue_on_fail: bool = True, seconds: float | None = None) -> list[dict[str, object]]:
    """Rows of the files in order; a file that is missing or malformed fails, and the sweep goes on unless told not to."""
    rows = []
    for path in paths:
        rows.append(limited(spark, functools.partial(run_edge_file, spark, path, source, supersteps, weight), path.rsplit("/", 1)[-1], seconds))
        if not goes_on(rows[-1], continue_on_fail):
            break
    return rows
