"""Measurement records: statistics, eligibility gates and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.storage import settle

#: Metrics (milliseconds) of a record; the first is the one that is compared.
METRICS = (
    "resident_batch_end_to_end_ms", "cold_workload_end_to_end_ms", "workload_end_to_end_ms", "update_device_ms", "compute_device_ms", "combined_device_ms",
    "device_kernel_sum_ms", "transfer_ms", "bridge_host_ms", "host_wall_ms", "host_pipeline_wall_ms", "compute_e2e_ms",
)
MINIMUM_RUNS = 10


def flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, minimum, p10, median, p90, maximum of non-null values; percentiles interpolate between ranks.

    Equal values of a group are counted first.  The rest is sorted by range over all
    tasks; the sums of each group's counts in earlier partitions give every value its
    ranks, and those at the wanted ranks are picked by aggregates.  So no group is
    gathered in one task, and none but a partition is sorted there.
    """
    names = {f"__by{k}": F.col(c) for k, c in enumerate(by)}
    values = rows.where(F.col(value).isNotNull()).select(*[c.alias(n) for n, c in names.items()], F.col(value).alias("__value"))
    values = values.groupBy(*names, "__value").agg(F.count(F.lit(1)).alias("__n"))
    placed = settle(values.repartitionByRange(*[F.asc(n) for n in names], F.asc("__value")).withColumn("__part", F.spark_partition_id()), "sorted-values")
    placed = placed.withColumn("__group", F.struct(*names) if names else F.lit(0))  # null keys are equal
    runs = placed.groupBy("__part", "__group").agg(F.sum("__n").alias("__of_part"))
    group = Window.partitionBy("__group")  # a row a partition
    runs = runs.select("__part", "__group", (F.sum("__of_part").over(group.orderBy("__part")) - F.col("__of_part")).alias("__before"), F.sum("__of_part").over(group).alias("__total"))
    to = F.sum("__n").over(Window.partitionBy("__part", "__group").orderBy("__value"))
    ranked = placed.withColumn("__to", to).join(runs, ["__part", "__group"]).withColumn("__to", F.col("__to") + F.col("__before"))
    rank = {q: (F.col("__total") - 1) * F.lit(q) for q in (0.1, 0.5, 0.9)}
    at = lambda r: (F.col("__to") - F.col("__n") <= r) & (r < F.col("__to"))
    ends = [F.max(F.when(at(f(r)), F.col("__value"))).alias(f"__{k}_{name}") for k, r in enumerate(rank.values()) for name, f in (("low", F.floor), ("high", F.ceil))]
    got = ranked.groupBy(*names).agg(F.sum("__n").alias("count"), F.min("__value").alias("minimum"), *ends, F.max("__value").alias("maximum"), F.max("__total").alias("__total"))

    def between(k: int, r: Column) -> Column:
        low, high, share = F.col(f"__{k}_low"), F.col(f"__{k}_high"), r - F.floor(r)
        return F.when(low == high, low).otherwise((1 - share) * low + share * high)

    p = {name: between(k, r) for k, (name, r) in enumerate(zip(("p10", "median", "p90"), rank.values(), strict=True))}
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "count", "minimum", *[c.cast("double").alias(n) for n, c in p.items()], "maximum")


def metric_stats(records: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("case_id", "system")) -> DataFrame:
    """``stats`` of each metric over measured, correct records; metrics without a value are absent."""
    good = records.where(~flag("warmup") & flag("correct"))
    long = good.select(*by, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    return stats(long, [*by, "metric"], "value")


def run_counts(records: DataFrame, by: Sequence[str] = ("case_id", "system")) -> DataFrame:
    measured = ~flag("warmup")
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs_total"), F.count_if(~measured).alias("warmups"), F.count_if(measured).alias("measured_runs"), F.count_if(measured & flag("correct")).alias("correct_runs")
    )


def claim_eligible(explicit: str = "performance_claim_eligible", fallback: str = "performance_valid", present: Column | None = None) -> Column:
    """The explicit flag if the record has that key (null is false), else the fallback; ``present``: whether it has."""
    there = F.col(explicit).isNotNull() if present is None else present
    return F.when(there, flag(explicit)).otherwise(flag(fallback))


def source_clean(strict: bool = False) -> Column:
    """Every source state has a commit and is not dirty; without states the integration isn't dirty.

    No state at all counts as clean, unless ``strict``.
    """
    clean = F.forall(F.map_values("source_states"), lambda s: s["commit"].isNotNull() & s["tracked_dirty"].eqNullSafe(F.lit(False)))
    if strict:
        clean = clean & (F.size("source_states") > 0)
    return F.when(F.col("source_states").isNotNull(), F.coalesce(clean, F.lit(False))).otherwise(F.col("integration_dirty").eqNullSafe(F.lit(False)))


def one_identity(column: str, where: Column) -> Column:
    """Aggregate: exactly one distinct value, null being one; null if no row has a value (the key then doesn't count)."""
    shown = F.when(where, F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")))
    return F.when(F.count_if(where & F.col(column).isNotNull()) > 0, F.count_distinct(shown) == 1)


def artifact_keys(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c.endswith("_sha256") and ("host" in c or "xclbin" in c)]


def need_system(records: DataFrame) -> DataFrame:
    """Fails closed: a record without a system raises when it is read."""
    named = F.when(F.col("system").isNotNull() & (F.col("system") != ""), F.col("system"))
    return records.withColumn("system", F.coalesce(named, F.raise_error(F.lit("record has no explicit system; fail closed"))))


def need_known_case(records: DataFrame, selection: DataFrame) -> DataFrame:
    """Records joined to their selection row (case_id, expected_sha256, expected_source); an unknown case raises."""
    joined = records.join(selection.withColumn("__known", F.lit(True)), "case_id", "left")
    known = F.coalesce(F.col("__known"), F.raise_error(F.concat(F.lit("unknown case: "), F.col("case_id"))).cast("boolean"))
    return joined.where(known).drop("__known")


def grid(records: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Every case that occurs, with every required system and its place in their order."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("ord")) for k, s in enumerate(systems)]))
    return records.select("case_id").distinct().select("case_id", each.alias("s")).select("case_id", "s.*")


def blockers(measured: Column, correct: Column, identity: Column, eligible: Column, clean: Column, artifacts: Column, comparable: Column, minimum: int) -> Column:
    """Reasons why a group may not make a performance claim, in a fixed order; counts may not be null."""
    none = measured == 0
    return F.array_compact(
        F.array(
            F.when(measured < minimum, F.concat(F.lit("measured_runs="), measured, F.lit(f"<{minimum}"))),
            F.when(correct != measured, F.concat(F.lit("correct_runs="), correct, F.lit("/"), measured)),
            F.when(~F.coalesce(identity, F.lit(True)), "input_identity_mismatch"),
            F.when(none | ~F.coalesce(eligible, F.lit(False)), "performance_claim_not_eligible"),
            F.when(none | ~F.coalesce(clean, F.lit(False)), "source_provenance_missing_or_dirty"),
            F.when(~F.coalesce(artifacts, F.lit(False)), "artifact_pair_not_unique"),
            F.when((comparable == 0) | (comparable != measured), "comparable_resident_batch_end_to_end_missing"),
        )
    )


def summarize(records: DataFrame, selection: DataFrame, systems: Sequence[str], *, minimum: int = MINIMUM_RUNS, metric: str = METRICS[0], strict: bool = False, present: Column | None = None) -> DataFrame:
    """One row for each case and required system: counts, identity_ok, blockers, claim_eligible and the metric's median.

    ``selection``: case_id, expected_sha256, expected_source.  Cases come from the
    records; a group without records is judged with zero runs.  Records of other
    systems take no part (``ignored_records`` counts them).
    """
    rows = need_known_case(need_system(records), selection)
    measured = ~flag("warmup")
    same = F.col("graph_sha256").eqNullSafe(F.col("expected_sha256")) & (F.coalesce("source", F.lit(-1)) == F.col("expected_source"))
    keys = artifact_keys(records)
    identities = [one_identity(k, measured).alias(f"__{k}") for k in keys]
    good = measured & flag("correct")
    agg = rows.groupBy("case_id", "system").agg(
        F.count(F.lit(1)).alias("runs_total"), F.count_if(measured).alias("measured_runs"), F.count_if(good).alias("correct_runs"),
        F.bool_and(F.when(measured, F.coalesce(same, F.lit(False)))).alias("identity_ok"), F.bool_and(F.when(measured, claim_eligible(present=present))).alias("__eligible"),
        F.bool_and(F.when(measured, source_clean(strict))).alias("__clean"), F.count(F.when(good, F.col(metric))).alias("__comparable"),
        *identities,
    )
    medians = stats(rows.where(good), ["case_id", "system"], metric).select("case_id", "system", F.col("median").alias("median_ms"))
    agg = agg.join(medians, ["case_id", "system"], "left")
    agg = agg.withColumn("__artifacts", F.array_compact(F.array(*[F.col(f"__{k}") for k in keys])) if keys else F.array().cast("array<boolean>"))
    all_ = grid(rows, systems).join(agg, ["case_id", "system"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("runs_total", "measured_runs", "correct_runs", "__comparable")}
    all_ = all_.withColumns(zero).withColumn("identity_ok", F.coalesce("identity_ok", F.lit(True)))
    unique = (F.size("__artifacts") > 0) & F.forall("__artifacts", lambda x: x)
    listed = blockers(F.col("measured_runs"), F.col("correct_runs"), F.col("identity_ok"), F.col("__eligible"), F.col("__clean"), unique, F.col("__comparable"), minimum)
    all_ = all_.withColumn("blockers", listed)
    return all_.select("case_id", "system", "ord", "runs_total", (F.col("runs_total") - F.col("measured_runs")).alias("warmups"), "measured_runs", "correct_runs", "identity_ok", "blockers", (F.size("blockers") == 0).alias("claim_eligible"), "median_ms")


def ignored_records(records: DataFrame, systems: Sequence[str]) -> DataFrame:
    return records.agg(F.count_if(~F.col("system").isin(list(systems))).alias("ignored_records"))


def rank(groups: DataFrame) -> DataFrame:
    """case_id, eligible, winner, winner_median: the least median, ties to the earlier system; no winner unless all systems are eligible."""
    all_ok = F.bool_and("claim_eligible")
    best = F.min_by(F.struct("system", "median_ms"), F.struct("median_ms", "ord"))
    out = groups.groupBy("case_id").agg(all_ok.alias("eligible"), best.alias("best"))
    return out.select("case_id", "eligible", F.when(F.col("eligible"), F.col("best.system")).alias("winner"), F.when(F.col("eligible"), F.col("best.median_ms")).alias("winner_median"))


def all_eligible(rankings: DataFrame) -> DataFrame:
    return rankings.agg(F.coalesce(F.bool_and("eligible"), F.lit(False)).alias("all_eligible"))


def summary_json(groups: DataFrame, rankings: DataFrame, statistics: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """One JSON text for each case: its groups by system, each with its statistics by metric, its ranking and the inputs' hashes.

    ``statistics``: what ``metric_stats`` gives; ``inputs``: path and sha256 of the few
    files that were read.  A group without values has empty statistics.
    """
    group = ["runs_total", "warmups", "measured_runs", "correct_runs", "identity_ok", "claim_eligible", "blockers", "median_ms"]
    if statistics is not None:
        numbers = F.struct("count", "minimum", "p10", "median", "p90", "maximum")
        nested = statistics.groupBy("case_id", "system").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", numbers)))).alias("statistics"))
        none = F.create_map().cast(nested.schema["statistics"].dataType)
        groups = groups.join(nested, ["case_id", "system"], "left").withColumn("statistics", F.coalesce("statistics", none))
        group.append("statistics")
    by = groups.groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", F.to_json(F.struct(*group)).alias("text"))))).alias("texts"))
    whole = by.join(rankings, "case_id").withColumn("ranking", F.to_json(F.struct("eligible", "winner", "winner_median")))
    named = F.concat_ws(",", F.transform(F.map_entries("texts"), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])))
    parts = [F.lit('{"groups":{'), named, F.lit('},"ranking":'), F.col("ranking")]
    if inputs is not None:
        hashes = inputs.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "sha256"))))).alias("inputs"))  # one row
        whole = whole.join(F.broadcast(hashes), F.lit(True))
        parts += [F.lit(',"inputs":'), F.col("inputs")]
    return whole.select("case_id", F.concat(*parts, F.lit("}")).alias("json"))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def named_metrics(records: DataFrame, names: dict[str, str]) -> DataFrame:
    """``records`` with the metrics of a file under their names here; ``names``: name in the file -> name in METRICS."""
    return records.withColumnsRenamed({k: v for k, v in names.items() if k in records.columns})
