"""Pairs of run summaries, and differences between snapshots."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import delta_text, number, ratio


@dataclasses.dataclass(frozen=True)
class Pair:
    chain_case: str
    level_case: str
    label: str


def parse_pair(text: str) -> Pair:
    """chain=level[:label]."""
    left, eq, rest = text.partition("=")
    right, colon, label = rest.partition(":")
    if not eq or not left or not right:
        raise ValueError("a pair is chain_case=level_case[:label]")
    return Pair(left, right, label if colon else f"{left}_vs_{right}")


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row in ``order`` of each key, combined before the shuffle; a null order comes first."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(F.col(order).isNotNull(), order)).alias("__row")).select("__row.*")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str | Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def common_pairs(chain: DataFrame, level: DataFrame) -> DataFrame:
    """Pairs of equal case names."""
    both = chain.select("case").where(F.col("case") != "").intersect(level.select("case"))
    return both.select(F.col("case").alias("chain_case"), F.col("case").alias("level_case"), F.col("case").alias("label"))


# fixed values: the published comparison's chain case, level case and label
PUBLISHED_PAIRS = (
    ("small_chain_v64", "carry_l1", "small_high_diameter"),
    ("small_star_v4096_u1024", "star_4096", "small_hot_source"),
    ("small_spread_v4096_u1024", "fanout_4096_s64", "small_spread_fanout"),
    ("small_hotdst_v4096_u1024", "duplicate_heavy_4096", "small_hot_destination"),
    ("medium_star_v65536_u8192", "star_65536", "medium_hot_source"),
    ("medium_spread_v65536_u16384", "fanout_65536_s256", "medium_spread_fanout"),
)


def published(spark: SparkSession) -> DataFrame:
    """The published pairs: chain_case, level_case, label."""
    return spark.createDataFrame(list(PUBLISHED_PAIRS), "chain_case string, level_case string, label string")


def by_size(pairs: DataFrame) -> DataFrame:
    """Of compared pairs, for each size (a label's first word): their number, and the least and greatest ratio of the chain's time to the kernel's; pairs without both times have none."""
    each = F.col("chain_over_level_kernel")
    return pairs.groupBy(F.substring_index("label", "_", 1).alias("size")).agg(F.count(F.lit(1)).alias("pairs"), F.min(each).alias("least_ratio"), F.max(each).alias("greatest_ratio"))


def notes(chain_there: Column, level_there: Column, chain_status: Column, level_status: Column) -> Column:
    not_pass = lambda s: F.coalesce(s, F.lit("")) != "PASS"
    return F.concat_ws(
        "; ", F.when(~chain_there, "missing chain case"), F.when(~level_there, "missing level case"), F.when(not_pass(chain_status), "chain not PASS"), F.when(not_pass(level_status), "level not PASS")
    )


def total_ms(update: Column, compute: Column) -> Column:
    """Time of an update and the computation after it; null if one of them is."""
    return update + compute


def paired(pairs: DataFrame, chain: DataFrame, level: DataFrame) -> DataFrame:
    """Each pair (chain_case, level_case, label) with both sides; a missing side stays, with a note.

    chain: case, status, vertices, final_edges, update_ms, compute_e2e_ms; level: case,
    status, vertices, input_edges, kernel_e2e_ms, maint_ms, conv_ms; text is read as numbers.
    """
    c = chain.select(F.col("case").alias("chain_case"), F.lit(True).alias("__c"), F.col("status").alias("chain_status"), F.col("vertices").alias("chain_vertices"), F.col("final_edges").alias("chain_final_edges"), number(F.col("update_ms").cast("string")).alias("update_ms"), number(F.col("compute_e2e_ms").cast("string")).alias("compute_e2e_ms"))
    s = level.select(F.col("case").alias("level_case"), F.lit(True).alias("__l"), F.col("status").alias("level_status"), F.col("vertices").alias("level_vertices"), F.col("input_edges").alias("level_input_edges"), number(F.col("kernel_e2e_ms").cast("string")).alias("level_kernel_ms"), (number(F.col("maint_ms").cast("string")) + number(F.col("conv_ms").cast("string"))).alias("level_maint_conv_ms"))
    rows = pairs.join(c, "chain_case", "left").join(s, "level_case", "left").withColumn("chain_total_ms", total_ms(F.col("update_ms"), F.col("compute_e2e_ms")))
    text = {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("chain_status", "level_status", "chain_vertices", "chain_final_edges", "level_vertices", "level_input_edges")}
    note = notes(F.coalesce("__c", F.lit(False)), F.coalesce("__l", F.lit(False)), F.col("chain_status"), F.col("level_status"))
    rows = rows.withColumn("notes", note).withColumns(text)
    return rows.select(
        "label", "chain_case", "level_case", *text, "chain_total_ms", "update_ms", "compute_e2e_ms", "level_kernel_ms", "level_maint_conv_ms",
        ratio(F.col("chain_total_ms"), F.col("level_kernel_ms")).alias("chain_over_level_kernel"), ratio(F.col("chain_total_ms"), F.col("level_maint_conv_ms")).alias("chain_over_level_maint_conv"), "notes",
    )


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], row_type: str, text: bool = False) -> DataFrame:
    """Outer diff of two snapshots with one row per key (text columns; null counts as ""): row_type, state, keys, before_/after_/delta_ values.

    Numeric (default): changed if some value's numeric difference isn't zero, so other
    edits go unseen.  ``text``: changed if some value differs; the delta shows that
    value and those after it.
    """
    clean = lambda df, side: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[F.coalesce(F.col(v).cast("string"), F.lit("")).alias(f"{side}_{v}") for v in values], F.lit(True).alias(f"__{side}"))
    rows = clean(before, "before").join(clean(after, "after"), list(keys), "full_outer")
    rows = rows.withColumns({f"{side}_{v}": F.coalesce(F.col(f"{side}_{v}"), F.lit("")) for side in ("before", "after") for v in values})
    kept = F.col("__before").isNotNull() & F.col("__after").isNotNull()
    deltas, changed = {}, F.lit(False)
    for v in values:
        b, a = F.col(f"before_{v}"), F.col(f"after_{v}")
        if text:
            changed = changed | (b != a)
            deltas[f"delta_{v}"] = F.when(kept & changed, F.concat(b, F.lit(" -> "), a)).otherwise("")
        else:
            deltas[f"delta_{v}"] = delta_text(b, a)
            changed = changed | ~delta_text(b, a).isin("", "0")
    state = F.when(F.col("__before").isNull(), "added").when(F.col("__after").isNull(), "removed").when(changed, "changed").otherwise("unchanged")
    rows = rows.withColumns(deltas).select(F.lit(row_type).alias("row_type"), state.alias("state"), "*")
    return rows.select("row_type", "state", *keys, *[f"{p}_{v}" for v in values for p in ("before", "after", "delta")])


def by_state(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count(F.lit(1)).alias("rows"))


def top_changes(diff: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The first n changed rows by key: what a report shows."""
    return diff.where(F.col("state") == "changed").orderBy(*keys).limit(n)


def bindings(connectivity: DataFrame) -> DataFrame:
    """Memory and region bindings, once each."""
    return connectivity.where(F.col("kind").isin("sp", "slr")).select("kind", "cu", "port", "target").distinct()


def top_modules(areas: DataFrame, order: str) -> DataFrame:
    return first_per_key(areas.where(F.col("is_top_module") == "yes"), ["kernel", "compute_unit", "module"], order)
