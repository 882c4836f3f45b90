"""Graph workloads: static edges and ordered updates as table functions over spark.range."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Case:
    name: str
    family: str
    vertices: int
    updates: int = 0
    supersteps: int = 0
    source: int = 0
    weight: int = 1


def _cases(text: str) -> list[Case]:
    rows = [line.split() for line in text.strip().splitlines()]
    return [Case(r[0], r[1], *map(int, r[2:])) for r in rows]


# fixed values: names and sizes of the published cases (name, family, vertices, updates, supersteps)
PRESETS = {
    "smoke": _cases("""
        tiny_chain_v16 chain 16 0 16
        tiny_star_v16_u12 hot-source 16 12 2
        tiny_hotdst_v64_u32 hot-dest 64 32 16"""),
    "review": _cases("""
        small_chain_v64 chain 64 0 64
        small_star_v4096_u1024 hot-source 4096 1024 2
        small_spread_v4096_u1024 spread 4096 1024 16
        small_hotdst_v4096_u1024 hot-dest 4096 1024 32
        medium_star_v65536_u8192 hot-source 65536 8192 2
        medium_spread_v65536_u16384 spread 65536 16384 32"""),
    "capacity": _cases("""
        large_star_v1048576_u65536 hot-source 1048576 65536 2
        large_spread_v262144_u65536 spread 262144 65536 32
        large_hotdst_v262144_u65536 hot-dest 262144 65536 64
        large_chain_v4096 chain 4096 0 4096"""),
}
THRESHOLD = _cases("""
    chain_v98305_e98304 chain 98305
    chain_v131074_e131073 chain 131074
    hotdst_v65536_u16384 hot-dest 65536 16384
    hotdst_v98304_u32768_e131071 hot-dest 98304 32768
    hotdst_v98304_u32770_e131073 hot-dest 98304 32770
    hotdst_v131072_u32768_e163839 hot-dest 131072 32768""")
THRESHOLD_LARGE = _cases("""
    chain_v262144_e262143 chain 262144
    hotdst_v262144_u65536_e327679 hot-dest 262144 65536""")
UPDATE_SWEEP = _cases("""
    tiny_spread_v16_u8 spread 16 8
    tiny_hot_v16_u8 hot 16 8
    tiny_delete_v16_u8 delete-even 16 8
    small_spread_v4096_u1024 spread 4096 1024
    small_hot_v4096_u1024 hot 4096 1024
    medium_spread_v16384_u4096 spread 16384 4096
    medium_hot_v16384_u4096 hot 16384 4096
    large_spread_v65536_u16384 spread 65536 16384
    large_hot_v65536_u16384 hot 65536 16384""")
#: Names and arguments of the levelled store's built-in scenarios; their generators are not public.
BUILTIN_SCENARIOS = {
    "smoke": {"hot_cold": "--hot-cold", "star_1024": "--star 1024", "fanout_1024_s64": "--fanout 1024 64"},
    "review": {
        "hot_cold": "--hot-cold", "star_4096": "--star 4096", "star_65536": "--star 65536", "fanout_4096_s64": "--fanout 4096 64",
        "fanout_65536_s256": "--fanout 65536 256", "repeat_star_4096_b4": "--repeat-star 4096 4", "repeat_fanout_4096_b4_s64": "--repeat-fanout 4096 4 64",
        "duplicate_heavy_4096": "--duplicate-heavy 4096", "carry_l1": "--carry-l1", "carry_l3": "--carry-l3",
    },
}
INTENT = {
    "chain": "High diameter: many supersteps of little work.",
    "hot-source": "Low diameter: one wide frontier right after the source.",
    "spread": "Updates all over the vertices: even partition traffic.",
    "hot-dest": "Updates into one vertex: a hot spot for the minimum.",
}


def intent(family: str) -> str:
    return INTENT.get(family, "General shortest-path workload.")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def ring(spark: SparkSession, vertices: int) -> DataFrame:
    """i -> (i + 1) mod V."""
    i = F.col("id")
    return spark.range(vertices).select(i.alias("src"), F.pmod(i + 1, F.lit(vertices)).alias("dst"))


def chain(spark: SparkSession, vertices: int) -> DataFrame:
    """i -> i + 1."""
    return spark.range(vertices - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def _updates(rows: DataFrame, src, dst, typ: int = 1) -> DataFrame:
    return rows.select(F.col("id").alias("seq"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(typ).cast("tinyint").alias("typ"))


def spread(spark: SparkSession, vertices: int, updates: int) -> DataFrame:
    """Inserts from each vertex in turn to one 2 + (round) ahead, past itself and its ring successor."""
    v, i = F.lit(vertices), F.col("id")
    src = F.pmod(i, v)
    dst = F.pmod(src + 2 + F.floor(i / v), v)
    past_self = F.when(dst == src, F.pmod(dst + 1, v)).otherwise(dst)
    past_next = F.when(past_self == F.pmod(src + 1, v), F.pmod(past_self + 1, v)).otherwise(past_self)
    return _updates(spark.range(updates), src, past_next)


def hot_source(spark: SparkSession, vertices: int, updates: int, source: int = 0) -> DataFrame:
    """Inserts from one source to 2, 3, ...; no more than V - 2."""
    return _updates(spark.range(min(updates, max(0, vertices - 2))), F.lit(source), F.col("id") + 2)


def hot_dest(spark: SparkSession, vertices: int, updates: int) -> DataFrame:
    """Inserts into the last vertex from 1, 2, ... V - 2, over and over; a source that is the last vertex is skipped."""
    src = 1 + F.pmod(F.col("id"), F.lit(max(1, vertices - 2)))
    return _updates(spark.range(updates), src, F.lit(vertices - 1)).where(F.col("src") != vertices - 1)


def delete_even(spark: SparkSession, vertices: int, updates: int) -> DataFrame:
    """Deletes of the ring edges of 0, 2, 4, ... (mod V); no more than V."""
    src = F.pmod(2 * F.col("id"), F.lit(vertices))
    return _updates(spark.range(min(updates, vertices)), src, F.pmod(src + 1, F.lit(vertices)), 0)


def no_updates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "seq long, src long, dst long, typ tinyint")


def build(spark: SparkSession, case: Case) -> tuple[DataFrame, DataFrame]:
    """Static edges and updates of a shortest-path case."""
    _need(case.vertices >= 2, "vertices must be at least 2")
    _need(0 <= case.source < case.vertices, f"{case.name}: invalid source {case.source}")
    if case.family == "chain":
        return chain(spark, case.vertices), no_updates(spark)
    if case.family == "hot-source":
        return ring(spark, case.vertices), hot_source(spark, case.vertices, case.updates, case.source)
    if case.family == "spread":
        return ring(spark, case.vertices), spread(spark, case.vertices, case.updates)
    if case.family == "hot-dest":
        return chain(spark, case.vertices), hot_dest(spark, case.vertices, case.updates)
    raise ValueError(f"{case.name}: unknown family {case.family}")


def build_update_case(spark: SparkSession, shape: str, vertices: int, updates: int) -> tuple[DataFrame, DataFrame]:
    """Static ring and updates of an update-sweep case (at least four vertices)."""
    _need(vertices >= 4, "vertices must be at least 4")
    _need(updates >= 0, "updates must be non-negative")
    if shape == "spread":
        return ring(spark, vertices), spread(spark, vertices, updates)
    if shape == "hot":
        return ring(spark, vertices), hot_source(spark, vertices, updates, 0)
    if shape == "delete-even":
        return ring(spark, vertices), delete_even(spark, vertices, updates)
    raise ValueError(f"unknown shape: {shape}")


def build_threshold(spark: SparkSession, case: Case) -> DataFrame:
    """Edges of a batching-threshold case; unlike ``build``, too many updates are an error."""
    _need(case.vertices >= 2, f"{case.name}: vertices must be at least 2")
    base = chain(spark, case.vertices)
    if case.family == "chain":
        _need(not case.updates, f"{case.name}: chain does not use updates")
        return base
    _need(case.family == "hot-dest", f"{case.name}: unknown family {case.family}")
    _need(case.updates <= case.vertices - 2, f"{case.name}: updates={case.updates} exceeds usable sources={case.vertices - 2}")
    return base.union(hot_dest(spark, case.vertices, case.updates).select("src", "dst")).distinct()


def one_partition_probe(spark: SparkSession, edges: int, fan: int = 64) -> DataFrame:
    """Edges i mod fan -> i + 1, which all lie in the first destination partition while edges < its size."""
    return spark.range(edges).select(F.pmod(F.col("id"), F.lit(fan)).alias("src"), (F.col("id") + 1).alias("dst"))


def balanced_probe(spark: SparkSession, edges: int, partitions: int = 16, partition_size: int = 1 << 20, fan: int = 64) -> DataFrame:
    """Edges dealt to the destination partitions in turn."""
    i = F.col("id")
    dst = F.pmod(i, F.lit(partitions)) * partition_size + F.floor(i / partitions) + 1
    return spark.range(edges).select(F.pmod(i, F.lit(fan)).alias("src"), dst.alias("dst"))
