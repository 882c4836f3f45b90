"""Ordered inserts and deletes, and set operations on edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["src", "dst"]


def dedup(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY).distinct()


def last_operation(updates: DataFrame) -> DataFrame:
    """typ of the last operation on each edge: a group maximum, combined before the only shuffle."""
    return updates.groupBy(*KEY).agg(F.max_by("typ", "seq").alias("typ"))


def replay(static: DataFrame | None, updates: DataFrame) -> DataFrame:
    """The edge set after all updates in order of seq (typ 0 deletes, else inserts).

    An operation fixes the state of its edge whatever came before, so the last one
    decides.  Static edges are inserts that come first; one aggregation does it all.
    """
    ops = updates.select(*KEY, F.col("seq").cast("long").alias("seq"), F.col("typ").cast("int").alias("typ"))
    if static is not None:
        # the least long: before any operation; one number to order by keeps the aggregation a hash one
        ops = ops.unionByName(static.select(*KEY, F.lit(-(1 << 63)).cast("long").alias("seq"), F.lit(1).alias("typ")))
    last = last_operation(ops)
    return last.where(F.col("typ") != 0).select(*KEY)


def no_ops(static: DataFrame, updates: DataFrame) -> DataFrame:
    """Counts of inserts of a present edge and of deletes of an absent one: (n_insert_noop, n_delete_noop, n_effective)."""
    from pyspark.sql import Window

    present = static.select(*KEY).distinct().withColumn("there", F.lit(True))
    before = F.lag("typ").over(Window.partitionBy(*KEY).orderBy("seq"))
    seen = updates.join(present, KEY, "left").withColumn("was", F.coalesce(before != 0, F.col("there"), F.lit(False)))
    insert, delete = F.col("typ") != 0, F.col("typ") == 0
    return seen.agg(
        F.count_if(insert & F.col("was")).alias("n_insert_noop"),
        F.count_if(delete & ~F.col("was")).alias("n_delete_noop"),
        F.count_if((insert & ~F.col("was")) | (delete & F.col("was"))).alias("n_effective"),
    )


def with_weight(edges: DataFrame, weight: int = 1) -> DataFrame:
    if weight < 0:
        raise ValueError("weight must be non-negative")
    return edges.select(*KEY, F.lit(weight).cast("long").alias("weight"))


def untouched(static: DataFrame, updates: DataFrame) -> DataFrame:
    return dedup(static).join(updates.select(*KEY).distinct(), KEY, "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).subtract(b.select(*KEY))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Edges of one side only, with their side; empty if the sets are equal."""
    e, a = dedup(expected).withColumn("e", F.lit(1)), dedup(actual).withColumn("a", F.lit(1))
    both = e.unionByName(a, allowMissingColumns=True).groupBy(*KEY).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    return both.where(F.col("e").isNull() | F.col("a").isNull()).select(*KEY, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"))


def identity(edges: DataFrame) -> DataFrame:
    """n and an order-free 64-bit fingerprint of an edge set."""
    return dedup(edges).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*KEY)).alias("fingerprint"))


def counts(static: DataFrame, updates: DataFrame) -> DataFrame:
    """One row: static_edges, update_edges, final_edges."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("k"), "n")

    rows = one(dedup(static), "s").union(one(updates, "u")).union(one(replay(static, updates), "f"))
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("n")))
    return rows.agg(of("s").alias("static_edges"), of("u").alias("update_edges"), of("f").alias("final_edges"))


def updates_per_microsecond(updates: Column, ms: Column) -> Column:
    """Throughput in millions of updates a second."""
    return F.when(ms > 0, updates / ms / 1000)
