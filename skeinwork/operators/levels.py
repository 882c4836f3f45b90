"""Levelled edge store: signed multiplicities, batches carried into levels of growing capacity.

Batch b (from 1) goes to the first empty level.  While no carry is empty that is
the number of trailing zeros of b, which lets whole levels be computed at once:
one aggregation for each level instead of one for each batch.  Where a carry is
empty, the level it was meant for stays free; then batches are replayed one by one.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import ceil_div
from skeinwork.storage import forget, settle, with_row_index

KEY = ["src", "dst"]
INT16 = (-32768, 32767)
OVERFLOW = "duplicate diff sum exceeds int16"
#: Edges that a task of ``usage`` holds, about; each becomes one row for every level that it is carried into.
TASK_EDGES = 1 << 17


@dataclasses.dataclass(frozen=True)
class Store:
    """Sizes of the store; the defaults are the published ones."""

    batch: int = 131_072
    ratio: int = 2
    levels: int = 11
    partitions: int = 16
    partition_size: int = 1_048_576

    def total(self, level: int) -> int:
        return self.batch * self.ratio**level

    def per_partition(self, level: int) -> int:
        """Level 0 isn't split: a whole batch fits in each partition."""
        return self.batch if level == 0 else -(-self.total(level) // self.partitions)


def coalesced(edges: DataFrame, *by: str) -> DataFrame:
    """Sum of diff and least weight of each edge (within ``by``); edges whose diffs cancel go, with their weight."""
    out = edges.groupBy(*by, *KEY).agg(F.min("weight").alias("weight"), F.sum("diff").cast("long").alias("diff"))
    return out.where(F.col("diff") != 0)


def coalesce(edges: DataFrame) -> DataFrame:
    """``coalesced``; a sum outside 16 bits raises."""
    low, high = INT16
    diff = F.when(F.col("diff").between(low, high), F.col("diff")).otherwise(F.raise_error(F.lit(OVERFLOW)).cast("long"))
    return coalesced(edges).withColumn("diff", diff)


def capacities(spark: SparkSession, store: Store = Store()) -> DataFrame:
    """level, total_capacity, partition_capacity."""
    level = F.col("id")
    total = (F.lit(store.batch) * F.pow(F.lit(store.ratio), level)).cast("long")
    split = F.when(level == 0, F.lit(store.batch).cast("long")).otherwise(ceil_div(total, store.partitions))
    return spark.range(store.levels).select(level.cast("int").alias("level"), total.alias("total_capacity"), split.alias("partition_capacity"))


def partition_of(dst: Column, store: Store = Store()) -> Column:
    """floor(dst / partition size); -1 outside the partitions."""
    p = F.floor(dst / F.lit(store.partition_size)).cast("int")
    return F.when(p.between(0, store.partitions - 1), p).otherwise(-1)


def histogram(edges: DataFrame, store: Store = Store()) -> DataFrame:
    """part, edges for every partition, zero included, and -1 for edges outside (only if there are any)."""
    spark = edges.sparkSession
    counts = edges.groupBy(partition_of(F.col("dst"), store).alias("part")).agg(F.count(F.lit(1)).alias("edges"))
    zeros = spark.range(store.partitions).select(F.col("id").cast("int").alias("part"), F.lit(0).cast("long").alias("edges"))
    return counts.union(zeros).groupBy("part").agg(F.sum("edges").alias("edges"))


def in_batches(edges: DataFrame, order: list[str], store: Store = Store()) -> DataFrame:
    """``edges`` with their batch, from 1, in ``order``."""
    return with_row_index(edges, order, "__row").withColumn("batch", (F.floor(F.col("__row") / store.batch) + 1).cast("long")).drop("__row")


def target_level(batch: Column) -> Column:
    """Trailing zeros of a batch number."""
    return F.bit_count(F.bitwise_not(batch).bitwiseAND(batch - 1)).cast("int")


def blocks(batched: DataFrame, batches: int, store: Store) -> tuple[DataFrame, bool]:
    """(level, batch, src, dst, weight, diff) of every carry, and whether none of them is empty.

    A carry is its own batch with the carries that stand below it, each coalesced
    before: weights depend on that order.
    """
    own = settle(coalesced(batched, "batch"), "batches")
    held: DataFrame | None = None
    level = 0
    while (1 << level) <= batches:
        mine = own.where(target_level(F.col("batch")) == level)
        if held is not None:
            # a carry of a lower level is read once, by the batch that it goes into
            into = F.col("batch") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
            below = held.withColumn("batch", into).where((target_level(F.col("batch")) == level) & (F.col("batch") <= batches))
            mine = mine.unionByName(below.select("batch", *KEY, "weight", "diff"))
        done = settle(coalesced(mine, "batch").withColumn("level", F.lit(level)), "carries")
        held = done if held is None else held.unionByName(done)
        level += 1
    full = held.select("batch").distinct().count() == batches
    return held, full


def state(batched: DataFrame, store: Store = Store()) -> DataFrame:
    """level, src, dst, weight, diff of the store after all batches of ``batched`` (batch, src, dst, weight, diff)."""
    batches = batched.agg(F.max("batch")).first()[0] or 0
    if not batches:
        return batched.limit(0).select(F.lit(0).alias("level"), *KEY, "weight", F.col("diff").cast("long").alias("diff"))
    carries, full = blocks(batched, batches, store)
    if not full:
        return replayed(batched, batches, store)
    # level t holds the last carry into it, if bit t of the number of batches is set
    last = [(t, (batches >> t) << t) for t in range(batches.bit_length()) if batches >> t & 1]
    standing = F.lit(False)
    for t, b in last:
        standing = standing | ((F.col("level") == t) & (F.col("batch") == b))
    return carries.where(standing).select("level", *KEY, "weight", "diff")


def replayed(batched: DataFrame, batches: int, store: Store) -> DataFrame:
    """As ``state``, batch by batch: needed where carries come out empty."""
    spark = batched.sparkSession
    batched = settle(batched, "batched")
    levels: dict[int, DataFrame] = {}
    for b in range(1, batches + 1):
        free = next((t for t in range(store.levels) if t not in levels), None)
        if free is None:
            raise ValueError("all_levels_occupied")
        carry = coalesced(batched.where(F.col("batch") == b))
        for t in range(free):
            carry = carry.unionByName(levels.pop(t))
        carry = settle(coalesced(carry), "carry")
        if carry.limit(1).count():
            levels[free] = carry
    out = spark.createDataFrame([], "level int, src long, dst long, weight long, diff long")
    for t, x in levels.items():
        out = out.unionByName(x.select(F.lit(t).alias("level"), *KEY, "weight", "diff"))
    return out


def windows(batched: DataFrame, batches: int) -> DataFrame:
    """(carry, level, src, dst, diff): the edges of every carry.  A batch enters one carry of each level above its own.

    Where ``batched`` is dealt out by edge, the rows of the levels stay in the tasks that make them.
    """
    level = F.col("level")
    unit = F.pow(F.lit(2), level).cast("long")
    upto = F.ceil(F.col("batch") / unit).cast("long") * unit
    each = batched.select(*KEY, "diff", "batch", F.explode(F.sequence(F.lit(0), F.lit(max(0, batches.bit_length())))).alias("level"))
    # of the multiples of 2^level, those that aren't multiples of twice as much are carried into that level
    into = each.withColumn("carry", upto).where((target_level(F.col("carry")) == level) & (F.col("carry") <= batches))
    return into.groupBy("carry", "level", *KEY).agg(F.sum("diff").cast("long").alias("diff")).where(F.col("diff") != 0)


def usage(batched: DataFrame, batches: int, store: Store = Store(), tasks: int | None = None) -> DataFrame:
    """carry, level, part, edges, over: how full each partition of each carry is, and diff sums outside 16 bits.

    ``tasks``: how many tasks the edges are dealt over before they are multiplied by the levels.
    """
    rows = windows(batched.repartition(tasks, *KEY) if tasks else batched, batches).withColumn("part", partition_of(F.col("dst"), store))
    wide = ~F.col("diff").between(*INT16)
    return rows.groupBy("carry", "level", "part").agg(F.count(F.lit(1)).alias("edges"), F.count_if(wide).alias("over"))


def classify(batched: DataFrame, store: Store = Store(), case: str = "", edge_file: str = "") -> dict[str, object]:
    """Whether the batches fit, and the first failure; keys as in ``schema.CLASSIFICATION``.

    Checks come in this order: 16-bit sums of every single batch; then batch by batch:
    no free level, 16-bit sums of the carry, total capacity, destinations outside the
    partitions, capacity of the lowest partition that is over it.
    """
    raw, batches = batched.agg(F.count(F.lit(1)), F.max("batch")).first()
    out: dict[str, object] = dict(case=case, status="FITS", raw_edges=raw, batches=batches or 0, final_edges=0, final_max_level=-1, max_partition_edges=0, first_failure_batch=0, failure_level=-1, failure_partition=-1, failure_partition_edges=0, failure_partition_capacity=0, failure_reason="", edge_file=edge_file)
    if not raw:
        raise ValueError(f"{edge_file or case}: no edges")

    def fail(status: str, reason: str, **more: int) -> dict[str, object]:
        return out | dict(status=status, failure_reason=reason) | more

    # tasks in proportion to the edges; a batch bounds the rows of one of its edges, and their number bounds the rows of an edge from then on
    tasks = -(-raw // TASK_EDGES)
    own = settle(batched.repartition(tasks, "batch", *KEY).groupBy("batch", *KEY).agg(F.sum("diff").alias("diff")), "batches")
    if own.where(~F.col("diff").between(*INT16)).limit(1).count():
        return fail("INVALID_INPUT", OVERFLOW)
    use = usage(own, batches, store, tasks)
    level = F.col("level")
    total = (F.lit(store.batch) * F.pow(F.lit(store.ratio), level)).cast("long")
    split = F.when(level == 0, F.lit(store.batch).cast("long")).otherwise(ceil_div(total, store.partitions))
    crowded = (F.col("part") >= 0) & (F.col("edges") > split)
    each = settle(use.groupBy("carry", "level").agg(
        F.sum("edges").alias("edges"), F.sum("over").alias("over"), F.max(F.when(F.col("part") < 0, F.col("edges"))).alias("outside"),
        F.max(F.when(F.col("part") >= 0, F.col("edges"))).alias("most"), F.min(F.when(crowded, F.struct("part", "edges"))).alias("crowded"),
    ).withColumns({"total": total, "split": split}), "carries")
    forget(own)
    if each.count() < batches:
        return _classify_replayed(batched, batches, store, out, fail)
    reason = (
        F.when(level >= store.levels, "all_levels_occupied").when(F.col("over") > 0, OVERFLOW).when(F.col("edges") > F.col("total"), "level_total_capacity")
        .when(F.col("outside") > 0, "dst_outside_partition_range").when(F.col("crowded").isNotNull(), "level_partition_capacity")
    )
    each = each.withColumn("reason", reason)
    bad = each.where(F.col("reason").isNotNull()).orderBy("carry").limit(1).collect()
    seen = each if not bad else each.where(F.col("carry") <= bad[0]["carry"])
    if bad and bad[0]["reason"] != "level_partition_capacity":
        seen = each.where(F.col("carry") < bad[0]["carry"])  # that check wasn't reached
    out["max_partition_edges"] = seen.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
    if bad:
        return _failure(bad[0].asDict(), fail)
    standing = [(batches >> t) << t for t in range(batches.bit_length()) if batches >> t & 1]
    final = each.where(F.col("carry").isin(standing)).agg(F.sum("edges"), F.max("level")).first()
    return out | {"final_edges": final[0] or 0, "final_max_level": -1 if final[1] is None else final[1]}


def _failure(r: dict, fail) -> dict[str, object]:
    at = dict(first_failure_batch=r["carry"], failure_level=r["level"])
    if r["reason"] == "all_levels_occupied":
        return fail("UNSUPPORTED_CAPACITY", r["reason"], first_failure_batch=r["carry"])
    if r["reason"] in (OVERFLOW, "dst_outside_partition_range"):
        return fail("INVALID_INPUT", r["reason"], **at)
    if r["reason"] == "level_total_capacity":
        return fail("UNSUPPORTED_CAPACITY", r["reason"], **at, failure_partition_edges=r["edges"], failure_partition_capacity=r["total"])
    part, n = r["crowded"]
    return fail("UNSUPPORTED_CAPACITY", r["reason"], **at, failure_partition=part, failure_partition_edges=n, failure_partition_capacity=r["split"])


def _classify_replayed(batched: DataFrame, batches: int, store: Store, out: dict, fail) -> dict[str, object]:
    """Batch by batch, for input with empty carries."""
    batched = settle(batched, "batched")
    levels: dict[int, tuple[DataFrame, int]] = {}
    for b in range(1, batches + 1):
        free = next((t for t in range(store.levels) if t not in levels), None)
        if free is None:
            return _failure(dict(carry=b, level=-1, reason="all_levels_occupied"), fail)
        carry = coalesced(batched.where(F.col("batch") == b))
        for t in range(free):
            if t in levels:
                carry = carry.unionByName(levels.pop(t)[0])
        carry = settle(coalesced(carry), "carry")
        part = partition_of(F.col("dst"), store)
        rows = {r["part"]: (r["n"], r["over"]) for r in carry.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("diff").between(*INT16)).alias("over")).collect()}
        edges, over, outside = sum(n for n, _ in rows.values()), sum(o for _, o in rows.values()), rows.pop(-1, (0, 0))[0]
        r = dict(carry=b, level=free, edges=edges, total=store.total(free), split=store.per_partition(free), crowded=None)
        if over or edges > r["total"] or outside:
            return _failure(r | {"reason": OVERFLOW if over else "level_total_capacity" if edges > r["total"] else "dst_outside_partition_range"}, fail)
        out["max_partition_edges"] = max([out["max_partition_edges"], *(n for n, _ in rows.values())])
        for p in sorted(rows):
            if rows[p][0] > r["split"]:
                return _failure(r | {"reason": "level_partition_capacity", "crowded": (p, rows[p][0])}, fail)
        if edges:
            levels[free] = (carry, edges)
    return out | {"final_edges": sum(n for _, n in levels.values()), "final_max_level": max(levels, default=-1)}


def case_name(path: str) -> str:
    """Case of an edge file: its name without the known ending, else its folder, else its stem."""
    from pathlib import PurePosixPath

    p = PurePosixPath(path)
    for ending in (".from_updates.sssp.edges", ".sssp.edges"):
        if p.name.endswith(ending):
            return p.name[: -len(ending)]
    return p.parent.name or p.stem
