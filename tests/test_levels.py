import random
import re

import pytest
from conftest import rows

from skeinwork.operators import generate, levels

L = "src long, dst long, weight long, diff long, batch long"
KEY = ("status", "first_failure_batch", "failure_level", "failure_partition", "failure_partition_edges", "failure_partition_capacity", "failure_reason")


def by_hand(batches, store):
    """The store of the definition, one batch after the other."""
    def merge(edges):
        out = {}
        for s, d, w, x in edges:
            a, b = out.get((s, d), (w, 0))
            out[s, d] = (min(a, w), b + x)
        return [(s, d, w, x) for (s, d), (w, x) in out.items() if x]

    held = {}
    for b in batches:
        free = next(t for t in range(store.levels) if t not in held)
        carry = merge(b)
        for t in range(free):
            carry += held.pop(t, [])
        if carry := merge(carry):
            held[free] = carry
    return sorted((t, *e) for t, x in held.items() for e in x)


def frame(spark, batches):
    return spark.createDataFrame([(*e, k) for k, b in enumerate(batches, 1) for e in b], L)


def test_coalesce(spark):
    e = spark.createDataFrame([(1, 2, 5, 1), (1, 2, 3, 1), (1, 3, 1, 1), (1, 3, 9, -1), (2, 1, 4, -1)], "src long, dst long, weight long, diff long")
    assert rows(levels.coalesce(e)) == [(1, 2, 3, 2), (2, 1, 4, -1)]
    with pytest.raises(Exception, match="int16"):
        levels.coalesce(spark.createDataFrame([(1, 2, 1, 32767), (1, 2, 1, 1)], "src long, dst long, weight long, diff long")).collect()


@pytest.mark.parametrize("seed, span, n", [(1, 6, 9), (2, 3, 7), (3, 40, 13)])
def test_state_equals_replay_by_hand(spark, seed, span, n):
    r = random.Random(seed)
    store = levels.Store(batch=8, partition_size=1 << 20)
    batches = [[(r.randrange(span), r.randrange(span), r.randrange(9), r.choice((1, 1, -1))) for _ in range(8)] for _ in range(n)]
    assert rows(levels.state(frame(spark, batches), store)) == by_hand(batches, store)


def test_empty_carry_and_weight_order(spark):
    store = levels.Store(batch=2)
    batches = [[(1, 2, 1, 1), (1, 2, 1, -1)], [(1, 2, 5, 1)]]
    assert rows(levels.state(frame(spark, batches), store)) == [(0, 1, 2, 5, 1)] == by_hand(batches, store)
    got = levels.classify(frame(spark, batches), store)
    assert (got["status"], got["final_edges"], got["final_max_level"]) == ("FITS", 1, 0)


def classify(spark, edges, store=levels.Store()):
    from pyspark.sql import functions as F

    e = edges.select("src", "dst", F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("diff"))
    return levels.classify(levels.in_batches(e, ["src", "dst"], store), store)


@pytest.mark.parametrize("v, u, needed", [(98_305, 0, 0), (131_074, 0, 131_073), (98_304, 32_768, 0), (98_304, 32_770, 131_073)])
def test_published_thresholds(spark, v, u, needed):
    got = classify(spark, generate.build_threshold(spark, generate.Case("x", "hot-dest" if u else "chain", v, u)))
    want = ("UNSUPPORTED_CAPACITY", 2, 1, 0, needed, 16384, "level_partition_capacity") if needed else ("FITS", 0, -1, -1, 0, 0, "")
    assert tuple(got[k] for k in KEY) == want


def test_published_probes(spark):
    got = classify(spark, generate.one_partition_probe(spark, 131_073))
    assert (got["status"], got["failure_partition_edges"]) == ("UNSUPPORTED_CAPACITY", 131_073)
    got = classify(spark, generate.balanced_probe(spark, 131_073))
    assert (got["status"], got["final_max_level"], got["max_partition_edges"]) == ("FITS", 1, 8193)


def test_other_failures(spark):
    small = levels.Store(batch=2, levels=1, partition_size=1 << 20)
    assert levels.classify(frame(spark, [[(1, 2, 1, 1)], [(3, 4, 1, 1)]]), small)["failure_reason"] == "all_levels_occupied"
    flat = levels.Store(batch=2, ratio=1, partitions=1)
    assert levels.classify(frame(spark, [[(1, 2, 1, 1), (1, 3, 1, 1)], [(3, 4, 1, 1)]]), flat)["failure_reason"] == "level_total_capacity"
    for dst in (-1, 16 << 20):
        got = levels.classify(frame(spark, [[(1, dst, 1, 1)]]), levels.Store())
        assert (got["status"], got["failure_reason"]) == ("INVALID_INPUT", "dst_outside_partition_range")
    got = levels.classify(frame(spark, [[(1, 2, 1, 20000), (1, 2, 1, 20000)]]), levels.Store())
    assert (got["status"], got["first_failure_batch"]) == ("INVALID_INPUT", 0)
    with pytest.raises(ValueError):
        levels.classify(spark.createDataFrame([], L))
    assert levels.case_name("/a/run1/x.sssp.edges") == "x" and levels.case_name("/a/run1/y.txt") == "run1"


def test_edges_are_multiplied_by_levels_where_they_lie(spark, monkeypatch):
    plans, settle = {}, levels.settle

    def settled(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return settle(df, name)

    monkeypatch.setattr(levels, "settle", settled)
    monkeypatch.setattr(levels, "TASK_EDGES", 64, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = classify(spark, generate.one_partition_probe(spark, 1000), levels.Store(batch=100, partitions=1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (got["status"], got["raw_edges"], got["final_edges"], got["final_max_level"]) == ("FITS", 1000, 1000, 3)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^\n]*)", plans["carries"])
    assert exchanges and not any("carry" in x and "src" in x for x in exchanges)
    assert any(re.match(r"src#\d+L, dst#\d+L, 16\)", x) for x in exchanges)  # tasks in proportion to the edges
    assert "SortMergeJoin" not in plans["batches"]  # rows are numbered where they are read


def test_capacities_and_histogram(spark):
    assert rows(levels.capacities(spark))[:2] == [(0, 131072, 131072), (1, 262144, 16384)]
    e = spark.createDataFrame([(0, -1), (0, 0), (0, 1 << 20), (0, 16 << 20)], "src long, dst long")
    h = dict(rows(levels.histogram(e)))
    assert h[-1] == 2 and h[0] == h[1] == 1 and h[2] == 0 and len(h) == 17
