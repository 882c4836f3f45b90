import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import gas, generate, updates

# final edges and reached vertices of the published cases
EXPECTED = {
    "tiny_chain_v16": (15, 0, 15, 16, 15), "tiny_star_v16_u12": (16, 12, 28, 15, 2), "tiny_hotdst_v64_u32": (63, 32, 95, 18, 16),
    "small_star_v4096_u1024": (4096, 1024, 5120, 1027, 2), "medium_star_v65536_u8192": (65536, 8192, 73728, 8195, 2),
}
FINAL = {"small_chain_v64": 63, "small_spread_v4096_u1024": 5120, "small_hotdst_v4096_u1024": 5119, "medium_spread_v65536_u16384": 81920}


def case(name):
    return next(c for p in generate.PRESETS.values() for c in p if c.name == name)


@pytest.mark.parametrize("name", EXPECTED)
def test_preset_counts_and_bounded_distances(spark, name):
    static, ups, final, reached, far = EXPECTED[name]
    c = case(name)
    s, u = generate.build(spark, c)
    assert updates.counts(s, u).first().asDict() == {"static_edges": static, "update_edges": ups, "final_edges": final}
    d = gas.sssp(updates.with_weight(updates.replay(s, u)), 0, c.supersteps)
    assert tuple(d.agg(F.count("*"), F.max("distance")).first()) == (reached, far)


@pytest.mark.parametrize("name", FINAL)
def test_preset_final_edges(spark, name):
    s, u = generate.build(spark, case(name))
    assert updates.replay(s, u).count() == FINAL[name]


@pytest.mark.parametrize("c, n", list(zip(generate.UPDATE_SWEEP[:7], (24, 24, 8, 5120, 5120, 20480, 20480))))
def test_update_sweep(spark, c, n):
    s, u = generate.build_update_case(spark, c.family, c.vertices, c.updates)
    assert updates.replay(s, u).count() == n


def sequential(static, ops):
    edges = set(static)
    for _, s, d, typ in sorted(ops):
        edges.discard((s, d)) if typ == 0 else edges.add((s, d))
    return sorted(edges)


def test_replay_golden(spark):
    static = [(0, 1), (1, 2), (2, 3), (3, 0)]
    ops = [(0, 0, 1, 0), (1, 0, 2, 1), (2, 0, 2, 1), (3, 3, 3, 0), (4, 0, 1, 1), (5, 1, 2, 0)]
    s, u = spark.createDataFrame(static, "src long, dst long"), spark.createDataFrame(ops, "seq long, src long, dst long, typ tinyint")
    assert rows(updates.replay(s, u)) == [(0, 1), (0, 2), (2, 3), (3, 0)] == sequential(static, ops)
    assert updates.no_ops(s, u).first().asDict() == {"n_insert_noop": 1, "n_delete_noop": 1, "n_effective": 4}
    assert rows(updates.untouched(s, u)) == [(2, 3), (3, 0)]
    assert rows(updates.set_diff(s, updates.replay(s, u))) == [(0, 2, "unexpected"), (1, 2, "missing")]
    assert updates.identity(s).first() == updates.identity(s.repartition(3).union(s)).first()


def test_replay_equals_sequential(spark):
    import random

    r = random.Random(5)
    static = list({(r.randrange(9), r.randrange(9)) for _ in range(30)})
    ops = [(i, r.randrange(9), r.randrange(9), r.randrange(2)) for i in range(400)]
    got = updates.replay(spark.createDataFrame(static, "src long, dst long"), spark.createDataFrame(ops, "seq long, src long, dst long, typ tinyint"))
    assert rows(got) == sequential(static, ops)


def test_validation(spark):
    for bad in (generate.Case("x", "chain", 1), generate.Case("x", "chain", 4, source=4), generate.Case("x", "odd", 4)):
        with pytest.raises(ValueError):
            generate.build(spark, bad)
    for shape, v, u in (("spread", 3, 1), ("spread", 4, -1), ("odd", 4, 1)):
        with pytest.raises(ValueError):
            generate.build_update_case(spark, shape, v, u)
    for bad in (generate.Case("x", "chain", 8, 1), generate.Case("x", "hot-dest", 8, 7), generate.Case("x", "spread", 8)):
        with pytest.raises(ValueError):
            generate.build_threshold(spark, bad)
    with pytest.raises(ValueError):
        updates.with_weight(generate.ring(spark, 4), -1)
    assert generate.build_threshold(spark, generate.Case("x", "hot-dest", 98, 32)).count() == 97 + 32


def test_weighted_golden_is_jacobi(spark):
    e = spark.createDataFrame([(0, 1, 3), (0, 2, 10), (1, 2, 4), (1, 3, 7), (2, 3, 1)], "src long, dst long, weight long")
    for k, want in ((1, [0, 3, 10, None]), (2, [0, 3, 7, 10]), (3, [0, 3, 7, 8]), (4, [0, 3, 7, 8]), (None, [0, 3, 7, 8])):
        assert [d for _, d in rows(gas.all_distances(gas.sssp(e, 0, k), 4))] == want
    assert rows(gas.bfs(e, 0)) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert gas.mismatches(gas.sssp(e, 0, 2), gas.sssp(e, 0, 3)).first()[0] == 1


def test_pagerank_and_components(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (10, 11), (12, 11)], "src long, dst long")
    ranks = dict(rows(gas.pagerank(e, 30)))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[0] > ranks[3]
    path = spark.createDataFrame([(i, i + 1) for i in range(40, 80)], "src long, dst long")
    got = dict(rows(gas.components(e.union(path))))
    assert got[3] == 0 and got[12] == 10 and got[80] == 40
