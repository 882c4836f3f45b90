import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skeinwork.operators import gas

EDGES = "src long, dst long, weight long"


def bellman(edges, source, rounds=None):
    d, k = {source: 0}, 0
    while rounds is None or k < rounds:
        new = dict(d)
        for s, t, w in edges:
            if s in d and d[s] + w < new.get(t, 1 << 60):
                new[t] = d[s] + w
        if new == d:
            break
        d, k = new, k + 1
    return sorted(d.items())


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60), r.randrange(1, 9)) for _ in range(150)]
    edges += [(7, 60 + k, 1 + k % 3) for k in range(80)] + [(k, k + 1, 1) for k in range(200, 230)] + [(3, 200, 2)]
    return edges, spark.createDataFrame(edges, EDGES)


def test_against_bellman_ford(graph):
    edges, df = graph
    for k in (1, 3, 8, 9, None):
        assert rows(gas.sssp(df, 7, k)) == bellman(edges, 7, k), k


def test_split_sources(graph):
    """Sources of many edges are cut into shares, with the same result."""
    edges, df = graph
    for share in (1, 10):
        own = gas.run(gas.SHORTEST, gas._weighted(df, None), gas._source(df, 7), 4, share=share)
        assert rows(own) == bellman(edges, 7, 4)
    with gas.lasting_partitions(df.sparkSession):
        cut = gas.Edges(df, 10)
        assert cut.split and cut.rows.where("src = 7").select("share").distinct().count() > 3


def test_only_candidates_move(spark, graph):
    """Within a superstep the one exchange is that of the candidates; edges and state stay."""
    _, df = graph
    with gas.lasting_partitions(spark):
        own = gas.Edges(gas._weighted(df, None))
        state = gas.dealt(gas._source(df, 7).withColumn("changed", F.lit(True)), gas.partitions(spark), "vertex")
        step = gas.Superstep(gas.SHORTEST, own, state.schema["value"].dataType)
        for _ in range(2):
            state = step(state)
            plan = state._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(vertex" in plan, plan
            state = state.checkpoint(eager=False).persist()
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_pagerank_rounds_are_alike(spark):
    """Thirty rounds, against the same rounds in Python; plans don't grow."""
    r = random.Random(3)
    edges = [(r.randrange(20), r.randrange(25), 1) for _ in range(60)]
    got = dict(rows(gas.pagerank(spark.createDataFrame(edges, EDGES), 30)))
    vertices = sorted({v for e in edges for v in e[:2]})
    n, rank = len(vertices), dict.fromkeys(vertices, 1 / len({v for e in edges for v in e[:2]}))
    out = {v: [t for s, t, _ in edges if s == v] for v in vertices}
    for _ in range(30):
        lost = sum(rank[v] for v in vertices if not out[v])
        new = dict.fromkeys(vertices, 0.15 / n + 0.85 * lost / n)
        for v in vertices:
            for t in out[v]:
                new[t] += 0.85 * rank[v] / len(out[v])
        rank = new
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-12 for v in vertices)


def test_certificate(spark, graph):
    edges, df = graph
    table = lambda d: spark.createDataFrame(d, "vertex long, distance long")
    right = bellman(edges, 7)
    assert tuple(gas.certificate(df, table(right), 7).first()) == (0, 0, 0, 0, 0)
    at = dict(right)
    far = max(at, key=at.get)
    cases = {
        "shorter than any path": (at | {far: at[far] - 1}, 2), "longer": (at | {far: at[far] + 1}, 1), "not reached": ({v: d for v, d in at.items() if v != far}, 1),
        "never reached": (at | {999: 5}, 2), "source": (at | {7: 1}, 0),
    }
    for name, (d, which) in cases.items():
        got = tuple(gas.certificate(df, table(sorted(d.items())), 7).first())
        assert got[which] >= 1, (name, got)
    # two vertices that support each other need an edge of weight 0
    assert gas.certificate(df.union(spark.createDataFrame([(1, 2, 0)], EDGES)), table(right), 7).first()["weights"] == 1
    assert gas.certificate(df, table([*right, right[0]]), 7).first()["repeated"] == 1
    assert gas.certificate(df, table(right).union(table([(5000, None)])), 7).first()["unsupported"] == 0
    for k in (1, 2, 5):
        bounded = bellman([(s, t, 3) for s, t, _ in edges], 7, k)
        assert tuple(gas.certificate(df, table(bounded), 7, k, 3).first()) == (0, 0, 0, 0, 0)
        assert sum(gas.certificate(df, table(bounded), 7, k + 1, 3).first()) > 0
        assert sum(gas.certificate(df, table(bellman([(s, t, 3) for s, t, _ in edges], 7, k + 1)), 7, k, 3).first()) > 0
    with pytest.raises(ValueError):
        gas.certificate(df, table(right), 7, 3)
    empty = gas.certificate(df.limit(0), table([(7, 0)]), 7)
    assert tuple(empty.first()) == (0, 0, 0, 0, 0)
