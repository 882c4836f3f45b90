import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from skeinwork.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """{index in rows: (code, error)}, the books' digest and the kept rows, with Python integers only."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * Fraction(x)) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((dist(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = {}
            for v in cut:
                at.setdefault(near(p, v[p])[1], []).append(v[p])
            new.append([[sum(c) // len(at[e]) for c in zip(*at[e], strict=True)] if e in at else old for e, old in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(kept, cut, strict=True):
        got = [near(p, v[p]) for p in range(parts)]
        out.append((i, label, bytes(e for _, e in got).hex(), sum(d for d, _ in got)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    most = (1 << 63) - 1
    return sorted(((i, code, min(error, most), min(sums[label], most), digest) for i, label, code, error in out), key=str)


def result(df):
    return sorted(map(tuple, vector_codes.compress(df).drop("label").collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(k * 3 % 401, [r.gauss(0, 0.1) for _ in range(32)], r.choice([1, 2, None])) for k in range(150)]
    rows += [(500 + k, [r.choice([0.0, 0.25, -0.25]) for _ in range(32)], 3) for k in range(60)]  # ties
    rows += [(600, None, 1), (601, [None] + [0.5] * 31, 1), (602, [float("nan")] * 32, 1), (603, [float("inf")] * 32, 1)]
    rows += [rows[0], (rows[1][0], [0.0] * 32, 5), (None, [0.01] * 32, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == brute(rows)
    clash = df
    for c in ("x", "code", "error", "label_error", "__label", "part", "value"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert result(clash) == result(df)


def test_large_values(spark):
    """Integers of any size: beyond longs, and next to what a double multiplies to infinity."""
    r = random.Random(5)
    for sizes in ((1.0, 1e6, 1e8), (1e15, 1e300, 1.0), (1.7e308, 1e-300, 3.0)):
        rows = [(k, [r.uniform(-1, 1) * r.choice(sizes) for _ in range(16)], k % 2) for k in range(90)]
        assert result(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, None), (2, [0.25] * 16, None)], SCHEMA)
    assert result(df) == brute([(1, [0.5] * 16, None), (2, [0.25] * 16, None)])
    assert result(df.limit(0)) == []
    assert [r[1:4] for r in result(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA))] == [("00" * 16, 0, 0)] * 2
    got = result(spark.createDataFrame([(1, [0.5] * 20, 1), (2, [0.5] * 16, 1), (3, [1.0] * 20, 2)], SCHEMA))
    assert [g[1] is None for g in got] == [False, True, False] and [g[2] for g in got] == [0, None, 0]
    equal = [(7, [0.5, -0.5] * 8, 1)] * 300
    assert result(spark.createDataFrame(equal, SCHEMA).repartition(4)) == brute(equal)


def test_bounds_filter():
    """The bounds keep the first of the nearest entries, and spare most exact distances."""
    r = np.random.default_rng(6)
    for width, spread in ((1, 50), (3, 200), (4, 200), (7, 3)):
        x, c = r.integers(-spread, spread, (400, width)), r.integers(-spread, spread, (64, width))
        entry, d, tried = vector_codes.nearest(x, c)
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (entry == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
        assert tried < exact.size / 2 or spread == 3
    small, large = np.array([[1, 2]]), np.array([[1 << 1032, 0], [2, 2]], object)
    for x, c, want in ((small, large, (1, 1)), (large[:1], small, (0, (2**1032 - 1) ** 2 + 4))):
        entry, d, _ = vector_codes.nearest(x, c)
        assert (entry[0], d[0]) == want


def test_decoded(spark):
    df = queries.table(spark, SF, "embeddings")
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    books = vector_codes.fit(rows)
    got = vector_codes.decoded(vector_codes.encoded(rows, books), books).join(rows, "vec_id")
    square = F.aggregate(F.zip_with("vector", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    lost, whole = got.agg(F.sum(square), F.sum(norm)).first()
    assert lost < 0.4 * whole


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op13_vector_codes(spark, SF).collect()))
    assert sorted(con.sql(vector_codes.oracle()).fetchall()) == got and len(got) == 500
