"""Compression of vectors to one code byte for each of 16 parts, with exact integer distances.

A part is compared with the entries of its codebook in three steps.  The mean of a
segment and the norm of what is left of it (the residual) bound the distance from
below: |x - c|^2 >= m (mean x - mean c)^2 + (|residual x| - |residual c|)^2, summed
over segments of m components.  First one segment, then two halves filter the entries
against the distance of the entry with the least bound; entries that are left get
exact integer distances.  The bounds are computed in floating point, scaled to one,
with a slack that exceeds all rounding, so no nearest entry and no tie is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skeinwork.llm.common import materialize, with_group

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: More than the rounding errors of bounds over components of at most 1.
SLACK = 1e-9
LIMB = 32
LONG = (-(1 << 63), (1 << 63) - 1)


def finite(vector: Column) -> Column:
    """Whether no component is null or not finite; false for a null vector."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(FACTOR * x): long, or Python integers if some don't fit the arithmetic of distances."""
    if float(np.abs(x).max(initial=0)) < 2.0**16:
        return np.floor(x * FACTOR).astype(np.int64)
    exact = [math.floor(v * FACTOR) if abs(v) < 2.0**900 else int(v) * FACTOR for v in x.ravel().tolist()]
    return np.array([*exact, None], object)[:-1].reshape(x.shape)


def bounds_of(dims: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """The components of each part: equal stretches where ``parts`` divides ``dims``, else as equal as can be."""
    cuts = [p * dims // parts for p in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def halves(width: int) -> list[tuple[int, int]]:
    mid = (width + 1) // 2
    return [(a, b) for a, b in ((0, mid), (mid, width)) if b > a]


def summary(x: np.ndarray, segments: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(sqrt(m) * mean, norm of the residual) of each row's segments."""
    means = np.stack([x[:, a:b].mean(axis=1) * math.sqrt(b - a) for a, b in segments], axis=1)
    rest = np.stack([np.linalg.norm(x[:, a:b] - x[:, a:b].mean(axis=1, keepdims=True), axis=1) for a, b in segments], axis=1)
    return means, rest


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: long, or Python integers where one of the sides has them."""
    d = x - c
    return (d * d).sum(axis=1) if d.shape[1] else np.zeros(len(d), np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the first of the nearest rows of ``c``, their distance, and how many exact distances it took."""
    n, width = x.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    # a power of two, so that scaling rounds nothing but what a double can't hold
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    bits = most.bit_length()
    unit = lambda v: np.ldexp(v.astype(np.float64), -bits) if v.dtype != object else np.array([k / (1 << bits) for k in v.ravel().tolist()]).reshape(v.shape)
    fx, fc = unit(x), unit(c)
    (mx, rx), (mc, rc) = summary(fx, [(0, width)]), summary(fc, [(0, width)])
    bound = (mx[:, 0][:, None] - mc[:, 0][None, :]) ** 2 + (rx[:, 0][:, None] - rc[:, 0][None, :]) ** 2
    guess = bound.argmin(axis=1)
    reach = ((fx - fc[guess]) ** 2).sum(axis=1)  # of the entry with the least bound
    row, entry = np.nonzero(bound <= (reach + SLACK * width)[:, None])
    cuts = halves(width)
    if len(cuts) > 1:
        (mx, rx), (mc, rc) = summary(fx, cuts), summary(fc, cuts)
        finer = ((mx[row] - mc[entry]) ** 2 + (rx[row] - rc[entry]) ** 2).sum(axis=1)
        left = finer <= reach[row] + SLACK * width
        row, entry = row[left], entry[left]
    exact = distances(x[row], c[entry])
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(exact, starts)
    first = np.minimum.reduceat(np.where(exact == np.repeat(best, np.diff(np.append(starts, len(row)))), entry, len(c)), starts)
    return first, best, len(row)


def as_array(rows: list[list[int]], width: int) -> np.ndarray:
    """Long where all distances between such values fit it."""
    most = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if most < 1 << 24 else object).reshape(len(rows), width)


class Codebooks:
    """The entries of each part, as Python integers."""

    def __init__(self, dims: int, entries: list[list[list[int]]]):
        self.dims, self.entries = dims, entries

    @classmethod
    def start(cls, vectors: list[list[float]], parts: int) -> Codebooks:
        dims = len(vectors[0])
        values = [[int(v) for v in row] for row in scaled(np.array(vectors, np.float64).reshape(len(vectors), dims)).tolist()]
        return cls(dims, [[v[a:b] for v in values] for a, b in bounds_of(dims, parts)])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its components of ``x``, nearest entries, distances); ``x``: doubles of the codebooks' dimension."""
        values = scaled(x)
        for p, (a, b) in enumerate(bounds_of(self.dims, len(self.entries))):
            own = values[:, a:b]
            yield p, own, *nearest(own, as_array(self.entries[p], b - a))[:2]

    def moved(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
        """With each entry at the floor of the mean of its parts (sum, count); unused entries stay."""
        return Codebooks(self.dims, [[[s // sums[p, e][1] for s in sums[p, e][0]] if (p, e) in sums else old for e, old in enumerate(part)] for p, part in enumerate(self.entries)])


def vectors_of(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose x has ``dims`` components, and these."""
    lists = b.column("x")
    off = lists.offsets.to_numpy().astype(np.int64)
    own = np.flatnonzero(np.diff(off) == dims)
    return own, lists.values.to_numpy(zero_copy_only=False)[off[own][:, None] + np.arange(dims)[None, :]]


def sums_of(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Sums and counts of the parts at each entry; at most PARTS * ENTRIES * components come to the driver.

    A task sends each sum in limbs of LIMB bits, which Spark adds up as longs, so sums
    of any size are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        count: dict[tuple[int, int], int] = {}
        for b in batches:
            own, x = vectors_of(b, books.dims)
            if not len(own):
                continue
            for p, values, entry, _ in books.assign(x):
                order = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                sums = np.add.reduceat(values[order], starts, axis=0)
                for e, s, n in zip(entry[order][starts].tolist(), sums.tolist(), np.diff(np.append(starts, len(own))).tolist(), strict=True):
                    total[p, e] = total.get((p, e), 0) + np.array([*map(int, s), None], object)[:-1]
                    count[p, e] = count.get((p, e), 0) + n
        out: list[tuple[int, int, int, int, int]] = []
        for (p, e), sums in total.items():
            out.append((p, e, -1, 0, count[p, e]))
            for j, s in enumerate(sums.tolist()):
                sign, s, k = (-1 if s < 0 else 1), abs(s), 0
                while s:
                    out.append((p, e, j, k, sign * (s & ((1 << LIMB) - 1))))
                    s, k = s >> LIMB, k + 1
        names = ["part", "entry", "component", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names)

    parts = rows.select("x").mapInArrow(run, "part long, entry long, component long, limb long, value long")
    got: dict[tuple[int, int], tuple[list[int], int]] = {}
    widths = [b - a for a, b in bounds_of(books.dims, len(books.entries))]
    for p, e, j, k, v in parts.groupBy("part", "entry", "component", "limb").agg(F.sum("value")).collect():
        s, n = got.get((p, e), ([0] * widths[p], 0))
        if j < 0:
            n = v
        else:
            s[j] += v << (LIMB * k)
        got[p, e] = (s, n)
    return got


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (x and others) with code and error instead of x; both null where x has another number of components."""
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = vectors_of(b, books.dims)
            codes, errors = [None] * b.num_rows, [None] * b.num_rows
            if len(own):
                entry, error = [], 0
                for _, _, e, d in books.assign(x):
                    entry.append(e)
                    error = error + d
                text = np.stack(entry, axis=1).astype(np.uint8)
                for r, code, e in zip(own.tolist(), text, error.tolist(), strict=True):
                    codes[r], errors[r] = code.tobytes().hex(), min(int(e), LONG[1])
            yield b.select(kept).append_column("code", pa.array(codes, pa.string())).append_column("error", pa.array(errors, pa.int64()))

    schema = StructType([*rows.select(kept).schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``rows`` (vec_id, x): the ``entries`` smallest ids to begin with, then ``rounds`` rounds; None without rows."""
    by = [F.asc_nulls_last("vec_id"), F.asc("x")]
    first = rows.select("vec_id", "x").orderBy(*by).limit(entries).collect()
    if not first:
        return None
    dims = len(first[0]["x"])
    books = Codebooks.start([r["x"] for r in first if len(r["x"]) == dims], parts)
    for _ in range(rounds):
        books = books.moved(sums_of(rows, books))
    return books


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of ``vectors`` (vec_id, embedding, label).

    Null vectors and those with a null or non-finite component are dropped; no other
    row is.  Fewer than ``entries`` rows make smaller codebooks.  Null ids come after
    all others; of rows of a repeated id each counts, the first by its components; rows
    that are equal get equal codes.  The vector of the smallest id sets the number of
    components; vectors of another number have null code and error and take no part
    in the codebooks.  Parts are equal stretches where their number divides that of
    the components, else as equal as can be; empty vectors have distance 0.  All
    integers are exact; an error beyond a long is the greatest long, as is a sum of
    errors.  Columns besides the three take no part.
    """
    x = F.col("embedding").cast("array<double>")
    rows = materialize(vectors.where(finite(F.col("embedding"))).select("vec_id", "label", x.alias("x")), "vectors")
    books = fit(rows, parts=parts, entries=entries, rounds=rounds) or Codebooks(0, [[[]]] * parts)
    done = materialize(encoded(rows, books), "vector-codes").withColumn("__label", F.struct("label"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    done = with_group(done, "__label", ["vec_id", "code"], total.alias("label_error"))
    label_error = F.least("label_error", F.lit(LONG[1]).cast("decimal(38,0)")).cast("long")
    return done.select("vec_id", "label", "code", "error", label_error.alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, vector: the entries that the codes name, as doubles of the embeddings' scale."""
    entry = [F.array(*[F.array(*[F.lit(v / FACTOR) for v in e]).cast("array<double>") for e in part]) for part in books.entries]
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.concat(*[F.get(entry[p], at(p)) for p in range(len(entry))]).alias("vector"))


def oracle(parts: int = PARTS, dims: int = 64) -> str:
    """The same rows as DuckDB SQL over embeddings of ``dims`` components."""
    width = dims // parts
    near = lambda k, books: f"""a{k} AS MATERIALIZED (SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
      SELECT x.i, x.p, c.e, list_sum(list_transform(range(1, {width + 1}), lambda j: CAST((x.v[j] - c.v[j]) * (x.v[j] - c.v[j]) AS BIGINT))) AS d FROM parts x JOIN {books} c ON c.p = x.p) GROUP BY i, p)"""  # noqa: E731
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT i, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, i AS e, v FROM parts WHERE i < {ENTRIES})",
    ]
    for k in range(ROUNDS):
        mean = ", ".join(f"CAST(floor(sum(v[{j}]) / count(*)) AS BIGINT)" for j in range(1, width + 1))
        ctes.append(near(k, f"c{k}"))
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT a.p, a.e, [{mean}] AS v FROM a{k} a JOIN parts USING (i, p) GROUP BY a.p, a.e) m ON m.p = c.p AND m.e = c.e)")
    ctes.append(near(ROUNDS, f"c{ROUNDS}"))
    return f"""WITH {", ".join(ctes)}, codes AS (SELECT i, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM kept JOIN codes USING (i)"""
