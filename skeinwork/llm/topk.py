"""Exact top-k inner products with block-at-a-time pruning.

Vectors are cut into blocks by id range.  A block carries the greatest and least
value of each term (component); for a query, the sum over terms of what the block
can give at most bounds every score in it.  Per query, blocks are scored through
their forward index in falling order of that bound, until it is below the k-th
best score found; a block whose bound equals it is still scored, for ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import materialize

BLOCK, K = 64, 5
#: Queries that are sent to the executors at once (times the dimensions, 8 bytes each).
QUERY_BATCH = 16_384
#: Integers up to this are exact in the arithmetic used for scores and bounds.
EXACT = 2**53


def scaled(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as long; null for a null vector or one with a null or non-finite component."""
    x = embedding.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` vectors (vec_id, ints; none null) of one dimension, by ascending id: ids, values, high, low, dims."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()
            dims = np.diff(off)
            rows: list[tuple] = []
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                for lo in range(0, len(own), block):
                    k = own[lo : lo + block]
                    x = flat[off[k][:, None] + np.arange(d)[None, :]] if d else np.zeros((len(k), 0), np.int64)
                    rows.append((int(d), ids[k].astype("<i8").tobytes(), x.astype("<i8").tobytes(), x.max(axis=0, initial=-(1 << 62)).astype("<i8").tobytes() if d else b"", x.min(axis=0, initial=1 << 62).astype("<i8").tobytes() if d else b""))
            names = ["dims", "ids", "x", "high", "low"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)] if rows else [pa.array([], t) for t in [pa.int64(), *[pa.binary()] * 4]], names)

    placed = vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("vec_id", "ints")
    return placed.mapInArrow(build, "dims long, ids binary, x binary, high binary, low binary")


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.vec = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        v = np.concatenate([self.vec[rows], np.broadcast_to(vec, score.shape)], axis=1)
        order = np.lexsort((v, -s), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.vec[rows] = np.take_along_axis(v, order, axis=1)


def search_blocks(best: Best, qid: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> int:
    """Score the queries against blocks (ids, values, high, low); returns how many block visits the bounds saved."""
    high, low = (np.stack([b[k] for b in blocks]) for k in (2, 3))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    alive = np.arange(len(q))
    saved = 0
    for r in range(len(blocks)):
        b = order[alive, r]
        keep = bound[alive, b] >= best.score[alive, -1]
        saved += int((~keep).sum()) * (len(blocks) - r)
        alive, b = alive[keep], b[keep]
        if not len(alive):
            break
        by = np.argsort(b, kind="stable")
        cuts = np.flatnonzero(np.diff(b[by])) + 1
        for rows in np.split(by, cuts):
            ids, x, _, _ = blocks[b[rows[0]]]
            own = alive[rows]
            score = q[own] @ x.T
            score[qid[own][:, None] == ids[None, :]] = -np.inf  # not the query's own row
            best.add(own, score, ids)
    return saved


def search(blocks: DataFrame, queries: DataFrame, k: int = K, batch: int = QUERY_BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``blocks`` for each row of ``queries`` (vec_id, ints).

    Queries go to the executors ``batch`` at a time, each batch against all blocks;
    every task keeps k rows for a query, the best of which are the result.
    Only vectors of the query's own number of components count.
    """
    spark: SparkSession = blocks.sparkSession
    found: list[DataFrame] = []

    def part(ids: list[int], ints: list[list[int]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array(ids, np.int64), ints))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, values = sent.value
            dims = np.array([len(v) for v in values])
            state: dict[int, tuple] = {}
            for b in batches:
                groups: dict[int, list] = {}
                for d, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids_, x, high, low = (np.frombuffer(y, "<i8") for y in raw)
                    groups.setdefault(d, []).append((ids_, x.reshape(len(ids_), d), high, low))
                for d, own in groups.items():
                    if d not in state:
                        rows = np.flatnonzero(dims == d)
                        if not len(rows):
                            continue
                        q = np.array([values[r] for r in rows], np.float64).reshape(len(rows), d)
                        state[d] = (qids[rows], q, Best(len(rows), k))
                    qid, q, best = state[d]
                    top = max((float(np.abs(x).max(initial=0)) for _, x, _, _ in own), default=0.0)
                    if top * float(np.abs(q).max(initial=0)) * max(1, d) >= EXACT:
                        raise ValueError("scores are too large for exact arithmetic")
                    search_blocks(best, qid, q, [(i, x.astype(np.float64), h.astype(np.float64), lo.astype(np.float64)) for i, x, h, lo in own])
            for qid, _, best in state.values():
                r, c = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best.vec[r, c]), pa.array(best.score[r, c].astype(np.int64))], ["query_id", "vec_id", "score"])

        return blocks.mapInArrow(run, "query_id long, vec_id long, score long")

    ids, ints = [], []
    for r in queries.select("vec_id", "ints").toLocalIterator():
        ids.append(r["vec_id"]), ints.append(r["ints"])
        if len(ids) == batch:
            found.append(materialize(part(ids, ints), "topk"))
            ids, ints = [], []
    if ids or not found:
        found.append(part(ids, ints))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, *, every: int = 50, k: int = K, block: int = BLOCK) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, against all rows but their own.

    Ids must be unique for a query to have one answer; rows of a repeated id are
    candidates each on its own, but never for their own id.  Null ids, and vectors
    that ``scaled`` makes null, take no part.  Empty vectors score 0.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("ints")).where(F.col("ints").isNotNull())
    blocks = materialize(index(rows, block), "blocks")
    return search(blocks, rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
