"""Scatter / gather / apply programs on edge tables, in synchronous supersteps.

A program is a set of Column expressions, so Catalyst plans every superstep.  Edges
are dealt out by source once, sorted and checkpointed; the state is dealt out by
vertex.  A superstep joins the changed vertices only (the frontier) with their edges
where these lie, combines the candidates of each vertex, and exchanges nothing but
these; the old state is merged with them where it lies.  Sources of very many edges
are cut into shares over several tasks.  States are cached and cut from their lineage
at once, so plans don't grow, and written by a checkpoint now and then.
"""

from __future__ import annotations

import contextlib
import dataclasses
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from skeinwork.storage import can_checkpoint

#: Supersteps between two writes of the state.
SETTLE_EVERY = 8
#: Edges of one source that a task meets at most.
SHARE = 1 << 22


@dataclasses.dataclass(frozen=True)
class Program:
    """scatter(source state, edge weight); gather: aggregate of candidates; apply(old or null, candidate)."""

    scatter: Callable[[Column, Column], Column]
    gather: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]


SHORTEST = Program(lambda d, w: d + w, F.min, F.least)
SMALLEST_LABEL = Program(lambda d, w: d, F.min, F.least)


class Edges:
    """Edges (src, dst and more) dealt out by source; a source of over ``share`` edges is cut into shares."""

    def __init__(self, edges: DataFrame, share: int = SHARE):
        n = partitions(edges.sparkSession)
        large = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > share)
        self.large = dealt(large.select(F.col("src").alias("src"), F.ceil(F.col("degree") / share).cast("int").alias("shares")), n, "src")
        self.split = self.large.limit(1).count() > 0
        self.keys = ["src"]
        if self.split:
            edges = edges.join(self.large, "src", "left").withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("shares")).cast("int"))).drop("shares")
            self.keys = ["src", "share"]
        self.rows = dealt(edges, n, *self.keys)

    def met_by(self, frontier: DataFrame) -> DataFrame:
        """The edges of ``frontier`` (src and more); only the frontier moves, and only if a source is split."""
        if self.split:
            shares = F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)
            frontier = frontier.join(self.large, "src", "left").withColumn("share", F.explode(shares)).drop("shares")
        return frontier.hint("merge").join(self.rows, self.keys)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` in ``n`` partitions by ``keys``, sorted and written, in a form whose partitioning Spark knows."""
    # cut from its plan first (lazily, so not written): constants and renamed columns there would cost the partitioning
    return df.checkpoint(eager=False).repartition(n, *keys).sortWithinPartitions(*keys).checkpoint()


@contextlib.contextmanager
def lasting_partitions(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile keep the partitions they ask for, so that later joins need no exchange."""
    can_checkpoint(spark)
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Superstep:
    """The next state (vertex, value, changed) of a program; all candidates come from the state before (Jacobi).

    Its expressions are made once, as making them takes longer than small supersteps.
    """

    def __init__(self, program: Program, edges: Edges, kind: DataType):
        none = F.lit(None).cast(kind)
        old, candidate = F.col("old"), F.col("candidate")
        new = F.when(candidate.isNull(), old).otherwise(program.apply(old, candidate))
        self.edges = edges
        self.changed = F.col("changed")
        self.sends = [F.col("vertex").alias("src"), F.col("value")]
        self.sent = [F.col("dst").alias("vertex"), program.scatter(F.col("value"), F.col("weight")).cast(kind).alias("candidate")]
        self.best = program.gather(candidate).alias("candidate")
        self.rows = [F.col("vertex"), F.col("value").alias("old"), none.alias("candidate")], [F.col("vertex"), none.alias("old"), candidate]
        self.merge = [F.max("old").alias("old"), F.max("candidate").alias("candidate")]  # one of each at most
        self.state = [F.col("vertex"), new.alias("value"), (candidate.isNotNull() & (old.isNull() | (new != old))).alias("changed")]

    def __call__(self, state: DataFrame) -> DataFrame:
        sent = self.edges.met_by(state.where(self.changed).select(*self.sends)).select(*self.sent)
        best = sent.groupBy("vertex").agg(self.best)
        return state.select(*self.rows[0]).union(best.select(*self.rows[1])).groupBy("vertex").agg(*self.merge).select(*self.state)


def run(program: Program, edges: DataFrame, start: DataFrame, supersteps: int | None = None, every: int = SETTLE_EVERY, share: int = SHARE) -> DataFrame:
    """``supersteps`` rounds from ``start`` (vertex, value), or rounds until nothing changes; (vertex, value) of reached vertices."""
    spark = edges.sparkSession
    with lasting_partitions(spark):
        own = Edges(edges, share)
        state = dealt(start.select("vertex", "value", F.lit(True).alias("changed")), partitions(spark), "vertex")
        step = Superstep(program, own, start.schema["value"].dataType)
        held: list[DataFrame] = []
        k = 0
        while supersteps is None or k < supersteps:
            # the next plan begins here: cached, and without what it came from
            state = step(state).checkpoint(eager=False).persist()
            held.append(state)
            k += 1
            if k % every == 0:
                done = not state.agg(F.count_if("changed")).first()[0]  # which writes the checkpoint
                for h in held[:-1]:
                    h.unpersist()
                held = held[-1:]
                if done:
                    break
        out = state.select("vertex", "value").checkpoint()
        for h in held:
            h.unpersist()
    return out


def _source(edges: DataFrame, source: int) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("vertex"), F.lit(0).cast("long").alias("value"))


def _weighted(edges: DataFrame, weight: int | None) -> DataFrame:
    w = F.col("weight").cast("long") if weight is None else F.lit(weight).cast("long")
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("weight"))


def sssp(edges: DataFrame, source: int, supersteps: int | None = None, weight: int | None = None) -> DataFrame:
    """vertex, distance after exactly ``supersteps`` rounds (none: until nothing changes); unreached vertices are absent.

    ``weight``: one weight for all edges instead of the column.
    """
    return run(SHORTEST, _weighted(edges, weight), _source(edges, source), supersteps).withColumnRenamed("value", "distance")


def bfs(edges: DataFrame, source: int, supersteps: int | None = None) -> DataFrame:
    """vertex, level."""
    return sssp(edges, source, supersteps, 1).withColumnRenamed("distance", "level")


def all_distances(reached: DataFrame, vertices: int) -> DataFrame:
    """vertex 0 .. V - 1 with distance, null where unreached."""
    return reached.sparkSession.range(vertices).select(F.col("id").alias("vertex")).join(reached, "vertex", "left")


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    """vertex, rank after ``iterations`` synchronous rounds from 1 / V.

    V counts the vertices that occur in an edge; parallel edges count each; a vertex
    without out-edges gives its rank to all vertices alike.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst")
    with lasting_partitions(spark):
        own = Edges(e)
        degree = e.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
        vertices = e.select(F.col("src").alias("vertex")).union(e.select("dst")).distinct().join(degree, "vertex", "left")
        ranks = dealt(vertices.select("vertex", "degree", F.lit(None).cast("double").alias("rank")), partitions(spark), "vertex")
        n = max(1, ranks.count())
        ranks = ranks.withColumn("rank", F.lit(1.0 / n))
        for _ in range(iterations):
            lost = ranks.where(F.col("degree").isNull()).agg(F.sum("rank")).first()[0] or 0.0
            share = ranks.where(F.col("degree").isNotNull()).select(F.col("vertex").alias("src"), (F.col("rank") / F.col("degree")).alias("share_of_rank"))
            got = own.met_by(share).groupBy(F.col("dst").alias("vertex")).agg(F.sum("share_of_rank").alias("got"))
            both = ranks.select("vertex", "degree", F.lit(0.0).alias("got")).union(got.select("vertex", F.lit(None).cast("long"), "got"))
            merged = both.groupBy("vertex").agg(F.max("degree").alias("degree"), F.sum("got").alias("got"))
            ranks = merged.select("vertex", "degree", (F.lit((1 - damping) / n) + damping * (F.col("got") + lost / n)).alias("rank")).checkpoint()
    return ranks.select("vertex", "rank")


def components(edges: DataFrame) -> DataFrame:
    """vertex, component: the smallest vertex of its weakly connected component.

    Smallest labels spread along edges in both directions; between rounds every
    label is replaced by the label of the vertex it names, so paths halve.
    """
    e = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    spark = edges.sparkSession
    with lasting_partitions(spark):
        own = Edges(e.withColumn("weight", F.lit(0).cast("long")))
        n = partitions(spark)
        state = dealt(e.select(F.col("src").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("value"), F.lit(True).alias("changed")), n, "vertex")
        step = Superstep(SMALLEST_LABEL, own, state.schema["value"].dataType)
        while state.where("changed").limit(1).count():
            state = step(state).checkpoint()
            to = state.select(F.col("vertex").alias("value"), F.col("value").alias("further"))
            jumped = state.join(to, "value").select("vertex", F.col("further").alias("value"), (F.col("changed") | (F.col("further") != F.col("value"))).alias("changed"))
            state = dealt(jumped, n, "vertex")
    return state.select("vertex", F.col("value").alias("component"))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: vertices whose distance differs between (vertex, distance) tables; absent and null are the same."""
    both = a.select("vertex", F.col("distance").alias("a")).join(b.select("vertex", F.col("distance").alias("b")), "vertex", "full_outer")
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatch_count"))


def certificate(edges: DataFrame, distances: DataFrame, source: int, supersteps: int | None = None, weight: int | None = None) -> DataFrame:
    """One row: how much refutes (vertex, distance); all counts are 0 exactly if the distances are right.

    No superstep is run.  The source needs distance 0 (``wrong_source``); no edge from
    a reached vertex may lead to a shorter distance (``relaxable`` vertices); every
    other reached vertex needs an edge that gives it its very distance
    (``unsupported``); no vertex may be listed twice (``repeated``).  This proves the
    distances for weights above 0, the others are counted (``weights``).  Null
    distances count as unreached.

    ``weight`` stands for all weights, as for ``sssp``.  With it ``supersteps`` can
    bound the paths: vertices at that many weights pass nothing on.
    """
    if supersteps is not None and weight is None:
        raise ValueError("a bounded number of supersteps needs one weight for all edges")
    e = _weighted(edges, weight)
    d = distances.where(F.col("distance").isNotNull()).groupBy("vertex").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("copies"))
    passing = d if supersteps is None else d.where(F.col("distance") < supersteps * weight)
    offers = e.join(passing.select(F.col("vertex").alias("src"), F.col("distance").alias("from")), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min(F.col("from") + F.col("weight")).alias("offer"))
    at = d.join(offers, "vertex", "full_outer")
    start, reached = F.col("vertex") == source, F.col("distance").isNotNull()
    found = at.agg(
        (1 - F.count_if(start & F.col("distance").eqNullSafe(F.lit(0)))).alias("wrong_source"), F.count_if(F.col("offer").isNotNull() & (~reached | (F.col("offer") < F.col("distance")))).alias("relaxable"),
        F.count_if(reached & ~start & ~F.coalesce(F.col("offer") <= F.col("distance"), F.lit(False))).alias("unsupported"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeated"),
    )
    return found.join(F.broadcast(e.agg(F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False))).alias("weights"))), F.lit(True))  # one row each


def mteps(edges: Column, supersteps: Column, ms: Column) -> Column:
    """Millions of traversed edges a second."""
    return F.when(ms > 0, edges * supersteps / ms / 1000)
