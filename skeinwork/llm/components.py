"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import forget, materialize, with_group


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that occurs in ``links`` (a, b).

    Rounds of large-star and small-star steps: each node links its greater (then its
    smaller) neighbours to the least node it knows; the number of links doesn't grow,
    and the number of rounds is about the logarithm of the longest path.  Both steps
    are group minima, combined before the shuffle; the links of one node are spread over many shares.
    """
    at = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        both = at.unionAll(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_group(both, "a", ["b"], F.min("b").alias("m")).where(F.col("b") > F.col("a"))
        large = materialize(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "links")
        # now b < a in every row: a's least neighbour takes a's others and a itself
        small = with_group(large, "a", ["b"], F.min("b").alias("m"))
        new = materialize(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), "links")
        # nothing reads what this round came from
        forget(large), forget(at)
        at = new
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == last:
            break
        last = now
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(at.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
