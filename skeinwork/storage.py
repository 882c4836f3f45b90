"""Where intermediate results are kept, and row order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place on one machine (tests); on a
    cluster that is an error, as executors wouldn't see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def can_checkpoint(spark: SparkSession) -> None:
    """Have ``DataFrame.checkpoint`` write to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what ``settle`` or ``in_buckets`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_settled_at", None)
    if path:
        spark = df.sparkSession
        if getattr(df, "_named", None):
            spark.sql(f"DROP TABLE IF EXISTS `{df._named}`")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written in buckets of ``key`` to the shared folder: joins on the key don't shuffle it again."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.read.table(name)
    out._settled_at, out._named = path, name
    return out


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """``df`` with its 0-based position in ``order``, numbered in parallel.

    A range shuffle sorts; each partition numbers its own rows, and the counts of the
    partitions (one row each) give the offsets.  Rows that tie get neighbouring numbers.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(placed.withColumns({"__part": F.spark_partition_id(), "__at": local}), "row-index")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    # one row a partition: the rows that are numbered stay where they are read
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
