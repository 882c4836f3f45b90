"""Files as relations: which are missing, which are newest, and the first and last lines of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, folder, name, size_bytes, mtime of the files below ``root`` that aren't empty; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace(F.col("path"), "/[^/]*$", "")
    return files.select("path", folder.alias("folder"), name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def missing(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Rows of ``expected`` whose keys ``found`` has not; a null key is missing."""
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def need_all(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("path",)) -> None:
    """Raises if something expected is missing, before anything is written; names at most ten."""
    gone = missing(expected, found, keys).select(*keys).orderBy(*keys).limit(10).collect()
    if gone:
        raise FileNotFoundError("missing: " + ", ".join("/".join(map(str, r)) for r in gone))


def newest(files: DataFrame, by: Sequence[str], time: str = "mtime", name: str = "path") -> DataFrame:
    """The newest row of each group, ties to the greater name; rows without a time are the oldest."""
    whole = F.struct(*[F.col(f"`{c}`") for c in files.columns])
    rank = F.struct(F.col(time).isNotNull(), time, name)
    return files.groupBy(*by).agg(F.max_by(whole, rank).alias("__row")).select("__row.*")


def head(lines: DataFrame, n: int, file: str = "file", line: str = "line_no") -> DataFrame:
    """The first ``n`` lines of each file, numbered from 1: a filter."""
    return lines.where(F.col(line) <= n)


def tail(lines: DataFrame, n: int, file: str = "file", line: str = "line_no") -> DataFrame:
    """The last ``n`` lines of each file; a file's lines aren't gathered, only its greatest number goes back to them."""
    last = lines.groupBy(file).agg(F.max(line).alias("__last"))
    return lines.join(last, file).where(F.col(line) > F.col("__last") - n).drop("__last")
