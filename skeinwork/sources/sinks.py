"""Writers of the exchange formats; tables stay typed until they get here."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import UNREACHED, hex_edge, six_digits


def _text(df: DataFrame, order: Sequence[str | Column], line: Column, path: str, one_file: bool = False) -> None:
    """Ordered lines.

    Tasks sort a range each and write it as a part file; the parts in order of their
    names, one after another, are the ordered file.  Small outputs come as one part.
    ``one_file``: a single task writes all, for formats whose first line counts the rest.
    """
    keys = [f"__{k}" for k in range(len(order))]
    rows = df.select(line.alias("value"), *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys, strict=True)])
    rows = rows.coalesce(1).sortWithinPartitions(*keys) if one_file else rows.orderBy(*keys)
    rows.select("value").write.mode("overwrite").text(path)


def write_graph(vertices: int, static: DataFrame, updates: DataFrame, path: str) -> None:
    """``V E U``, then static edges, then updates in order."""
    spark = static.sparkSession
    head = spark.createDataFrame([(f"{vertices} {static.count()} {updates.count()}", 0, 0, 0)], "line string, part int, a long, b long")
    s = static.select(F.concat_ws(" ", "src", "dst").alias("line"), F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    u = updates.select(F.concat_ws(" ", "src", "dst", "typ").alias("line"), F.lit(2).alias("part"), F.col("seq").alias("a"), F.lit(0).cast("long").alias("b"))
    _text(head.union(s).union(u), ["part", "a", "b"], F.col("line"), path, one_file=True)


def write_result(edges: DataFrame, path: str) -> None:
    _text(edges, ["src", "dst"], hex_edge(F.col("src"), F.col("dst")), path)


def write_edges(edges: DataFrame, path: str, weight: bool = True) -> None:
    _text(edges, ["src", "dst"], F.concat_ws(" ", "src", "dst", *(["weight"] if weight else [])), path)


def write_distances(distances: DataFrame, path: str) -> None:
    """vertex and distance, INF where unreached, with a header."""
    rows = distances.select("vertex", F.coalesce(F.col("distance").cast("string"), F.lit(UNREACHED)).alias("distance_after_supersteps"))
    write_tsv(rows.orderBy("vertex"), path, rows.columns)


def write_tsv(df: DataFrame, path: str, fields: Sequence[str], mode: str = "overwrite", header: bool = True) -> None:
    """The fields in this order, other columns left out; a missing field or null is "".

    Every task writes its rows, in their order, to a part file with a header of its own.
    """
    columns = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    df.select(*columns).write.mode(mode).option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def case_json(row: dict, intent: str) -> str:
    return json.dumps({**row, "intent": intent, "unit_weight_note": "Unit weights keep shortest-path comparisons fair."}, indent=2, sort_keys=True) + "\n"


def env_lines(values: dict[str, object]) -> str:
    return "".join(f"{k}={v}\n" for k, v in values.items())


def markdown(rows: Iterable[dict], columns: Sequence[str], empty: str = "No rows.") -> str:
    """A table of a few rows; floats with six significant digits."""
    rows = list(rows)
    if not rows:
        return empty + "\n"
    cell = lambda x: "" if x is None else six_digits(x) if isinstance(x, float) else str(x).replace("|", "\\|")
    out = [f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |"]
    return "\n".join(out + [f"| {' | '.join(cell(r.get(c)) for c in columns)} |" for r in rows]) + "\n"


def report(title: str, parts: dict[str, DataFrame], most: int = 64) -> str:
    """Markdown with a table for each named relation, its first ``most`` rows."""
    text = f"# {title}\n"
    for name, df in parts.items():
        text += f"\n## {name}\n\n" + markdown((r.asDict() for r in df.limit(most).collect()), df.columns)
    return text
