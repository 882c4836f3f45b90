"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows are sorted by range over all tasks.  Counts of the groups in each partition give
the place of a partition's rows in their groups, so each partition builds all complete
aligned subtrees of its own rows.  Only the ragged nodes at the ends of its runs (some
for each level) are shuffled, by their coordinate in the tree: STEP levels meet in one
group of at most FAN ** STEP nodes, however large the tree is.  The siblings found on
the way up go back to the partitions, which extend them to proofs of their rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skeinwork.llm.common import materialize

FAN = 3
#: Levels that one shuffle finishes: at most FAN ** STEP nodes meet.
STEP = 9
#: Proofs that leave a worker at once.
ROWS = 1000

RUNS = "array<struct<grp: string, first: long, n: long, before: long, total: long>>"
UPPER = "array<struct<grp: string, level: int, idx: long, path: string, top: string>>"


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field(value: Column) -> Column:
    """The text of a value that its digest takes: ``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    h = 0
    while total > 1:
        total, h = -(-total // FAN), h + 1
    return h


def climb(lo: int, nodes: list[str], total: int) -> list[tuple[int, list[str], int]]:
    """(first index, digests, length of the whole level) of each level that follows from ``nodes``, which begin at ``lo`` of ``total``."""
    levels = [(lo, nodes, total)]
    while total > 1 and nodes:
        first, end = -(-lo // FAN), -(-total // FAN) if lo + len(nodes) == total else (lo + len(nodes)) // FAN
        nodes = [joined_hash(nodes[FAN * i - lo : FAN * i + FAN - lo]) for i in range(first, end)]
        lo, total = first, -(-total // FAN)
        levels.append((lo, nodes, total))
    return levels


def ragged(levels: list[tuple[int, list[str], int]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes without a parent in ``levels``."""
    for level, (lo, nodes, _) in enumerate(levels):
        up_lo, up, _ = levels[level + 1] if level + 1 < len(levels) else (0, [], 0)
        # those with a parent are one stretch in the middle
        left, right = (max(lo, FAN * up_lo) - lo, min(len(nodes), FAN * (up_lo + len(up)) - lo)) if up else (len(nodes), len(nodes))
        yield from ((level, lo + k, nodes[k]) for k in (*range(left), *range(right, len(nodes))))


def siblings(index: int, total: int) -> list[int]:
    first = index - index % FAN
    return [i for i in range(first, min(first + FAN, total)) if i != index]


def proofs(levels: list[tuple[int, list[str], int]], level: int, index: int, path: str) -> Iterator[str]:
    """Proofs of the leaves below a node, from left to right; ``path`` is the node's own."""
    if level == 0:
        yield path
        return
    lo, nodes, total = levels[level - 1]
    for child in range(FAN * index, min(FAN * index + FAN, total)):
        yield from proofs(levels, level - 1, child, "".join([nodes[i - lo] for i in siblings(child, total)]) + path)


def fold(digest: str, proof: str, place: int, total: int) -> tuple[str, str]:
    """The root that follows from a leaf and its proof, and what the proof has left."""
    while total > 1:
        first = place - place % FAN
        n = min(FAN, total - first) - 1
        others, proof = [proof[64 * k : 64 * k + 64] for k in range(n)], proof[64 * n :]
        others.insert(place - first, digest)
        digest, place, total = joined_hash(others), place // FAN, -(-total // FAN)
    return digest, proof


def wider(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


# -- the tree of each group ------------------------------------------------------------


def in_order(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` sorted by group and ``order`` over all tasks, with their partition (part) and place there (at)."""
    # the last key deals out rows that are equal in all others
    rows = materialize(leaves, "merkle-leaves").withColumn("__tie", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in ("grp", *order, "leaf", "__tie")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(placed.withColumns({"part": F.spark_partition_id(), "at": at}), "merkle-sorted")


def runs_of(leaves: DataFrame) -> DataFrame:
    """For each partition and group: first place, rows, rows of the group in earlier partitions and in all."""
    runs = leaves.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")  # one row a partition
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    return materialize(runs.withColumns({"before": before, "total": F.sum("n").over(whole)}), "merkle-runs")


def by_partition(leaves: DataFrame, info: DataFrame) -> DataFrame:
    """The leaves of each partition in their order, after its row of ``info`` (at = -1)."""
    info = info.withColumn("at", F.lit(-1).cast("long"))
    return leaves.unionByName(info, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "at")


def partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Table]]:
    """The row of information and the leaves of each partition."""
    info: dict | None = None
    held: list[pa.RecordBatch] = []
    for b in batches:
        heads = {i for i, at in enumerate(b.column("at").to_pylist()) if at < 0}
        for lo, hi in itertools.pairwise(sorted({0, *heads, b.num_rows})):
            if lo in heads:
                if info is not None:
                    yield info, pa.Table.from_batches(held)
                info, held = b.slice(lo, 1).to_pylist()[0], [b.slice(lo + 1, hi - lo - 1)]
            else:
                held.append(b.slice(lo, hi - lo))
    if info is not None:
        yield info, pa.Table.from_batches(held)


def run_levels(run: dict, leaves: pa.Table) -> list[tuple[int, list[str], int]]:
    return climb(run["before"], leaves.column("leaf").slice(run["first"], run["n"]).to_pylist(), run["total"])


def ragged_nodes(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """grp, total, level, idx, digest, part: the highest nodes that the partitions build on their own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for info, table in partitions(batches):
            rows = []
            for run in info["runs"]:
                rows += [(run["grp"], run["total"], level, idx, digest, info["part"]) for level, idx, digest in ragged(run_levels(run, table))]
            names = ["grp", "total", "level", "idx", "digest", "part"]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    info = runs.groupBy("part").agg(F.collect_list(F.struct("grp", "first", "n", "before", "total")).cast(RUNS).alias("runs"))
    return by_partition(leaves.select("part", "at", "leaf"), info).mapInArrow(build, "grp string, total long, level int, idx long, digest string, part int")


def finish(target: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Builds the nodes of one coordinate up to level ``target`` or the root.

    A row for each given node, with its siblings up to that level and where they lead;
    and one row for the node there (path null).
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        grp, total = group["grp"].iloc[0], int(group["total"].iloc[0])
        top = min(target, height(total))
        given = list(zip(group["level"], group["idx"], group["digest"], strict=True))
        by_level: list[dict[int, str]] = [{} for _ in range(top + 1)]
        for level, idx, digest in given:
            by_level[level][idx] = digest
        sizes = [total]
        for level in range(top):
            n = sizes[-1]
            for p in {i // FAN for i in by_level[level]}:
                by_level[level + 1][p] = joined_hash([by_level[level][i] for i in range(FAN * p, min(FAN * p + FAN, n))])
            sizes.append(-(-n // FAN))
        rows = []
        for level, idx, _ in given:
            at, path = idx, []
            for up in range(level, top):
                path += [by_level[up][i] for i in siblings(at, sizes[up])]
                at //= FAN
            rows.append((grp, total, level, idx, None, top, at, "".join(path)))
        (idx, digest), *_ = by_level[top].items()
        rows.append((grp, total, top, idx, digest, top, idx, None))
        return pd.DataFrame(rows, columns=["grp", "total", "level", "idx", "digest", "to_level", "to_idx", "path"])

    return run


def upper_paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, grp, level, idx, path) of ragged nodes, their siblings up to the root of their group; and (grp, total, top) of the groups."""
    nodes = materialize(nodes, "merkle-nodes")
    most = height(nodes.agg(F.max("total")).first()[0] or 0)
    start = nodes.select("part", "grp", "level", "idx", F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.lit("").alias("path"))
    root_level = F.lit(0)  # height(total)
    for h in range(1, most + 1):
        root_level = F.when(F.col("total") > FAN ** (h - 1), h).otherwise(root_level)
    open_, roots = nodes.drop("part"), []
    for target in range(STEP, most + STEP, STEP):
        roots.append(open_.where(F.col("level") == root_level).select("grp", "total", F.col("digest").alias("top")))
        open_ = open_.where(F.col("level") < root_level)
        low = open_.where(F.col("level") < target)
        coordinate = F.floor(F.col("idx") / F.pow(F.lit(FAN), F.lit(target) - F.col("level"))).cast("long").alias("coordinate")
        schema = "grp string, total long, level int, idx long, digest string, to_level int, to_idx long, path string"
        done = materialize(low.groupBy("grp", coordinate).applyInPandas(finish(target), schema), "merkle-round")
        step = done.where("path IS NOT NULL").select("grp", F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("to_level").alias("__level"), F.col("to_idx").alias("__idx"), F.col("path").alias("__path"))
        joined = start.join(step, ["grp", "to_level", "to_idx"], "left")
        moved = {"to_level": F.coalesce("__level", "to_level"), "to_idx": F.coalesce("__idx", "to_idx"), "path": F.concat("path", F.coalesce("__path", F.lit("")))}
        start = joined.withColumns(moved).drop("__level", "__idx", "__path")
        open_ = open_.where(F.col("level") >= target).unionByName(done.where("path IS NULL").select("grp", "total", "level", "idx", "digest"))
    roots.append(open_.where(F.col("level") == root_level).select("grp", "total", F.col("digest").alias("top")))
    tops = roots[0]
    for r in roots[1:]:
        tops = tops.unionByName(r)
    return start.select("part", "grp", "level", "idx", "path"), tops


def forest(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sorted leaves, runs, paths of ragged nodes and roots of the groups of ``leaves`` (grp, leaf, and more); none of grp and leaf is null."""
    placed = in_order(leaves, order)
    runs = runs_of(placed)
    paths, tops = upper_paths(ragged_nodes(placed, runs))
    return placed, runs, materialize(paths, "merkle-paths"), materialize(tops, "merkle-tops")


def with_proofs(placed: DataFrame, runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Each leaf with place, total, proof and top; ``paths`` has path and top for each ragged node."""
    kept = placed.drop("part", "at").columns
    schema = wider(placed.select(kept), "place long, total long, proof string, top string")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for info, table in partitions(batches):
            above: dict[str, list[dict]] = {}
            for u in info["upper"]:
                above.setdefault(u["grp"], []).append(u)
            for run in info["runs"]:
                levels = run_levels(run, table)
                nodes = sorted(above[run["grp"]], key=lambda u: u["idx"] * FAN ** u["level"])
                found = (p for u in nodes for p in proofs(levels, u["level"], u["idx"], u["path"]))
                own = table.slice(run["first"], run["n"]).select(kept)
                for lo in range(0, run["n"], ROWS):
                    part = own.slice(lo, ROWS)
                    n = part.num_rows
                    more = {"place": pa.array(range(run["before"] + lo, run["before"] + lo + n), pa.int64()), "total": pa.array([run["total"]] * n, pa.int64())}
                    more |= {"proof": pa.array([next(found) for _ in range(n)], pa.string()), "top": pa.array([nodes[0]["top"]] * n, pa.string())}
                    for name, values in more.items():
                        part = part.append_column(name, values)
                    yield from part.combine_chunks().to_batches()

    info = runs.groupBy("part").agg(F.collect_list(F.struct("grp", "first", "n", "before", "total")).cast(RUNS).alias("runs"))
    upper = paths.groupBy("part").agg(F.collect_list(F.struct("grp", "level", "idx", "path", "top")).cast(UPPER).alias("upper"))
    return by_partition(placed, info.join(upper, "part")).mapInArrow(extend, schema)


def manifest(rows: DataFrame, group: str, order: str, fields: list[str], presented: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, place, proof, subroot and root of each row of ``rows``.

    Columns: ``order``, leaf, place and total (in the row's group), proof (hex digests
    of the siblings from the leaf up, one after another), subroot (root of the group),
    group_place, groups (of the group among all), root; and ``presented``, the digest
    of the row as it is shown to a verifier, where ``presented`` has other values for
    some of its fields.  Other columns of ``rows`` take no part.

    A leaf digests ``fields`` in their order.  Groups are sorted by bytes, null first;
    leaves by ``order``, null first, then by digest, so rows of a repeated id have a
    defined place, and rows that are equal take neighbouring ones.  A single leaf is
    its group's root, a single group's root the whole's; no rows give no rows.
    """
    own = leaf_digest(*[F.col(f) for f in fields])
    shown = leaf_digest(*[(presented or {}).get(f, F.col(f)) for f in fields])
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(F.col(order).alias("key"), grp.alias("grp"), own.alias("leaf"), shown.alias("presented"))
    leaves = leaves.withColumn("presented", F.when(F.col("presented") != F.col("leaf"), F.col("presented")))
    placed, runs, paths, tops = forest(leaves, ["key"])
    # the same over the groups' roots
    groups, g_runs, g_paths, g_tops = forest(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("leaf")), ["name"])
    above = materialize(with_proofs(groups, g_runs, g_paths.join(g_tops.drop("total"), "grp")), "merkle-groups")
    above = above.select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), F.col("proof").alias("__more"), F.col("place").alias("group_place"), F.col("total").alias("groups"), F.col("top").alias("root"))
    whole = paths.join(above, "grp")
    # what a group's leaves share travels as one text
    top = F.concat_ws(",", "subroot", "group_place", "groups", "root")
    done = with_proofs(placed, runs, whole.select("part", "grp", "level", "idx", F.concat("path", "__more").alias("path"), top.alias("top")))
    parts = F.split("top", ",")
    return done.select(
        F.col("key").alias(order), "leaf", F.coalesce("presented", "leaf").alias("presented"), "place", "total", "proof",
        parts[0].alias("subroot"), parts[1].cast("long").alias("group_place"), parts[2].cast("long").alias("groups"), parts[3].alias("root"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of a manifest with folded_root, which follows from ``presented`` and the proof, and whether it is the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for digest, proof, place, total, group_place, groups in zip(*(b.column(c).to_pylist() for c in ("presented", "proof", "place", "total", "group_place", "groups")), strict=True):
                top, proof = fold(digest, proof, place, total)
                out.append(fold(top, proof, group_place, groups)[0])
            yield b.append_column("folded_root", pa.array(out, pa.string()))

    folded = rows.mapInArrow(run, wider(rows, "folded_root string"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source, each also presented as a tamperer shows it.

    Where 2 divides the crc32 of the decimal id, line feeds are deleted from the
    presented text; a null id is left alone, a null text stays null.
    """
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verified(manifest(docs, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": text}))


def oracle(levels: int = 16) -> str:
    """The same rows as DuckDB SQL over documents, for groups of at most FAN ** levels leaves."""
    field_sql = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    digest = lambda text: "sha256(" + " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))), lambda i: (ascii(CAST(doc_id AS VARCHAR)[1 + i // 8]) >> (i % 8)) & 1)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    ctes = [
        f"""shown AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other, coalesce('=' || source, '') AS g FROM documents)""",
        f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
          FROM (SELECT doc_id, g, {digest("text")} AS leaf, {digest("other")} AS cur FROM shown))""",
    ]

    def tree_sql(name: str) -> None:
        """{name}0 has g, p, h, n; {name}s{k} the siblings before and after each node of level k."""
        for k in range(levels):
            w = f"OVER (PARTITION BY g, p // {FAN} ORDER BY p)"
            near = lambda f: [f"coalesce({f}(h, {j}) {w}, '')" for j in range(1, FAN)]
            ctes.append(f"{name}s{k} AS MATERIALIZED (SELECT g, p, n, {' || '.join(near('lag')[::-1])} AS pre, {' || '.join(near('lead'))} AS post FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, p // {FAN} AS p, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, (n + {FAN - 1}) // {FAN} AS n FROM {name}{k} GROUP BY g, p // {FAN}, n)")

    def fold_sql(name: str, to: str) -> None:
        for k in range(levels):
            ctes.append(f"""{to}{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (p, cur, proof), f.p // {FAN} AS p, CASE WHEN s.n = 1 THEN cur ELSE sha256(pre || cur || post) END AS cur, proof || pre || post AS proof
              FROM {to}{k} f JOIN {name}s{k} s ON s.g = f.g AND s.p = f.p)""")

    ctes.append("a0 AS (SELECT g, p, leaf AS h, n FROM leaves)")
    tree_sql("a")
    ctes.append(f"t0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS n, g AS name FROM a{levels})")
    tree_sql("t")
    ctes.append("f0 AS (SELECT doc_id, g, p, leaf, cur, '' AS proof FROM leaves)")
    fold_sql("a", "f")
    ctes.append(f"e0 AS (SELECT doc_id, leaf, t0.h AS subroot, t0.g, t0.p, cur, proof FROM f{levels} f JOIN t0 ON t0.name = f.g)")
    fold_sql("t", "e")
    return f"""WITH {", ".join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM e{levels}, (SELECT h FROM t{levels})"""
