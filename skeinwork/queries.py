"""The operators as queries over the star-schema tables, each with SQL of the same result.

Updates come from ``lineitem`` (supplier -> part, deletes where a line was returned),
the shortest-path graph from consecutive ``events`` of two users, measurement
records from ``events``, snapshots from two years of ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork import functions as fn
from skeinwork import storage
from skeinwork.operators import compare, gas, generate, levels, records, status, updates
from skeinwork.sources import files, ranges, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- relations derived from the tables ------------------------------------------

CUTOFF = "1998-01-01"
OPS = "ops AS (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS typ FROM lineitem)"
STATIC = f"stat AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}')"
LAST = "lastop AS (SELECT src, dst, arg_max(typ, seq) AS typ FROM ops GROUP BY src, dst)"
FINAL = "final AS (SELECT src, dst FROM lastop WHERE typ = 1 UNION SELECT src, dst FROM stat WHERE (src, dst) NOT IN (SELECT (src, dst) FROM lastop))"
TRANS = "tr AS (SELECT a.user_id AS src, b.user_id AS dst, 1 + a.event_id % 7 AS weight FROM events a JOIN events b ON b.event_id = a.event_id + 1)"


def ops(spark: SparkSession, d: str) -> DataFrame:
    typ = F.when(F.col("l_returnflag") == "R", 0).otherwise(1).cast("tinyint")
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), typ.alias("typ"))


def static(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit(CUTOFF).cast("timestamp")).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def transitions(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    a = e.select("event_id", F.col("user_id").alias("src"))
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    return a.join(b, "event_id").select("src", "dst", (1 + F.col("event_id") % 7).alias("weight"))


STORE = levels.Store(batch=4096, partition_size=128)
BATCH_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag"]
SIGNED = "l_suppkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS weight, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS diff"
BATCHED = f"batched AS (SELECT {SIGNED}, CAST(floor((row_number() OVER (ORDER BY {', '.join(BATCH_ORDER)}) - 1) / {STORE.batch}) AS BIGINT) + 1 AS batch FROM lineitem)"


def signed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    diff = F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long")
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"), diff.alias("diff"), *more)


def batched(spark: SparkSession, d: str) -> DataFrame:
    return levels.in_batches(signed(spark, d, *BATCH_ORDER), BATCH_ORDER, STORE).select("src", "dst", "weight", "diff", "batch")


SYSTEMS = ("view", "click", "purchase")
RUNS = """runs AS (SELECT 'case' || CAST(user_id % 10 AS VARCHAR) AS case_id, event_type AS system, event_id % 10 = 0 AS warmup,
  CAST(json_extract(props, '$.k') AS BIGINT) >= 3 AS correct, value AS ms, user_id, event_id FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select(F.concat(F.lit("case"), F.col("user_id") % 10).alias("case_id"), F.col("event_type").alias("system"), (F.col("event_id") % 10 == 0).alias("warmup"), (k >= 3).alias("correct"), F.col("value").alias("ms"), "user_id", "event_id")


# -- generators --------------------------------------------------------------------

V, U = 5000, 12_000


@query(f"SELECT i AS src, (i + 1) % {V} AS dst FROM range({V}) r(i)")
def gen_ring_edges(spark, d):
    return generate.ring(spark, V)


@query(f"SELECT i AS src, i + 1 AS dst FROM range({V} - 1) r(i)")
def gen_chain_edges(spark, d):
    return generate.chain(spark, V)


@query(f"""WITH a AS (SELECT i AS seq, i % {V} AS src, (i % {V} + 2 + i // {V}) % {V} AS d0 FROM range({U}) r(i)),
b AS (SELECT seq, src, CASE WHEN d0 = src THEN (d0 + 1) % {V} ELSE d0 END AS d1 FROM a)
SELECT seq, src, CASE WHEN d1 = (src + 1) % {V} THEN (d1 + 1) % {V} ELSE d1 END AS dst, CAST(1 AS TINYINT) AS typ FROM b""")
def gen_spread_updates(spark, d):
    return generate.spread(spark, V, U)


@query(f"SELECT i AS seq, CAST(7 AS BIGINT) AS src, i + 2 AS dst, CAST(1 AS TINYINT) AS typ FROM range({V} - 2) r(i)")
def gen_hot_source_updates(spark, d):
    return generate.hot_source(spark, V, U, 7)


@query(f"SELECT i AS seq, 1 + i % ({V} - 2) AS src, CAST({V} - 1 AS BIGINT) AS dst, CAST(1 AS TINYINT) AS typ FROM range({U}) r(i) WHERE 1 + i % ({V} - 2) <> {V} - 1")
def gen_hot_dest_updates(spark, d):
    return generate.hot_dest(spark, V, U)


@query(f"SELECT i AS seq, (2 * i) % {V} AS src, ((2 * i) % {V} + 1) % {V} AS dst, CAST(0 AS TINYINT) AS typ FROM range({V}) r(i)")
def gen_delete_even_updates(spark, d):
    return generate.delete_even(spark, V, U)


# -- updates -------------------------------------------------------------------------


@query(f"WITH {OPS}, {STATIC}, {LAST}, {FINAL} SELECT src, dst FROM final")
def update_replay(spark, d):
    return updates.replay(static(spark, d), ops(spark, d))


@query(f"""WITH {OPS}, {STATIC}, s AS (SELECT o.*, lag(typ) OVER (PARTITION BY src, dst ORDER BY seq) AS p, t.src IS NOT NULL AS there
  FROM ops o LEFT JOIN stat t USING (src, dst)), w AS (SELECT typ, coalesce(p = 1, there) AS was FROM s)
SELECT count(*) FILTER (typ = 1 AND was) AS n_insert_noop, count(*) FILTER (typ = 0 AND NOT was) AS n_delete_noop, count(*) FILTER ((typ = 1) <> was) AS n_effective FROM w""")
def update_noop_stats(spark, d):
    return updates.no_ops(static(spark, d), ops(spark, d))


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def edge_dedup(spark, d):
    return updates.dedup(ops(spark, d))


@query(f"WITH {OPS}, {STATIC}, {LAST}, {FINAL} SELECT src, dst, CAST(3 AS BIGINT) AS weight FROM final")
def attach_weight(spark, d):
    return updates.with_weight(update_replay(spark, d), 3)


@query(f"""WITH {OPS}, {STATIC}, {LAST}, {FINAL} SELECT src, dst, 'missing' AS side FROM (SELECT * FROM stat EXCEPT SELECT * FROM final)
UNION ALL SELECT src, dst, 'unexpected' FROM (SELECT * FROM final EXCEPT SELECT * FROM stat)""")
def edge_set_diff(spark, d):
    return updates.set_diff(static(spark, d), update_replay(spark, d))


@query(f"WITH {OPS}, {STATIC}, {LAST}, {FINAL} SELECT (SELECT count(*) FROM stat) AS static_edges, (SELECT count(*) FROM ops) AS update_edges, (SELECT count(*) FROM final) AS final_edges")
def update_counts(spark, d):
    return updates.counts(static(spark, d), ops(spark, d))


@query(f"WITH {OPS}, {STATIC} SELECT src, dst FROM stat WHERE (src, dst) NOT IN (SELECT (src, dst) FROM ops WHERE typ = 0)")
def untouched_edges(spark, d):
    return updates.untouched(static(spark, d), ops(spark, d).where("typ = 0"))


@query(f"WITH {OPS}, {STATIC} SELECT src, dst FROM stat UNION SELECT src, dst FROM ops WHERE typ = 1")
def edge_union(spark, d):
    return updates.union(static(spark, d), ops(spark, d).where("typ = 1"))


@query(f"WITH {OPS}, {STATIC} SELECT src, dst FROM stat EXCEPT SELECT src, dst FROM ops WHERE typ = 0")
def edge_except(spark, d):
    return updates.minus(static(spark, d), ops(spark, d).where("typ = 0"))


@query(f"WITH {OPS}, {STATIC} SELECT src, dst FROM stat INTERSECT SELECT src, dst FROM ops WHERE typ = 0")
def edge_intersect(spark, d):
    return updates.intersect(static(spark, d), ops(spark, d).where("typ = 0"))


@query(f"WITH {OPS}, {STATIC}, {LAST}, {FINAL} SELECT src, dst FROM final ORDER BY src, dst")
def sorted_edges(spark, d):
    return update_replay(spark, d).orderBy("src", "dst")


# -- levelled store -------------------------------------------------------------------


@query(f"WITH e AS (SELECT {SIGNED} FROM lineitem) SELECT src, dst, min(weight) AS weight, CAST(sum(diff) AS BIGINT) AS diff FROM e GROUP BY src, dst HAVING sum(diff) <> 0")
def diff_coalesce(spark, d):
    return levels.coalesce(signed(spark, d))


@query("SELECT CAST(i AS INTEGER) AS level, CAST(131072 * pow(2, i) AS BIGINT) AS total_capacity, CAST(CASE WHEN i = 0 THEN 131072 ELSE ceil(131072 * pow(2, i) / 16) END AS BIGINT) AS partition_capacity FROM range(11) r(i)")
def level_capacity_table(spark, d):
    return levels.capacities(spark)


@query("""WITH h AS (SELECT CASE WHEN floor(l_partkey / 128) BETWEEN 0 AND 15 THEN CAST(floor(l_partkey / 128) AS INTEGER) ELSE -1 END AS part FROM lineitem)
SELECT part, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT part, count(*) AS n FROM h GROUP BY part UNION ALL SELECT CAST(i AS INTEGER), 0 FROM range(16) r(i)) GROUP BY part""")
def dst_partition_histogram(spark, d):
    return levels.histogram(ops(spark, d), STORE)


def _carry_sql(most: int = 10) -> str:
    """Carries level by level, as CTEs: c{t} holds those of level t."""
    coal = "SELECT batch, src, dst, min(weight) AS weight, CAST(sum(diff) AS BIGINT) AS diff FROM ({}) GROUP BY batch, src, dst HAVING sum(diff) <> 0"
    ctes = [BATCHED, f"own AS ({coal.format('SELECT * FROM batched')})", "b AS (SELECT max(batch) AS n FROM batched)"]
    for lv in range(most):
        unit = 1 << lv
        parts = [f"SELECT batch, src, dst, weight, diff FROM own WHERE batch % {2 * unit} = {unit}"]
        parts += [f"SELECT batch + {1 << j}, src, dst, weight, diff FROM c{j} WHERE (batch + {1 << j}) % {2 * unit} = {unit} AND batch + {1 << j} <= (SELECT n FROM b)" for j in range(lv)]
        ctes.append(f"c{lv} AS ({coal.format(' UNION ALL '.join(parts))})")
    rows = " UNION ALL ".join(f"SELECT {lv} AS level, src, dst, weight, diff FROM c{lv}, b WHERE (n >> {lv}) % 2 = 1 AND batch = (n >> {lv}) << {lv}" for lv in range(most))
    return f"WITH {', '.join(ctes)} {rows}"


@query(_carry_sql())
def level_carry_state(spark, d):
    return levels.state(batched(spark, d), STORE)


@query(f"""WITH {BATCHED}, bs AS (SELECT DISTINCT batch AS carry, CAST(log2(batch & -batch) AS INTEGER) AS level FROM batched),
w AS (SELECT carry, level, src, dst, sum(diff) AS diff FROM bs JOIN batched ON batch > carry - CAST(pow(2, level) AS BIGINT) AND batch <= carry GROUP BY ALL HAVING sum(diff) <> 0),
u AS (SELECT carry, level, CAST(floor(dst / {STORE.partition_size}) AS INTEGER) AS part, count(*) AS edges FROM w GROUP BY ALL),
c AS (SELECT *, CASE WHEN level = 0 THEN {STORE.batch} ELSE CAST(ceil({STORE.batch} * pow(2, level) / 16) AS BIGINT) END AS cap FROM u),
bad AS (SELECT carry, level, part, edges, cap FROM c WHERE part < 16 AND edges > cap UNION ALL SELECT carry, min(level), 99, NULL, NULL FROM c WHERE part > 15 GROUP BY carry),
f AS (SELECT * FROM bad ORDER BY carry, part DESC LIMIT 1), f2 AS (SELECT * FROM bad WHERE carry = (SELECT carry FROM f) ORDER BY part = 99 DESC, part LIMIT 1),
n AS (SELECT count(*) AS raw, max(batch) AS b FROM batched),
m AS (SELECT coalesce(max(edges), 0) AS most FROM u WHERE part < 16 AND carry <= coalesce((SELECT carry - CAST(part = 99 AS BIGINT) FROM f2), 1 << 40))
SELECT CASE WHEN f2.carry IS NULL THEN 'FITS' WHEN f2.part = 99 THEN 'INVALID_INPUT' ELSE 'UNSUPPORTED_CAPACITY' END AS status, raw AS raw_edges, b AS batches, most AS max_partition_edges,
  coalesce(f2.carry, 0) AS first_failure_batch, CAST(coalesce(f2.level, -1) AS BIGINT) AS failure_level, CAST(CASE WHEN f2.part = 99 THEN -1 ELSE coalesce(f2.part, -1) END AS BIGINT) AS failure_partition,
  coalesce(f2.edges, 0) AS failure_partition_edges, CAST(coalesce(f2.cap, 0) AS BIGINT) AS failure_partition_capacity,
  CASE WHEN f2.carry IS NULL THEN '' WHEN f2.part = 99 THEN 'dst_outside_partition_range' ELSE 'level_partition_capacity' END AS failure_reason
FROM n LEFT JOIN f2 ON true, m""")
def capacity_classify(spark, d):
    r = levels.classify(batched(spark, d), STORE)
    keep = ["status", "raw_edges", "batches", "max_partition_edges", "first_failure_batch", "failure_level", "failure_partition", "failure_partition_edges", "failure_partition_capacity", "failure_reason"]
    return spark.createDataFrame([tuple(r[k] for k in keep)], ", ".join(f"{k} {'string' if k in ('status', 'failure_reason') else 'long'}" for k in keep))


# -- graph compute ------------------------------------------------------------------------


def _sssp_sql(k: int, weight: str = "weight", last: str = "distance") -> str:
    ctes = [TRANS, "d0 AS (SELECT CAST(0 AS BIGINT) AS vertex, CAST(0 AS BIGINT) AS distance)"]
    for i in range(k):
        ctes.append(f"d{i + 1} AS (SELECT vertex, min(distance) AS distance FROM (SELECT * FROM d{i} UNION ALL SELECT t.dst, d.distance + {weight} FROM d{i} d JOIN tr t ON t.src = d.vertex) GROUP BY vertex)")
    return f"WITH {', '.join(ctes)} SELECT vertex, CAST(distance AS BIGINT) AS {last} FROM d{k}"


@query(_sssp_sql(1))
def sssp_bounded_k1(spark, d):
    return gas.sssp(transitions(spark, d), 0, 1)


@query(_sssp_sql(2))
def sssp_bounded_k2(spark, d):
    return gas.sssp(transitions(spark, d), 0, 2)


@query(_sssp_sql(12))
def sssp_converged(spark, d):
    return gas.sssp(transitions(spark, d), 0)


@query(_sssp_sql(4, "1", "level"))
def bfs_levels(spark, d):
    return gas.bfs(transitions(spark, d), 0, 4)


def _pagerank_sql(n: int) -> str:
    ctes = [TRANS, "v AS (SELECT src AS vertex FROM tr UNION SELECT dst FROM tr)", "c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)", "g AS (SELECT src, count(*) AS degree FROM tr GROUP BY src)", "r0 AS (SELECT vertex, 1.0 / n AS rank FROM v, c)"]
    for i in range(n):
        ctes.append(f"""r{i + 1} AS (SELECT v.vertex, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM v CROSS JOIN c
          CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE vertex NOT IN (SELECT src FROM g))
          LEFT JOIN (SELECT dst AS vertex, sum(rank / degree) AS got FROM tr JOIN r{i} ON r{i}.vertex = tr.src JOIN g USING (src) GROUP BY dst) USING (vertex))""")
    return f"WITH {', '.join(ctes)} SELECT vertex, round(rank, 9) AS rank FROM r{n}"


@query(_pagerank_sql(5))
def pagerank_fixed_iters(spark, d):
    return gas.pagerank(transitions(spark, d), 5).select("vertex", F.round("rank", 9).alias("rank"))


def same_brand_links(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst"), "p_brand")
    b = p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("p_brand"))
    return a.join(b, ["dst", "p_brand"]).select("src", "dst")


@query("""WITH RECURSIVE e AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size AND a.p_brand = b.p_brand),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS vertex, src AS root FROM u UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.vertex)
SELECT vertex, min(root) AS component FROM r GROUP BY vertex""")
def connected_components(spark, d):
    return gas.components(same_brand_links(spark, d))


@query(f"""WITH a AS ({_sssp_sql(1)}), b AS ({_sssp_sql(2)}) SELECT count(*) FILTER (a.distance IS DISTINCT FROM b.distance) AS mismatch_count FROM a FULL JOIN b ON a.vertex = b.vertex""")
def distance_mismatch_count(spark, d):
    return gas.mismatches(sssp_bounded_k1(spark, d), sssp_bounded_k2(spark, d))


@query(f"""WITH a AS ({_sssp_sql(1)}), {TRANS}, d AS (SELECT vertex, distance + CAST(vertex % 10 = 3 AS BIGINT) AS distance FROM a),
o AS (SELECT t.dst AS vertex, min(d.distance + t.weight) AS offer FROM d JOIN tr t ON t.src = d.vertex GROUP BY t.dst)
SELECT 1 - count(*) FILTER (vertex = 0 AND distance = 0) AS wrong_source, count(*) FILTER (offer IS NOT NULL AND (distance IS NULL OR offer < distance)) AS relaxable,
  count(*) FILTER (distance IS NOT NULL AND vertex <> 0 AND coalesce(offer > distance, true)) AS unsupported, CAST(0 AS BIGINT) AS repeated, (SELECT count(*) FILTER (weight <= 0) FROM tr) AS weights
FROM d FULL JOIN o USING (vertex)""")
def distance_certificate(spark, d):
    early = sssp_bounded_k1(spark, d)
    wrong = early.select("vertex", (F.col("distance") + (F.col("vertex") % 10 == 3).cast("long")).alias("distance"))
    return gas.certificate(transitions(spark, d), wrong, 0)


# -- pairs and snapshots ---------------------------------------------------------------------

CHAIN = """chain AS (SELECT 'n' || c_nationkey AS "case", CASE WHEN count(*) % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS vertices, count(*) * 2 AS final_edges,
  CAST(count(*) AS DOUBLE) AS update_ms, CAST(CASE WHEN sum(CAST(floor(c_acctbal) AS BIGINT)) % 5 <> 0 THEN sum(CAST(floor(c_acctbal) AS BIGINT)) END AS DOUBLE) AS compute_e2e_ms FROM customer GROUP BY c_nationkey)"""
LEVEL = """lev AS (SELECT 'n' || s_nationkey AS "case", CASE WHEN count(*) % 2 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS vertices, count(*) * 3 AS input_edges,
  CAST(count(*) - 3 AS DOUBLE) AS kernel_e2e_ms, CAST(count(*) AS DOUBLE) AS maint_ms, CAST(sum(s_suppkey) AS DOUBLE) AS conv_ms FROM supplier GROUP BY s_nationkey)"""


def chain_cases(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.count(F.lit(1)), F.sum(F.floor("c_acctbal"))
    return t(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("case")).agg(F.when(n % 3 == 0, "FAIL").otherwise("PASS").alias("status"), n.alias("vertices"), (n * 2).alias("final_edges"), n.cast("double").alias("update_ms"), F.when(s % 5 != 0, s).cast("double").alias("compute_e2e_ms"))


def level_cases(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    return t(spark, d, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("case")).agg(F.when(n % 2 == 0, "FAIL").otherwise("PASS").alias("status"), n.alias("vertices"), (n * 3).alias("input_edges"), (n - 3).cast("double").alias("kernel_e2e_ms"), n.cast("double").alias("maint_ms"), F.sum("s_suppkey").cast("double").alias("conv_ms"))


PAIRED = """SELECT p.label, p.chain_case, p.level_case, coalesce(c.status, '') AS chain_status, coalesce(l.status, '') AS level_status, coalesce(CAST(c.vertices AS VARCHAR), '') AS chain_vertices,
  coalesce(CAST(c.final_edges AS VARCHAR), '') AS chain_final_edges, coalesce(CAST(l.vertices AS VARCHAR), '') AS level_vertices, coalesce(CAST(l.input_edges AS VARCHAR), '') AS level_input_edges,
  c.update_ms + c.compute_e2e_ms AS chain_total_ms, c.update_ms, c.compute_e2e_ms, l.kernel_e2e_ms AS level_kernel_ms, l.maint_ms + l.conv_ms AS level_maint_conv_ms,
  CASE WHEN l.kernel_e2e_ms <> 0 THEN (c.update_ms + c.compute_e2e_ms) / l.kernel_e2e_ms END AS chain_over_level_kernel,
  CASE WHEN l.maint_ms + l.conv_ms <> 0 THEN (c.update_ms + c.compute_e2e_ms) / (l.maint_ms + l.conv_ms) END AS chain_over_level_maint_conv,
  concat_ws('; ', CASE WHEN c."case" IS NULL THEN 'missing chain case' END, CASE WHEN l."case" IS NULL THEN 'missing level case' END,
    CASE WHEN coalesce(c.status, '') <> 'PASS' THEN 'chain not PASS' END, CASE WHEN coalesce(l.status, '') <> 'PASS' THEN 'level not PASS' END) AS notes
FROM pairs p LEFT JOIN chain c ON c."case" = p.chain_case LEFT JOIN lev l ON l."case" = p.level_case"""
COMMON = """pairs AS (SELECT "case" AS chain_case, "case" AS level_case, "case" AS label FROM (SELECT "case" FROM chain INTERSECT SELECT "case" FROM lev))"""
EXPLICIT = "pairs AS (SELECT 'n' || n_nationkey AS chain_case, 'n' || (n_nationkey + 3) AS level_case, n_name AS label FROM nation)"


def explicit_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return t(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("chain_case"), F.concat(F.lit("n"), k + 3).alias("level_case"), F.col("n_name").alias("label"))


@query(f"WITH {CHAIN}, {LEVEL}, {COMMON} {PAIRED}")
def pair_join_common(spark, d):
    c, s = chain_cases(spark, d), level_cases(spark, d)
    return compare.paired(compare.common_pairs(c, s), c, s)


@query(f"WITH {CHAIN}, {LEVEL}, {EXPLICIT} {PAIRED}")
def pair_join_explicit(spark, d):
    return compare.paired(explicit_pairs(spark, d), chain_cases(spark, d), level_cases(spark, d))


@query(f"WITH {CHAIN}, {LEVEL}, {EXPLICIT}, x AS ({PAIRED}) SELECT notes, count(*) AS pairs FROM x GROUP BY notes")
def pair_notes(spark, d):
    return pair_join_explicit(spark, d).groupBy("notes").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT o_orderkey, o_totalprice + o_custkey AS total_ms FROM orders")
def derived_totals(spark, d):
    return t(spark, d, "orders").select("o_orderkey", compare.total_ms(F.col("o_totalprice"), F.col("o_custkey")).alias("total_ms"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem")
def safe_ratio(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def first_per_key(spark, d):
    rows = compare.first_per_key(t(spark, d, "lineitem"), ["l_suppkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def priority_pick(spark, d):
    prio = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return compare.first_per_key(t(spark, d, "orders"), ["o_custkey"], [prio, F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def snapshot(spark: SparkSession, d: str, year: int) -> DataFrame:
    rows = t(spark, d, "lineitem").where(F.year("l_shipdate") == year)
    return rows.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max("l_linestatus").alias("mark"))


def _snap_sql(values: tuple[str, ...], text: bool) -> str:
    snap = "(SELECT CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag AS flag, CAST(count(*) AS VARCHAR) AS lines, CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS VARCHAR) AS quantity, max(l_linestatus) AS mark FROM lineitem WHERE year(l_shipdate) = {} GROUP BY ALL)"
    num = lambda v: f"try_cast(a.{v} AS DOUBLE) - try_cast(b.{v} AS DOUBLE)"
    out, changed = [], []
    for v in values:
        bv, av = f"coalesce(b.{v}, '')", f"coalesce(a.{v}, '')"
        if text:
            changed.append(f"{bv} <> {av}")
            delta = f"CASE WHEN b.supplier IS NOT NULL AND a.supplier IS NOT NULL AND ({' OR '.join(changed)}) THEN {bv} || ' -> ' || {av} ELSE '' END"
        else:
            changed.append(f"coalesce({num(v)} <> 0, false)")
            delta = f"coalesce(CAST(CAST({num(v)} AS BIGINT) AS VARCHAR), '')"
        out += [f"{bv} AS before_{v}", f"{av} AS after_{v}", f"{delta} AS delta_{v}"]
    state = f"CASE WHEN b.supplier IS NULL THEN 'added' WHEN a.supplier IS NULL THEN 'removed' WHEN {' OR '.join(changed)} THEN 'changed' ELSE 'unchanged' END"
    return f"SELECT 'supplier' AS row_type, {state} AS state, coalesce(b.supplier, a.supplier) AS supplier, coalesce(b.flag, a.flag) AS flag, {', '.join(out)} FROM {snap.format(1996)} b FULL JOIN {snap.format(1997)} a ON a.supplier = b.supplier AND a.flag = b.flag"


@query(_snap_sql(("lines", "quantity"), False))
def snapshot_diff_numeric(spark, d):
    return compare.snapshot_diff(snapshot(spark, d, 1996), snapshot(spark, d, 1997), ["supplier", "flag"], ["lines", "quantity"], "supplier")


@query(_snap_sql(("mark", "lines"), True))
def snapshot_diff_text(spark, d):
    return compare.snapshot_diff(snapshot(spark, d, 1996), snapshot(spark, d, 1997), ["supplier", "flag"], ["mark", "lines"], "supplier", text=True)


@query(f"SELECT * FROM ({_snap_sql(('lines', 'quantity'), False)}) WHERE state = 'changed' ORDER BY supplier, flag LIMIT 20")
def topk_changes(spark, d):
    return compare.top_changes(snapshot_diff_numeric(spark, d), ["supplier", "flag"], 20)


# -- records -----------------------------------------------------------------------------------

#: Interpolated percentiles differ in the last bit between engines, so both sides round.
STATS = "count(x) AS count, min(x) AS minimum, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, max(x) AS maximum"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})



@query(f"SELECT event_type, {STATS.replace('(x', '(value')} FROM events GROUP BY event_type")
def metric_stats(spark, d):
    return rounded(records.stats(t(spark, d, "events"), ["event_type"], "value"), "p10", "median", "p90")


@query(f"""WITH {RUNS}, l AS (SELECT case_id, system, unnest(['ms', 'user_ms']) AS metric, unnest([ms, CAST(user_id AS DOUBLE)]) AS x FROM runs WHERE NOT warmup AND correct)
SELECT case_id, system, metric, {STATS} FROM l GROUP BY ALL""")
def metric_stats_unpivot(spark, d):
    return rounded(records.metric_stats(runs(spark, d).withColumn("user_ms", F.col("user_id").cast("double")), ["ms", "user_ms"]), "p10", "median", "p90")


@query(f"WITH {RUNS} SELECT case_id, system, count(*) AS runs_total, count(*) FILTER (warmup) AS warmups, count(*) FILTER (NOT warmup) AS measured_runs, count(*) FILTER (NOT warmup AND correct) AS correct_runs FROM runs GROUP BY ALL")
def run_counts(spark, d):
    return records.run_counts(runs(spark, d))


@query(f"""WITH {RUNS}, g AS (SELECT case_id, unnest(['view', 'click', 'purchase', 'absent']) AS system, unnest([0, 1, 2, 3]) AS ord FROM (SELECT DISTINCT case_id FROM runs))
SELECT g.case_id, g.system, CAST(g.ord AS INTEGER) AS ord, count(r.case_id) AS runs FROM g LEFT JOIN runs r USING (case_id, system) GROUP BY ALL""")
def case_system_grid(spark, d):
    r = runs(spark, d)
    counts = r.groupBy("case_id", "system").agg(F.count(F.lit(1)).alias("runs"))
    return records.grid(r, (*SYSTEMS, "absent")).join(counts, ["case_id", "system"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)).cast("long"))


@query(f"""WITH {RUNS}, h AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'h' || (user_id // 50) END AS hash FROM runs)
SELECT user_id, CASE WHEN count(hash) FILTER (NOT warmup) > 0 THEN count(DISTINCT coalesce('=' || hash, '')) FILTER (NOT warmup) = 1 END AS one_identity FROM h GROUP BY user_id""")
def artifact_identity(spark, d):
    h = runs(spark, d).withColumn("host_sha256", F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("h"), F.floor(F.col("user_id") / 50))))
    return h.groupBy("user_id").agg(records.one_identity("host_sha256", ~F.col("warmup")).alias("one_identity"))


def full_records(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).withColumnRenamed("ms", records.METRICS[0])
    wrong = F.col("case_id") == "case3"
    return r.select(
        "*", F.when(wrong & (F.col("system") == "click"), "other").otherwise(F.col("case_id")).alias("graph_sha256"), F.lit(0).cast("long").alias("source"), (F.col("case_id") != "case5").alias("performance_claim_eligible"), F.lit(None).cast("boolean").alias("performance_valid"),
        (F.col("case_id") == "case7").alias("integration_dirty"), F.lit(None).cast("map<string, struct<commit: string, tracked_dirty: boolean>>").alias("source_states"), F.when(F.col("system") == "view", F.concat(F.lit("v"), F.col("user_id") % 20)).otherwise("same").alias("host_sha256"),
    )


def groups(spark: SparkSession, d: str) -> DataFrame:
    r = full_records(spark, d)
    selection = r.select("case_id").distinct().select("case_id", F.col("case_id").alias("expected_sha256"), F.lit(0).cast("long").alias("expected_source"))
    return records.summarize(r, selection, (*SYSTEMS, "absent"), minimum=120)


@query(f"""WITH {RUNS}, g AS (SELECT case_id, unnest(['view', 'click', 'purchase', 'absent']) AS system FROM (SELECT DISTINCT case_id FROM runs)),
a AS (SELECT case_id, system, count(*) FILTER (NOT warmup) AS m, count(*) FILTER (NOT warmup AND correct) AS c,
  count(DISTINCT CASE WHEN system = 'view' THEN 'v' || (user_id % 20) ELSE 'same' END) FILTER (NOT warmup) AS ids FROM runs GROUP BY ALL),
b AS (SELECT g.case_id, g.system, coalesce(m, 0) AS m, coalesce(c, 0) AS c, coalesce(ids, 0) AS ids FROM g LEFT JOIN a USING (case_id, system))
SELECT case_id, system, concat_ws('; ', CASE WHEN m < 120 THEN 'measured_runs=' || m || '<120' END, CASE WHEN c <> m THEN 'correct_runs=' || c || '/' || m END,
  CASE WHEN case_id = 'case3' AND system = 'click' THEN 'input_identity_mismatch' END, CASE WHEN m = 0 OR case_id = 'case5' THEN 'performance_claim_not_eligible' END,
  CASE WHEN m = 0 OR case_id = 'case7' THEN 'source_provenance_missing_or_dirty' END, CASE WHEN ids <> 1 THEN 'artifact_pair_not_unique' END,
  CASE WHEN c = 0 OR c <> m THEN 'comparable_resident_batch_end_to_end_missing' END) AS blockers FROM b""")
def claim_blockers(spark, d):
    return groups(spark, d).select("case_id", "system", F.concat_ws("; ", "blockers").alias("blockers"))


@query(f"""WITH {RUNS}, s AS (SELECT case_id, system, count(*) AS n, quantile_cont(ms, 0.5) AS median, CASE system WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS ord
  FROM runs WHERE NOT warmup AND correct AND system IN ('view', 'click', 'purchase') GROUP BY ALL)
SELECT case_id, bool_and(n >= 100) AS eligible, CASE WHEN bool_and(n >= 100) THEN arg_min(system, (median, ord)) END AS winner, CASE WHEN bool_and(n >= 100) THEN round(min(median), 6) END AS winner_median FROM s GROUP BY case_id""")
def rank_winner(spark, d):
    r = runs(spark, d).where(F.col("system").isin(*SYSTEMS))
    s = records.metric_stats(r, ["ms"]).join(records.grid(r, SYSTEMS), ["case_id", "system"])
    return records.rank(s.select("case_id", "system", "ord", F.col("median").alias("median_ms"), (F.col("count") >= 100).alias("claim_eligible"))).withColumn("winner_median", F.round("winner_median", 6))


@query(f"""WITH {RUNS}, s AS (SELECT case_id, system, quantile_cont(ms, 0.5) AS median, quantile_cont(ms, 0.9) AS p90, count(*) AS n FROM runs WHERE NOT warmup AND correct AND system IN ('view', 'click', 'purchase') GROUP BY ALL)
SELECT case_id, CAST(3 AS BIGINT) AS systems, round(max(median) FILTER (system = 'view'), 6) AS view_median, round(max(p90) FILTER (system = 'click'), 6) AS click_p90,
  max(n) FILTER (system = 'purchase') AS purchase_count, 'abc' AS input_sha256 FROM s GROUP BY case_id""")
def ranking_summary(spark, d):
    r = full_records(spark, d)
    selection = r.select("case_id").distinct().select("case_id", F.col("case_id").alias("expected_sha256"), F.lit(0).cast("long").alias("expected_source"))
    g = records.summarize(r, selection, SYSTEMS, minimum=120)
    inputs = spark.createDataFrame([("runs.jsonl", "abc")], "path string, sha256 string")
    texts = records.summary_json(g, records.rank(g), records.metric_stats(r, records.METRICS[:1]), inputs)
    at = lambda path: F.get_json_object("json", f"$.{path}")
    number = lambda system, what: at(f"groups.{system}.statistics.{records.METRICS[0]}.{what}")
    return texts.select(
        "case_id", F.size(F.json_object_keys(at("groups"))).cast("long").alias("systems"), F.round(number("view", "median").cast("double"), 6).alias("view_median"), F.round(number("click", "p90").cast("double"), 6).alias("click_p90"),
        number("purchase", "count").cast("long").alias("purchase_count"), F.get_json_object("json", "$.inputs['runs.jsonl']").alias("input_sha256"),
    )


# -- text ------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def sticky_section(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), "role")
    return reports.sticky(rows, F.when(F.col("role") == "user", F.col("line_no")), "section").select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "section")


@query("SELECT conv_id, arg_min(turn, (CASE WHEN contains(text, ' the ') THEN 0 ELSE 1 END, turn)) AS turn FROM conversations GROUP BY conv_id")
def first_final_line(spark, d):
    final = F.when(F.col("text").contains(" the "), 0).otherwise(1)
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("turn", F.struct(final, F.col("turn"))).alias("turn"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def regex_first_match(spark, d):
    return t(spark, d, "pages").select("page_id", fn.first_match(F.col("html"), "<title>([^<]*)</title>").alias("title"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey AS VARCHAR) AS vertices, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS errors, l_returnflag = 'R' AS failed FROM lineitem""")
def kv_token_parse(spark, d):
    mark = F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS")
    line = F.concat_ws(" ", F.lit("TAG_SMOKE"), mark, F.lit("vertices=0"), F.concat(F.lit("vertices="), "l_orderkey"), F.lit("noise"), F.concat(F.lit("errors="), F.col("l_quantity").cast("long")))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *(fn.token(F.col("line"), k).alias(k) for k in ("vertices", "errors")), F.col("line").contains(" FAIL ").alias("failed"))


@query("""SELECT l_returnflag, CASE WHEN l_linenumber = 7 AND l_quantity > 5 THEN 'DRY_RUN'
  WHEN l_linenumber = 6 THEN CASE WHEN (l_linenumber = 5 OR l_linestatus = 'F') AND l_quantity > 5 AND l_discount > 0.02 AND l_tax < 0.07 THEN 'PERF_ONLY' ELSE 'FAIL' END
  WHEN (l_linenumber = 5 OR l_linestatus = 'F') AND l_quantity > 5 AND l_discount > 0.02 AND l_tax < 0.07 AND l_quantity < 40 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS runs FROM lineitem GROUP BY ALL""")
def status_classify(spark, d):
    rows = t(spark, d, "lineitem")
    update = F.when(F.col("l_linestatus") == "F", f"x\n{status.UPDATE_OK}\n").otherwise("")
    compute = F.concat(F.when(F.col("l_discount") > 0.02, status.PROGRAM_OK).otherwise(""), F.lit(f"\n{status.SKIPPED}\n"), F.when(F.col("l_tax") >= 0.07, "error: mismatch on destination vertex 3\n").otherwise(""))
    converted = F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("long").cast("string")).otherwise("")
    processed = F.when(F.col("l_quantity") < 40, "1").otherwise("")
    n = F.col("l_linenumber")
    rows = rows.withColumns({"u": update, "c": compute})
    s = status.chain_status(F.col("u"), F.col("c"), converted, processed, F.regexp_count("c", F.lit(status.MISMATCH)), n == 7, n == 5, n == 6)
    return rows.select("l_returnflag", s.alias("status")).groupBy("l_returnflag", "status").agg(F.count(F.lit(1)).alias("runs"))


@query("SELECT user_id, (SELECT max(ts) FROM events) - max(ts) >= INTERVAL 6 HOUR AS idle FROM events GROUP BY user_id")
def idle_gap_flag(spark, d):
    e = t(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.join(F.broadcast(now), F.lit(True)).select("user_id", status.idle(F.col("last"), F.col("now"), 6 * 3600).alias("idle"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""WITH x AS (SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS DOUBLE) AS b, CAST(o_custkey AS DOUBLE) AS a FROM orders)
SELECT o_orderkey, CASE WHEN a - b = floor(a - b) THEN CAST(CAST(a - b AS BIGINT) AS VARCHAR) ELSE printf('%.3f', a - b) END AS delta FROM x""")
def format_delta(spark, d):
    before = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return t(spark, d, "orders").select("o_orderkey", fn.delta_text(before, F.col("o_custkey").cast("string")).alias("delta"))


# -- operators shown by one relation each ---------------------------------------------------


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1")
def last_row_per_key(spark, d):
    rows = t(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return compare.last_per_key(rows, ["l_suppkey", "l_partkey"], "at").select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity")


@query("SELECT CASE l_linestatus WHEN 'F' THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS rows FROM lineitem GROUP BY ALL")
def rows_by_state(spark, d):
    return compare.by_state(t(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "F", "changed").otherwise("unchanged").alias("state")))


@query("SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'sp' ELSE 'slr' END AS kind, l_suppkey AS cu, l_linestatus AS port, l_returnflag AS target FROM lineitem WHERE l_linenumber % 3 < 2")
def memory_bindings(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "sp").when(F.col("l_linenumber") % 3 == 1, "slr").otherwise("clock")
    return compare.bindings(t(spark, d, "lineitem").select(kind.alias("kind"), F.col("l_suppkey").alias("cu"), F.col("l_linestatus").alias("port"), F.col("l_returnflag").alias("target")))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_orderkey / (l_discount * 100) / 1000 END AS updates_per_us,
  CASE WHEN l_discount > 0 THEN l_partkey * l_linenumber / (l_discount * 100) / 1000 END AS mteps FROM lineitem""")
def throughput_rates(spark, d):
    ms = F.col("l_discount") * 100
    rates = updates.updates_per_microsecond(F.col("l_orderkey"), ms), gas.mteps(F.col("l_partkey"), F.col("l_linenumber"), ms)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rates[0].alias("updates_per_us"), rates[1].alias("mteps"))


@query("SELECT p_partkey, p_partkey AS from_hex, p_partkey AS from_decimal, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS DOUBLE) + 0.5 END AS number FROM part")
def parsed_ids(spark, d):
    rows = t(spark, d, "part")
    padded = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "))
    text = F.when(F.col("p_partkey") % 3 == 1, padded).when(F.col("p_partkey") % 3 == 2, F.trim(padded)).otherwise("n/a")
    return rows.select(
        "p_partkey", fn.parse_id(F.concat(F.lit("0x"), F.hex("p_partkey"))).alias("from_hex"), fn.parse_id(F.col("p_partkey").cast("string"), "10").alias("from_decimal"), fn.number(text).alias("number")
    )


@query(f"WITH {TRANS} SELECT u.user_id AS vertex, CASE WHEN u.user_id = 0 THEN 0 ELSE min(weight) END AS distance FROM (SELECT unnest(range(0, 200)) AS user_id) u LEFT JOIN tr ON tr.src = 0 AND tr.dst = u.user_id GROUP BY u.user_id")
def all_vertex_distances(spark, d):
    return gas.all_distances(gas.sssp(transitions(spark, d), 0, 1), 200)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey AS VARCHAR) AS vertices, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS errors, CAST(2 AS INTEGER) AS words FROM lineitem")
def kv_token_map(spark, d):
    line = F.concat_ws(" ", F.lit("TAG_SMOKE PASS vertices=0"), F.concat(F.lit("vertices="), "l_orderkey"), F.lit("noise"), F.concat(F.lit("errors="), F.col("l_quantity").cast("long")))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.tokens_to_map(line).alias("kv"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("kv")["vertices"].alias("vertices"), F.col("kv")["errors"].alias("errors"), F.size("kv").alias("words"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'TAG n=2 PASS' WHEN o_orderstatus = 'O' THEN 'TAG n=1 step' END AS line FROM orders""")
def result_lines(spark, d):
    log = F.when(F.col("o_orderstatus") == "F", "start\nTAG n=1 step\nTAG n=2 PASS\nTAG n=3 FAIL").when(F.col("o_orderstatus") == "O", " TAG n=0 PASS\nTAG n=1 step\nTAG n=2 step").otherwise("PASS\nnothing")
    return t(spark, d, "orders").select("o_orderkey", status.result_line(log, "TAG").alias("line"))


@query("""SELECT DISTINCT c_nationkey AS folder, c_mktsegment AS name FROM customer WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_acctbal > 9000)""")
def missing_artifacts(spark, d):
    each = t(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("name"), "c_acctbal")
    return files.missing(each.select("folder", "name").distinct(), each.where("c_acctbal > 9000"), ["folder", "name"])


@query("SELECT user_id AS folder, event_id AS path, ts AS mtime FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_file(spark, d):
    return files.newest(t(spark, d, "events").select(F.col("user_id").alias("folder"), F.col("event_id").alias("path"), F.col("ts").alias("mtime")), ["folder"])


@query("""WITH l AS (SELECT conv_id AS file, turn AS line_no, text AS value, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT file, line_no, value, 'head' AS part FROM l WHERE line_no <= 2 UNION ALL SELECT file, line_no, value, 'tail' FROM l WHERE line_no > last - 2""")
def head_and_tail(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.col("text").alias("value"))
    return files.head(rows, 2).withColumn("part", F.lit("head")).unionByName(files.tail(rows, 2).withColumn("part", F.lit("tail")))


# -- exchange files written from the tables, read back by byte ranges ----------------


def written(lines: DataFrame, name: str) -> str:
    """The folder of text files, one for each task, that the lines were written to."""
    path = storage.shared_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def exchange_result_edges(spark, d):
    edges = updates.dedup(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))
    return ranges.read(spark, written(edges.select(fn.hex_edge(F.col("src"), F.col("dst"))), "result"), "result").select("src", "dst")


@query("""SELECT l_suppkey AS src, l_partkey AS dst, CASE l_linenumber % 3 WHEN 0 THEN 1 ELSE l_orderkey END AS weight, CASE l_linenumber % 3 WHEN 2 THEN -l_linenumber ELSE 1 END AS diff FROM lineitem""")
def exchange_level_edges(spark, d):
    src, dst = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    literal = F.concat(F.lit("0x"), F.hex("l_orderkey"))
    line = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws(" ", src, dst))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("# an edge\n\n"), src, F.lit("\t"), dst, F.lit(" "), literal, F.lit(" # with weight")))
        .otherwise(F.concat_ws(" ", src, dst, "l_orderkey", -F.col("l_linenumber")))
    )
    return ranges.read(spark, written(t(spark, d, "lineitem").select(line), "edges"), "edges").select("src", "dst", "weight", "diff")


@query("""SELECT l_suppkey AS src, l_partkey AS dst, CASE l_linenumber % 3 WHEN 1 THEN l_orderkey % 65536 ELSE 1 END AS weight, CASE l_linenumber % 3 WHEN 1 THEN -l_linenumber ELSE 1 END AS diff
FROM lineitem WHERE l_linenumber % 5 > 0""")
def exchange_native_edges(spark, d):
    weight = F.when(F.col("l_linenumber") % 3 == 0, "n/a").when(F.col("l_linenumber") % 3 == 1, (F.col("l_orderkey") % 65536).cast("string"))
    diff = F.when(F.col("l_linenumber") % 3 < 2, (-F.col("l_linenumber")).cast("string"))
    line = F.concat_ws(" ", F.when(F.col("l_linenumber") % 5 == 0, "skipped"), "l_suppkey", "l_partkey", weight, diff)
    return ranges.read(spark, written(t(spark, d, "lineitem").select(line), "native"), "native").select("src", "dst", "weight", "diff")


@query("""WITH c AS (SELECT o_orderkey, o_custkey + 1 AS graph, o_custkey + o_orderkey % 4 AS processed FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN processed - graph END AS padded_edges,
  CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' WHEN processed < graph THEN 'SHORT' WHEN processed = graph THEN 'EXACT' ELSE 'PADDED' END AS edge_check FROM c""")
def processed_edge_padding(spark, d):
    rows = t(spark, d, "orders").withColumn("processed", (F.col("o_custkey") + F.col("o_orderkey") % 4).cast("string"))
    # a log without its last line has no processed edges
    last = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("Processed edges: "), "processed", F.lit("; "))).otherwise("")
    log = F.concat(F.lit("e2e: 0.25 ms\n"), last, F.lit("Graph edges: "), (F.col("o_custkey") + 1).cast("string"))
    found = [fn.first_match(log, status.PATTERNS[k][1]) for k in ("processed_edges", "graph_edges")]
    more, check = status.padding(*found)
    return rows.select("o_orderkey", more.alias("padded_edges"), check.alias("edge_check"))


def category_side(spark: SparkSession, d: str, key: str, names: str, *columns: Column) -> DataFrame:
    """The lineitems dealt to the six published pairs by ``key``, under one side's case names."""
    pairs = compare.published(spark).select(F.col(names).alias("case"), F.row_number().over(Window.orderBy("label")).alias("k"))
    rows = t(spark, d, "lineitem").groupBy((F.col(key) % 6 + 1).cast("int").alias("k")).agg(*columns)
    return rows.join(F.broadcast(pairs), "k").drop("k").withColumn("status", F.lit("PASS"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY label) AS k FROM (VALUES ('small_chain_v64', 'small_high_diameter', 'small'), ('small_star_v4096_u1024', 'small_hot_source', 'small'), ('small_spread_v4096_u1024', 'small_spread_fanout', 'small'),
  ('small_hotdst_v4096_u1024', 'small_hot_destination', 'small'), ('medium_star_v65536_u8192', 'medium_hot_source', 'medium'), ('medium_spread_v65536_u16384', 'medium_spread_fanout', 'medium')) v(chain_case, label, size)),
c AS (SELECT l_suppkey % 6 + 1 AS k, CAST(sum(l_linenumber) AS DOUBLE) + max(l_orderkey) AS ms FROM lineitem GROUP BY 1),
l AS (SELECT l_partkey % 6 + 1 AS k, CAST(max(l_orderkey) AS DOUBLE) AS ms FROM lineitem GROUP BY 1)
SELECT size, count(*) AS pairs, min(c.ms / l.ms) AS least_ratio, max(c.ms / l.ms) AS greatest_ratio FROM p JOIN c USING (k) JOIN l USING (k) GROUP BY size""")
def published_pair_ratios(spark, d):
    chain = category_side(spark, d, "l_suppkey", "chain_case", F.sum("l_linenumber").alias("update_ms"), F.max("l_orderkey").alias("compute_e2e_ms"), F.lit(1).alias("vertices"), F.lit(1).alias("final_edges"))
    level = category_side(spark, d, "l_partkey", "level_case", F.max("l_orderkey").alias("kernel_e2e_ms"), F.lit(0).alias("maint_ms"), F.lit(0).alias("conv_ms"), F.lit(1).alias("vertices"), F.lit(1).alias("input_edges"))
    return compare.by_size(compare.paired(compare.published(spark), chain, level))
