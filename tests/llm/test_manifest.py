import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Levels of a tree, and each leaf's siblings."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for at in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            lo = at - at % 3
            proof += [x for i, x in enumerate(level[lo : lo + 3], lo) if i != at]
            at //= 3
        proofs.append(proof)
    return levels, proofs


def folded(leaf, at, leaves, proofs):
    """What replacing the leaf at ``at`` makes of the root, with the siblings of the original."""
    size = len(leaves)
    proof = list(proofs[at])
    while size > 1:
        lo = at - at % 3
        n = min(3, size - lo) - 1
        run, proof = proof[:n], proof[n:]
        run.insert(at - lo, leaf)
        leaf, at, size = h(*run), at // 3, -(-size // 3)
    return leaf


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    by = {}
    for i, t, lang, source, n in rows:
        by.setdefault(source, []).append((i, leaf_of(i, source, lang, n, t), leaf_of(i, source, lang, n, t and t.replace("\n", "")) if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else None))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in by[s]]) for s in sources}
    tops = [trees[s][0][-1][0] for s in sources]
    (*_, (root,)), more = tree(tops)
    out = []
    for k, s in enumerate(sources):
        leaves = [r[1] for r in by[s]]
        for at, (i, leaf, shown) in enumerate(by[s]):
            got = folded(folded(shown or leaf, at, leaves, trees[s][1]), k, tops, more)
            out.append((i, leaf, tops[k], root, h(*trees[s][1][at], *more[k]), got, got == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in merkle.manifest_of_documents(df).withColumn("proof_sha256", F.sha2("proof", 256)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_climb():
    """Any stretch of leaves gives the nodes that it covers whole, and its ragged nodes cover it once."""
    for total in (1, 2, 3, 4, 9, 10, 28, 100):
        leaves = [str(k) for k in range(total)]
        levels, _ = tree(leaves)
        for lo in range(0, total, 1 + total // 9):
            for hi in range(lo + 1, total + 1, 1 + total // 7):
                got = merkle.climb(lo, leaves[lo:hi], total)
                for level, (first, nodes, size) in enumerate(got):
                    assert size == len(levels[level]) and nodes == levels[level][first : first + len(nodes)]
                covered = sorted(x for level, i, _ in merkle.ragged(got) for x in range(i * 3**level, min((i + 1) * 3**level, total)))
                assert covered == list(range(lo, hi)), (total, lo, hi)


@pytest.fixture
def many_partitions(spark):
    """No partition is joined with the next one, and each has a part of the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("step", [1, 9])
def test_manifest(spark, many_partitions, step, monkeypatch):
    """Sizes around powers of three, one hot group, null and empty values; any number of levels finished by a shuffle."""
    r = random.Random(step)
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "ROWS", 7)
    rows = []
    for s, n in ((None, 3), ("", 1), ("a", 9), ("é", 10), ("z", 28), ("hot", 300), ("b", 2)):
        rows += [(r.randrange(10_000), r.choice([None, "", "a\nb", "é\n\n", "x" * 50, "plain"]), r.choice(["en", None]), s, r.choice([None, 5])) for _ in range(n)]
    rows.append((None, "no id\n", "en", "z", 1))
    rows += [rows[5]] * 4
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == brute(rows)
    leaves = df.select(F.coalesce("source", F.lit("none")).alias("grp"), "doc_id", F.sha2("text", 256).alias("leaf"))
    assert merkle.in_order(leaves, ["doc_id"]).where("grp = 'hot'").select("part").distinct().count() > 3


def test_odd_tables(spark, many_partitions):
    df = spark.createDataFrame([(4, "a\nb", "en", "s", 3)], SCHEMA)
    assert result(df) == brute([(4, "a\nb", "en", "s", 3)])
    assert result(df.limit(0)) == []
    clash = df
    for c in ("leaf", "grp", "key", "part", "at", "place", "proof", "top", "runs", "level", "path", "root", "presented"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert result(clash) == result(df)
    equal = [(7, "same\n", None, "s", None)] * 500
    assert result(spark.createDataFrame(equal, SCHEMA).repartition(4)) == brute(equal)


def test_other_proofs_fail(spark):
    """A proof holds for its own row only."""
    rows = [(k, f"text {k}", "en", f"s{k % 3}", 1) for k in range(40)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), "source", "doc_id", ["doc_id", "text"])
    assert merkle.verified(got).where("verified").count() == 40
    assert not merkle.verified(got.withColumn("presented", F.sha2("leaf", 256))).where("verified").count()
    assert not merkle.verified(got.withColumn("place", (F.col("place") + 1) % F.col("total"))).where("verified").count()


def test_documents_and_sql(spark):
    from skeinwork.llm import queries

    got = sorted(map(tuple, queries.op11_merkle(spark, SF).collect()), key=str)
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()
    assert got == brute(docs) and len(got) == 200
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(merkle.oracle()).fetchall(), key=str) == got
