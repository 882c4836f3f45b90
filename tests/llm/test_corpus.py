import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skeinwork.llm import components, language_id, quality_net, quality_rules, simhash, suffix_dedup, topk, toxicity
from skeinwork.llm.common import materialize, with_group

SF = "/root/testdata/sf0.001"


def docs(spark, texts, **more):
    rows = [(k, t, more.get("lang", "en")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


NASTY = ["", None, " \n\t ", "one", "\x0b\x0c", "é ü", "a " * 5000, "x" * 60_000, "same text", "same text"]


# -- quality rules -------------------------------------------------------------------


def rule_counts(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_features(spark):
    r = random.Random(3)
    texts = NASTY + [" ".join(r.choice("ab#") for _ in range(n)) + "\n" + "l\n" * (n % 4) for n in (7, 8, 9, 16, 40, 200)] + ["w%d " % k * 3 for k in range(3)]
    got = by_id(quality_rules.features(docs(spark, texts).withColumn("n_words", F.lit("clash"))))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for k, t in enumerate(texts):
        want = rule_counts(t)
        assert tuple(got[k][n] for n in names) == want, t
        assert got[k]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality_rules.features(docs(spark, texts).limit(0)).count() == 0


def binomial(n, k, p):
    from math import comb

    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_exact_binomial(spark):
    rows = [(n, k) for n in (1, 10, 400, 3000) for k in (0, 1, 3, 20) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long")
    for r in df.withColumn("p", quality_rules.at_most(F.col("n"), F.col("k"), 0.01)).collect():
        assert abs(r["p"] - (1.0 if r["k"] > 0.01 * r["n"] else binomial(r["n"], r["k"], 0.01))) < 1e-9


def test_risk_control_takes_bad_documents_and_bounds_the_loss(spark):
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"), F.when(F.col("id") % 5 == 0, 40).otherwise(F.col("id") % 2).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(False).alias("base_failed"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 5 != 0).cast("int").alias("quality"))
    chosen = quality_rules.cutoffs(rows, labels)
    assert [(r["rule"], r["cutoff"], r["lost"]) for r in chosen.collect()] == [("symbols", 300, 0)]
    got = quality_rules.judge(rows, chosen)
    assert got.where("kept").count() == 3200 and got.where("kept and n_symbols = 40").count() == 0
    # too few labels: nothing is certified, nothing is lost
    assert quality_rules.cutoffs(rows, labels.where("doc_id < 200")).count() == 0
    assert quality_rules.cutoffs(rows, labels.limit(0)).count() == 0


def test_rules_keep_columns(spark):
    d = docs(spark, NASTY + ["good words " + " ".join(f"w{k}" for k in range(40))]).withColumn("kept", F.lit("mine"))
    out = quality_rules.keep_good(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.columns == d.columns and [(r["doc_id"], r["kept"]) for r in out.collect()] == [(len(NASTY), "mine")]


# -- classifiers ------------------------------------------------------------------------


def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held_out_accuracy(got, truth, column):
    pairs = [(r[column], truth[k]) for k, r in got.items() if r["held_out"] and k in truth]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language_accuracy(spark):
    d, _ = real(spark)
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    assert held_out_accuracy(by_id(language_id.identify(d)), truth, "lang_pred") > 0.97


def test_language_edges(spark):
    texts = ["the cat and the dog " * 3] * 30 + ["", None, "123 !!", "日本", "the"]
    got = by_id(language_id.identify(docs(spark, texts).withColumn("score", F.lit("clash"))))
    assert [got[30 + k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "en", "en"] and got[0]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = by_id(language_id.identify(docs(spark, texts, lang=None)))
    assert {r["lang_pred"] for r in nothing.values()} == {"und"}
    many = {f"l{k:03}": [chr(0x4E00 + 50 * k + j) * 6 for j in range(40)] * 2 for k in range(70)}
    f = language_id.learn(many)
    for lang in ("l000", "l069"):
        raw = "".join(many[lang][:9]).encode()
        share, _ = f.hits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert f.languages[share.argmax()] == lang
    kept = language_id.keep_known(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 32


def test_quality_net(spark):
    d, labels = real(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert held_out_accuracy(by_id(quality_net.assess(d, labels)), truth, "predicted") > 0.95
    edge = by_id(quality_net.assess(docs(spark, NASTY).withColumn("held_out", F.lit("clash")), labels.limit(0)))
    assert all(r["score"] == 0.5 for r in edge.values()) and len(edge) == len(NASTY)


def test_net_gradient_and_tables():
    texts = ["abc def" * 40, "x", "zz" * 700, "GHI!! " * 30]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    net = quality_net.learn(texts * 3, [1, 0, 1, 0] * 3, epochs=1)
    assert np.allclose(net.scores(off, data), net.scores(off, data, net.tables()), atol=1e-5)
    alone = [net.scores(np.array([0, len(r)]), np.frombuffer(r, np.uint8))[0] for r in raw]
    assert np.allclose(alone, net.scores(off, data), atol=1e-6)
    y, weight = np.array([1, 0, 1, 0]), np.ones(4)
    net = quality_net.Net(net.bytes_.astype(float), net.bias.astype(float), net.out.astype(float))
    w = quality_net.Windows.of(off, data)
    g = quality_net.gradient(net, w, y, weight)

    def loss():
        p = net.scores(off, data)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for p, gp in zip((net.bytes_, net.bias, net.out), g):
        flat, gf = p.reshape(-1), np.asarray(gp).reshape(-1)
        for k in np.argsort(-np.abs(gf))[:5]:
            keep, h = flat[k], 1e-6
            flat[k] = keep + h
            up = loss()
            flat[k] = keep - h
            down = loss()
            flat[k] = keep
            assert abs((up - down) / (2 * h) - gf[k]) < 1e-3 * max(1, abs(gf[k]))


def test_toxicity(spark):
    r = random.Random(4)
    plain = [" ".join(f"w{r.randrange(300)}" for _ in range(80)) for _ in range(300)]
    texts = [t + (" vile nasty" if k % 6 == 0 else "") for k, t in enumerate(plain)]
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 6 == 0).cast("int").alias("toxic"))
    d = docs(spark, texts + NASTY)
    got = by_id(toxicity.assess(d.withColumn("predicted", F.lit("clash")), labels))
    assert held_out_accuracy(got, {k: int(k % 6 == 0) for k in range(300)}, "predicted") > 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[300]["predicted"] == got[301]["predicted"] == 0 and got[300]["score"] == got[301]["score"]
    none = by_id(toxicity.assess(d, labels.limit(0)))
    assert {x["score"] for x in none.values()} == {0.0}


def test_anchors_of_equal_strings_are_equal_in_every_slice():
    r = np.random.default_rng(11)
    passage = r.integers(97, 123, 700).astype(np.uint8)
    found = []
    for before, after in ((0, 0), (313, 5), (70_001, 200_000)):
        data = np.concatenate([r.integers(97, 123, before), passage, r.integers(97, 123, after)]).astype(np.uint8)
        a, first, last = suffix_dedup.anchors(np.array([0, len(data)]), data)
        each = {p: int(x) - p for x, lo, hi in zip(a, first, last, strict=True) for p in range(lo, hi + 1)}
        found.append([each[before + k] for k in range(len(passage) - suffix_dedup.LENGTH + 1)])
    assert found[0] == found[1] == found[2]
    h = suffix_dedup.gram_hashes(passage)
    assert found[0] == [int(np.argmin(h[k : k + suffix_dedup.LENGTH - suffix_dedup.GRAM + 1])) for k in range(len(found[0]))]


# -- search ---------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(5)
    vecs = [(int(k), [float(x) for x in r.normal(0, 0.3, 8)]) for k in range(400)]
    vecs[3:60] = [(k, [0.5] * 8) for k in range(3, 60)]
    odd = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [0.1] * 3), (1151, [0.2] * 3), (1200, []), (None, [0.1] * 8)]
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for row in topk.top_k(df, block=16).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["rank"], row["vec_id"], row["score"]))
    ints = {k: np.floor(256 * np.array(v, np.float32).astype(float)) for k, v in vecs + odd[3:6]}
    for q in [k for k in ints if k % 50 == 0]:
        scores = sorted((-int(ints[q] @ x), k) for k, x in ints.items() if k != q and len(x) == len(ints[q]))[:5]
        assert got[q] == [(n, k, -s) for n, (s, k) in enumerate(scores, 1)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_prunes_and_batches(spark):
    far = [(np.arange(4), np.full((4, 2), v, float), np.full(2, v, float), np.full(2, v, float)) for v in (9.0, 1.0, 2.0)]
    best = topk.Best(1, 2)
    assert topk.search_blocks(best, np.array([99]), np.array([[1.0, 1.0]]), far) == 2 and best.score.tolist() == [[18, 18]]
    rows = materialize(spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id"), F.lit(1).cast("long")).alias("ints")), "t")
    got = topk.search(topk.index(rows, 8), rows.where("vec_id % 10 = 0"), 3, batch=2)
    assert got.count() == 12 and got.where("query_id = 30 and rank = 1").first()["vec_id"] == 39


# -- near duplicates ----------------------------------------------------------------------------


def slow_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = docs(spark, NASTY).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    both = d.union(extra).withColumn("fp", F.lit("clash"))
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    fps = {k: slow_fingerprint(t) for k, t in texts.items()}
    ids = sorted(fps)
    want = closure(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = by_id(simhash.near_duplicates(both))
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (format(fps[k], "016x"), want[k]) for k in ids}
    assert simhash.near_duplicates(both.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [1_000_000, 3])
def test_links_of_chains_and_clusters(spark, crowded):
    r = random.Random(6)
    fps = {r.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:12]:
        for _ in range(40):
            for b in r.sample(range(64), r.randrange(1, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(df, len(signed), np.array(sorted(signed), np.int64).view(np.uint64), crowded=crowded)
    pairs = [(x["a"], x["b"]) for x in links.collect()]
    un = lambda f: f & ((1 << 64) - 1)
    assert all(0 < (un(a) ^ un(b)).bit_count() <= 4 for a, b in pairs)
    s = sorted(signed)
    want = closure(s, [(a, b) for i, a in enumerate(s) for b in s[i + 1 :] if (un(a) ^ un(b)).bit_count() <= 4])
    assert closure(s, pairs) == want
    roots = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(roots.get(n, n) == want[n] for n in s)


def test_pigeonhole_allocation():
    assert sum(simhash.allocate([[0, 5, 9, 20, 30, 40], [0, 1, 2, 3, 4, 5], [0, 50, 60, 70, 80, 90]], 2)) == 2
    sample = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    groups = simhash.bit_groups(sample, 5)
    assert sorted(b for g in groups for b in g) == list(range(64))
    parts = simhash.choose(sample, 100_000)
    assert all(len(simhash.near(len(g), t)) <= simhash.MOST_KEYS for g, t in parts)


def test_keep_one(spark):
    long = [" ".join(f"w{k}_{j}" for j in range(60)) for k in range(3)]
    d = docs(spark, [long[0], long[1], long[0], long[2], long[1]]).withColumn("fp", F.lit("clash"))
    d = d.union(d.where("doc_id = 3"))
    out = simhash.keep_one(d)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 3]


def test_groups_and_components(spark):
    e = [(0, 1), (1, 2), (5, 5), (7, 6)] + [(100, 100 + k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1100)]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert roots[2] == 0 and roots[7] == 6 and roots[399] == 100 and roots[1100] == 1000 and 5 not in roots
    got = with_group(spark.createDataFrame(e, "a long, b long"), "a", ["b"], F.max("b").alias("m"))
    assert got.count() == len(e) and got.where("a = 100").agg(F.min("m")).first()[0] == 399


# -- exact passages ------------------------------------------------------------------------------


def slow_dedup(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [1_000_000, 2])
def test_dedup_equals_brute_force(spark, crowded):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    texts = NASTY + [text(r.randrange(5, 150)) for _ in range(25)]
    texts += [text(r.randrange(1, 40)) + passage + text(r.randrange(1, 40)) for _ in range(8)] + [passage[:199], passage[:200], passage[3:203], "ab" * 300, "ab" * 150 + "c", texts[12], texts[12] + "!"]
    d = docs(spark, texts).withColumn("n_spans", F.lit("clash")).select("doc_id", "n_spans", "text", F.col("lang").alias("ranges"))
    out = suffix_dedup.dedup(d, crowded=crowded)
    assert out.columns == ["doc_id", "text", "ranges", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = by_id(out)
    assert [tuple(got[k][c] for c in out.columns[3:]) for k in range(len(texts))] == slow_dedup(texts)
    assert got[1]["text"] is None and got[3]["text"] == "one"
    assert suffix_dedup.dedup(d.limit(0)).count() == 0


def test_bucket_refinement():
    r = np.random.default_rng(8)
    for length in (8, 9, 24, 200):
        parts = [r.integers(97, 99, int(n)).astype(np.uint8) for n in r.integers(1, 400, 20)]
        parts += parts[:3]
        data, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        group = np.arange(len(parts)) % 3
        seen = Counter((int(g), p[i : i + length].tobytes()) for g, p in zip(group, parts) for i in range(len(p) - length + 1))
        want = [int(b + i) for b, g, p in zip(bounds, group, parts) for i in range(len(p) - length + 1) if seen[int(g), p[i : i + length].tobytes()] > 1]
        assert suffix_dedup.repeated(data, bounds, group, length).tolist() == want


# -- SQL and the pipeline ---------------------------------------------------------------------------


def test_registered_sql(spark):
    from skeinwork.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for f in queries.QUERIES:
        if sql := queries.oracle_sql().get(f.__name__):
            got, want = f(spark, SF), con.execute(sql)
            names = [x[0] for x in want.description]
            assert sorted(got.columns) == sorted(names)
            assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    d, rows = spark.read.parquet(f"{SF}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "suffix-array dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, d, SF), "t")
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
        before, after = {r["doc_id"] for r in d.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        if name == "SimHash near-dedup":
            texts = [r["text"] for r in d.collect()]
            assert len(after) <= len(set(texts)) and len({r["text"] for r in out.collect()}) == out.count()
        d = out
        rows.append(len(after))
    assert rows[0] > 150 and rows[3] == rows[2]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == rows[3]
