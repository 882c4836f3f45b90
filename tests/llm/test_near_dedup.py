import random

import numpy as np
from pyspark.sql import functions as F

from skeinwork.llm import simhash
from skeinwork.llm.common import materialize


def edited_copies(r, words, copies, edits):
    """A text, and copies of it that are edited independently of each other."""
    text = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = [text]
    for _ in range(copies):
        own = list(text)
        for k in r.sample(range(words), edits):
            own[k] = f"x{r.randrange(10**6)}"
        out.append(own)
    return [" ".join(t) for t in out]


def roots(n, links):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(k) for k in range(n)]


def test_links_of_edited_copies_equal_brute_force(spark):
    r = random.Random(9)
    texts = edited_copies(r, 400, 300, 6) + edited_copies(r, 150, 12, 2) + [" ".join(f"y{r.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    r.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = materialize(simhash.profiles(d), "t")
    at = sorted(nodes.collect(), key=lambda x: x["fp"])
    fp, fp2 = (np.array([x[c] for x in at], np.int64).view(np.uint64) for c in ("fp", "fp2"))
    assert len(set(fp.tolist())) == len(texts)
    sketch = np.frombuffer(b"".join(bytes(x["sketch"]) for x in at), np.uint8).reshape(-1, simhash.BINS)
    a, b = np.triu_indices(len(at), 1)
    bits, both = np.bitwise_count(fp[a] ^ fp[b]), np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(fp2[a] ^ fp2[b])
    x, y = sketch[a], sketch[b]
    same = ((x == y) & (x != 0)).sum(axis=1) / ((x | y) != 0).sum(axis=1)
    ok = (bits <= simhash.STAGE_DISTANCE) & (both <= simhash.STAGE_IN_ALL) & (same >= simhash.SIMILARITY - simhash.SLACK)
    want = roots(len(at), zip(a[ok].tolist(), b[ok].tolist(), strict=True))
    place = {x["fp"]: k for k, x in enumerate(at)}
    found = [(place[x["a"]], place[x["b"]]) for x in simhash.similar_links(nodes, len(at), np.sort(fp)).collect()]
    assert roots(len(at), found) == want and max(want.count(k) for k in want) > 250
    # what is linked has passed the similarity test
    good = {(i, j) for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True)}
    assert {(min(p), max(p)) for p in found} <= good
    assert simhash.keep_one(d).agg(F.count("doc_id")).first()[0] == len(set(want))


def test_texts_that_share_one_frequent_shingle_stay(spark):
    r = random.Random(4)
    texts = [" ".join(["same"] * 120 + [f"v{r.randrange(10**6)}" for _ in range(60)]) for _ in range(2)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(d).count() == 2


def test_odd_distances_have_no_midpoints(spark):
    fps = [0, 1, 3, 7, 0xFF00, 0xFF07, 1 << 40]
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "doc_id long, fp long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {r["doc_id"]: r["component_id"] for r in simhash.group(materialize(rows, "t"), 3).collect()} == dict(enumerate(want))
    sample = np.array(fps, np.uint64)
    assert simhash.links(rows.select("fp"), len(fps), sample, 3, crowded=1).count() >= 2


def brute_similar(texts):
    sets = [set(simhash.shingle_hashes(t, simhash.STAGE_SHINGLE).tolist()) for t in texts]
    return {(i, j): len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i in range(len(texts)) for j in range(i)}


def test_stage_against_exact_jaccard(spark):
    """Pairs of similarity 0.8 or more are found (0.9 of them at least), none below 0.7 is linked."""
    r = random.Random(21)
    texts = []
    for k in range(120):
        words = r.choice([40, 90, 200, 600])
        texts += edited_copies(r, words, 2, max(1, round(words * r.choice([0.004, 0.01, 0.02, 0.05, 0.1]))))
    exact = brute_similar(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    nodes = materialize(simhash.profiles(d), "t")
    fp = {x["fp"]: x["doc_id"] for x in nodes.select("fp", "doc_id").collect()}
    assert len(fp) == len(texts)
    found = {tuple(sorted((fp[x["a"]], fp[x["b"]]), reverse=True)) for x in simhash.similar_links(nodes, len(texts), np.sort(np.array(list(fp), np.int64).view(np.uint64))).collect()}
    due = {p for p, j in exact.items() if j >= 0.8}
    assert len(due) > 60 and len(found & due) >= 0.9 * len(due)
    assert all(exact[p] >= 0.7 for p in found)
