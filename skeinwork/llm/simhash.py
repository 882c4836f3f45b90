"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into partitions, correlated bits together.  If two
fingerprints differ in at most t bits and the thresholds t_i of m partitions sum
to t - m + 1, then in some partition they differ in at most t_i bits (a threshold
of -1 leaves a partition out).  A dynamic programme gives each partition its
threshold, so that probes and estimated candidates (from a sample of the
fingerprints' own values) are fewest; m is chosen with them.  Fingerprints meet
their candidates under a key of partition and value, are verified, and each
group passes on a spanning star of every cluster, never all pairs.  Values that
very many fingerprints share are linked through midpoints instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import materialize, salt, with_group
from skeinwork.llm.components import components

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Fingerprints that correlations and costs are estimated from (the choice of keys only: results don't depend on it).
SAMPLE = 20_000
#: A value shared by more fingerprints than this is linked through midpoints.
CROWDED = 100_000
#: Relative costs of a key that is sent and of a candidate that is verified; most keys of a fingerprint in a partition.
SEND, VERIFY, MOST_KEYS = 1.0, 0.01, 300
#: All pairs are compared in runs of up to so many rows; longer ones pass on a spanning forest.
SHORT = 32
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else 0x20 if b in SEPARATORS else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles of ``shingle`` words, in order; none if there is no word."""
    words = (text or "").encode().translate(LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles of ``shingle`` words; 0 if there is no word."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """fp (long, the 64 bits as a signed integer) and the columns ``keep``; a null or empty text, or one without words, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    rows = docs.select(*[c for c in keep if c != "text"], "text")
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kinds}fp long")


# -- choice of partitions and thresholds --------------------------------------


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size; each takes the bits most correlated with those it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(scale[:, None] * scale[None, :], 1e-9)
    left, groups = set(range(BITS)), []
    for size in [BITS // m + (k < BITS % m) for k in range(m)]:
        own = [min(left, key=lambda b: (-sum(corr[b, c] for c in left), b))]
        left.discard(own[0])
        while len(own) < size:
            b = min(left, key=lambda b: (-sum(corr[b, c] for c in own), b))
            own.append(b), left.discard(b)
        groups.append(sorted(own))
    return groups


def values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def near(width: int, t: int) -> list[int]:
    """Masks with at most t of ``width`` bits set."""
    return [sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(width), r)]


def estimate(sample: np.ndarray, group: list[int], t: int, n: int, send: float = SEND, verify: float = VERIFY) -> float:
    """Cost of a threshold in a group for n fingerprints: keys that are sent, and candidates (pairs) by the sample's value counts."""
    if t < 0:
        return 0.0
    # near its width a threshold lets everything through
    if t > 0 and 4 * t > len(group) or (keys := sum(math.comb(len(group), r) for r in range(t + 1))) > MOST_KEYS:
        return math.inf
    seen, counts = np.unique(values(sample, group), return_counts=True)
    pairs = 0.0
    for mask in near(len(group), t):
        other = seen ^ mask
        at = np.minimum(np.searchsorted(seen, other), len(seen) - 1)
        hit = seen[at] == other
        pairs += float((counts[hit] * (counts[at[hit]] - (1 if mask == 0 else 0))).sum())
    # what the sample can't see: values that are as good as random
    random = n * n * keys / 2.0 ** len(group)
    return send * n * keys + verify * max(pairs * (n / max(1, len(sample))) ** 2, random)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds -1 .. len(costs[i]) - 2 of least cost that sum to ``total``; costs[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, cost in enumerate(own, -1):
                if s + t not in nxt or c + cost < nxt[s + t][0]:
                    nxt[s + t] = (c + cost, [*chosen, t])
        best = nxt
    return best[total][1]


def choose(sample: np.ndarray, n: int, distance: int = DISTANCE, send: float = SEND, verify: float = VERIFY) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed; ``send``, ``verify``: costs of a key and of a candidate."""
    found = []
    for m in range(2, distance + 2):
        groups = bit_groups(sample, m)
        costs = [[estimate(sample, g, t, n, send, verify) for t in range(-1, distance + 1)] for g in groups]
        chosen = allocate(costs, distance - m + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, chosen, strict=True))
        found.append((cost, m, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


# -- candidates and links -------------------------------------------------------


def stars(fps: np.ndarray, home: np.ndarray, run: np.ndarray, distance: int, more: np.ndarray | None = None, in_all: int = 0, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal ``run`` (ascending); each run gives a spanning forest of its links.

    Rows with ``home`` false only probe: two of them aren't compared.  ``more``: further
    bits of each row; at most ``in_all`` of all bits may differ then.  ``sketches``: those
    of the rows; links are similar by them, too.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]])
    size = np.diff(cuts)
    out_a, out_b = [], []
    # short runs: all pairs at a fixed gap at once
    a, b = short_pairs(fps, home, run, size, distance, more, in_all)
    if sketches is not None and len(a):
        ok = similarity(sketches[a], sketches[b]) >= SIMILARITY - SLACK
        a, b = a[ok], b[ok]
    out_a.append(fps[a]), out_b.append(fps[b])
    for k in np.flatnonzero(size > SHORT):
        # flood each cluster from its first member
        for tree in flood(slice(cuts[k], cuts[k + 1]), fps, home, distance, more, in_all, sketches):
            for x, y in tree:
                out_a.append(np.full(len(y), fps[x])), out_b.append(fps[y])
    return np.concatenate(out_a), np.concatenate(out_b)


def close(x, y, fps: np.ndarray, distance: int, more: np.ndarray | None, in_all: int) -> np.ndarray:
    d = np.bitwise_count(fps[x] ^ fps[y])
    return d <= distance if more is None else (d <= distance) & (d + np.bitwise_count(more[x] ^ more[y]) <= in_all)


def short_pairs(fps: np.ndarray, home: np.ndarray, run: np.ndarray, size: np.ndarray, distance: int, more: np.ndarray | None, in_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all close pairs in runs of up to SHORT rows."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    in_short = np.repeat(size <= SHORT, size)
    for gap in range(1, min(SHORT, len(run))):
        a = np.flatnonzero(in_short[:-gap] & (run[:-gap] == run[gap:]))
        if not len(a):
            break
        b = a + gap
        ok = (home[a] | home[b]) & close(a, b, fps, distance, more, in_all) & (fps[a] != fps[b])
        out_a.append(a[ok]), out_b.append(b[ok])
    return np.concatenate(out_a), np.concatenate(out_b)


def flood(here: slice, fps: np.ndarray, home: np.ndarray, distance: int, more: np.ndarray | None, in_all: int, sketches: np.ndarray | None = None) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The clusters of a run that have links, each as a tree: (row, rows reached from it), the first member first.

    A row is compared when it is taken from the queue, and only what a verified link reaches is marked.
    """
    left = np.arange(here.start, here.stop)
    for s in left[home[here]]:
        at = np.searchsorted(left, s)
        if at == len(left) or left[at] != s:
            continue
        left, tree, queue = np.delete(left, at), [], [int(s)]
        while queue and len(left):
            x = queue.pop()
            hit = close(left, x, fps, distance, more, in_all)
            if not home[x]:
                hit &= home[left]
            if sketches is not None:
                hit[hit] = similarity(sketches[left[hit]], sketches[x]) >= SIMILARITY - SLACK
            y = left[hit]
            if len(y):
                left = left[~hit]
                tree.append((x, y))
                queue.extend(y.tolist())
        if tree:
            yield tree


def sorted_runs(solve, keys: tuple[str, ...]):
    """A function that hands ``solve`` the rows of batches sorted by ``keys``, as tables of whole runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            own = [b.column(k).to_numpy() for k in keys]
            # everything before the last run of this batch is complete
            other = np.flatnonzero(np.any([x != x[-1] for x in own], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or any(held[-1].column(k)[-1].as_py() != int(x[0]) for k, x in zip(keys, own, strict=True))):
                yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield solve(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def starts(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """The number of each row's run."""
    return np.cumsum(np.concatenate([[True], np.any([np.diff(t.column(k).to_numpy()) != 0 for k in keys], axis=0)]))


def columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """fp, home and, if there is one, fp2."""
    more = t.column("fp2").to_numpy().view(np.uint64) if "fp2" in t.column_names else None
    return t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(), more


def verify_runs(distance: int):
    """A function that links the rows (part, value, fp, home) of sorted batches, run by run."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        fps, home, _ = columns(t)
        a, b = stars(fps, home, starts(t, ("part", "value")), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return sorted_runs(solve, ("part", "value"))


def candidate_runs(distance: int, in_all: int):
    """A function that finds what is near in all bits, for sketches to decide on, in the rows (part, value, fp, fp2, home) of sorted batches.

    Near pairs of clusters of up to SHORT rows come as (a, b).  Larger clusters come as
    their rows: run (a number of the cluster), a (fp), fp2 and home.  No link of a run
    leaves its cluster, as near in all bits is the weaker test.
    """
    names = ["run", "a", "b", "fp2", "home"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        fps, home, more = columns(t)
        run = starts(t, ("part", "value"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]])
        size = np.diff(cuts)
        a, b = short_pairs(fps, home, run, size, distance, more, in_all)
        found_a, found_b, rows, cluster = [a], [b], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        part, value = t.column("part").to_numpy(), t.column("value").to_numpy()
        for k in np.flatnonzero(size > SHORT):
            for tree in flood(slice(cuts[k], cuts[k + 1]), fps, home, distance, more, in_all):
                own = np.sort(np.concatenate([[tree[0][0]], *(y for _, y in tree)]))
                if len(own) <= SHORT:
                    a, b = (own[i] for i in np.triu_indices(len(own), 1))
                    ok = (home[a] | home[b]) & close(a, b, fps, distance, more, in_all)
                    found_a.append(a[ok]), found_b.append(b[ok])
                else:
                    name = xxhash.xxh64_intdigest(np.array([part[own[0]], value[own[0]], tree[0][0] - cuts[k]], np.int64).tobytes())
                    rows.append(own), cluster.append(np.full(len(own), np.array(name, np.uint64).view(np.int64)))
        a, b, own, number = (np.concatenate(x) for x in (found_a, found_b, rows, cluster))
        fp, none = fps.view(np.int64), np.zeros(len(a), bool)
        is_pair = np.arange(len(a) + len(own)) < len(a)
        row = lambda pair, single, mask: pa.array(np.concatenate([pair, single]), mask=mask)
        return pa.RecordBatch.from_arrays(
            [row(a, number, is_pair), row(fp[a], fp[own], None), row(fp[b], own, ~is_pair), row(a, more.view(np.int64)[own], is_pair), row(none, home[own], is_pair)], names
        )

    return sorted_runs(solve, ("part", "value"))


def similar_runs(distance: int, in_all: int):
    """A function that links the rows (run, fp, fp2, home, sketch) of sorted batches by bits and sketches, run by run."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        fps, home, more = columns(t)
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        a, b = stars(fps, home, starts(t, ("run",)), distance, more, in_all, sketches)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return sorted_runs(solve, ("run",))


def links(distinct: DataFrame, n: int, sample: np.ndarray, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links of which the closure is that of all pairs within ``distance``; ``distinct`` has different fingerprints (fp)."""
    parts = choose(sample, n, distance)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i, (group, t) in enumerate(parts):
                v = values(fps, group)
                for mask in near(len(group), t):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fps), i, np.int32)), pa.array(v ^ mask), pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), mask == 0))], ["part", "value", "fp", "home"]
                    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i, (group, _) in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(values(fps, group))], ["part", "value"])

    if distance % 2:  # midpoints need an even distance
        crowded = n
    counts = distinct.mapInArrow(own, "part int, value long").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    full = materialize(counts.where(F.col("n") > crowded).select("part", "value"), "crowded")
    sent = distinct.mapInArrow(keys, "part int, value long, fp long, home boolean")
    out = sent
    any_full = full.limit(1).count() > 0
    if any_full:
        out = sent.join(full, ["part", "value"], "left_anti")
    found = out.repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(verify_runs(distance), "a long, b long")
    if any_full:
        found = found.unionAll(midpoints(sent.join(full, ["part", "value"]), parts, distance))
    return found


def midpoints(rows: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """Links of fingerprints in crowded values, without pairs.

    Two fingerprints differ in at most 2h bits just if some string differs from both
    in at most h (for an odd distance, one of them is first moved by one bit more, and
    links are verified afterwards).  Every fingerprint names its midpoints; those of
    one midpoint are joined to its least fingerprint by a group minimum.
    """
    if distance % 2:
        raise ValueError("midpoints need an even distance")
    h = distance // 2
    masks = np.array(near(BITS, h), np.uint64)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in np.unique(b.column(0).to_numpy()):
                m = np.array([f], np.int64).view(np.uint64) ^ masks
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(np.full(len(m), f))], ["mid", "fp"])

    # all bits, not only those outside the value: a probe differs inside it
    named = rows.select("fp").distinct().mapInArrow(name, "mid long, fp long")
    # two rows of a midpoint are within `distance` of each other, so linking both to the least one is exact
    least = named.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where(F.col("b") != F.col("top")).select("mid", "b")
    return named.join(least, "mid").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the smallest doc_id reachable (null only if all of them are null).
    Texts without words have fingerprint 0 and are linked like any other.
    """
    rows = materialize(fingerprints(docs, ("doc_id",)), "fingerprints")
    return group(rows, distance)


def group(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """As ``near_duplicates``, from written rows (doc_id, fp)."""
    least = rows.withColumn("salt", salt("doc_id")).groupBy("fp").agg(F.min("doc_id").alias("least"), F.collect_set("salt").alias("salts"))
    least = materialize(least, "distinct-fingerprints")
    n = least.count()
    picked = least.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    named = least.withColumn("component_id", F.col("least"))
    if n > 1:
        roots = components(links(least.select("fp"), n, sample, distance))
        joined = materialize(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
        named = with_group(joined, "root", ["fp"], F.min("least").alias("component_id"))
    # each fingerprint goes only to the shares that have a document of it
    named = named.select("fp", F.explode("salts").alias("salt"), "component_id")
    out = rows.withColumn("salt", salt("doc_id")).join(named, ["fp", "salt"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- similar texts --------------------------------------------------------------------

#: The stage for similar texts: words in a shingle, least Jaccard similarity of the sets of shingles.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Bits that may differ in the fingerprint that is probed, and in it and a second one together.  At a similarity of
#: 0.8 some 10 and 19 differ on average; 2 in 100 such pairs differ in more than 15, 4 in 100 in more than 26.
STAGE_DISTANCE, STAGE_IN_ALL = 15, 26
#: Bins of the sketch that similarity is measured with.  Sets of up to some hundred shingles are compared as they
#: are; for longer ones a similarity of 0.8 is measured with a deviation of 0.025, so half of that is allowed for.
BINS, SLACK = 256, 0.0125
#: Costs of a key (it goes to two bands, and takes disk) and of a candidate (only a tenth of them share a band).
STAGE_SEND, STAGE_VERIFY = 6.0, 0.001
#: Sizes of sets in one band differ by less than this factor, so similar sets lie in one band or in neighbours.
BAND = 1.25


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a set: of each bin the least hash, as 1 .. 255; 0 in an empty bin."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(BINS - 1)).astype(np.int64), hashes >> np.uint64(8))
    return np.where(least == np.iinfo(np.uint64).max, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that one of two sketches fills, row by row; 1 for two empty sets."""
    used = np.count_nonzero(a | b, axis=1)
    # bins that are empty in both are equal, too
    return np.where(used == 0, 1.0, (np.count_nonzero(a == b, axis=1) - (BINS - used)) / np.maximum(used, 1))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp, fp2 (two fingerprints), n (different shingles) and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), STAGE_SHINGLE)
                # of the set of shingles: one that recurs has no more say than others
                once = np.unique(h)
                second = (once ^ (once >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
                row = (majority(once), majority(second ^ (second >> np.uint64(28))), len(once), sketch(once).tobytes())
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            fp, fp2 = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[:2])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), fp, fp2, pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "h", "fp", "fp2", "n", "sketch"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return lean.mapInArrow(run, "doc_id long, h long, fp long, fp2 long, n long, sketch binary")


def similar_links(nodes: DataFrame, n: int, sample: np.ndarray) -> DataFrame:
    """(a, b): links between fingerprints of similar texts; ``nodes`` is a written table (fp, fp2, n, sketch).

    Keys carry the size band: a row is at home in its own band and probes the next one,
    too.  Near pairs of small clusters meet their sketches one by one; the rows of larger
    clusters take their sketches with them, and pass on a forest of verified links.
    """
    parts = choose(sample, n, STAGE_DISTANCE, STAGE_SEND, STAGE_VERIFY)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            band = np.floor(np.log(np.maximum(b.column("n").to_numpy(), 1)) / np.log(BAND)).astype(np.int64)
            for i, (group, t) in enumerate(parts):
                v = values(fps, group)
                for mask in near(len(group), t):
                    for up in (0, 1):
                        home = np.full(len(fps), mask == 0 and up == 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array((band + up) << 32 | (v ^ mask)), b.column("fp"), b.column("fp2"), pa.array(home)], ["part", "value", "fp", "fp2", "home"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
                ok = pa.array(similarity(x, y) >= SIMILARITY - SLACK)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    sent = nodes.select("fp", "fp2", "n").mapInArrow(keys, "part int, value long, fp long, fp2 long, home boolean")
    found = sent.repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(candidate_runs(STAGE_DISTANCE, STAGE_IN_ALL), "run long, a long, b long, fp2 long, home boolean")
    found = materialize(found, "near-links")
    pairs = found.where(F.col("run").isNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # an adaptive join splits a fingerprint that very many links name
    both = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("sketch").alias("sa")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("sketch").alias("sb")), "b")
    small = both.select("a", "b", "sa", "sb").mapInArrow(measure, "a long, b long")
    members = found.where(F.col("run").isNotNull()).select("run", F.col("a").alias("fp"), "fp2", "home").join(nodes.select("fp", "sketch"), "fp")
    large = members.select("run", "fp", "fp2", "home", "sketch").repartition("run").sortWithinPartitions("run").mapInArrow(similar_runs(STAGE_DISTANCE, STAGE_IN_ALL), "a long, b long")
    return small.unionAll(large)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar texts, that of the smallest doc_id; the columns of ``docs``.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8
    or more, or the same fingerprint.  Of repeated rows with that id and text one stays.
    Rows without an id stay only where no member of the group has one, one of them.
    Texts without a word are alike.
    """
    rows = materialize(profiles(docs), "profiles")
    chosen = F.min_by(F.struct("doc_id", "h", "fp2", "n", "sketch"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))).alias("x")
    nodes = materialize(rows.groupBy("fp").agg(chosen).select("fp", "x.*"), "nodes")
    n = nodes.count()
    picked = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    first = nodes.select("doc_id", "h")
    if n > 1:
        roots = components(similar_links(nodes, n, sample))
        grouped = nodes.select("fp", "doc_id", "h").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
        first = grouped.groupBy("root").agg(F.min_by(F.struct("doc_id", "h"), order).alias("x")).select("x.*")
    first = materialize(first.select(F.coalesce("doc_id", F.lit(0)).alias("__k"), "h", F.col("doc_id").isNull().alias("__none")).withColumnRenamed("h", "__h"), "first")
    keyed = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__h": F.xxhash64("text"), "__none": F.col("doc_id").isNull()})
    kept = keyed.join(first, ["__k", "__h", "__none"], "left_semi")
    return kept.dropDuplicates(["__k", "__h", "__none"]).select(*docs.columns)
