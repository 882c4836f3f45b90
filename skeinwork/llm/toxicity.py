"""Toxicity by class-conditional Kneser-Ney models.

The expressions of a text are its words: lower-cased runs of letters, marks and
digits.  A model spells a word byte by byte, each byte given the ORDER - 1 before
it (spaces before the word, one at its end), with interpolated Kneser-Ney:

* the highest order has the counts of one class (in how many documents a word
  that holds the n-gram occurs) and that class's discount n1 / (n1 + 2 n2);
* all lower orders count distinct preceding bytes and are *shared* by both classes.

What neither class knows costs both the same, so rare expressions add nothing to
the difference.  A toxic document is ordinary language but for a few words: its
likelihood of a word is that of the ordinary model with SHARE of the toxic model
mixed in.  The difference of the log-likelihoods, summed over the different words
of a document and normalised by their number and by its square root, goes
through a logistic curve.  The curve is fitted to documents of one part of the
training folds, scored by counts of the other parts.

Counts are exact and grow with the corpus.  Documents are cut into slices; a
slice keeps its different words once, and of each document their numbers.  Only
the slices' different n-grams meet the counts: both are dealt into buckets by
context, a bucket's counts are held and the slices' n-grams stream past them.  No
table of the corpus is broadcast or sent to the driver, texts are never shuffled.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import fold_of, forget, gathered, held_out, in_buckets, materialize, segment_sum, slices, string_buffers

#: Bytes of an n-gram; eight fit a long without loss.
ORDER = 8
#: Share of a toxic document's words that the toxic model draws.
SHARE = 0.01
#: Bytes and rows of a slice, about; bytes that are cut into words at a time.
SLICE_BYTES, SLICE_ROWS, WORK_BYTES = 1 << 23, 1 << 15, 1 << 20
#: N-grams that a task counts before it hands them on, about.
COMBINE = 1 << 20
#: Labelled documents of each class that the curve is fitted to, at most (the bound of the fit).
CURVE_DOCUMENTS = 1500
#: The curve is fitted to one of so many parts of the training documents.
PARTS = 4
THRESHOLD = 0.7
#: Contexts of a bucket, about; the prime that deals them out.
BUCKET, SPREAD = 1 << 15, 2147483647
SPACE = 0x20
MIX = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in rising order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def plain(text: Column) -> Column:
    """The words of a text with one space between them (a null text: none)."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(""))


def word_starts(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of bytes other than a space; runs end with their row."""
    inside = data != SPACE
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    rows = off[:-1]
    rows = rows[rows < len(data)]
    edge[rows] = inside[rows]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return starts, starts
    number = np.cumsum(edge) - 1
    return starts, np.bincount(number[inside], minlength=len(starts))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (they only tell the words of one slice apart)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw, ends = gathered(data, starts, lengths), np.cumsum(lengths)
    at = np.arange(len(raw)) - np.repeat(ends - lengths, lengths)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), PRIME)]), dtype=np.uint64)
    return mixed(np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[at], ends - lengths))


class Slice:
    """The different words of some documents, and of each document their numbers."""

    def __init__(self) -> None:
        self.ids: list = []
        self.bytes = 0
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: int, off: np.ndarray, data: np.ndarray) -> None:
        """Texts of the rows ``row``, ``row`` + 1, ..."""
        starts, lengths = word_starts(off, data)
        hashes, first, number = np.unique(word_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        rows = np.searchsorted(off, starts, side="right") - 1
        pairs = distinct((row + rows).astype(np.int64) << 32 | number)
        self.seen.append((hashes, lengths[first], gathered(data, starts[first], lengths[first]), pairs >> 32, pairs & 0xFFFFFFFF))
        self.bytes += len(data)

    def record(self) -> dict:
        hashes, first, number = np.unique(np.concatenate([s[0] for s in self.seen]), return_index=True, return_inverse=True)
        lengths = np.concatenate([s[1] for s in self.seen])
        raw = np.concatenate([s[2] for s in self.seen])
        starts = np.cumsum(lengths) - lengths
        before = np.cumsum([0, *(len(s[0]) for s in self.seen)])
        rows, words = np.concatenate([s[3] for s in self.seen]), np.concatenate([number[s[4] + b] for s, b in zip(self.seen, before, strict=False)])
        # frequent words get small numbers
        order = np.argsort(-np.bincount(words, minlength=len(hashes)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        pairs = distinct(rows << 32 | rank[words])
        rows, words, first = pairs >> 32, pairs & 0xFFFFFFFF, first[order]
        step = np.diff(words, prepend=0)
        new = np.flatnonzero(np.diff(rows, prepend=-1))
        step[new] = words[new]
        packed = {"sizes": np.bincount(rows, minlength=len(self.ids)).astype("<u4"), "steps": step.astype("<u4"), "lengths": lengths[first].astype("<u4"), "words": gathered(raw, starts[first], lengths[first])}
        zip_ = zstandard.ZstdCompressor(3)
        return {"slice": uuid.uuid4().hex, "ids": self.ids} | {k: zip_.compress(v.tobytes()) for k, v in packed.items()}


def pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``data`` cut at spaces into pieces of about ``most`` bytes (longer only where a word is)."""
    at = 0
    while at < len(data):
        to = at + most
        if to < len(data):
            gaps = np.flatnonzero(data[to : to + most] == SPACE)
            while not len(gaps) and to < len(data):
                to += most
                gaps = np.flatnonzero(data[to : to + most] == SPACE)
            to += int(gaps[0]) if len(gaps) else 0
        yield data[at:to]
        at = max(to, at + 1)


class Spelling:
    """What a slice's record holds, and the n-grams of its words."""

    def __init__(self, sizes: bytes, steps: bytes, lengths: bytes, words: bytes) -> None:
        sizes, steps, lengths, words = map(zstandard.ZstdDecompressor().decompress, (sizes, steps, lengths, words))
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.sizes)])
        step = np.frombuffer(steps, "<u4").astype(np.int64)
        total = np.concatenate([[0], np.cumsum(step)])
        #: number of the word, for each different word of each document
        self.numbers = total[1:] - np.repeat(total[self.off[:-1]], self.sizes)
        n = np.frombuffer(lengths, "<u4").astype(np.int64)
        # ORDER - 1 spaces, the word, a space
        padded = np.full(int(n.sum()) + ORDER * len(n), SPACE, np.uint8)
        starts = np.cumsum(n + ORDER) - n - 1
        raw = np.frombuffer(words, np.uint8)
        padded[np.arange(len(raw)) + np.repeat(starts - (np.cumsum(n) - n), n)] = raw
        value = np.zeros(max(0, len(padded) - ORDER + 1), np.uint64)
        for k in range(ORDER):
            value = value << np.uint64(8) | padded[k : k + len(value)]
        self.word = np.repeat(np.arange(len(n)), n + 1)
        last = np.arange(len(self.word)) + np.repeat(starts - (np.cumsum(n + 1) - n - 1), n + 1)
        #: the different n-grams in rising order, and the number of each n-gram of each word
        self.grams, self.at = np.unique(value[last - ORDER + 1], return_inverse=True)


def bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    return (context % np.uint64(SPREAD) % np.uint64(buckets)).astype(np.int64)


def packed(grams: np.ndarray) -> bytes:
    """Rising numbers as the differences between them."""
    return zstandard.compress(np.diff(grams, prepend=np.uint64(0)).tobytes(), 3)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(raw), "<u8"), dtype=np.uint64)


EVIDENCE = ["gram", "a", "a_rest", "b", "b_rest"]
BINARIES = ("sizes", "steps", "lengths", "words")


def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Spelling]]:
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield row, Spelling(*(row[x] for x in BINARIES))


def sliced(docs: DataFrame) -> DataFrame:
    """slice, whether of the curve's sample, ids, and the packed words of (doc_id, text, sample), in slices; null ids are kept."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sample = Slice(), None

        def out(part: Slice) -> pa.RecordBatch:
            r = part.record()
            return pa.RecordBatch.from_arrays(
                [pa.array([r["slice"]]), pa.array([sample]), pa.array([r["ids"]], pa.list_(ids.type)), *(pa.array([r[x]], pa.binary()) for x in BINARIES)], ["slice", "sample", "ids", *BINARIES]
            )

        for whole in batches:
            flags = whole.column("sample").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
            for lo, hi in itertools.pairwise(edges):
                if lo < hi and part.ids and sample != flags[lo]:  # a slice has rows of one kind
                    yield out(part)
                    part = Slice()
                for b in slices(whole.slice(lo, hi - lo), "words", WORK_BYTES):
                    sample = bool(flags[lo])
                    ids, row = b.column("doc_id"), len(part.ids)
                    part.ids += ids.to_pylist()
                    off, data = string_buffers(b.column("words"))
                    if len(data) > 2 * WORK_BYTES and b.num_rows == 1:
                        for piece in pieces(data, WORK_BYTES):
                            part.add(row, np.array([0, len(piece)]), piece)
                    else:
                        part.add(row, off, data)
                    if part.bytes >= SLICE_BYTES or len(part.ids) >= SLICE_ROWS:
                        yield out(part)
                        part = Slice()
        if part.ids:
            yield out(part)

    kinds = f"slice string, sample boolean, ids array<{kind.simpleString()}>, " + ", ".join(f"{x} binary" for x in BINARIES)
    return in_buckets(docs.select("doc_id", plain(F.col("text")).alias("words"), "sample").mapInArrow(run, kinds), "slice", "toxicity_slices")


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) outside the held-out fold; of several labels of a document the greatest counts."""
    return labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 1)).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))


def in_curve(doc_id: Column) -> Column:
    """Whether a document is of the part that the curve is fitted to."""
    return F.pmod(F.xxhash64(doc_id), F.lit(PARTS)) == 0


def counted(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """gram, a0, a1, b0, b1: documents and words with each n-gram, by class; b without the curve's part."""
    parts = parts.where(~F.col("sample"))
    where = parts.select("slice", F.posexplode("ids").alias("pos", "doc_id")).where(F.col("doc_id").isNotNull())
    known = where.join(marks(labels), "doc_id").select("slice", F.struct("pos", "toxic", in_curve(F.col("doc_id")).alias("curve")).alias("mark"))
    known = materialize(known.groupBy("slice").agg(F.collect_list("mark").alias("marks")), "toxicity-marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([x[k] for _, x in held]), len(grams)).astype(np.int64) for k in range(4)]
            for k in range(0, len(grams), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (grams.view(np.int64), *sums)], ["gram", "a0", "a1", "b0", "b1"])

        for row, s in spelled(batches):
            use = np.full((4, len(s.sizes)), False)
            for m in row["marks"]:
                use[m["toxic"], m["pos"]] = True
                use[2 + m["toxic"], m["pos"]] = not m["curve"]
            doc = np.repeat(np.arange(len(s.sizes)), s.sizes)
            sums = np.array([np.bincount(s.at, np.bincount(s.numbers[u[doc]], minlength=s.word[-1] + 1 if len(s.word) else 0)[s.word], len(s.grams)) for u in use])
            some = np.flatnonzero(sums[0] + sums[1])
            held.append((s.grams[some], sums[:, some]))
            size += len(some)
            if size >= COMBINE:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    rows = parts.join(known, "slice").mapInArrow(run, "gram long, a0 long, a1 long, b0 long, b1 long")
    out = materialize(rows.groupBy("gram").agg(*(F.sum(x).alias(x) for x in ("a0", "a1", "b0", "b1"))), "toxicity-counts")
    forget(known)
    return out


def discount(ones: int | None, twos: int | None) -> float:
    """Kneser-Ney discount from the numbers of n-grams that occur once and twice; a half if either is 0."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def discounts(counts: DataFrame, columns: list[str]) -> dict[str, float]:
    row = counts.agg(*(F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in columns for n in (1, 2))).first()
    return {c: discount(row[f"{c}_1"], row[f"{c}_2"]) for c in columns}


def suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def lower_orders(counts: DataFrame) -> dict[int, DataFrame]:
    """gram, n of each order below ORDER: the distinct bytes that precede an n-gram."""
    rows, tables = counts.select("gram"), {}
    for m in range(ORDER - 1, 0, -1):
        rows = materialize(rows.select(suffix(F.col("gram"), m).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"toxicity-order-{m}")
        tables[m] = rows
    return tables


def shared(counts: DataFrame, tables: dict[int, DataFrame] | None = None) -> DataFrame:
    """low, p: probability of the last byte of each n-gram of order ORDER - 1 by the lower orders, from distinct preceding bytes."""
    tables, below = tables or lower_orders(counts), None
    for m in range(1, ORDER):
        d = discounts(tables[m], ["n"])["n"]
        context = Window.partitionBy(F.shiftrightunsigned("gram", 8))
        here = tables[m].select("gram", "n", F.sum("n").over(context).alias("total"), F.count(F.lit(1)).over(context).alias("kinds"))
        here = here.withColumn("gram_below", suffix(F.col("gram"), m - 1)).join(below, "gram_below") if below is not None else here.withColumn("p_below", F.lit(1 / 257))
        p = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("p_below")) / F.col("total")
        below = here.select(F.col("gram").alias("gram_below"), p.alias("p_below"))
    return below.select(F.col("gram_below").alias("low"), F.col("p_below").alias("p"))


def evidence(counts: DataFrame) -> DataFrame:
    """context, gram, and for each of its n-grams log P(byte | toxic) - log P(byte | ordinary), with the difference of any other byte.

    ``a`` are the differences by all counts, ``b`` those without the curve's part.
    """
    columns = ["a0", "a1", "b0", "b1"]
    d = discounts(counts, columns)
    context = Window.partitionBy("context")
    tables = lower_orders(counts)
    rows = counts.withColumn("low", suffix(F.col("gram"), ORDER - 1)).join(shared(counts, tables), "low").withColumn("context", F.shiftrightunsigned("gram", 8))
    rows = rows.withColumns({f"{c}_total": F.sum(c).over(context) for c in columns} | {f"{c}_kinds": F.count_if(F.col(c) > 0).over(context) for c in columns})

    def log_p(c: str) -> Column:
        return F.log(F.when(F.col(f"{c}_total") > 0, (F.greatest(F.col(c) - d[c], F.lit(0.0)) + d[c] * F.col(f"{c}_kinds") * F.col("p")) / F.col(f"{c}_total")).otherwise(F.col("p")))

    def log_rest(c: str) -> Column:
        return F.log(F.when(F.col(f"{c}_total") > 0, d[c] * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(F.lit(1.0)))

    rows = rows.select("context", "gram", *((log_p(f"{v}1") - log_p(f"{v}0")).cast("float").alias(v) for v in "ab"), *((log_rest(f"{v}1") - log_rest(f"{v}0")).cast("float").alias(f"{v}_rest") for v in "ab"))
    out = materialize(rows, "toxicity-evidence")
    for table in tables.values():
        forget(table)
    return out


class Bucket:
    """The evidence of one bucket of contexts."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        columns = [np.concatenate([b.column(x).to_numpy() for b in held]) if held else np.zeros(0) for x in EVIDENCE]
        grams = columns[0].astype(np.int64).view(np.uint64)
        order = np.argsort(grams)
        self.grams = grams[order]
        context = self.grams >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, int)
        self.contexts = context[first]
        #: by whether a document is of the sample: values of the n-grams, of the rest of a context
        self.values = [(columns[k][order], columns[k + 1][order][first]) for k in (1, 3)]

    def look_up(self, grams: np.ndarray, sample: bool) -> np.ndarray:
        """The evidence of each n-gram: its own, or else its context's, or else 0."""
        out = np.zeros(len(grams), np.float32)
        own, rests = self.values[sample]
        for keys, known, values in ((grams >> np.uint64(8), self.contexts, rests), (grams, self.grams, own)):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = values[at[hit]]
        return out


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, evidence before requests: slice, bucket, and the evidence of the requested n-grams."""
    now, held, bucket = None, [], None
    for b in batches:
        numbers, asks = b.column("bucket").to_numpy(), b.column("slice").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(numbers, prepend=-1) != 0) | (np.diff(asks.astype(int), prepend=-1) != 0)).tolist()
        for lo, hi in zip(edges, [*edges[1:], b.num_rows], strict=True):
            if numbers[lo] != now:
                now, held, bucket = numbers[lo], [], None
            if not asks[lo]:
                held.append(b.slice(lo, hi - lo).select(EVIDENCE))
                continue
            if bucket is None:
                bucket, held = Bucket(held), []
            for name, sample, raw in zip(*(b.column(x).slice(lo, hi - lo).to_pylist() for x in ("slice", "sample", "packed")), strict=True):
                reply = zstandard.compress(bucket.look_up(unpacked(raw), sample).tobytes(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([now], pa.int64()), pa.array([reply], pa.binary())], ["slice", "bucket", "reply"])


def measured(parts: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """doc_id, sample, mean, root of every document: its summed difference by the number of its words, and by the root of that.

    The curve's sample is measured by the evidence ``version``, all else by ``a``.
    """
    kind = parts.schema["ids"].dataType.elementType.simpleString()

    buckets = max(16, known.select("context").distinct().count() // BUCKET)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in spelled(batches):
            to = bucket_of(s.grams >> np.uint64(8), buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            each = [(k, packed(s.grams[order[ends[k] : ends[k + 1]]])) for k in range(buckets) if ends[k] < ends[k + 1]]
            if each:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in each], pa.int64()), pa.array([row["slice"]] * len(each)), pa.array([row["sample"]] * len(each)), pa.array([x for _, x in each], pa.binary())], ["bucket", "slice", "sample", "packed"])

    asked = parts.select("slice", "sample", *BINARIES).mapInArrow(requests, "bucket long, slice string, sample boolean, packed binary")
    told = known.select((F.col("context") % SPREAD % buckets).alias("bucket"), "gram", "a", "a_rest", F.col(version).alias("b"), F.col(f"{version}_rest").alias("b_rest"))
    both = told.unionByName(asked, allowMissingColumns=True).select("bucket", "slice", "sample", "packed", *EVIDENCE)
    replies = both.repartition("bucket").sortWithinPartitions("bucket", F.col("slice").isNotNull()).mapInArrow(looked_up, "slice string, bucket long, reply binary")
    back = replies.groupBy("slice").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                row = one.select(["sample", *BINARIES, "replies"]).to_pylist()[0]
                s = Spelling(*(row[x] for x in BINARIES))
                each, to = np.zeros(len(s.grams)), bucket_of(s.grams >> np.uint64(8), buckets)
                for r in row["replies"] or ():
                    each[to == r["bucket"]] = np.frombuffer(zstandard.decompress(r["reply"]), "<f4")
                ratio = np.bincount(s.word, each[s.at], minlength=int(s.word[-1]) + 1 if len(s.word) else 0)
                total = segment_sum(np.log1p(SHARE * np.expm1(np.minimum(ratio, 50)))[s.numbers], s.off)
                n = np.maximum(s.sizes, 1)
                sample = pa.array(np.full(len(n), row["sample"]))
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), sample, pa.array(total / n), pa.array(total / np.sqrt(n))], ["doc_id", "sample", "mean", "root"])

    rows = parts.join(back, "slice", "left").select("ids", "sample", *BINARIES, "replies")
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, sample boolean, mean double, root double"), "toxicity-measures")


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and intercept of a slightly regularised logistic regression by Newton's method; classes weigh the same."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b, ridge = np.zeros(a.shape[1]), np.diag([*[1e-3] * x.shape[1], 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ b)
        b = b + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return np.array([*(b[:-1] / scale), b[-1]])


def curve_sample(ids: DataFrame, marks: DataFrame, most: int) -> tuple[dict, str]:
    """Ids and classes of the documents that the curve is fitted to, and the evidence that measures them."""
    marked, chosen = ids.where(F.col("doc_id").isNotNull()).join(marks, "doc_id").distinct(), {}
    for version, part in (("b", in_curve(F.col("doc_id"))), ("a", F.lit(True))):
        of = [marked.where(part & (F.col("toxic") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
        chosen = {r["doc_id"]: r["toxic"] for r in of[0].union(of[1]).collect()}
        if len(set(chosen.values())) == 2:
            break
    return chosen, version


def assess(docs: DataFrame, labels: DataFrame, *, most: int = CURVE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), by the labels (doc_id, toxic) outside the held-out fold.

    The counts cover all labelled documents, the curve at most ``most`` of each class
    (chosen by a hash of the id) of one part of them.  A null or empty text, or one
    without a word, has no evidence and gets the curve's value at 0.  Without labelled
    documents of one class every score is 0 (no toxic one) or 1; if the curve's part
    has none of a class, the curve is fitted to documents that the counts hold.
    Repeated rows get equal scores; null ids and other columns are no obstacle.
    """
    docs = docs.select("doc_id", "text")
    chosen, version = curve_sample(docs.select("doc_id"), marks(labels), most)
    sample = docs.where(F.col("doc_id").isin(list(chosen)))
    parts = sliced(docs.withColumn("sample", F.lit(False)).union(sample.withColumn("sample", F.lit(True))))
    counts = counted(parts, labels)
    totals = counts.agg(F.sum("a0"), F.sum("a1")).first()
    if not totals[0] or not totals[1]:
        score = F.lit(1.0 if totals[1] else 0.0)
        rows = docs
        forget(parts)
        forget(counts)
    else:
        known = evidence(counts)
        forget(counts)
        rows = measured(parts, known, version)
        forget(parts)
        forget(known)
        fitted = rows.where("sample").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
        w = [float(v) for v in curve(np.array([(r["mean"], r["root"]) for r in fitted]), np.array([chosen[r["doc_id"]] for r in fitted]))]
        rows = rows.where("not sample")
        # a sum of logarithms beyond 30 either way is as good as certain
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("mean") * w[0] + F.col("root") * w[1] + w[2]))))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
