"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if some string of LENGTH bytes that covers it also starts at another
place of the corpus.  Two equal strings hold the same rarest q-gram (that of least
hash, the leftmost of equals) at the same offset, so all suffixes of the corpus
fall into initial buckets by the q-gram of their string, one row for each run of
suffixes that share it ("anchor").  Runs whose whole surroundings are equal are
settled by a digest of them, copies inside one task before anything is sent.  The
rest of a bucket is refined like a suffix array: positions get the bucket of their
first 8 bytes, then of pairs of buckets 8, 16, 32 ... bytes apart, each round
reusing the identifiers of the one before, and positions that are alone drop out;
what still shares a bucket at depth LENGTH occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import materialize, slices, string_buffers, with_group

LENGTH, GRAM = 200, 24
#: Anchors that a task combines at once; bytes of context that are refined at once (a bucket stays whole).
COMBINE, REFINE_BYTES = 400_000, 1 << 21
#: Buckets with more members than this are compared by digests of all their strings, spread over all tasks.
CROWDED = 20_000


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h = {1: x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)}
    n, base = 1, 0x100000001B3
    while 2 * n <= GRAM:
        power = np.uint64(pow(base, n, 1 << 64))
        h[2 * n] = h[n][:-n] * power + h[n][n:]
        n *= 2
    out, done = h[n], n
    while done < GRAM:
        step = max(k for k in h if k <= GRAM - done)
        size = min(len(out), len(h[step]) - done)
        out = out[:size] * np.uint64(pow(base, step, 1 << 64)) + h[step][done : done + size]
        done += step
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string) of each run of strings with the same anchor, as positions in ``data``."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    k = gram_hashes(data)
    where = np.arange(len(k))

    def lower(by: int) -> None:
        """The least hash of two neighbouring windows, ``by`` apart; of equal ones the left."""
        nonlocal k, where
        right = k[by:] < k[:-by]
        k, where = np.where(right, k[by:], k[:-by]), np.where(right, where[by:], where[:-by])

    # least of LENGTH - GRAM + 1 neighbours, by doubling
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        lower(span)
        span *= 2
    if span < width:
        lower(width - span)
    n = np.maximum(np.diff(off) - LENGTH + 1, 0)
    p = np.arange(n.sum()) + np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    if not len(p):
        return (np.zeros(0, np.int64),) * 3
    a = where[p]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) != 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return a[first], p[first], p[last]


# -- initial buckets -------------------------------------------------------------

KEYS = "doc_id long, h long"
ROW = pa.schema([("settled", pa.bool_()), ("key", pa.int64()), ("ctx", pa.int64()), ("copies", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("p0", pa.int32()), ("p1", pa.int32())])


def signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW for documents (doc_id, h, text).

    Of equal surroundings inside the task one row is sent, marked ``copies``; their
    ranges are settled at once.
    """
    held: list[np.ndarray] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> Iterator[pa.RecordBatch]:
        t = np.concatenate(held)
        held.clear()
        t = t[np.lexsort((t[:, 1], t[:, 0]))]
        same = (t[1:, 0] == t[:-1, 0]) & (t[1:, 1] == t[:-1, 1])
        first = np.concatenate([[True], ~same])
        copies = np.zeros(len(t), bool)
        copies[:-1] |= same
        copies[1:] |= same
        for rows, settled in ((t[first], False), (t[copies], True)):
            c = copies[first] if not settled else np.ones(len(rows), bool)
            if settled:
                # ranges of a document that touch become one
                rows = rows[np.lexsort((rows[:, 5], rows[:, 3], rows[:, 2]))]
                if len(rows):
                    begins = np.concatenate([[True], (np.diff(rows[:, 2]) != 0) | (np.diff(rows[:, 3]) != 0) | (rows[1:, 5] > rows[:-1, 6] + 1)])
                    at = np.flatnonzero(begins)
                    ends = np.maximum.reduceat(rows[:, 6], at)
                    rows = rows[at]
                    rows[:, 6] = ends
                    rows[:, 0] = rows[:, 3]  # dealt by document
                c = np.ones(len(rows), bool)
            columns = [np.full(len(rows), settled), rows[:, 0], rows[:, 1], c, rows[:, 2], rows[:, 3], *(rows[:, k].astype(np.int32) for k in (4, 5, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=ROW)

    for whole in batches:
        for b in slices(whole, "text"):
            off, data = string_buffers(b.column("text"))
            a, p0, p1 = anchors(off, data)
            if not len(a):
                continue
            row = np.searchsorted(off, p0, side="right") - 1
            raw = memoryview(np.ascontiguousarray(data))
            key = signed([digest(raw[s : s + GRAM]) for s in a.tolist()])
            ctx = signed([digest(raw[s:e], 1) for s, e in zip(p0.tolist(), (p1 + LENGTH).tolist(), strict=True)])
            ids, h = b.column("doc_id").fill_null(0).to_numpy(), b.column("h").to_numpy()
            base = off[row]
            held.append(np.stack([key, ctx, ids[row], h[row], a - base, p0 - base, p1 - base], axis=1))
            if sum(map(len, held)) > COMBINE:
                yield from flush()
    if held:
        yield from flush()


VERDICT = pa.schema([("todo", pa.bool_()), ("key", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("p0", pa.int32()), ("p1", pa.int32())])


def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ROWs sorted by (settled, key, ctx): ranges that occur twice (todo false), and runs that need refinement.

    Each row is compared with its neighbours only, so a bucket of any size passes.
    """

    def judge(t: dict[str, np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
        key, ctx = t["key"], t["ctx"]
        n = len(key)
        same_key, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # [i]: row i and row i - 1
        same_key[1:n] = (key[1:] == key[:-1]) & (t["settled"][1:] == t["settled"][:-1])
        same[1:n] = same_key[1:n] & (ctx[1:] == ctx[:-1])
        twice = t["copies"] | same[:-1] | same[1:]
        other_before, other_after = same_key[:-1] & ~same[:-1], same_key[1:] & ~same[1:]
        # an unsettled run, and one run of each settled surrounding, if the bucket has another surrounding
        todo = ~t["settled"] & np.where(twice, other_before | (other_after & ~((other_before) | same[:-1])), other_before | other_after)
        todo |= ~t["settled"] & twice & other_after & same[:-1]
        out = []
        for mark, flag in ((twice, False), (todo, True)):
            k = np.flatnonzero(mark[lo:hi]) + lo
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(k), flag)), *(pa.array(t[c][k]) for c in VERDICT.names[1:])], schema=VERDICT))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else out[0]

    tail: dict[str, np.ndarray] | None = None  # a row that is done, then one that waits for its successor
    done = 0
    for b in batches:
        t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        if not len(t["key"]):
            continue
        if tail is not None:
            t = {c: np.concatenate([tail[c], x]) for c, x in t.items()}
        n = len(t["key"])
        if n - 1 > done:
            yield judge(t, done, n - 1)
        tail = {c: x[max(0, n - 2) :].copy() for c, x in t.items()}
        done = len(tail["key"]) - 1
    if tail is not None:
        yield judge(tail, done, done + 1)


# -- refinement --------------------------------------------------------------------


def buckets(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket number of each row of equal keys, and whether the bucket has more than one row."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    number = np.cumsum(new) - 1
    shared = ~(new & np.append(new[1:], True))
    out, many = np.empty(len(order), np.int64), np.empty(len(order), bool)
    out[order], many[order] = number, shared
    return out, many


def repeated(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions whose ``length`` bytes occur at another position of the same group.

    ``bounds`` (contexts + 1) cut ``data`` into contexts; ``group`` has each one's bucket.
    """
    size = np.diff(bounds)
    inside = np.repeat(bounds[1:], size) - np.arange(len(data))  # bytes up to the context's end
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    at = np.flatnonzero(inside >= min(8, length))
    number = np.full(len(data), -1, np.int64)
    # initial buckets: group and first 8 bytes
    own, many = buckets(np.repeat(group, size)[at], word[at])
    number[at[many]] = own[many]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)  # the last round overlaps
        at = np.flatnonzero((number >= 0) & (inside >= depth + step))
        at = at[number[at + step] >= 0]
        own, many = buckets(number[at], number[at + step])
        fresh = np.full(len(data), -1, np.int64)
        fresh[at[many]] = own[many]
        number, depth = fresh, depth + step
    return np.flatnonzero(number >= 0)


def ranges_of(doc: np.ndarray, h: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Runs of string starts, as byte ranges (start, end) of their documents."""
    order = np.lexsort((p, h, doc))
    doc, h, p = doc[order], h[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(h) != 0) | (np.diff(p) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1 if len(p) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(h[first]), pa.array(p[first].astype(np.int64)), pa.array(p[last].astype(np.int64) + LENGTH)], ["doc_id", "h", "s", "e"])


def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges from contexts (key, doc_id, h, p0, raw) sorted by key; whole buckets, about REFINE_BYTES at a time."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])])
        key, doc, h, p0 = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        at = repeated(data, bounds, key)
        c = np.searchsorted(bounds, at, side="right") - 1
        return ranges_of(doc[c], h[c], p0[c] + at - bounds[c])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > REFINE_BYTES and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield solve(held)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of every string of crowded buckets' contexts."""
    for b in batches:
        for key, doc, h, p0, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = len(raw) - LENGTH + 1
            d = [xxhash.xxh3_128_digest(raw[k : k + LENGTH]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(np.full(n, doc)), pa.array(np.full(n, h)), pa.array(np.arange(p0, p0 + n, dtype=np.int64))], ["digest", "doc_id", "h", "s"])


# -- the operator ---------------------------------------------------------------------


def spans(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, *, crowded: int = CROWDED) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, any others) with text replaced, and n_bytes, n_removed, n_spans, kept_sha256.

    The new text is the kept bytes, read as UTF-8 without sequences that a cut left
    incomplete; kept_sha256 is of the bytes themselves.  A null text counts as empty
    and stays null.  Strings are judged on the input.  Repeated rows are copies of
    each other.  A column that has one of the four new names gives way to it.
    """
    spark = docs.sparkSession
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", *new)}
    others = list(names.values())
    # rows are told apart by id and text; two rows that agree in both are copies anyway
    h = F.xxhash64("text", F.lit(1)).alias("__h")
    lean = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), h.alias("h"), "text")
    rows = lean.mapInArrow(bucket_rows, "settled boolean, key long, ctx long, copies boolean, doc_id long, h long, a int, p0 int, p1 int")
    rows = rows.repartition("key").sortWithinPartitions("settled", "key", "ctx")
    said = materialize(rows.mapInArrow(verdicts, "todo boolean, key long, doc_id long, h long, a int, p0 int, p1 int"), "verdicts")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        at = None
        for b in batches:
            at = b.schema.names.index("text")
            z = pa.array([None if t is None else press.compress(t.encode()) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    carried = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), h, F.col("doc_id"), "text", *[F.col(c).alias(v) for c, v in names.items()])
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in carried.schema)
    packed = carried.mapInArrow(shrink, kinds).repartition("__id", "__h")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, h_, z, asked in zip(*(b.column(c).to_pylist() for c in ("__id", "__h", "text", "asked")), strict=True):
                raw = open_.decompress(z)
                keys, p0, p1 = ([x[k] for x in asked] for k in ("key", "p0", "p1"))
                own = [raw[s : e + LENGTH] for s, e in zip(p0, p1, strict=True)]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([h_] * n, pa.int64()), pa.array(p0, pa.int64()), pa.array(own, pa.binary())], ["key", "doc_id", "h", "p0", "raw"])

    todo = said.where("todo")
    asked = todo.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("key", "p0", "p1")).alias("asked"))
    near = packed.join(asked, ["__id", "__h"]).select("__id", "__h", "text", "asked").mapInArrow(contexts, "key long, doc_id long, h long, p0 long, raw binary")
    full = materialize(todo.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key"), "crowded")
    found = said.where(~F.col("todo")).select("doc_id", "h", F.col("p0").cast("long").alias("s"), (F.col("p1") + LENGTH).cast("long").alias("e"))
    kinds_of_range = f"{KEYS}, s long, e long"
    rest = near
    if full.limit(1).count():
        near = materialize(near, "contexts")
        rest = near.join(full, "key", "left_anti")
        many = near.join(full, "key", "left_semi").mapInArrow(digests, f"digest binary, {KEYS}, s long")
        twice = with_group(many, "digest", ["doc_id", "h", "s"], F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        found = found.unionAll(twice.select("doc_id", "h", "s", (F.col("s") + LENGTH).alias("e")))
    found = found.unionAll(rest.repartition("key").sortWithinPartitions("key").mapInArrow(refine, kinds_of_range))
    each = found.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for z, found_ in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw = b"" if z is None else open_.decompress(z)
                gone = spans([(x["s"], x["e"]) for x in found_ or []])
                kept, at = [], 0
                for s, e in gone:
                    kept.append(raw[at:s])
                    at = e
                kept_raw = b"".join([*kept, raw[at:]])
                text = None if z is None else kept_raw.decode(errors="ignore")
                for column, x in zip(out, (text, len(raw), len(raw) - len(kept_raw), len(gone), hashlib.sha256(kept_raw).hexdigest()), strict=True):
                    column.append(x)
            columns = [b.column(c) for c in ("doc_id", *others)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", *others, "text", *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in ("doc_id", *others) for f in [carried.schema[c]])
    result = packed.join(each, ["__id", "__h"], "left").mapInArrow(cut, f"{kinds}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return result.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in new], *new)
