"""SentencePiece encoding and decoding by a relational lattice.

Texts fall apart into units wherever two neighbouring characters stand side by side
in no piece of the model: no path and no merge crosses such a place.  Different
units are encoded once: their substrings of bounded length are exploded and
equi-joined to the piece table, the edges of a unit are grouped, and Spark's
``aggregate`` folds over them:

* a unigram model: Viterbi, the best path to each position, the first of equals by
  start, as the library's decoder takes it;
* a BPE model, whose ids are not those of any best path: merges on the same
  lattice.  The boundaries of a unit are the bits of a long; an edge that spans two
  neighbouring symbols may be merged, that of greatest score (then leftmost) first.
  One pass over the edges in that order does it, unless a merge lets an earlier edge
  in; then the pass starts anew after every merge.

A character that no piece covers becomes an edge of its own and ends up as byte
pieces.  Units travel as lists in blocks of documents, not as single occurrences:
a block keeps its documents as ranks of its own units, and gets the ids of those
units back.  Nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import dataclasses
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import gathered, in_buckets, slices

MARK = "▁"
#: Bytes of text of a block and of a part that is cut at a time; different units of a bucket, about.
BLOCK_BYTES, WORK_BYTES, BUCKET_UNITS = 8 << 20, 1 << 19, 1 << 16
#: Longest unit of the lattice (its boundaries fill a long): longer ones are encoded one by one in Python.
LONG_UNIT = 60
#: Bit of a BPE state that says that a merge let an earlier edge in.
AGAIN = 1 << 62
#: Added to ids in outcomes: code points are below zero.
OUTCOME = 1 << 31
UNKNOWN_PENALTY = 10.0


@dataclasses.dataclass(frozen=True)
class Model:
    """pieces: (piece, id, score) of normal pieces; byte_ids: id of each byte; longest: characters of the longest piece."""

    bpe: bool
    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown_id: int
    longest: int
    floor: float
    """score of an unknown character"""

    @classmethod
    def load(cls, path: str) -> Model:
        """From a model file with identity normalisation, a leading blank and byte fallback (or an unknown piece)."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or not n.escape_whitespaces or n.remove_extra_whitespaces or not n.add_dummy_prefix:
            raise ValueError("only identity normalisation with a leading blank is supported")
        kinds = pb.ModelProto.SentencePiece
        normal = [(p.piece, k, float(p.score)) for k, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in normal):
            raise ValueError("pieces of this model cross words")
        if m.trainer_spec.model_type not in (m.trainer_spec.UNIGRAM, m.trainer_spec.BPE):
            raise ValueError("only unigram and BPE models are supported")
        bytes_ = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        unknown = next(k for k, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        return cls(m.trainer_spec.model_type == m.trainer_spec.BPE, normal, [bytes_.get(b, unknown) for b in range(256)], unknown, max(len(p) for p, _, _ in normal), min(s for _, _, s in normal) - UNKNOWN_PENALTY)


class Cutter:
    """Cuts texts into units: runs of characters whose neighbours stand side by side in some piece."""

    def __init__(self, model: Model) -> None:
        chars = sorted({c for p, _, _ in model.pieces for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p, _, _ in model.pieces:
            k = self.kind[[ord(c) for c in p]]
            self.joined[k[:-1], k[1:]] = True

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different units, the number of each unit of the texts in order, and how many units each text has."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        if not whole:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds = self.kind[points]
        edge = np.append(True, ~self.joined[kinds[:-1], kinds[1:]])
        first = np.cumsum([0, *map(len, marked)])
        edge[first[first < len(points)]] = True
        starts = np.flatnonzero(edge)
        lengths = np.diff(starts, append=len(points))
        at = np.arange(len(points)) - np.repeat(starts, lengths)
        for prime in PRIMES:
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), prime)]), dtype=np.uint64)
            hashes = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * power[at], starts)
            _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
            # equal hashes have to be equal units
            same = starts[one][number]
            if (lengths[one][number] == lengths).all() and (gathered(points, same, lengths) == points).all():
                break
        else:
            raise RuntimeError("units can't be told apart by any of the hashes")
        return [whole[a : a + n] for a, n in zip(starts[one].tolist(), lengths[one].tolist(), strict=True)], number, np.diff(np.searchsorted(starts, first))


#: Multipliers of the hash that tells units apart, one after another.
PRIMES = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def viterbi(unit: str, table: dict[str, tuple[int, float]], model: Model) -> list[int]:
    """Plain Viterbi; ids below -1 stand for characters (-2 - code point)."""
    best: list[tuple[float, int, int] | None] = [None] * (len(unit) + 1)
    best[0] = (0.0, 0, -1)
    for s in range(len(unit)):
        base = best[s][0]
        for e in range(s + 1, min(len(unit), s + model.longest) + 1):
            hit = table.get(unit[s:e])
            if hit is None:
                if e > s + 1:
                    continue
                hit = (-2 - ord(unit[s]), model.floor)
            if best[e] is None or base + hit[1] > best[e][0]:
                best[e] = (base + hit[1], s, hit[0])
    ids, e = [], len(unit)
    while e:
        _, s, k = best[e]
        ids.append(k)
        e = s
    return ids[::-1]


def merges(unit: str, table: dict[str, tuple[int, float]], model: Model) -> list[int]:
    """Plain BPE merges of a unit, greatest score first, then leftmost; ids as in ``viterbi``."""
    n = len(unit)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(s: int) -> None:
        m = after[s]
        if m < n and (hit := table.get(unit[s : after[m]])):
            heapq.heappush(heap, (-hit[1], s, m, after[m]))

    for s in range(n):
        offer(s)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if not alive[s] or m >= n or not alive[m] or after[s] != m or after[m] != e:
            continue
        alive[m] = False
        after[s] = e
        if e < n:
            before[e] = s
        offer(s)
        if before[s] >= 0:
            offer(before[s])
    return [table.get(unit[s : after[s]], (-2 - ord(unit[s]),))[0] for s in range(n) if alive[s]]


def late_pieces(model: Model) -> set[str]:
    """Pieces that can come after a piece of greater or equal score of which they are one of two parts: merging one may let an earlier edge in."""
    score, out = {p: x for p, _, x in model.pieces}, set()
    for p, x in score.items():
        for k in range(1, len(p)):
            parts = p[:k], p[k:]
            if all(len(y) == 1 or y in score for y in parts):
                out.update(y for y in parts if len(y) > 1 and score[y] <= x)
    return out


def lattice(distinct: DataFrame, model: Model, parts: int = 1) -> DataFrame:
    """(unit, path) of different units (unit, none longer than LONG_UNIT): ids in order, characters as -2 - code point.

    ``parts``: partitions that the units are dealt over.
    """
    spark = distinct.sparkSession
    late, rank = late_pieces(model) if model.bpe else set(), {x: k for k, x in enumerate(sorted({x for _, _, x in model.pieces}, reverse=True))}
    table = spark.createDataFrame([(p, k, x, rank[x], p in late) for p, k, x in model.pieces], "piece string, id int, score double, rank int, late boolean")
    rows = distinct.where(F.length("unit") > 0).withColumn("uid", F.monotonically_increasing_id()).repartition(parts, "uid")
    starts = rows.select("uid", "unit", F.length("unit").alias("n"), F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    cuts = starts.select("uid", "unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("s")))).alias("w"))
    cuts = cuts.withColumn("cut", F.substring("unit", F.col("s") + 1, F.col("w")))
    # the piece table has the size of the vocabulary
    edges = cuts.join(F.broadcast(table), F.col("cut") == F.col("piece"), "left").where(F.col("id").isNotNull() | (F.col("w") == 1))
    unit = F.max(F.when((F.col("s") == 0) & (F.col("w") == 1), F.col("unit"))).alias("unit")
    if not model.bpe:
        edge = F.struct((F.col("s") + F.col("w")).alias("e"), "s", F.coalesce("id", -2 - F.ascii("cut")).alias("id"), F.coalesce("score", F.lit(model.floor)).alias("score"))
        return edges.groupBy("uid").agg(unit, F.sort_array(F.collect_list(edge)).alias("edges")).select("unit", fold_viterbi(F.col("edges")).alias("path"))
    # made before the edges are grouped, by compiled code.  An outcome is start and id (or code point) in one long
    s, far = F.col("s"), F.col("s") + F.col("w")
    outcome = lambda k: F.shiftleft(s.cast("long"), 32) + k.cast("long") + F.lit(OUTCOME)
    one = outcome(F.coalesce("id", -2 - F.ascii("cut")))
    # place: rank and start; ends: bits of both ends; inner: bits between them
    longer = F.struct(
        (F.shiftleft(F.col("rank").cast("long"), 6) + s).alias("place"), (power(1, s) + power(1, far)).alias("ends"), (power(1, far) - power(2, s)).alias("inner"),
        "late", outcome(F.col("id")).alias("outcome"),
    )
    ones, more = F.collect_list(F.when(F.col("w") == 1, one)).alias("ones"), F.sort_array(F.collect_list(F.when(F.col("w") > 1, longer))).alias("more")
    return edges.groupBy("uid").agg(unit, ones, more).select("unit", F.transform(F.array(F.struct("ones", "more")), lambda x: fold_merges(x["ones"], x["more"], F.length("unit")))[0].alias("path"))


def power(x: int, by: Column) -> Column:
    """x shifted left, as a long."""
    return F.call_function("shiftleft", F.lit(x).cast("long"), by.cast("int"))


def fold_merges(ones: Column, more: Column, n: Column) -> Column:
    """BPE over the edges ``more`` in order of place; ``ones`` are the outcomes of the n symbols."""

    def fold(edges: Column) -> Column:
        def may(bits: Column, x: Column) -> Column:
            return (F.bit_count(bits.bitwiseAND(x["inner"])) == 1) & (bits.bitwiseAND(x["ends"]) == x["ends"])

        def once(bits: Column, x: Column) -> Column:
            after = bits.bitwiseAND(F.bitwise_not(x["inner"]))
            let_in = x["late"] & F.exists(edges, lambda y: (y["place"] < x["place"]) & may(after, y))
            return F.when(~may(bits, x), bits).when(let_in, after.bitwiseOR(F.lit(AGAIN))).otherwise(after)

        def anew(bits: Column, _: Column) -> Column:
            first = F.get(F.filter(edges, lambda x: may(bits, x)), F.lit(0))["inner"]
            return bits.bitwiseAND(F.bitwise_not(F.coalesce(first, F.lit(0).cast("long"))))

        start = power(2, n) - 1  # every position is a boundary
        rounds = F.slice(F.sequence(F.lit(0), n), 2, F.greatest(n - 1, F.lit(0)))
        passed = F.aggregate(edges, start, once)
        bits = F.transform(F.array(passed), lambda b: F.when(b.bitwiseAND(F.lit(AGAIN)) == 0, b).otherwise(F.aggregate(rounds, start, anew)))

        def path(b: Column) -> Column:
            long = F.transform(F.filter(edges, lambda x: (b.bitwiseAND(x["inner"]) == 0) & (b.bitwiseAND(x["ends"]) == x["ends"])), lambda x: x["outcome"])
            # symbols are left only between two neighbouring boundaries
            alone = lambda x: F.call_function("shiftright", b, F.shiftright(x, 32).cast("int")).bitwiseAND(F.lit(3).cast("long")) == 3
            short = F.when(b.bitwiseAND(F.shiftright(b, 1)) == 0, F.array().cast("array<long>")).otherwise(F.filter(ones, alone))
            return F.transform(F.sort_array(F.concat(long, short)), lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(OUTCOME)).cast("int"))

        return F.transform(bits, path)[0]

    # the list is made once, as the argument of a lambda
    return F.transform(F.array(more), fold)[0]


def fold_viterbi(edges: Column) -> Column:
    """Viterbi over edges (e, s, id, score) in order of end and start: positions finished so far, and the best edge into the current one."""
    node = "struct<score: double, s: int, id: int>"
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(-1).alias("id")).cast(node)
    start = F.struct(F.array().cast(f"array<{node}>").alias("done"), F.lit(0).alias("e"), zero.alias("best"))

    def step(acc, x):
        new_end = x["e"] != acc["e"]
        done = F.when(new_end, F.concat(acc["done"], F.array(acc["best"]))).otherwise(acc["done"])
        score = F.get(done, x["s"])["score"] + x["score"]
        mine = F.struct(score.alias("score"), x["s"].alias("s"), x["id"].alias("id")).cast(node)
        return F.struct(done.alias("done"), x["e"].alias("e"), F.when(new_end | (score > acc["best"]["score"]), mine).otherwise(acc["best"]).alias("best"))

    def back(acc):
        nodes = F.concat(acc["done"], F.array(acc["best"]))
        walk = F.struct(acc["e"].alias("at"), F.array().cast("array<int>").alias("ids"))
        hop = lambda w, _: F.when(w["at"] > 0, F.struct(F.get(nodes, w["at"])["s"].alias("at"), F.concat(F.array(F.get(nodes, w["at"])["id"]), w["ids"]).alias("ids"))).otherwise(w)
        return F.aggregate(acc["done"], walk, hop, lambda w: w["ids"])

    return F.aggregate(edges, start, step, back)


# -- blocks -------------------------------------------------------------------------


def pressed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def opened(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane."""
    return pressed(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opened(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def listed(units: list[str]) -> bytes:
    """Units in one string; only the unit of a line feed holds one."""
    return pressed("\n".join("" if u == "\n" else u for u in units).encode())


def unlisted(raw: bytes) -> list[str]:
    return ["\n" if u == "" else u for u in opened(raw).decode().split("\n")]


def by_bucket(units: list[str], buckets: int) -> list[list[tuple[str, int]]]:
    """The units of each bucket in order, with their places in ``units``."""
    out: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
    for k, u in enumerate(units):
        out[zlib.crc32(u.encode()) % buckets].append((u, k))
    for own in out:
        own.sort()
    return out


def to_blocks(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (block, ids, sizes, ranks, n, units): documents as ranks of the block's units, the frequent ones first, and the n units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, part, number, size = Cutter(model), TaskContext.get().partitionId(), 0, 0
        known: dict[str, int] = {}
        ids, sizes, marks = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            all_ = np.concatenate(marks)
            order = np.argsort(-np.bincount(all_, minlength=len(known)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            names = list(known)
            values = (part << 24 | number, list(ids), planes(np.concatenate(sizes)), planes(rank[all_]), len(names), listed([names[k] for k in order.tolist()]))
            known.clear(), ids.clear(), sizes.clear(), marks.clear()
            number, size = number + 1, 0
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "ids", "sizes", "ranks", "n", "units"])

        for whole in batches:
            for b in slices(whole, "text", WORK_BYTES):
                units, at, each = cutter.cut(b.column("text").to_pylist())
                own = np.fromiter((known.setdefault(u, len(known)) for u in units), np.int64, len(units))
                ids.extend(b.column("doc_id").to_pylist()), sizes.append(each), marks.append(own[at])
                size += b.column("text").nbytes
                if size > BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "block long, ids array<long>, sizes binary, ranks binary, n long, units binary")


def encode(docs: DataFrame, path: str, *, buckets: int | None = None, digests: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every document (doc_id, text); with ``digests`` what ``digest`` makes of them.

    A null or empty text has no id.  Repeated rows are encoded each.  Characters
    without a piece become byte pieces, or the unknown id where the model has none.
    """
    model = Model.load(path)
    blocks = in_buckets(to_blocks(docs, model), "block", "unit_blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or max(16, total // BUCKET_UNITS)

    def plain(p: list[int]) -> list[int]:
        """Characters without a piece as byte pieces."""
        return [y for x in p for y in ([x] if x >= 0 else [model.byte_ids[c] for c in chr(-2 - x).encode()])] if min(p) < -1 else p

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("units").to_pylist(), strict=True):
                own = [(k, listed([u for u, _ in x])) for k, x in enumerate(by_bucket(unlisted(raw), buckets)) if x] if raw else []
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], ["block", "bucket", "raw"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different units of each bucket."""
        seen, now = set(), None
        for b in batches:
            for k, raw in zip(b.column("bucket").to_pylist(), b.column("raw").to_pylist(), strict=True):
                if k != now:
                    seen, now = set(), k
                new = set(unlisted(raw)) - seen
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array([u for u in new if len(u) <= LONG_UNIT], pa.string())], ["unit"])

    lists = blocks.where(F.col("n") > 0).select("block", "units").mapInArrow(ask, "block long, bucket int, raw binary").repartition("bucket")
    distinct = lists.sortWithinPartitions("bucket").mapInArrow(spread, "unit string")
    paths = lattice(distinct, model, max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def pack_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Dictionary rows (bucket, units, their numbers of ids, ids), one for each bucket and batch."""
        for b in batches:
            us, ps = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for k, own in enumerate(by_bucket(us, buckets)):
                if own:
                    mine = [plain(ps[j]) for _, j in own]
                    rows.append((k, listed([u for u, _ in own]), planes(np.array([len(p) for p in mine], np.uint32)), planes(np.fromiter((x for p in mine for x in p), np.uint32))))
            kinds = (pa.int32(), *[pa.binary()] * 3)
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "units", "n", "ids"])

    entries = paths.mapInArrow(pack_paths, "bucket int, units binary, n binary, ids binary")

    def reply(lists_: Iterator[pa.RecordBatch], entries_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block's list of a bucket: the ids of its units."""
        known: dict[str, bytes] = {}
        for b in entries_:
            for us, ns, xs in zip(*(b.column(c).to_pylist() for c in ("units", "n", "ids")), strict=True):
                ends = 4 * np.cumsum(unplanes(ns).astype(np.int64))
                raw = unplanes(xs).tobytes()
                at = 0
                for u, e in zip(unlisted(us), ends.tolist(), strict=True):
                    known[u] = raw[at:e]
                    at = e
        table = None
        for b in lists_:
            for block, k, raw in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "raw")), strict=True):
                own = unlisted(raw)
                for u in own:
                    if u not in known:  # a long unit
                        table = table or {p: (i, x) for p, i, x in model.pieces}
                        known[u] = np.array(plain((merges if model.bpe else viterbi)(u, table, model)), "<u4").tobytes()
                found = [known[u] for u in own]
                n = planes(np.array([len(x) // 4 for x in found], np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([k], pa.int32()), pa.array([n], pa.binary()), pa.array([planes(np.frombuffer(b"".join(found), "<u4"))], pa.binary())], ["block", "bucket", "n", "ids"])

    replies = lists.groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(reply_tables(reply), "block long, bucket int, n binary, ids binary")
    back = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", F.col("n").alias("sizes"), "ids")).alias("replies"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                own = [np.array([j for _, j in x], np.int64) for x in by_bucket(unlisted(row["units"]), buckets)] if row["n"] else []
                sizes, first, found, at = np.zeros(row["n"], np.int64), np.zeros(row["n"], np.int64), [np.zeros(0, "<u4")], 0
                for r in row["replies"] or ():
                    places, n = own[r["bucket"]], unplanes(r["sizes"]).astype(np.int64)
                    sizes[places], first[places] = n, at + np.cumsum(n) - n
                    found.append(unplanes(r["ids"]))
                    at += len(found[-1])
                every, ranks = np.concatenate(found).astype(np.int32), unplanes(row["ranks"])
                ends = np.concatenate([[0], np.cumsum(unplanes(row["sizes"]).astype(np.int64))])
                for lo in range(0, len(row["ids"]), 256):
                    hi = min(lo + 256, len(row["ids"]))
                    u = ranks[ends[lo] : ends[hi]]
                    n = sizes[u]
                    total = np.concatenate([[0], np.cumsum(n)])
                    off = total[ends[lo : hi + 1] - ends[lo]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"][lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(gathered(every, first[u], n)))], ["doc_id", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In the same worker: ids don't travel between two."""
        return digests_of(assemble(batches), model)

    run, kinds = (digested, DIGEST) if digests else (assemble, "doc_id long, ids array<int>")
    return blocks.join(back, "block", "left").select("ids", "sizes", "ranks", "n", "units", "replies").mapInArrow(run, kinds)


def reply_tables(f):
    """A function of two batch iterators as one of two tables (those of one block or bucket)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(f(iter(left.to_batches(max_chunksize=64)), iter(right.to_batches(max_chunksize=64))))
        return pa.Table.from_batches(out)

    return run


class Decoder:
    """Ids to texts: pieces joined, marks to blanks, the leading blank dropped.

    Bytes that are no UTF-8 become U+FFFD; control ids (unknown, begin, end) give nothing.
    """

    def __init__(self, model: Model) -> None:
        text_of = {k: p.replace(MARK, " ").encode() for p, k, _ in model.pieces} | {k: bytes([b]) for b, k in enumerate(model.byte_ids) if k != model.unknown_id}
        raw = [text_of.get(k, b"") for k in range(max(text_of, default=0) + 1)]
        self.raw, self.lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ranges of ``ids`` that begin at 0 and end at ``ends``."""
        n = self.lengths[ids]
        raw = gathered(self.raw, self.starts[ids], n).tobytes()
        at = np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        texts = (raw[a:b].decode(errors="replace") for a, b in zip([0, *at[:-1]], at, strict=True))
        return [t[1:] if t[:1] == " " else t for t in texts]


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of ids one after another, and where each list ends; a null has none."""
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    return ids, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null."""
    model = Model.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = decoder.texts(*flat(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string(), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


DIGEST = "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long"


def digests_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(model)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            ids, ends = flat(part.column(1))
            raw, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            columns = [np.diff(ends, prepend=0), [zlib.crc32(raw[a:e]) for a, e in zip(cuts, cuts[1:], strict=False)], [zlib.crc32(t.encode()) for t in decoder.texts(ids, ends)]]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "ids_crc32", "text_crc32"])


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), text_crc32 (of the decoded text as UTF-8)."""
    model = Model.load(path)
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: digests_of(batches, model), DIGEST)
