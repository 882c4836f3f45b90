"""Packing of token sequences by minimum bin slack.

Documents are cut into full windows and one rest.  Only the *counts* of piece
lengths (at most ``window`` numbers) reach the driver, which plans windows one
pattern at a time: the longest length left is set, and a bitset subset-sum over
the lengths left finds the multiset that comes closest to the capacity; counts
are found by walking the bitsets back.  A pattern is repeated while its lengths
last, so there are about as many patterns as lengths, whatever the corpus size.
Pieces are numbered within their length in parallel and look their window up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm import tokenizing
from skeinwork.llm.common import materialize, slices


def padding(total: int, window: int) -> int:
    """Padding of a sequence: up to the window, none at a power of two."""
    return 0 if total & (total - 1) == 0 else window - total


def closest(counts: dict[int, int], seed: int, window: int) -> dict[int, int]:
    """The multiset with one ``seed`` that leaves the least padding (then the greatest total): length -> times."""
    space = window - seed
    mask = (1 << (space + 1)) - 1
    reach, trail = 1, []
    for length in sorted(counts, reverse=True):
        times = min(counts[length] - (length == seed), space // length)
        if times <= 0:
            continue
        trail.append((length, times, reach))
        step, left = 1, times
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left, step = left - step, step * 2
        if reach >> space & 1:
            break
    totals = {reach.bit_length() - 1} | {p - seed for p in (1 << k for k in range(window.bit_length())) if p >= seed and reach >> (p - seed) & 1}
    at = min(totals, key=lambda x: (padding(x + seed, window), -x))
    used = {seed: 1}
    for length, times, before in reversed(trail):
        k = next(k for k in range(times + 1) if at >= k * length and before >> (at - k * length) & 1)
        at -= k * length
        if k:
            used[length] = used.get(length, 0) + k
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first, last, times, sequence, offset).

    The pieces of ``length`` numbered first .. last - 1 lie there; ``times`` of them
    follow each other in each sequence from ``sequence`` on, beginning at ``offset``.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    done = dict.fromkeys(left, 0)
    slots, sequence = [], 0
    while left:
        pattern = closest(left, max(left), window)
        repeats = min(left[k] // v for k, v in pattern.items())
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            slots.append((length, done[length], done[length] + repeats * times, times, sequence, offset))
            done[length] += repeats * times
            left[length] -= repeats * times
            offset += length * times
            if not left[length]:
                del left[length]
        sequence += repeats
    return slots


def pieces(docs: DataFrame, vocabulary: str, *, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of each document (doc_id, text), numbered within (part, length).

    A null or empty text is the end id alone.  Repeated rows give pieces of their own.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for b in (x for whole in batches for x in slices(whole, "text")):
            out: list[list] = [[] for _ in names]
            for doc, raw in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    row = [doc, start, length, zlib.crc32(piece), n, part, int(seen[length])] + [piece] * keep_ids
                    seen[length] += 1
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    kinds = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, kinds)


def place(cut: DataFrame, window: int) -> DataFrame:
    """Sequence and offset of each row of ``cut`` (length, part, number and any other columns).

    ``cut`` must be read from written files: its rows are read more than once.
    """
    spark = cut.sparkSession
    each = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = each.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    # at most `window` rows
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, window), "length long, first long, last long, times long, sequence long, at long")
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("number")).drop("before")
    # slots: a few for each of at most `window` lengths, so the broadcast has a fixed bound
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    k = F.col("rank") - F.col("first")
    return (
        ranked.join(s, inside)
        .withColumn("sequence_id", F.col("sequence") + F.floor(k / F.col("times")).cast("long"))
        .withColumn("offset", F.col("at") + (k % F.col("times")) * F.col("length"))
        .drop("slot_length", "first", "last", "times", "sequence", "at", "rank", "part", "number")
    )


def pack(docs: DataFrame, vocabulary: str, *, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Other columns of ``docs`` are not read.  An empty table gives no piece.
    """
    cut = materialize(pieces(docs, vocabulary, window=window, end_id=end_id, keep_ids=keep_ids), "pieces")
    keep = ["ids"] if keep_ids else []
    return place(cut, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *keep)
