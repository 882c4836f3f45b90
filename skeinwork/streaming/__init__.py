"""Streaming forms of batch operators (beyond what batch files need)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skeinwork.operators import levels
from skeinwork.storage import settle


def last_operations(updates: DataFrame) -> DataFrame:
    """Running state of a stream of updates (seq, src, dst, typ): the last operation on each edge.  Write it in update or complete mode."""
    return updates.groupBy("src", "dst").agg(F.max("seq").alias("seq"), F.max_by("typ", "seq").alias("typ"))


def live_edges(updates: DataFrame) -> DataFrame:
    """The edge set of a stream of updates, for complete mode; equals batch replay of the same updates."""
    return last_operations(updates).where(F.col("typ") != 0).select("src", "dst")


class LastOperation(StatefulProcessor):
    """Keeps (seq, typ) of the last operation on an edge, and tells when the edge comes or goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, typ int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        last = before
        for part in rows:
            r = part.loc[part["seq"].idxmax()]
            # an operation that was seen already, or that a later one has overtaken, changes nothing
            if last is None or r["seq"] > last[0]:
                last = (int(r["seq"]), int(r["typ"]))
        if last == before:
            return
        self.last.update(last)
        present = last[1] != 0
        if present != (before is not None and before[1] != 0):
            yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "seq": [last[0]], "present": [present]})

    def close(self) -> None:
        pass


def changes(updates: DataFrame) -> DataFrame:
    """src, dst, seq, present: one row for each edge that a micro-batch of updates (seq, src, dst, typ) brings or takes away.

    Unlike ``live_edges``, a trigger writes only what it changes.  State is a number
    and a type an edge, in the state store; updates may come in any order and more than
    once.  Rows with a null in src, dst, seq or typ are left out.  Write it in update
    or append mode; the session needs RocksDB as its state store.
    """
    rows = updates.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("seq").cast("long").alias("seq"), F.col("typ").cast("int").alias("typ")).dropna()
    return rows.groupBy("src", "dst").transformWithStateInPandas(LastOperation(), outputStructType="src long, dst long, seq long, present boolean", outputMode="Update", timeMode="None")


def edges_after(changed: DataFrame) -> DataFrame:
    """The edge set that all written changes lead to."""
    return changed.groupBy("src", "dst").agg(F.max_by("present", "seq").alias("present")).where("present").select("src", "dst")


def rates(events: DataFrame, ts: str = "ts", width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events in tumbling or sliding windows; rows later than ``late`` are left out by a stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    got = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "events")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    got = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


class LevelStream:
    """A levelled store fed by micro-batches; ``levels`` holds the table of each occupied level."""

    def __init__(self, store: levels.Store):
        self.store, self.levels, self.done = store, {}, -1

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Carry one batch (src, dst, weight, diff); a batch that was seen already changes nothing."""
        if batch_id <= self.done:
            return
        free = next((t for t in range(self.store.levels) if t not in self.levels), None)
        if free is None:
            raise ValueError("all_levels_occupied")
        carry = levels.coalesced(batch)
        below = [t for t in self.levels if t < free]
        for t in below:
            carry = carry.unionByName(self.levels[t])
        carry = settle(levels.coalesced(carry), "carry")
        for t in below:
            del self.levels[t]
        if carry.limit(1).count():
            self.levels[free] = carry
        self.done = batch_id

    def start(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        return edges.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()
