"""Pairing each left record with the nearest right record in time of the same entity.

A stateful stream join: both sides are read in order of time, kept in a buffer per
entity, and a left row is emitted once the watermark has passed its tolerance
horizon, since no better partner can come after that. Rows that no open left row
can need any more are evicted. :func:`nearest_in_time` replays tables this way,
:func:`stream_nearest` does the same with Structured Streaming state.

An entity's time is cut into spans; right rows within the tolerance of a span's
edge are copied to the neighbouring span. So a hot entity is spread over many
tasks or state keys, and no buffer holds more than a span.

Of equally near right rows the earlier counts, then the one of smaller sequence
number. Left rows without a partner within the tolerance give no row. Rows of
either side with a null entity, time or sequence number are left out. Empty
tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIGHT, LEFT = 0, 1
SPAN_US = 600_000_000


class NearestBuffer:
    """Both sides of the join while they may still matter. Rows must come sorted by group, time, side and sequence."""

    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance
        self.rows = [np.empty(0, "int64") for _ in range(4)]

    def push(self, group: np.ndarray, time: np.ndarray, side: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take rows in; give the pairs of all left rows the watermark (the last row) has passed."""
        self.rows = [np.concatenate(x) for x in zip(self.rows, (group, time, side, seq), strict=True)]
        if not len(self.rows[0]):
            return self.rows[3], self.rows[3]
        at, now = self.rows[0][-1], self.rows[1][-1]
        return self._emit((self.rows[0] < at) | (self.rows[1] + self.tolerance < now), at, now)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the remaining left rows, at the end of input."""
        return self._emit(np.ones(len(self.rows[0]), bool), None, None)

    def _emit(self, passed: np.ndarray, at, now) -> tuple[np.ndarray, np.ndarray]:
        group, time, side, seq = self.rows
        left = np.flatnonzero((side == LEFT) & passed)
        partner = nearest(group, time, side, left, self.tolerance)
        found = partner >= 0
        out = seq[left[found]], seq[partner[found]]
        if at is None:
            keep = np.zeros(len(group), bool)
        else:
            keep = (group == at) & (time >= now - 2 * self.tolerance) & ~((side == LEFT) & passed)
        self.rows = [x[keep] for x in self.rows]
        return out


def nearest(group: np.ndarray, time: np.ndarray, side: np.ndarray, left: np.ndarray, tolerance: int) -> np.ndarray:
    """Index of the nearest right row of each row of ``left``, -1 for none. Arrays are sorted by group, time, side, sequence."""
    n = len(group)
    if not n or not len(left):
        return np.full(len(left), -1)
    index = np.arange(n)
    right = side == RIGHT
    fresh = right.copy()
    fresh[1:] &= (group[1:] != group[:-1]) | (time[1:] != time[:-1]) | ~right[:-1]
    first = np.maximum.accumulate(np.where(fresh, index, -1))
    before = np.maximum.accumulate(np.where(right, index, -1))[left]
    after = np.minimum.accumulate(np.where(right, index, n)[::-1])[::-1][left]
    far = np.iinfo("int64").max
    back = np.where((before >= 0) & (group[before] == group[left]), time[left] - time[before], far)
    after_at = np.minimum(after, n - 1)
    ahead = np.where((after < n) & (group[after_at] == group[left]), time[after_at] - time[left], far)
    best = np.where(back <= ahead, first[before], after_at)
    return np.where(np.minimum(back, ahead) <= tolerance, best, -1)


def _sides(left: DataFrame, right: DataFrame, entity: str, time: str, seq: str, tolerance_us: int, span_us: int) -> DataFrame:
    if tolerance_us > span_us:
        raise ValueError("the tolerance must not exceed a span")
    column = F.col(time)
    span = lambda c: ((c - F.pmod(c, F.lit(span_us))) / span_us).cast("long")
    base = [F.col(entity).alias("entity"), column.cast("long").alias("time"), F.col(seq).cast("long").alias("seq")]
    lefts = left.select(*base).dropna().withColumn("span", span(F.col("time"))).withColumn("side", F.lit(LEFT))
    rights = right.select(*base).dropna()
    reach = F.array_distinct(F.array(span(F.col("time") - tolerance_us), span(F.col("time")), span(F.col("time") + tolerance_us)))
    rights = rights.withColumn("span", F.explode(reach)).withColumn("side", F.lit(RIGHT))
    return lefts.unionByName(rights)


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, time: str, seq: str, tolerance_us: int, span_us: int = SPAN_US) -> DataFrame:
    """``left_seq``, ``right_seq`` of each left row with a partner; ``time`` in microseconds."""
    both = _sides(left, right, entity, time, seq, tolerance_us, span_us)
    ordered = both.repartition("entity", "span").sortWithinPartitions("entity", "span", "time", "side", "seq")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, number, last = NearestBuffer(tolerance_us), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            name, span = batch.column("entity"), batch.column("span").to_numpy()
            cut = np.zeros(len(span), bool)
            cut[1:] = span[1:] != span[:-1]
            cut[1:] |= pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)).to_numpy(zero_copy_only=False)
            cut[0] = last != (name[0].as_py(), span[0])
            group = number + np.cumsum(cut)
            number, last = int(group[-1]), (name[-1].as_py(), span[-1])
            yield _pairs(buffer.push(group, *(batch.column(c).to_numpy().astype("int64") for c in ("time", "side", "seq"))))
        yield _pairs(buffer.flush())

    return ordered.mapInArrow(kernel, "left_seq long, right_seq long")


def _pairs(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["left_seq", "right_seq"])


def stream_nearest(left: DataFrame, right: DataFrame, entity: str, time: str, seq: str, tolerance_us: int, lateness: str = "1 minute", span_us: int = SPAN_US) -> DataFrame:
    """The same join over two streams. Rows that arrive behind the watermark by more than ``lateness`` are dropped.

    State per (entity, span) holds open left rows and the right rows they may still
    need; it ends when the watermark has passed the span and its tolerance.
    """
    both = _sides(left, right, entity, time, seq, tolerance_us, span_us)
    timed = both.withColumn("event_time", F.timestamp_micros("time")).withWatermark("event_time", lateness)

    def step(key, frames, state):
        rows = [pd.DataFrame(dict(zip(("time", "side", "seq"), state.get, strict=True)))] if state.exists else []
        rows += [f[["time", "side", "seq"]] for f in frames]
        held = pd.concat(rows, ignore_index=True).astype("int64").sort_values(["time", "side", "seq"], kind="stable")
        mark = state.getCurrentWatermarkMs() * 1000
        end = (int(key[1]) + 1) * span_us + tolerance_us
        held_time, side, number = (held[c].to_numpy() for c in ("time", "side", "seq"))
        passed = held_time + tolerance_us < mark if not state.hasTimedOut else np.ones(len(held), bool)
        lefts = np.flatnonzero((side == LEFT) & passed)
        partner = nearest(np.zeros(len(held), "int64"), held_time, side, lefts, tolerance_us)
        out = pd.DataFrame({"left_seq": number[lefts[partner >= 0]], "right_seq": number[partner[partner >= 0]]})
        keep = (held_time >= mark - 2 * tolerance_us) & ~((side == LEFT) & passed)
        if state.hasTimedOut or not keep.any():
            state.remove()
        else:
            state.update(tuple(x[keep].tolist() for x in (held_time, side, number)))
            state.setTimeoutTimestamp(max(end, mark) // 1000 + 1)
        yield out

    return timed.groupBy("entity", "span").applyInPandasWithState(
        step, "left_seq long, right_seq long", "time array<long>, side array<long>, seq array<long>", "append", "EventTimeTimeout"
    )
