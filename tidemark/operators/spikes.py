"""Implausible measurements of a source, relative to that source's normal behaviour.

Two detectors share the chunked order of ``ordered.py``:

* :func:`running_median_flags` compares each value with the median of its
  neighbours, scaled by the median deviation of the whole group;
* :func:`kalman_flags` forecasts each value with a local-level Kalman filter,
  flags standardised innovations above a threshold, withholds flagged values
  from the state and reports a source whose innovation variance vanishes as stuck.

Rows without group, time or value (null or NaN) are left out. Equal rows are kept
and ordered by their sequence number. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import key_blocks
from tidemark.operators.ordered import group_medians, into_chunks, order_statistics, with_positions
from tidemark.session import materialize

CHUNK = 4096


def _rolling_median(values: np.ndarray, block: np.ndarray, reach: int) -> np.ndarray:
    """Median of each value with up to ``reach`` neighbours to either side within its block."""
    width = 2 * reach + 1
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(values, reach, constant_values=np.nan), width)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(block, reach, constant_values=-1), width)
    rows = np.where(near == block[:, None], wide, np.nan)
    count = (near == block[:, None]).sum(1)
    rows.sort(axis=1)
    at = np.arange(len(values))
    return (rows[at, (count - 1) // 2] + rows[at, count // 2]) / 2.0


def _run_lengths(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Length of the run of identical values each row stands in."""
    cut = np.ones(len(values), bool)
    cut[1:] = (values[1:] != values[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(values)))
    return np.repeat(sizes, sizes)


def _chunked(rows: DataFrame, group: list[str], slot: Column, order: list[str], halo: int, size: int) -> DataFrame:
    placed = with_positions(rows.withColumn("_slot", slot), group, "_slot", order)
    keys = [*group, "chunk"]
    return into_chunks(placed.drop("_slot"), "pos", size, halo).repartition(*keys).sortWithinPartitions(*keys, "pos")


def running_median_flags(rows: DataFrame, group: list[str], slot: Column, order: list[str], seq: str, value: str, reach: int, factor: float, min_run: int, chunk: int = CHUNK) -> DataFrame:
    """Rows (``group``, ``seq``) that are not above 0, deviate from the local median by more
    than ``factor`` times the group's median deviation, or stand in a run of ``min_run`` equal values.
    """
    halo = max(reach, min_run - 1)
    keys = [*group, "chunk"]
    wanted = list(dict.fromkeys([*group, *order, seq, value]))
    clean = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).dropna(subset=[*group, *order]).select(*wanted)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{g}` {types[g]}" for g in group), f"`{seq}` long", "deviation double", "certain boolean"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, block in key_blocks(batches, keys):
            x = table.column(value).to_numpy()
            own = table.column("own").to_numpy(zero_copy_only=False)
            off = np.abs(x - _rolling_median(x, block, reach))
            sure = (x <= 0) | (_run_lengths(x, block) >= min_run)
            out = [*(table.column(g) for g in group), table.column(seq), pa.array(off), pa.array(sure)]
            yield from pa.table(out, names=[*group, seq, "deviation", "certain"]).filter(pa.array(own)).to_batches()

    scored = materialize(_chunked(clean, group, slot, order, halo, chunk).select(*keys, "own", value, seq).mapInArrow(kernel, schema), "deviations")
    usual = group_medians(scored, group, "deviation", "usual")
    suspects = scored.filter(F.col("certain") | (F.col("deviation") > 0))
    judged = suspects.join(usual, group)
    return judged.filter(F.col("certain") | (F.col("deviation") > factor * F.col("usual"))).select(*group, seq)


def level_flags(rows: DataFrame, group: list[str], slot: Column, order: list[str], seq: str, value: str, factor: float, min_run: int, chunk: int = CHUNK) -> DataFrame:
    """Rows (``group``, ``seq``) below 0, above ``factor`` times the group's median, or in a run of ``min_run`` equal values above 0."""
    keys = [*group, "chunk"]
    wanted = list(dict.fromkeys([*group, *order, seq, value]))
    clean = rows.dropna(subset=[*group, *order, value]).select(*wanted)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{g}` {types[g]}" for g in group), f"`{seq}` long", "level double", "certain boolean"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, block in key_blocks(batches, keys):
            x = table.column(value).to_numpy()
            own = table.column("own").to_numpy(zero_copy_only=False)
            sure = (x < 0) | ((_run_lengths(x, block) >= min_run) & (x > 0))
            out = [*(table.column(g) for g in group), table.column(seq), pa.array(x.astype("float64")), pa.array(sure)]
            yield from pa.table(out, names=[*group, seq, "level", "certain"]).filter(pa.array(own)).to_batches()

    scored = materialize(_chunked(clean, group, slot, order, min_run - 1, chunk).select(*keys, "own", value, seq).mapInArrow(kernel, schema), "levels")
    usual = group_medians(scored, group, "level", "usual")
    judged = scored.join(usual, group)
    return judged.filter(F.col("certain") | (F.col("level") > factor * F.col("usual"))).select(*group, seq)


#: Weights of the newest value in the two forgetting estimates: of the noise, and of the innovation variance that may vanish.
NOISE_WEIGHT, VANISH_WEIGHT = 0.02, 0.5
#: The innovation variance has vanished below this share of the group's normal one; steps of at most STILL of the normal step belong to one stuck run.
VANISHED, STILL = 0.001, 0.03
#: Rows that the lockstep filter holds at most, beyond one chunk.
HELD_ROWS = 1 << 20


@dataclass(frozen=True)
class LocalLevel:
    """A local-level model: ``process`` is the level's step variance in units of the noise variance.

    A value is a spike above ``threshold`` standard deviations of its forecast. After ``restart``
    withheld values in a row that agree with each other the level has moved there.
    """

    threshold: float = 8.0
    process: float = 1.0
    restart: int = 6


def kalman_flags(rows: DataFrame, group: list[str], slot: Column, order: list[str], seq: str, value: Column, impossible: Column, resting: Column, model: LocalLevel = LocalLevel(), warm_up: int = 256, chunk: int = CHUNK) -> DataFrame:
    """Rows (``group``, ``seq``, ``reason``, ``score``) that a local-level Kalman filter finds implausible.

    Each value is forecast from those before it; ``score`` is its standardised innovation. Reasons:

    * ``impossible``: the condition of that name holds; the value is withheld from the state;
    * ``spike``: the score is above the model's threshold; the value is withheld, that is the level
      is only predicted forward, until withheld values that agree show that the level moved;
    * ``stuck``: the innovation variance, estimated with forgetting from accepted values, vanished
      against the group's normal one. The whole run of values without a step worth mention is
      flagged, its first rows included; rows that are ``resting`` are not.

    A group's normal is its quartiles (level and spread before the first value) and the median step
    between neighbours of one slot (noise). Groups are filtered in chunks of ``chunk`` rows, a third or
    more of all rows may be in one group. Each chunk starts from the group's normal ``warm_up`` rows
    early; that is the definition of a score, which depends on nothing farther back than that.
    """
    wanted = list(dict.fromkeys([*group, *order, seq]))
    clean = rows.withColumns({"_x": value.cast("double"), "_bad": F.coalesce(impossible, F.lit(False)), "_rest": F.coalesce(resting, F.lit(False)), "_slot": slot})
    clean = clean.filter(F.col("_x").isNotNull() & ~F.isnan("_x")).dropna(subset=[*group, *order]).select(*wanted, "_x", "_bad", "_rest", "_slot")
    step = F.abs(F.col("_x") - F.lag("_x").over(Window.partitionBy(*group, "_slot").orderBy(*order)))
    placed = with_positions(clean, group, "_slot", order).withColumn("_step", step)
    placed = materialize(placed.select(*group, "pos", F.col(seq).alias("_seq"), "_x", "_bad", "_rest", "_step"), "measured")
    sound = placed.filter("NOT _bad")
    spread = order_statistics(sound, group, "_x", {"_q1": "(_all + 3) div 4", "_q2": "(_all + 1) div 2", "_q3": "(3 * _all + 3) div 4"})
    steps = order_statistics(sound, group, "_step", {"_usual": "(_all + 1) div 2"})
    wide = (F.col("_q3") - F.col("_q1")) / 1.349
    normal = F.greatest(F.coalesce(F.col("_usual") * 1.4826, wide), F.abs("_q2") * 1e-4, F.lit(1e-9))
    usual = spread.join(steps, group, "left").select(*group, F.col("_q2").alias("_level"), F.greatest(wide, normal).alias("_wide"), normal.alias("_normal"))
    keys = [*group, "chunk"]
    cut = into_chunks(placed.drop("_step"), "pos", chunk, warm_up).join(usual, group).repartition(*keys).sortWithinPartitions(*keys, "pos")
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{g}` {types[g]}" for g in group), f"`{seq}` long", "reason string", "score double"])

    def flagged(held: list[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.concat_tables(t for t, _ in held)
        sizes = np.concatenate([np.bincount(b) for _, b in held])
        column = lambda c: table.column(c).to_numpy()
        start = np.cumsum(sizes) - sizes
        x, bad = column("_x"), column("_bad")
        score, spike, vanished = _lockstep(x, bad, sizes, *(column(c)[start] for c in ("_level", "_wide", "_normal")), model)
        stuck = _stuck(x, sizes, vanished, column("_normal")) & ~column("_rest")
        reason = np.select([bad, spike, stuck], ["impossible", "spike", "stuck"], "")
        out = [*(table.column(g) for g in group), table.column("_seq"), pa.array(reason, pa.string()), pa.array(score)]
        yield from pa.table(out, names=[*group, seq, "reason", "score"]).filter(pa.array(column("own") & (reason != ""))).to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table, block in key_blocks(batches, keys):
            held.append((table, block))
            size += table.num_rows
            if size >= HELD_ROWS:
                yield from flagged(held)
                held, size = [], 0
        yield from flagged(held)

    return cut.select(*keys, "own", "_seq", "_x", "_bad", "_rest", "_level", "_wide", "_normal").mapInArrow(kernel, schema)


def _lockstep(x: np.ndarray, bad: np.ndarray, sizes: np.ndarray, level: np.ndarray, wide: np.ndarray, normal: np.ndarray, model: LocalLevel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, spike and vanished variance of each value; blocks of ``sizes`` rows are filtered side by side, one step of all at a time."""
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    running = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    level, normal = level[order].copy(), normal[order] * normal[order]
    p, r, v = wide[order] * wide[order], normal.copy(), normal.copy()
    held, agreed = np.zeros(len(order), "int64"), np.zeros(len(order))
    score, spike, vanished = np.zeros(len(x)), np.zeros(len(x), bool), np.zeros(len(x), bool)
    for i, n in enumerate(running):
        at = start[:n] + i
        now, out = x[at], bad[at]
        ahead = p[:n] + model.process * r[:n]
        s = ahead + r[:n]
        root = np.sqrt(s)
        e = now - level[:n]
        z = np.abs(e) / root
        far = (z > model.threshold) & ~out
        fine = ~far & ~out
        score[at], spike[at] = z, far
        near = far & (held[:n] > 0) & (np.abs(now - agreed[:n]) / root <= model.threshold)
        count = np.where(far, np.where(near, held[:n] + 1, 1), np.where(fine, 0, held[:n]))
        agreed[:n] = np.where(near, agreed[:n] + (now - agreed[:n]) / np.maximum(count, 1), np.where(far, now, agreed[:n]))
        moved = far & (count >= model.restart)
        held[:n] = np.where(moved, 0, count)
        gain = ahead / s
        level[:n] = np.where(moved, agreed[:n], np.where(fine, level[:n] + gain * e, level[:n]))
        noise = np.maximum((1 - NOISE_WEIGHT) * r[:n] + NOISE_WEIGHT * e * e * r[:n] / s, normal[:n] / 16)
        p[:n] = np.where(moved, r[:n], np.where(fine, ahead * (1 - gain), ahead))
        v[:n] = np.where(moved, normal[:n], np.where(fine, (1 - VANISH_WEIGHT) * v[:n] + VANISH_WEIGHT * e * e, v[:n]))
        r[:n] = np.where(fine, noise, r[:n])
        vanished[at] = fine & (v[:n] < VANISHED * normal[:n])
    return score, spike, vanished


def _stuck(x: np.ndarray, sizes: np.ndarray, vanished: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Rows of the runs without a real step in which the innovation variance vanished."""
    first = np.zeros(len(x), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    first[1:] |= np.abs(x[1:] - x[:-1]) > STILL * normal[1:]
    run = np.cumsum(first) - 1
    return np.isin(run, run[vanished])
