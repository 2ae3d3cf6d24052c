"""Items that appear together: pair counts and how far they exceed chance.

Items get 32-bit numbers in code point order, a pair is one 64-bit code. Each task
collects codes up to a fixed run size, sorts the run and writes it with run
lengths, so frequent pairs shrink before the shuffle; the shuffle's external sort
merges the sorted runs and a streaming pass adds up equal codes. The association of
a pair is given as ratio to independence and as odds ratio with the usual
continuity correction of one half in each cell.

Null and empty lists count for nothing; an item counts once per record. An empty
input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

RUN_CODES = 1 << 21
#: Bounds of the item table that may be sent to every executor; beyond them numbers come by a join.
MAX_SENT_ITEMS = 1_000_000
MAX_SENT_BYTES = 32 << 20
#: Partitions in which more items than that are numbered.
PARTS = 512


def pair_counts(records: DataFrame, record: str, items: str, min_count: int = 1, max_sent: int = MAX_SENT_ITEMS) -> DataFrame:
    """``item_a`` < ``item_b``, ``n_ab``, ``n_a``, ``n_b``, ``n_all``, ``ratio`` and ``odds_ratio`` of pairs with at least ``min_count`` records.

    ``items`` is an array of strings in any order; nulls and empty ones drop out. Each
    row is a record of its own, whether its ``record`` is null or repeated.
    """
    sound = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))
    named = records.select(F.col(record).alias("record"), sound.alias("items")).filter(F.size("items") > 0)
    # the empty string is no item; as one more element it counts the records
    counts = named.select(F.explode(F.concat("items", F.array(F.lit("")))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "items")
    facts = counts.agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("item") + 16).alias("bytes"), F.max(F.when(F.col("item") == "", F.col("n"))).alias("n_all")).first()
    sent = facts["items"] <= max_sent and (facts["bytes"] or 0) <= MAX_SENT_BYTES
    if sent:
        words = sorted(r["item"] for r in counts.select("item").filter("item <> ''").collect())
        numbered = counts.sparkSession.createDataFrame(pa.table({"item": pa.array(words, pa.string()), "id": pa.array(range(len(words)), pa.int64())}))
        lists = _by_lookup(named, words)
    else:
        numbered = materialize(_numbers(counts.filter("item <> ''").select("item")), "item-numbers")
        # numbers are written out, so that a repeated task can't give others
        rows = materialize(named.select(F.monotonically_increasing_id().alias("record"), "items"), "item-lists")
        told = rows.select("record", F.explode("items").alias("item")).join(numbered, "item")
        lists = told.groupBy("record").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids")
    merged = _merge(_runs(lists).repartition("code").sortWithinPartitions("code")).filter(F.col("n_ab") >= min_count)
    vocabulary = numbered.join(counts, "item")
    one = lambda tag: vocabulary.select(F.col("id").alias(f"_{tag}"), F.col("item").alias(f"item_{tag}"), F.col("n").alias(f"n_{tag}"))
    pairs = merged.withColumn("_a", F.shiftrightunsigned("code", 32)).withColumn("_b", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = pairs.join(one("a"), "_a").join(one("b"), "_b").withColumn("n_all", F.lit(facts["n_all"] or 0).cast("long"))
    if not sent:  # then numbers follow no order
        swap = F.col("item_a") > F.col("item_b")
        pairs = pairs.select(
            "n_ab", "n_all",
            *(F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("item", "n") for x, y in ("ab", "ba")),
        )
    half = F.lit(0.5)
    only_a, only_b = F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = F.col("n_all") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return pairs.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n_all",
        (F.col("n_ab").cast("double") * F.col("n_all") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("ratio"),
        ((F.col("n_ab") + half) * (neither + half) / ((only_a + half) * (only_b + half))).alias("odds_ratio"),
    )


def above_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs with n_ab × n_all ≥ times × n_a × n_b, compared as exact integers."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.filter(exact("n_ab") * exact("n_all") >= (F.col("n_a") * times).cast("decimal(19,0)") * exact("n_b"))


def _numbers(items: DataFrame) -> DataFrame:
    """Dense numbers from 0 for items too many to be sent: places in partitions, written out, plus the sizes of the partitions before."""
    placed = materialize(items.repartition(PARTS, "item").sortWithinPartitions("item").select("item", F.monotonically_increasing_id().alias("_at")), "item-places")
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    if total > 1 << 32:
        raise ValueError("a packed pair code holds numbers of 32 bits; there are more items than that")
    first = F.element_at(F.create_map(*(F.lit(x) for p, n in starts.items() for x in (p, n))), part) if starts else F.lit(0)
    return placed.select("item", (first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("id"))


def _by_lookup(named: DataFrame, words: list[str]) -> DataFrame:
    sent = named.sparkSession.sparkContext.broadcast(words)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            lists = batch.column(0)
            ids = pc.index_in(lists.flatten(), value_set=known).cast(pa.int64())
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids)], names=["ids"])

    return named.select("items").mapInArrow(kernel, "ids array<long>")


def _runs(lists: DataFrame) -> DataFrame:
    """Sorted runs of pair codes with their run lengths."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            for codes in _codes(column.flatten().to_numpy(), offsets):
                held.append(codes)
                size += len(codes)
                if size >= RUN_CODES:
                    yield _run(held)
                    held, size = [], 0
        yield _run(held)

    return lists.mapInArrow(kernel, "code long, n long")


def _codes(ids: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs of each list, list lengths together; a long list comes in parts."""
    lengths = np.diff(offsets)
    for n in np.unique(lengths[lengths > 1]):
        starts = offsets[:-1][lengths == n]
        if n <= 64:
            a, b = np.triu_indices(n, 1)
            step = max(1, RUN_CODES // len(a))
            for i in range(0, len(starts), step):
                rows = ids[starts[i : i + step, None] + np.arange(n)]
                yield (rows[:, a] << 32 | rows[:, b]).ravel()
        else:
            for s in starts:
                row = ids[s : s + n]
                for i in range(n - 1):
                    yield row[i] << 32 | row[i + 1 :]


def _run(held: list[np.ndarray]) -> pa.RecordBatch:
    codes, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, "int64"),) * 2
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])


def _merge(sorted_runs: DataFrame) -> DataFrame:
    """Run-length sums over the merged order; the last code of a batch waits for the next batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count = np.empty(0, "int64"), np.empty(0, "int64")
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.concatenate([code, batch.column("code").to_numpy()])
            count = np.concatenate([count, batch.column("n").to_numpy()])
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            code, count = code[first], np.add.reduceat(count, first)
            yield _counted(code[:-1], count[:-1])
            code, count = code[-1:], count[-1:]
        yield _counted(code, count)

    return sorted_runs.mapInArrow(kernel, "code long, n_ab long")


def _counted(code: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n_ab"])
