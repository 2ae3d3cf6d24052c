"""Filling containers of fixed capacity with items, under several limits at once.

Items are placed under simultaneous limits on tokens, segments and loss-bearing
tokens by the dot-product heuristic of vector bin packing: the next item of an open
container is the fitting one whose size vector has the largest scalar product with what
is left. Vectors are shortened to a power of their length first: at length one, items that use the
limits in the proportion that is left come first, at their own length large ones do. Each lot is
packed with two such powers, and the fewer containers count. With a single limit the next
item is the largest that fits.

Items are dealt into lots of about the same number, each lot is packed by one task, and
its well-filled containers stay. Items of the others are dealt again, which are few, until
one lot is left; so lots cost next to no room. Within a lot only sizes matter: a
container's pattern of sizes is repeated as often as the stock allows, and items
take their container by their place among the items of their size. No task ever holds
more than a lot, whatever the number of items and of distinct sizes, and lots of equal
items are cut like all others.

An item that alone exceeds the capacity (or the limit on loss-bearing tokens) is cut
into full pieces and a rest, which is packed like an item. All others stay whole.

Defined cases: items with null key, null tokens or no tokens are placed nowhere; loss-bearing tokens
are the last ones of an item, null means all its tokens. Equal keys and repeated rows are packed as
separate items. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import key_blocks
from tidemark.session import materialize

#: Pieces of a lot, about: without and with a limit on loss-bearing tokens, which makes far more distinct sizes.
LOT, LOSS_LOT = 1 << 16, 1 << 13
#: How far size vectors are brought to length one (1) or left as they are (0), where there are several limits.
POWERS = (0.6, 1.0)
#: A container stays if one of its limits is used up to this share.
FULL = 0.995
#: Bits of a container's number for its place in the lot and for the lot.
PLACE_BITS, LOT_BITS = 22, 34


@dataclass(frozen=True)
class Limits:
    """What a container holds at most; None is no limit."""

    tokens: int
    segments: int | None = None
    loss: int | None = None


def pieces(items: DataFrame, key: str, limits: Limits) -> DataFrame:
    """``key``, ``piece_no``, ``piece_start``, ``tokens``, ``loss``: whole items, and the pieces of those too large."""
    sized = items.withColumn("_lim", _limit_struct("", limits))
    return _pieces(sized, [key]).select(key, "piece_no", "piece_start", "tokens", "loss")


def _limit_struct(name: str, limits: Limits):
    whole = lambda x: F.lit(x).cast("long")
    return F.struct(F.lit(name).alias("pack_name"), whole(limits.tokens).alias("tokens"), whole(limits.segments).alias("segments"), whole(limits.loss).alias("loss"))


def _pieces(items: DataFrame, kept: list[str]) -> DataFrame:
    """Pieces of items with ``tokens``, ``loss`` and the limits ``_lim``."""
    over = (F.col("tokens") > F.col("_lim.tokens")) | F.coalesce(F.col("loss") > F.col("_lim.loss"), F.lit(False))
    step = F.when(over, F.least("_lim.tokens", "_lim.loss")).otherwise(F.col("tokens")).cast("long")
    sized = items.filter((F.col("tokens") > 0) & F.col(kept[0]).isNotNull()).withColumn("loss", F.least(F.coalesce("loss", "tokens"), "tokens"))
    cut = sized.withColumn("_step", step).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(tokens - 1) div _step"))))
    start = F.col("_at") * F.col("_step")
    end = F.least(start + F.col("_step"), F.col("tokens"))
    unpaid = F.col("tokens") - F.col("loss")
    return cut.select(
        *kept, "_lim", F.col("_at").alias("piece_no"), start.alias("piece_start"), (end - start).alias("tokens"),
        F.greatest(F.lit(0).cast("long"), end - F.greatest(start, unpaid)).cast("long").alias("loss"),
    )


def patterns(tokens: np.ndarray, loss: np.ndarray, count: np.ndarray, limits: Limits, power: float = 0.0) -> tuple[np.ndarray, int]:
    """Rows (size, first rank, items of that size per container, first container) and the number of containers."""
    left = count.astype("int64").copy()
    taken = np.zeros(len(left), "int64")
    whole = np.array([limits.tokens, limits.segments or 0, limits.loss or 0], "float64")
    asked = np.flatnonzero([True, limits.segments is not None, limits.loss is not None])
    sizes = np.stack([tokens, np.ones_like(tokens), loss]).astype("int64")[asked]
    scaled = sizes / whole[asked, None]
    norm = np.sqrt((scaled * scaled).sum(0))
    limit = whole[asked].astype("int64")
    rows, made = [], 0
    live = np.flatnonzero(left)
    while len(live):
        room = limit.copy()
        used: dict[int, int] = {}
        stock = left[live].copy()
        size, weight = sizes[:, live], scaled[:, live] / norm[live] ** power
        fits = np.flatnonzero((size <= room[:, None]).all(0))
        while len(fits):
            best = int(fits[np.argmax((room / whole[asked]) @ weight[:, fits])])
            times = int(min(stock[best], room[0] // size[0, best])) if len(asked) == 1 else 1
            used[best] = used.get(best, 0) + times
            room = room - times * size[:, best]
            stock[best] -= times
            fits = fits[(size[:, fits] <= room[:, None]).all(0) & (stock[fits] > 0)]
        often = min(int(left[live[i]] // n) for i, n in used.items())
        for i, n in used.items():
            s = int(live[i])
            rows.append((s, taken[s], n, made))
            taken[s] += n * often
            left[s] -= n * often
        made += often
        live = live[left[live] > 0]
    return np.array(rows, "int64").reshape(-1, 4), made


def _containers(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """The container of each piece of a lot, and which containers are full. Pieces are sorted by tokens and loss."""
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (loss[1:] != loss[:-1])]
    first = np.flatnonzero(new)
    stock = tokens[first], loss[first], np.diff(np.append(first, len(tokens)))
    powers = POWERS if limits.segments or limits.loss else (0.0,)
    table, made = min((patterns(*stock, limits, power) for power in powers), key=lambda found: found[1])
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    kind = np.cumsum(new) - 1
    rank = np.arange(len(tokens)) - first[kind]
    row = table[np.searchsorted(table[:, 0] << 32 | table[:, 1], kind << 32 | rank, side="right") - 1]
    container = row[:, 3] + (rank - row[:, 1]) // row[:, 2]
    full = np.zeros(made, bool)
    for most, used in ((limits.tokens, tokens), (limits.segments, np.ones_like(tokens)), (limits.loss, loss)):
        if most:
            full |= np.bincount(container, weights=used, minlength=made) >= FULL * most
    return container, full


def _packed(parts: DataFrame, kept: list[str], level: int, lots: int) -> DataFrame:
    """One round over ``parts``: each piece with its ``container_id``, and ``again`` if its container isn't full."""
    columns = [*kept, "piece_no", "piece_start", "tokens", "loss"]
    limits = [F.col(f"_lim.{c}").alias(f"_most_{c}") for c in ("tokens", "segments", "loss")]
    rows = parts.select(*columns, F.col("_lim.pack_name").alias("pack_name"), *limits, F.pmod(F.xxhash64("_row", "piece_no", F.lit(level)), F.lit(lots)).alias("_lot"))
    keys = ["pack_name", "_lot"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "tokens", "loss", "_row", "piece_no")
    schema = rows.drop("_lot").schema.add("container_id", "long").add("again", "boolean")
    names = [f.name for f in schema]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, block in key_blocks(batches, keys):
            ends = np.cumsum(np.bincount(block))
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                lot = table.slice(a, b - a)
                most = {c: lot.column(f"_most_{c}")[0].as_py() for c in ("tokens", "segments", "loss")}
                size, loss = lot.column("tokens").to_numpy(), lot.column("loss").to_numpy()
                container, full = _containers(size, loss if most["loss"] is not None else np.zeros_like(loss), Limits(**most))
                number = (np.int64(level) << LOT_BITS | lot.column("_lot")[0].as_py()) << PLACE_BITS | container
                out = lot.drop_columns(["_lot"]).append_column("container_id", pa.array(number)).append_column("again", pa.array(~full[container]))
                yield from out.select(names).to_batches()

    return rows.mapInArrow(kernel, schema)


def pack_each(items: DataFrame, key: str, packs: dict[str, Limits], lot: int | None = None) -> DataFrame:
    """``pack_name``, ``container_id``, ``key``, ``piece_no``, ``piece_start``, ``piece_tokens``, ``piece_loss`` of every item with ``tokens`` and ``loss``, packed anew for each name.

    Numbers of containers are unique within a pack, not dense.
    """
    sized = materialize(items.select(key, F.col("tokens").cast("long").alias("tokens"), F.col("loss").cast("long").alias("loss"), F.monotonically_increasing_id().alias("_row")), "pack-items")
    wanted = F.array(*(_limit_struct(n, limits) for n, limits in packs.items()))
    kept = [key, "_row"]
    parts = _pieces(sized.withColumn("_lim", F.explode(wanted)), kept)
    size = lot or (LOT if all(limits.loss is None for limits in packs.values()) else LOSS_LOT)
    n, done, level = parts.count(), [], 0
    while True:
        lots = max(1, -(-n // (size * len(packs))))
        made = _packed(parts, kept, level, lots)
        if lots == 1:
            done.append(made)
            break
        made = materialize(made, "packed")
        again = made.filter("again")
        left = again.count()
        if left * 2 > n:  # sizes that leave room whatever their company; dealing them again would not help
            done.append(made)
            break
        done.append(made.filter("NOT again"))
        lim = F.struct("pack_name", *(F.col(f"_most_{c}").alias(c) for c in ("tokens", "segments", "loss")))
        parts, n, level = again.withColumn("_lim", lim).select(*kept, "_lim", "piece_no", "piece_start", "tokens", "loss"), left, level + 1
    out = reduce(DataFrame.unionByName, done)
    return out.select("pack_name", "container_id", key, "piece_no", "piece_start", F.col("tokens").alias("piece_tokens"), F.col("loss").alias("piece_loss"))


def pack(items: DataFrame, key: str, limits: Limits, lot: int | None = None) -> DataFrame:
    """:func:`pack_each` for one set of limits, without its name."""
    return pack_each(items, key, {"": limits}, lot).drop("pack_name")


def pack_all(items: DataFrame, key: str, capacities: DataFrame, segments: int | None = None, loss_percent: int | None = None) -> DataFrame:
    """:func:`pack_each` for each row of ``pack_name``, ``capacity_tokens``; rows with a null name or no capacity are left out.

    ``loss_percent`` limits the loss-bearing tokens to that share of the capacity. The capacities are settings: a plan has
    a part for each, since each packs all items.
    """
    wanted = capacities.filter("pack_name IS NOT NULL AND capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").alias("c")).orderBy("pack_name")
    packs = {r["pack_name"]: Limits(int(r["c"]), segments, None if loss_percent is None else max(1, int(r["c"]) * loss_percent // 100)) for r in wanted.toLocalIterator()}
    if not packs:
        return pack_each(items.limit(0), key, {"": Limits(1)})
    return pack_each(items, key, packs)
