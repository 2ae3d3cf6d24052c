"""History of changing attributes: a type-two dimension kept by merging updates into it by attribute hashes.

The dimension holds one row for each observed time of a key. A row that ``opens`` begins
a version, whose period ends at ``valid_to_us`` (null while it is current). The other rows
confirm the version they fall in; they are kept because an update that arrives later may
fall between them and split the version.

:func:`merge` takes a batch of updates, in whatever order they arrive. Of each touched key it
picks the version that is current at the earliest update and what follows it, compares
attribute hashes along time, closes versions at the first differing row and inserts the new
ones. All other rows pass through, so a batch of news at the end of time only meets current
versions. :func:`changes` tells what a merge closed, inserted and withdrew.

Windows never span a whole key: rows are compared within (key, bucket of time), and one row
per bucket carries the comparison over the bucket's edge, so a key with a third of all
rows is spread over its buckets.

Attributes themselves stay out of the dimension; it has two 64-bit hashes of them and the rank
columns, by which callers join the attributes of the versions they show.

Nulls: rows without key or time are left out. Null is a value of its own in hashes. Equal rows
delivered again fall together. An empty input gives an empty history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, materialize

#: Width of a time bucket; a key is split into that many parts at most as it has buckets.
BUCKET_US = 86_400_000_000
HASHES = ("hash_a", "hash_b")
#: Bounds of a batch's touched keys that may be sent to every executor.
SENT_ROWS, SENT_BYTES = 1_000_000, 32 << 20


def attribute_hashes(*attributes: Column) -> list[Column]:
    """Two independent 64-bit hashes of the attributes; null differs from every value and lengths keep columns apart."""
    parts = [F.coalesce(F.concat(F.octet_length(a).cast("string"), F.lit(":"), a), F.lit("-")) for a in attributes]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(HASHES)]


def observations(rows: DataFrame, key: str, time_us: Column, rank: dict[str, Column], attributes: list[Column]) -> DataFrame:
    """``key``, ``time_us``, the columns of ``rank`` (the greatest wins at one time, first column first) and the hashes."""
    hashes = attribute_hashes(*(a.cast("string") for a in attributes))
    found = rows.select(F.col(key), time_us.alias("time_us"), *(r.alias(n) for n, r in rank.items()), *hashes)
    return found.filter(F.col(key).isNotNull() & F.col("time_us").isNotNull())


def _differs(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, (p != q for p, q in zip(a, b, strict=True)))


def _versions(rows: DataFrame, key: str, rank: list[str], bucket_us: int) -> DataFrame:
    """One row per key and time, that of greatest rank, with ``opens`` and ``valid_to_us``."""
    hashes = [F.col(h) for h in HASHES]
    part = [key, "_bucket"]
    rows = rows.select(key, "time_us", *rank, *HASHES).withColumn("_bucket", F.expr(f"time_us - pmod(time_us, {bucket_us}L)"))
    best_first = Window.partitionBy(*part).orderBy("time_us", *(F.desc_nulls_last(r) for r in rank), *HASHES)
    kept = rows.withColumn("_same", F.lag("time_us").over(best_first)).filter("_same IS NULL OR _same <> time_us").drop("_same")
    by_time = Window.partitionBy(*part).orderBy("time_us")
    seen = kept.withColumns({f"_was_{h}": F.lag(h).over(by_time) for h in HASHES})
    was = [F.col(f"_was_{h}") for h in HASHES]
    inner = was[0].isNotNull() & _differs(hashes, was)
    edges = seen.groupBy(*part).agg(
        F.min("time_us").alias("_first"), F.min(F.when(inner, F.col("time_us"))).alias("_inner"),
        *(F.min_by(h, "time_us").alias(f"_head_{h}") for h in HASHES), *(F.max_by(h, "time_us").alias(f"_tail_{h}") for h in HASHES),
    )
    across = Window.partitionBy(key).orderBy("_bucket")
    edges = edges.withColumns({f"_carried_{h}": F.lag(f"_tail_{h}").over(across) for h in HASHES})
    carried = [F.col(f"_carried_{h}") for h in HASHES]
    begins = carried[0].isNull() | _differs([F.col(f"_head_{h}") for h in HASHES], carried)
    edges = edges.withColumn("_start", F.when(begins, F.col("_first")).otherwise(F.col("_inner")))
    later = Window.partitionBy(key).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*part, begins.alias("_begins"), F.last("_start", ignorenulls=True).over(later).alias("_next"))
    placed = seen.join(edges, part).withColumn("opens", F.when(was[0].isNull(), F.col("_begins")).otherwise(inner))
    after = Window.partitionBy(*part).orderBy(F.desc("time_us")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_to", F.last(F.when(F.col("opens"), F.col("time_us")), ignorenulls=True).over(after))
    return placed.select(key, "time_us", *rank, *HASHES, "opens", F.when(F.col("opens"), F.coalesce("_to", "_next")).alias("valid_to_us"))


def merge(dimension: DataFrame | None, updates: DataFrame, key: str, rank: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """The dimension after a batch of :func:`observations`; without a dimension the first one, built from the batch."""
    if dimension is None:
        return _versions(updates, key, rank, bucket_us)
    touched, _ = broadcast_if_small(updates.groupBy(key).agg(F.min("time_us").alias("_since")), "touched-keys", SENT_ROWS, SENT_BYTES)
    marked = dimension.join(touched, key, "left")
    # the version current at the earliest update, and everything from there on
    current = F.col("opens") & (F.col("valid_to_us").isNull() | (F.col("valid_to_us") >= F.col("_since")))
    affected = F.coalesce((F.col("time_us") >= F.col("_since")) | current, F.lit(False))
    passed = marked.filter(~affected).select(*dimension.columns)
    met = marked.filter(affected).select(*updates.columns)
    return passed.unionByName(_versions(met.unionByName(updates), key, rank, bucket_us))


def fold(updates: DataFrame, key: str, rank: list[str], arrival: str, loads: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """The dimension after merging ``updates`` in ``loads`` batches: equal slices of the range of ``arrival``, in its order.

    Rows without arrival come in the first load. Each load's dimension is written out and
    read by the next. The result is the same for every number of loads.
    """
    edge = updates.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    if edge["a"] is None or loads < 2:
        return merge(None, updates, key, rank, bucket_us)
    cuts = sorted({edge["a"] + (edge["b"] - edge["a"]) * i // loads for i in range(1, loads)})
    at = F.coalesce(arrival, F.lit(edge["a"]))
    dimension = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True)
        inside = inside if low is None else inside & (at >= low)
        inside = inside if high is None else inside & (at < high)
        dimension = merge(dimension, updates.filter(inside), key, rank, bucket_us)
        if high is not None:
            dimension = materialize(dimension, "dimension")
    return dimension


def versions(dimension: DataFrame, key: str) -> DataFrame:
    """``key``, ``valid_from_us``, ``valid_to_us`` (null while current), the rank columns and the hashes of each version."""
    rest = [c for c in dimension.columns if c not in (key, "time_us", "opens", "valid_to_us")]
    return dimension.filter("opens").select(key, F.col("time_us").alias("valid_from_us"), "valid_to_us", *rest)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What a merge did to the versions: ``inserted``, ``withdrawn``, ``closed`` (was current) or ``moved`` (another end or other attributes)."""
    side = lambda d, tag: versions(d, key).select(key, "valid_from_us", F.struct("valid_to_us", *HASHES).alias(f"_{tag}"))
    both = side(before, "old").join(side(after, "new"), [key, "valid_from_us"], "full")
    action = (
        F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "withdrawn")
        .when(F.col("_old.valid_to_us").isNull() & F.col("_new.valid_to_us").isNotNull(), "closed").otherwise("moved")
    )
    changed = both.filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return changed.select(key, "valid_from_us", F.coalesce("_new.valid_to_us", "_old.valid_to_us").alias("valid_to_us"), action.alias("action"))
