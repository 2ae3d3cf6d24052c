"""Order-dependent work on groups of any size without a window over a whole group.

A group's rows get dense positions from two levels (rows within a slot, slots
within the group), are cut into chunks of equal length, and rows close to a cut
are copied to the neighbouring chunk. A kernel that looks at most ``halo`` rows
to either side then sees all it needs inside one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, group: list[str], slot: str, order: list[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by ``slot`` and then ``order``.

    ``slot`` must not decrease along the wanted order and should cut a hot group
    into many parts. Rows with a null group or slot drop out. ``order`` should be
    unique within a slot and end in an integer column; the counts read that column so
    that both uses of ``df`` need the same columns and share one exchange.
    """
    keys = [*group, slot]
    for k in keys:  # the join would ask for this on one side only, and the exchanges would differ
        df = df.filter(F.col(k).isNotNull())
    sizes = df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(order[-1]) * 0 + 1, F.lit(1))).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(starts, keys).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")


def into_chunks(df: DataFrame, pos: str, size: int, halo: int) -> DataFrame:
    """Add ``chunk`` and ``own``; rows within ``halo`` of a cut appear in the neighbouring chunk too, with ``own`` false."""
    if not 0 <= halo <= size:
        raise ValueError("halo must be between 0 and size")
    at = F.expr(f"{pos} div {size}")
    rest = F.col(pos) % size
    places = F.filter(
        F.array(at, F.when((rest < halo) & (at > 0), at - 1), F.when(rest >= size - halo, at + 1)),
        lambda c: c.isNotNull(),
    )
    return df.withColumn("_at", at).withColumn("chunk", F.explode(places)).withColumn("own", F.col("chunk") == F.col("_at")).drop("_at")


def _coarse(value: Column) -> Column:
    """A bucket that never decreases as the value grows."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) * 1048576.0 + 1.0) * 32.0)).cast("int")


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """The values at some ranks of each group's ascending order, nulls left out, as doubles.

    ``ranks`` gives for each column of the result a rank from 1, as SQL over ``_all``, the
    number of values. A histogram, counted before the shuffle, finds the buckets these
    ranks fall in; only the values of those buckets are counted and ordered.
    """
    values = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_b", _coarse(F.col("_v")))
    by_bucket = values.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_m"))
    run = Window.partitionBy(*group).orderBy("_b")
    placed = by_bucket.select(
        *group, "_b", "_m",
        F.sum("_m").over(run).alias("_upto"),
        F.sum("_m").over(Window.partitionBy(*group)).alias("_all"),
    )
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | ((F.expr(rank) > F.col("_upto") - F.col("_m")) & (F.expr(rank) <= F.col("_upto")))
    chosen = placed.filter(wanted).select(*group, "_b", (F.col("_upto") - F.col("_m")).alias("_skip"), "_all")
    inner = Window.partitionBy(*group, "_b").orderBy("_v")
    counted = values.join(chosen, [*group, "_b"]).groupBy(*group, "_b", "_v", "_skip", "_all").agg(F.count(F.lit(1)).alias("_n"))
    fine = counted.withColumn("_to", F.col("_skip") + F.sum("_n").over(inner))
    at = lambda rank: F.max(F.when((F.expr(rank) > F.col("_to") - F.col("_n")) & (F.expr(rank) <= F.col("_to")), F.col("_v")))
    return fine.groupBy(*group).agg(*(at(rank).alias(name) for name, rank in ranks.items()))


def group_medians(df: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of ``value`` per group (mean of the two middle ones if even), nulls left out."""
    both = order_statistics(df, group, value, {"_low": "(_all + 1) div 2", "_high": "_all div 2 + 1"})
    return both.select(*group, ((F.col("_low") + F.col("_high")) / 2.0).alias(name))


def percentile_ranks(*percents: int) -> dict[str, str]:
    """Ranks of percentiles by index on the sorted values, the index rounded half to even."""
    return {f"p{p}": f"bround({p / 100.0}D * (_all - 1), 0) + 1" for p in percents}
