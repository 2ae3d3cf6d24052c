from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.deliveries import TRADE_IDENTITY, first_deliveries
from tidemark.operators.revisions import Lateness, changelog, revised_periods, roll_up, settle, version_deltas

RULE = Lateness(100, 300, 50, {})
SCHEMA = "k string, e long, a long, v long, period_us string, version string, n string"


def _rule():
    return Lateness(100, 300, 50, {"total": F.col("v")})


def _rows(spark, rows):
    """Extra columns have the names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def _log(spark, rows):
    return changelog(version_deltas(_rows(spark, rows), ["k"], "e", "a", _rule()), ["k"], ["total"])


def test_late_records_retract_and_assert(spark):
    log = _log(spark, [("a", 10, 20, 1), ("a", 20, 120, 2), ("a", 30, 499, 4), ("a", 40, 500, 8)])
    got = sorted((r.version, r.weight, r.n, r.total) for r in log.collect())
    assert got == [(0, 1, 1, 1), (1, -1, 1, 1), (1, 1, 2, 3)]


def test_borders_of_period_and_cutoff(spark):
    rows = [("a", 0, 99, 1), ("a", 99, 100, 1), ("a", 100, 100, 1), ("a", 50, 399, 1), ("a", 50, 400, 1), ("a", -1, -50, 1)]
    done = settle(_log(spark, rows), ["k", "period_us"], ["total"])
    assert {(r.period_us, r.n) for r in done.collect()} == {(0, 3), (100, 1), (-100, 1)}
    assert [(r.k, r.period_us) for r in revised_periods(_log(spark, rows), ["k"]).collect()] == [("a", 0)]


def test_nulls_early_and_empty(spark):
    rows = [(None, 1, 1, 1), ("a", None, 1, 1), ("a", 1, None, 1), ("a", 150, 10, None)]
    got = settle(_log(spark, rows), ["k", "period_us"], ["total"]).collect()
    assert [(r.k, r.period_us, r.n, r.total) for r in got] == [("a", 100, 1, 0)]
    assert _log(spark, []).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-250, 250), st.integers(-300, 900), st.integers(0, 9)), max_size=60))
def test_changelog_equals_recount(spark, rows):
    want, coarse, late = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), set()
    for k, e, a, v in rows:
        p = e // 100 * 100
        if a < p + 400:
            for table, key in ((want, (k, p)), (coarse, (k, p // 200 * 200))):
                table[key][0] += 1
                table[key][1] += v
            if a >= p + 100:
                late.add((k, p))
    log = _log(spark, rows).cache()
    assert {(r.k, r.period_us): [r.n, r.total] for r in settle(log, ["k", "period_us"], ["total"]).collect()} == want
    assert {(r.k, r.period_us): [r.n, r.total] for r in roll_up(log, ["k"], ["total"], 200).collect()} == coarse
    assert {(r.k, r.period_us) for r in revised_periods(log, ["k"]).collect()} == late


def test_first_delivery_takes_smallest_number_and_equal_nulls(spark):
    rows = [("S", 1, 2.0, None, "X", None, "A", None, 7, 70), ("S", 1, 2.0, None, "X", None, "A", None, 5, 50), ("S", 1, 2.0, 1, "X", None, "A", None, 6, 60)]
    df = spark.createDataFrame(rows, "symbol string, ts_us long, price double, size long, exchange string, conditions string, tape string, trade_id long, ingest_seq long, received_us long")
    got = sorted((r.ingest_seq, r.received_us, r["size"]) for r in first_deliveries(df, carry=("received_us",)).collect())
    assert got == [(5, 50, None), (6, 60, 1)]
    assert set(TRADE_IDENTITY) <= set(df.columns)


def test_stream_changelog_settles_to_the_same(spark, tmp_path):
    from tidemark.streaming.feeds import drain_to_table
    from tidemark.streaming.revisions import stream_changelog

    schema = "k string, e long, a long, v long"
    rows = [("a", 10, 20, 1), ("a", 20, 120, 2), ("a", 20, 399, 4), ("b", 20, 401, 8), ("b", 120, 130, None), (None, 1, 1, 1)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    log = drain_to_table(stream_changelog(stream, "k", "e", "a", "v", RULE), f"{tmp_path}/home")
    done = settle(log, ["key", "period_us"], ["total"])
    assert {(r.key, r.period_us, r.n, r.total) for r in done.collect()} == {("a", 0, 3, 7), ("b", 100, 1, 0)}
    assert log.filter("weight = -1").count() == 1


def test_files_out_of_the_order_of_arrival_lose_nothing(spark, tmp_path):
    from tidemark.streaming.feeds import drain_to_table
    from tidemark.streaming.revisions import stream_changelog

    schema = "k string, e long, a long, v long"
    rows = [("a", 10 + i, 390_000_000 - i * 60_000_000, i) for i in range(6)] + [("b", 20, 400_000_000, 8)]
    for i, row in enumerate(reversed(rows)):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    rule = Lateness(100_000_000, 600_000_000)
    done = settle(drain_to_table(stream_changelog(stream, "k", "e", "a", "v", rule, "1 hour"), f"{tmp_path}/home"), ["key", "period_us"], ["total"])
    assert {(r.key, r.n, r.total) for r in done.collect()} == {("a", 6, 15), ("b", 1, 8)}


def test_streamed_thinning_keeps_the_last_arrival_over_batches(spark, tmp_path):
    from tidemark.streaming.deltas import last_per_bucket

    schema = "symbol string, ts_us long, bid_price double, ingest_seq long"
    parts = [[("A", 1_100_000, 1.0, 1), ("A", 1_900_000, 2.0, 2), ("A", 2_500_000, 3.0, 3)], [("A", 1_950_000, 4.0, 5), ("A", 2_100_000, 9.0, 0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    stream = lambda n: spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(f"{tmp_path}/q")
    for n in (1, 8):
        got = last_per_bucket(stream(n), 1_000_000, ["bid_price"], f"{tmp_path}/home{n}")
        assert {(r.bucket_us, r.bid_price) for r in got.collect()} == {(1_000_000, 4.0), (2_000_000, 3.0)}
