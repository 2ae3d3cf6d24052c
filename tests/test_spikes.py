from statistics import median

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import spikes
from tidemark.operators.ordered import group_medians, with_positions

SCHEMA = "s string, d long, t long, q long, p double, chunk string, own string, deviation string, pos string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "e") for r in rows], SCHEMA)


def _brute(rows, reach=10, factor=10.0, run=12):
    out, groups = set(), {}
    for s, d, t, q, p in rows:
        if None not in (s, d, t, q, p) and p == p:
            groups.setdefault((s, d), []).append((t, q, p))
    for g in groups.values():
        g.sort()
        ps = [x[2] for x in g]
        dev = [abs(p - median(ps[max(0, i - reach) : i + reach + 1])) for i, p in enumerate(ps)]
        usual = median(dev)
        for i, p in enumerate(ps):
            lo = i
            while lo and ps[lo - 1] == p:
                lo -= 1
            hi = i
            while hi + 1 < len(ps) and ps[hi + 1] == p:
                hi += 1
            if p <= 0 or dev[i] > factor * usual or hi - lo + 1 >= run:
                out.add(g[i][1])
    return out


def _flags(spark, rows, chunk=16):
    df = spikes.running_median_flags(_frame(spark, rows), ["s", "d"], F.expr("t div 7"), ["t", "q"], "q", "p", 10, 10.0, 12, chunk=chunk)
    return {r.q for r in df.collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.sampled_from([1.0, 1.0, 1.0, 2.0, 2.5, 90.0, -1.0])), max_size=90))
def test_running_median_equals_brute_force(spark, values):
    rows = [(s, 0, t, i, p) for i, (s, t, p) in enumerate(values)]
    assert _flags(spark, rows) == _brute(rows)


def test_chunks_do_not_change_runs_or_edges(spark):
    rng = np.random.default_rng(3)
    rows = [("a", 0, i // 3, i, float(np.round(100 + rng.normal(), 2))) for i in range(300)]
    for i in range(60, 73):
        rows[i] = (*rows[i][:4], 100.0)
    rows[150] = (*rows[150][:4], 500.0)
    want = _brute(rows)
    assert {60, 72, 150} <= want
    for chunk in (13, 16, 64, 4096):
        assert _flags(spark, rows, chunk) == want


def test_nulls_nan_and_empty(spark):
    rows = [("a", 0, 1, 1, None), ("a", 0, 1, 2, float("nan")), (None, 0, 1, 3, 0.0), ("a", None, 1, 4, 0.0), ("a", 0, None, 5, 0.0), ("a", 0, 1, 6, 0.0)]
    assert _flags(spark, rows) == {6}
    assert _flags(spark, []) == set()


def test_levels(spark):
    values = [5] * 9 + [0] * 12 + [7] * 10 + [-1, 1000, None, 6, 6, 6, 6, 6, 6, 6, 6, 6, 8, 9, 10]
    rows = [("a", 0, i, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, d long, t long, q long, p long")
    got = {r.q for r in spikes.level_flags(df, ["s", "d"], F.expr("t div 5"), ["t", "q"], "q", "p", 15.0, 10, chunk=10).collect()}
    assert got == {*range(21, 31), 31, 32}


def test_medians_of_negative_even_and_tied_groups(spark):
    groups = {"a": [-5, -1, 3, 4], "b": [0] * 50 + [9] * 49, "c": [1e-9, 2e-9, 5e9], "d": [2.0, 8.0], "e": [-7.5]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None)], "g string, v double")
    got = {r.g: r.m for r in group_medians(df, ["g"], "v", "m").collect()}
    assert got == {k: median(map(float, v)) for k, v in groups.items()}


def test_positions_are_dense(spark):
    df = spark.createDataFrame([("a", t // 5, t) for t in range(37)] + [("b", 0, 1)], "g string, slot long, t long")
    got = with_positions(df, ["g"], "slot", ["t"]).collect()
    assert sorted(r.pos for r in got if r.g == "a") == list(range(37))
    assert all(r.pos == r.t for r in got if r.g == "a")


def _kalman(spark, values, chunk=512, model=spikes.LocalLevel(), **more):
    df = _frame(spark, [("a", 0, i, i, None if v is None else float(v)) for i, v in enumerate(values)])
    rows = spikes.kalman_flags(df, ["s", "d"], F.expr("t div 100"), ["t", "q"], "q", F.col("p"), F.col("p") <= 0, F.lit(False), model, chunk=chunk, **more).collect()
    return {r.q: (r.reason, r.score) for r in rows}


def _walk(n, seed=5, step=0.05):
    return np.round(100 + np.cumsum(np.random.default_rng(seed).normal(0, step, n)), 2)


def test_kalman_finds_planted_spikes_and_stuck_values(spark):
    price = _walk(2000)
    planted = {300: 140.0, 900: 61.0, 1500: -3.0}
    for i, v in planted.items():
        price[i] = v
    price[1200:1230] = price[1200]
    got = {i: why for i, (why, _) in _kalman(spark, price).items()}
    assert got[300] == got[900] == "spike" and got[1500] == "impossible"
    assert all(got.get(i) == "stuck" for i in range(1200, 1230))
    assert len([i for i, why in got.items() if i not in planted and not 1199 <= i < 1231]) < 20


def test_vanishing_variance_is_stuck_though_no_two_values_are_equal(spark):
    rng = np.random.default_rng(8)
    values = 100 + rng.normal(0, 0.5, 1000)
    values[400:500] = 100 + rng.normal(0, 1e-6, 100)
    got = _kalman(spark, values)
    assert all(got.get(i, ("",))[0] == "stuck" for i in range(400, 500))
    assert not [i for i, (why, _) in got.items() if why == "stuck" and not 400 <= i < 500]


def test_filter_follows_a_moved_level_and_ignores_impossible_values_on_the_way(spark):
    values = _walk(400)
    values[200:] += 50
    values[202] = -1.0
    got = {i: why for i, (why, _) in _kalman(spark, values).items()}
    assert got[202] == "impossible"
    assert {i for i, why in got.items() if why == "spike" and i >= 195} == {200, 201, 203, 204, 205, 206}


def test_scores_look_back_only(spark):
    """Later values change nothing before them, but for the group's normal, which is kept here."""
    values = list(_walk(300))
    other = values[:200] + values[:100]
    x, bad, args = np.array(values), np.zeros(300, bool), (np.array([300]), np.array([100.0]), np.array([1.0]), np.array([0.1]))
    one, two = (spikes._lockstep(np.array(v), bad, *args, spikes.LocalLevel()) for v in (values, other))
    assert all((a[:200] == b[:200]).all() for a, b in zip(one, two, strict=True))
    sizes, three = np.array([100, 300, 7]), [np.repeat(v, 3) for v in args[1:]]
    both = spikes._lockstep(np.r_[x[:100], x, x[:7]], np.zeros(407, bool), sizes, *three, spikes.LocalLevel())
    assert all((m[100:400] == a).all() for m, a in zip(both, one, strict=True))


def test_chunks_of_one_group_agree_away_from_the_filter_s_start(spark):
    values = _walk(1500, seed=9)
    values[[100, 700, 1300]] += 20
    values[1000:1020] = values[1000]
    whole = {i: why for i, (why, _) in _kalman(spark, values, chunk=4096).items()}
    assert {i: why for i, (why, _) in _kalman(spark, values, chunk=300).items()} == whole and {100, 700, 1000, 1019, 1300} <= set(whole)


def test_kalman_nulls_single_values_and_empty(spark):
    assert _kalman(spark, []) == {} and _kalman(spark, [None, float("nan")]) == {} and _kalman(spark, [5.0]) == {}
    assert {i: why for i, (why, _) in _kalman(spark, [5.0, None, -1.0]).items()} == {2: "impossible"}


def test_innovations_cover_minute_volumes(spark, tmp_path):
    from tidemark.plans.problems import p5_innovations

    rng = np.random.default_rng(6)
    volume = [int(v) for v in rng.integers(900, 1100, 300)]
    volume[100], volume[150], volume[50] = 90_000, -4, 0
    volume[200:215] = [volume[200]] * 15
    bars = [("a", "1min", 60 * i, i, v) for i, v in enumerate(volume)] + [("a", "1day", 0, 999, -1), ("a", "1min", 0, 998, None)]
    spark.createDataFrame(bars, "symbol string, timeframe string, ts long, seq long, volume long").write.parquet(f"{tmp_path}/stock_bars.parquet")
    trades = "symbol string, ts_us long, price double, size long, exchange string, conditions string, tape string, trade_id long, ingest_seq long"
    spark.createDataFrame([("a", i, -1.0 if i == 30 else 100.0 + i % 7, 1, "x", "", "t", i, i) for i in range(60)], trades).write.parquet(f"{tmp_path}/stock_trades.parquet")
    got = {(r.table_name, r.row_seq): r.reason for r in p5_innovations(spark, str(tmp_path)).collect()}
    assert got["stock_bars", 100] == "spike" and got["stock_bars", 150] == "impossible" and got["stock_trades", 30] == "impossible"
    assert all(got.get(("stock_bars", i)) == "stuck" for i in range(200, 215))
    assert not {("stock_bars", i) for i in (50, 998, 999)} & {k for k, why in got.items() if why == "impossible"}
