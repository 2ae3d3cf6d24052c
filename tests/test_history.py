from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import history

SCHEMA = "id long, t long, r long, v string, h string, hash_a string, opens int, _bucket int, valid_to_us int, _since int"


def _seen(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)
    return history.observations(df, "id", F.col("t"), {"r": F.col("r"), "v": F.col("v")}, [F.trim(F.coalesce("h", F.lit("")))])


def _brute(rows):
    best = {}
    for i, t, r, v, h in rows:
        if i is not None and t is not None:
            rank = ((r is not None, r or 0), (v is not None, v or ""))
            if (i, t) not in best or best[i, t][0] < rank:
                best[i, t] = (rank, (h or "").strip(" "))
    out, last = [], {}
    for i, t in sorted(best):
        h = best[i, t][1]
        if last.get(i, (None,))[0] != h:
            if i in last:
                out[last[i][1]][2] = t
            last[i] = (h, len(out))
            out.append([i, t, -1, h])
    return sorted(map(tuple, out))


def _heads(spark):
    """Headline by hash, for the few headlines of the tests."""
    rows = [(h,) for h in ("x", "y", "z", "")]
    return {(r.hash_a, r.hash_b): r.h for r in spark.createDataFrame(rows, "h string").select("h", *history.attribute_hashes(F.col("h"))).collect()}


def _got(spark, dimension):
    heads = _heads(spark)
    rows = history.versions(dimension, "id").collect()
    return sorted((r.id, r.valid_from_us, -1 if r.valid_to_us is None else r.valid_to_us, heads[r.hash_a, r.hash_b]) for r in rows)


def _merged(spark, parts, bucket=10):
    dimension = None
    for part in parts:
        dimension = history.merge(dimension, _seen(spark, part), "id", ["r", "v"], bucket)
    return dimension


ROW = st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(-30, 30)), st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["a", "b", "c"]), st.sampled_from(["x", " x ", "y", None, ""]))


def _by_rank(rows):
    """Rows that differ in their headline only can't be told apart by rank; the tests leave one of them."""
    return list({r[:4]: r for r in rows}.values())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=40).map(_by_rank), st.integers(0, 40), st.integers(0, 40))
def test_merge_in_any_order_equals_rebuilding(spark, rows, one, two):
    low, high = sorted((one, two))
    want = _brute(rows)
    assert _got(spark, _merged(spark, [rows])) == want
    assert _got(spark, _merged(spark, [rows[:low], rows[low:high], rows[high:]])) == want


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=30).map(_by_rank), st.integers(1, 5))
def test_number_of_loads_changes_nothing(spark, rows, loads):
    assert _got(spark, history.fold(_seen(spark, rows), "id", ["r", "v"], "r", loads, 10)) == _brute(rows)


def test_hot_key_is_spread_over_buckets(spark):
    rows = [(1, t, 0, "a", "xy"[t // 7 % 2]) for t in range(200)] + [(2, 5, 0, "a", "z")]
    assert _got(spark, _merged(spark, [rows])) == _brute(rows)


def test_late_update_splits_a_closed_version(spark):
    old = [(1, 1, 0, "a", "x"), (1, 9, 0, "b", "x"), (1, 20, 0, "c", "y"), (2, 1, 0, "a", "x")]
    late = [(1, 5, 1, "d", "z"), (1, 30, 1, "e", "y"), (3, 2, 1, "a", "x")]
    before, after = _merged(spark, [old]), _merged(spark, [old, late])
    assert _got(spark, after) == [(1, 1, 5, "x"), (1, 5, 9, "z"), (1, 9, 20, "x"), (1, 20, -1, "y"), (2, 1, -1, "x"), (3, 2, -1, "x")]
    got = {(r.id, r.valid_from_us): r.action for r in history.changes(before, after, "id").collect()}
    assert got == {(1, 1): "moved", (1, 5): "inserted", (1, 9): "inserted", (3, 2): "inserted"}


def test_new_state_closes_the_current_one_and_a_correction_withdraws(spark):
    old = [(1, 1, 0, "a", "x"), (1, 20, 0, "c", "y")]
    closed = history.changes(_merged(spark, [old]), _merged(spark, [old, [(1, 25, 1, "d", "z")]]), "id").collect()
    assert {(r.valid_from_us, r.valid_to_us, r.action) for r in closed} == {(20, 25, "closed"), (25, None, "inserted")}
    back = history.changes(_merged(spark, [old]), _merged(spark, [old, [(1, 20, 1, "d", "x")]]), "id").collect()
    assert {(r.valid_from_us, r.action) for r in back} == {(1, "moved"), (20, "withdrawn")}


def test_hash_tells_null_and_columns_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("", "c")], "x string, y string")
    assert df.select(F.struct(*history.attribute_hashes(F.col("x"), F.col("y"))).alias("h")).distinct().count() == 4


def test_empty(spark):
    assert _got(spark, _merged(spark, [[]])) == _got(spark, _merged(spark, [[], []])) == []
