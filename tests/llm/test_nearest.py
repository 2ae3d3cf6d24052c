import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm.nearest import LEFT, RIGHT, NearestBuffer, nearest_in_time, stream_nearest

SCHEMA = "e string, t long, q long, entity string, time string, seq string, side string, span string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)


def _brute(left, right, tolerance):
    out = set()
    for e, t, q in left:
        near = [(abs(t - u), u, p) for f, u, p in right if f == e and None not in (f, u, p, t, q) and abs(t - u) <= tolerance] if e is not None and t is not None else []
        if near:
            out.add((q, min(near)[2]))
    return out


def _got(df):
    return {(r.left_seq, r.right_seq) for r in df.collect()}


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-60, 60))), max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, ROWS)
def test_equals_brute_force_across_spans(spark, left, right):
    lefts = [(e, t, i) for i, (e, t) in enumerate(left)]
    rights = [(e, t, 100 + i) for i, (e, t) in enumerate(right)]
    assert _got(nearest_in_time(_frame(spark, lefts), _frame(spark, rights), "e", "t", "q", 7, span_us=10)) == _brute(lefts, rights, 7)


def test_ties_go_to_the_earlier_then_the_smaller_number(spark):
    rights = [("a", 90, 9), ("a", 90, 3), ("a", 110, 1)]
    got = _got(nearest_in_time(_frame(spark, [("a", 100, 0)]), _frame(spark, rights), "e", "t", "q", 10, span_us=50))
    assert got == {(0, 3)}


def test_tolerance_is_inclusive_and_empty_sides_are_fine(spark):
    left, right = _frame(spark, [("a", 0, 1), ("a", 100, 2)]), _frame(spark, [("a", 10, 5), ("a", 111, 6)])
    assert _got(nearest_in_time(left, right, "e", "t", "q", 10, span_us=1000)) == {(1, 5)}
    assert _got(nearest_in_time(left, right.limit(0), "e", "t", "q", 10)) == set()
    assert _got(nearest_in_time(left.limit(0), right, "e", "t", "q", 10)) == set()


def test_buffer_emits_past_the_horizon_and_evicts():
    buffer = NearestBuffer(5)
    rows = sorted([(0, t, LEFT, t) for t in range(0, 200, 10)] + [(0, t + 2, RIGHT, 1000 + t) for t in range(0, 200, 10)])
    out, most = [], 0
    for i in range(0, len(rows), 4):
        out += zip(*buffer.push(*map(np.array, zip(*rows[i : i + 4], strict=True))), strict=True)
        most = max(most, len(buffer.rows[0]))
    out += zip(*buffer.flush(), strict=True)
    assert sorted(out) == [(t, 1000 + t) for t in range(0, 200, 10)]
    assert most <= 8


def test_stream_gives_the_same_pairs(spark, tmp_path):
    from tidemark.streaming.feeds import drain_to_table

    rng = np.random.default_rng(1)
    second = 1_000_000
    lefts = [("ab"[i % 2], int(t), i) for i, t in enumerate(np.sort(rng.integers(0, 300, 60)) * second)]
    rights = [("ab"[i % 2], int(t), 1000 + i) for i, t in enumerate(np.sort(rng.integers(0, 300, 90)) * second + 7)]
    end = [("z", 4000 * second, 9999)]
    schema = "e string, t long, q long"
    streams = []
    for name, rows in (("l", lefts), ("r", rights)):
        for lo in range(0, 300, 60):
            part = [r for r in rows if lo * second <= r[1] < (lo + 60) * second]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        for _ in range(2):
            spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
    got = drain_to_table(stream_nearest(*streams, "e", "t", "q", 2 * second, "600 seconds", span_us=60 * second), f"{tmp_path}/home")
    want = _brute(lefts, rights, 2 * second)
    assert {(r.left_seq, r.right_seq) for r in got.collect() if r.left_seq != 9999} == want
