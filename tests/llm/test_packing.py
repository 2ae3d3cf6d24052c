from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import Limits, pack, pack_all, pieces

SCHEMA = "id long, tokens long, loss long, container_id string, piece_no string, rank string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def _check(rows, out, limits):
    sizes, loss, count, parts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    of = {i: (t, t if u is None else min(u, t)) for i, t, u in rows if t}
    for r in out:
        assert r.piece_loss == max(0, r.piece_start + r.piece_tokens - max(r.piece_start, of[r.id][0] - of[r.id][1]))
        sizes[r.container_id] += r.piece_tokens
        count[r.container_id] += 1
        total, paid = of[r.id]
        loss[r.container_id] += max(0, r.piece_start + r.piece_tokens - max(r.piece_start, total - paid))
        parts[r.id].append((r.piece_no, r.piece_start, r.piece_tokens))
    assert max(sizes.values(), default=0) <= limits.tokens
    if limits.segments:
        assert max(count.values(), default=0) <= limits.segments
    if limits.loss:
        assert max(loss.values(), default=0) <= limits.loss
    assert set(parts) == set(of)
    for i, ps in parts.items():
        at = 0
        for n, (no, start, size) in enumerate(sorted(ps)):
            assert (no, start) == (n, at) and size > 0
            at += size
        assert at == of[i][0]
        if of[i][0] <= limits.tokens and (limits.loss is None or of[i][1] <= limits.loss):
            assert len(ps) == 1
    return len(sizes)


LIMITS = [Limits(16), Limits(16, segments=3), Limits(16, loss=9), Limits(16, segments=4, loss=8)]


@pytest.mark.parametrize("limits", LIMITS)
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 50)), st.one_of(st.none(), st.integers(0, 50))), max_size=60))
def test_limits_hold_and_nothing_is_lost(spark, limits, sizes):
    rows = [(i, t, u) for i, (t, u) in enumerate(sizes)]
    _check(rows, pack(_frame(spark, rows), "id", limits).collect(), limits)


def test_little_room_is_left(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(t), None) for i, t in enumerate(np.minimum(rng.lognormal(5, 1, 4000), 3000))]
    used = _check(rows, pack(_frame(spark, rows), "id", Limits(2048)).collect(), Limits(2048))
    assert used <= 1.002 * sum(t for _, t, _ in rows) / 2048 + 1


def test_a_third_of_all_items_of_one_size(spark):
    rows = [(i, 700 if i % 3 == 0 else i % 500 + 1, None) for i in range(3000)]
    _check(rows, pack(_frame(spark, rows), "id", Limits(1000)).collect(), Limits(1000))


@pytest.mark.parametrize("limits", [Limits(2048), Limits(2048, segments=9, loss=1500)])
def test_small_lots_lose_next_to_nothing(spark, limits):
    rng = np.random.default_rng(4)
    rows = [(i, int(t), int(t * u)) for i, (t, u) in enumerate(zip(np.minimum(rng.lognormal(5, 1, 4000), 1900), rng.uniform(0.2, 1, 4000), strict=True))]
    one, many = (_check(rows, pack(_frame(spark, rows), "id", limits, lot=lot).collect(), limits) for lot in (1 << 20, 300))
    assert one <= many <= 1.04 * one


def test_repeated_rows_are_dealt_like_all_others(spark):
    rows = [(7, 100, None)] * 900 + [(8, 30, None)] * 100
    out = pack(_frame(spark, rows), "id", Limits(1000), lot=50).collect()
    assert sum(r.piece_tokens for r in out) == 93_000 and len(out) == 1000
    sizes = defaultdict(int)
    for r in out:
        sizes[r.container_id] += r.piece_tokens
    assert max(sizes.values()) <= 1000 and len(sizes) <= 97


def test_loss_is_at_the_end_of_an_item(spark):
    got = pieces(_frame(spark, [(1, 25, 12)]), "id", Limits(10, loss=100)).orderBy("piece_no").collect()
    assert [(r.piece_start, r.tokens, r.loss) for r in got] == [(0, 10, 0), (10, 10, 7), (20, 5, 5)]


def test_all_capacities_and_empty(spark):
    rows = [(1, 5, None), (2, 9, None)]
    caps = spark.createDataFrame([("a", 5), ("b", 20), (None, 3), ("c", 0)], "pack_name string, capacity_tokens int")
    got = pack_all(_frame(spark, rows), "id", caps).collect()
    assert sorted((r.pack_name, r.id, r.piece_tokens) for r in got) == [("a", 1, 5), ("a", 2, 4), ("a", 2, 5), ("b", 1, 5), ("b", 2, 9)]
    assert pack_all(_frame(spark, []), "id", caps).collect() == []
    assert pack_all(_frame(spark, rows), "id", caps.limit(0)).collect() == []
