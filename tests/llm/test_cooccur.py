from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import cooccur

SCHEMA = "id long, items array<string>, record string, code string, n string"


def _frame(spark, lists):
    return spark.createDataFrame([(i, x, "a", "b", "c") for i, x in enumerate(lists)], SCHEMA)


def _brute(lists):
    return Counter(p for x in lists for p in combinations(sorted(x or []), 2))


@pytest.mark.parametrize("max_sent", [cooccur.MAX_SENT_ITEMS, 3])
def test_counts_and_ratios(spark, max_sent):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)] + ["É", "z"]
    lists = [sorted(set(rng.choice(words, rng.integers(0, 6)).tolist())) for _ in range(120)] + [None, [], ["w1"]]
    single, both = Counter(w for x in lists for w in x or []), _brute(lists)
    total = sum(bool(x) for x in lists)
    got = {(r.item_a, r.item_b): r for r in cooccur.pair_counts(_frame(spark, lists), "id", "items", max_sent=max_sent).collect()}
    assert {k: r.n_ab for k, r in got.items()} == both
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n_all) == (single[a], single[b], total)
        n, na, nb = r.n_ab, r.n_a, r.n_b
        assert r.ratio == pytest.approx(n * total / (na * nb))
        assert r.odds_ratio == pytest.approx((n + 0.5) * (total - na - nb + n + 0.5) / ((na - n + 0.5) * (nb - n + 0.5)))


def test_one_long_record_and_runs_smaller_than_it(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "RUN_CODES", 500)
    lists = [[f"{i:03d}" for i in range(80)], ["000", "001"], ["000", "001"]]
    runs = list(cooccur._codes(np.arange(80), np.array([0, 80])))
    assert sum(map(len, runs)) == 80 * 79 // 2
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccur.pair_counts(_frame(spark, lists), "id", "items", min_count=2).collect()}
    assert got == {("000", "001"): 3}


def test_above_chance_is_exact(spark):
    df = spark.createDataFrame([(5, 100, 5, 25), (5, 100, 5, 26), (3_000_000_000, 4_000_000_000, 3_000_000_000, 1_000_000_000)], "n_ab long, n_all long, n_a long, n_b long")
    assert cooccur.above_chance(df, 4).count() == 2


@pytest.mark.parametrize("max_sent", [cooccur.MAX_SENT_ITEMS, 1])
def test_repeated_and_null_ids_are_rows_of_their_own(spark, max_sent):
    rows = [(1, ["a", "b"]), (1, ["a", "b"]), (None, ["a", "c"]), (None, ["b", "c"])]
    df = spark.createDataFrame(rows, "id long, items array<string>")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in cooccur.pair_counts(df, "id", "items", max_sent=max_sent).collect()}
    assert got == {("a", "b"): (2, 3, 3, 4), ("a", "c"): (1, 3, 2, 4), ("b", "c"): (1, 3, 2, 4)}


def test_empty(spark):
    assert cooccur.pair_counts(_frame(spark, []), "id", "items").collect() == []
    assert cooccur.pair_counts(_frame(spark, [None, []]), "id", "items").collect() == []
