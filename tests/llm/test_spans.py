import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.llm.automata import Automaton, _codes, reference_spans
from tidemark.llm.spans import shared_share, shared_spans

SCHEMA = "id long, body string, doc string, text string, gram string, a string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)


def _brute(rows, length):
    where = {}
    texts = {i: t for i, t in rows if i is not None and t}
    for i, t in texts.items():
        for j in range(len(t) - length + 1):
            where.setdefault(t[j : j + length], set()).add(i)
    out = []
    for i, t in texts.items():
        shared = [False] * (len(t) + 1)
        for j in range(len(t) - length + 1):
            if len(where[t[j : j + length]]) > 1:
                shared[j : j + length] = [True] * length
        j = 0
        while j < len(t):
            if shared[j]:
                k = j
                while shared[k] and k < len(t):
                    k += 1
                out.append((i, j, k))
                j = k
            else:
                j += 1
    return sorted(out)


def _got(spark, rows, length=20, gram=8, slice_chars=1 << 20):
    return sorted(map(tuple, shared_spans(_frame(spark, rows), "id", "body", length, gram, slice_chars).collect()))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from(["ab", "a", "abcdefgh 😀é"]))
def test_equals_brute_force(spark, seed, letters):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(8)]
    for _ in range(12):
        a, b = rng.randrange(8), rng.randrange(8)
        i, j, n = rng.randint(0, len(texts[a])), rng.randint(0, len(texts[b])), rng.randint(10, 60)
        texts[b] = texts[b][:j] + texts[a][i : i + n] + texts[b][j:]
    rows = list(enumerate(texts))
    assert _got(spark, rows) == _brute(rows, 20)
    assert _got(spark, rows, slice_chars=23) == _brute(rows, 20)


def test_copies_repeats_nulls_and_short_texts(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(60)) + "The same words stand here again and again. "
    inside = "0123456789 inside one document only " * 4
    rows = [(1, text), (2, text), (3, "x" + text + "y"), (4, inside), (5, None), (6, ""), (7, text[:19]), (None, text)]
    assert _got(spark, rows) == _brute(rows, 20) == [(1, 0, len(text)), (2, 0, len(text)), (3, 1, len(text) + 1)]
    assert _got(spark, [(1, text), (1, text)]) == []
    assert _got(spark, []) == []


def test_production_lengths_on_a_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghijklmnop \n") for _ in range(60_000))
    rows = [(1, long), (2, "q" * 500 + long[1000:1199] + "q" * 500), (3, long[2000:2200]), (4, "zz" + long[30_000:41_234])]
    for slice_chars in (1 << 20, 1000):
        assert _got(spark, rows, 200, 100, slice_chars) == [(1, 2000, 2200), (1, 30_000, 41_234), (3, 0, 200), (4, 2, 11_236)]


def test_many_documents_share_a_passage_in_different_surroundings(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    legal = noise(47)
    rows = [(i, noise(rng.randint(0, 30)) + legal + noise(rng.randint(0, 30))) for i in range(60)]
    assert _got(spark, rows) == _brute(rows, 20)


def test_share(spark):
    df = _frame(spark, [(1, "abcde" * 10), (2, None), (3, "")])
    spans = spark.createDataFrame([(1, 0, 20), (1, 30, 35)], "doc long, span_start long, span_end long")
    got = {r.doc: (r.n_chars, r.shared_chars, r.share) for r in shared_share(df, "id", "body", spans).collect()}
    assert got == {1: (50, 25, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from(["ab", "abcdefgh 😀é"]), st.sampled_from([40, 1 << 17]))
def test_automata_give_the_spans_of_the_reference(spark, seed, letters, shard_chars):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(9)]
    for _ in range(14):
        a, b = rng.randrange(9), rng.randrange(9)
        i, j, n = rng.randint(0, len(texts[a])), rng.randint(0, len(texts[b])), rng.randint(10, 60)
        texts[b] = texts[b][:j] + texts[a][i : i + n] + texts[b][j:]
    rows = list(enumerate(texts)) + [(20, None), (None, texts[0])]
    want = [r for r in _brute(rows, 20) if r[0] % 3 == 0]
    got = reference_spans(_frame(spark, rows), "id", "body", F.col("id") % 3 == 0, 20, 8, shard_chars, sent_bytes=20_000)
    assert sorted(map(tuple, got.collect())) == want


def test_automata_without_reference_or_documents(spark):
    for rows in ([], [(1, "x" * 500), (2, "x" * 500)], [(3, "short")]):
        assert reference_spans(_frame(spark, rows), "id", "body", F.col("id") % 3 == 0).collect() == []
    assert [tuple(r) for r in reference_spans(_frame(spark, [(1, "y" * 500), (3, "x" + "y" * 250)]), "id", "body", F.col("id") % 3 == 0).collect()] == [(3, 1, 251)]


def test_matching_statistics():
    text, other = Automaton.of([_codes("abracadabra"), _codes("banana")]), _codes("xbraca banan abra")
    for a in (text, Automaton.from_bytes(text.to_bytes())):
        assert [at for at, _ in a.windows(other, 4)] == [1, 2, 7, 8, 13]
