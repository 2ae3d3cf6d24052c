from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import boilerplate as bp

SCHEMA = "id long, source string, content string, key string, line string, lines string, mask string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)


def _lines(spark, rows):
    return bp.article_lines(_frame(spark, rows), "id", F.lower(F.trim("source")), "content")


def _brute(rows, least=5, percent=2):
    import re

    of, have, total = defaultdict(set), {}, defaultdict(set)
    for i, s, text in rows:
        if s is None or not text:
            continue
        s = s.strip(" ").lower()
        total[s].add(i)
        have[i] = (s, [re.sub("[ \t\r ]+", " ", x).strip(" ") for x in text.split("\n")])
        for x in have[i][1]:
            of[s, x].add(i)
    return {(i, n + 1) for i, (s, xs) in have.items() for n, x in enumerate(xs) if x and len(of[s, x]) >= least and 100 * len(of[s, x]) >= percent * len(total[s])}


def _found(spark, rows):
    lines = _lines(spark, rows)
    wanted = bp.repeated_lines(lines, bp.Excess(), exact=True)
    return {(r.key, r.line_no) for r in bp.occurrences(lines, wanted).collect()}


ROWS = (
    [(i, " Wire " if i % 2 else "WIRE", f"Story {i} of Anna Berg\nShare  this:\tmail | chat\r\nBy  Bo\n\nShare this: mail | chat\nUnique words number {i * 7} here") for i in range(30)]
    + [(100 + i, "small", "Only four times") for i in range(4)]
    + [(200, None, "Share this: mail | chat"), (201, "wire", None), (202, "wire", ""), (203, "wire", "  \n\t\n"), (204, "wire", "Lang " * 20_000)]
)


def test_found_equals_brute_force(spark):
    want = _brute(ROWS)
    assert (0, 2) in want and (0, 5) in want and (0, 3) in want and not any(k == 100 for k, _ in want)
    assert _found(spark, ROWS) == want


def test_repeated_rows_are_one_article(spark):
    rows = [(1, "s", "the same line")] * 9 + [(2, "s", "the same line")]
    assert _found(spark, rows) == set()


def test_share_of_a_source(spark):
    rows = [(i, "s", "rare line" if i < 5 else f"l{i}") for i in range(300)]
    assert _found(spark, rows) == _brute(rows) == set()
    assert _found(spark, rows[:250]) == {(i, 1) for i in range(5)}


def test_near_copies_form_a_cluster_and_are_removed(spark):
    names = ["Anna Berg", "Bo Lind", "Cara Diaz", "Dan Moor", "Eva Roth", "Finn Hale"]
    rows = [(i, "s", f"Figures of May {i + 3}, 2021 were read by {n} for page {i} of our daily list of prices and yields\nkept words {'abcdefgh'[i] * 3}") for i, n in enumerate(names)]
    lines = _lines(spark, rows)
    wanted = bp.repeated_lines(lines, bp.Excess(), exact=False)
    gone = bp.occurrences(lines, wanted)
    clean = {r.id: r.clean for r in bp.without_lines(_frame(spark, rows), "id", "content", gone, "clean").collect()}
    assert clean == {i: f"kept words {'abcdefgh'[i] * 3}" for i in range(6)}


def test_clusters_need_the_similarity(spark):
    base = [f"w{i}" for i in range(40)]
    near, far = base.copy(), base.copy()
    near[39] = "x"
    for i in range(0, 40, 5):
        far[i] = f"y{i}"
    forms = spark.createDataFrame([("s", n, " ".join(w)) for n, w in enumerate((base, near, far))], "source string, mask long, form string")
    links = {r.mask: r.cluster for r in bp.clusters(forms).collect()}
    assert links == {1: 0}


def _brute_clusters(texts, similarity=0.8):
    sets = {n: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for n, t in texts.items()}
    near = {n: {m for m in sets if m != n and len(sets[m] & sets[n]) >= similarity * len(sets[m] | sets[n])} for n in sets}
    of = {}
    for n in sorted(near):
        todo = [n] if n not in of else []
        while todo:
            m = todo.pop()
            of[m] = n
            todo += [x for x in near[m] if x not in of]
    return {m: n for m, n in of.items() if m != n}


@pytest.mark.parametrize("block", [bp.BLOCK, 3])
def test_clusters_equal_brute_force_with_chains_of_variants(spark, monkeypatch, block):
    monkeypatch.setattr(bp, "BLOCK", block)
    rng = np.random.default_rng(11)
    texts, n = {}, 0
    for family in range(25):
        words = [f"f{family}w{i}" for i in range(int(rng.integers(6, 50)))]
        for step in range(10):
            if step:
                words[int(rng.integers(0, len(words)))] = f"x{n}"
            texts[n * 7919 % 100_003] = " ".join(words)
            n += 1
    forms = spark.createDataFrame([("s", m, t) for m, t in texts.items()] + [("t", m, t) for m, t in list(texts.items())[:40]], "source string, mask long, form string")
    want = {("s", m): c for m, c in _brute_clusters(texts).items()} | {("t", m): c for m, c in _brute_clusters(dict(list(texts.items())[:40])).items()}
    assert len(want) > 60
    assert {(r.source, r.mask): r.cluster for r in bp.clusters(forms).collect()} == want


def test_components_follow_every_link(spark):
    links = spark.createDataFrame([("s", 9, 3), ("s", 9, 5), ("s", 8, 5), ("s", 8, 1), ("t", 9, 2)], "source string, mask long, rep long")
    assert {(r.source, r.mask, r.cluster) for r in bp.components(links).collect()} == {*(("s", m, 1) for m in (3, 5, 8, 9)), ("t", 9, 2)}
    assert bp.components(links.limit(0)).collect() == []


def test_hashing_alone_finds_most_links_of_families(spark):
    """Stars of a long line and eight variants with one word changed, at a similarity of 0.836 to it."""
    rng = np.random.default_rng(12)
    rows, pairs = [], []
    for family in range(100):
        base = [f"f{family}w{i}" for i in range(60)]
        rows.append((family * 9, base))
        for v in range(1, 9):
            words = base.copy()
            words[int(rng.integers(5, 55))] = f"x{v}"
            rows.append((family * 9 + v, words))
            pairs.append((family * 9, family * 9 + v))
    order = rng.permutation(900)
    forms = spark.createDataFrame([("s", int(order[n]), " ".join(w)) for n, w in rows], "source string, mask long, form string")
    found = {whole: {r.mask: r.cluster for r in bp.clusters(forms, whole=whole).collect()} for whole in (False, True)}
    same = {w: sum(c.get(int(order[a]), int(order[a])) == c.get(int(order[b]), int(order[b])) for a, b in pairs) / len(pairs) for w, c in found.items()}
    assert same[True] == 1.0 and same[False] > 0.2, same


def test_masks_keep_sentence_starts_and_short_lines(spark):
    lines = {
        "Bonds due 2041 were sold by Anna Berg on May 3, 2021": "Bonds due <0> were sold by <n> on <d>",
        "By Anna Berg": "By Anna Berg",
        "Read it here. Shares of Acme fell 3.5 percent": "Read it here. Shares of <n> fell <0> percent",
        "12 34 56": "12 34 56",
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.form for r in df.select("line", bp.masked(F.col("line")).alias("form")).collect()} == lines


def test_many_wanted_lines_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bp, "broadcast_if_small", lambda df, *_: (df, False))
    assert _found(spark, ROWS) == _brute(ROWS)


def test_empty(spark):
    assert _found(spark, []) == set()
