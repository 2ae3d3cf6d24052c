"""The registered llm queries against their SQL and against plain recounts, on the smallest data."""

import os

import duckdb
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{small}/{f}')")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    short = lambda rows: sorted(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows)
    assert short(df.select(*columns).collect()) == short(want)


def test_spans_equal_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) >= 200]
    owners = {}
    for i, t in rows:
        for j in range(len(t) - 199):
            owners.setdefault(t[j : j + 200], set()).add(i)
    want = []
    for i, t in rows:
        end = -1
        for j in range(len(t) - 199):
            if len(owners[t[j : j + 200]]) > 1:
                if j > end:
                    want.append([i, j, j + 200])
                want[-1][2] = end = j + 200
    got = queries.QUERIES["p9_found"](spark, small)
    assert got.columns == ["doc_id", "span_start", "span_end"]
    assert sorted(map(list, got.collect())) == sorted(want)


def test_packs_hold_every_token_once(spark, small):
    ids = {r.doc_id: len(r.ids) for r in queries.QUERIES["p7_ids"](spark, small).collect()}
    rows = queries.QUERIES["p8_packs"](spark, small).collect()
    for name in {r.pack_name for r in rows}:
        sizes = {}
        for r in rows:
            if r.pack_name == name:
                sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.piece_tokens
        assert sizes == {i: n for i, n in ids.items() if n}
    for r in queries.QUERIES["p8_fill"](spark, small).collect():
        assert r.fewest <= r.containers <= r.fewest * (1.01 if r.limits == "tokens" else 1.3) + 1
    sums = {}
    for r in queries.QUERIES["p8_limits"](spark, small).collect():
        size, loss, count = sums.get((r.pack_name, r.container_id), (0, 0, 0))
        sums[r.pack_name, r.container_id] = (size + r.piece_tokens, loss + r.piece_loss, count + 1)
    most = {r.pack_name: r.capacity_tokens for r in spark.read.parquet(f"{small}/pack_capacity.parquet").collect()}
    assert all(t <= most[n] and u <= most[n] * 3 // 4 and c <= 16 for (n, _), (t, u, c) in sums.items())
    assert sum(t for t, _, _ in sums.values()) == len(most) * sum(ids.values())


def test_clean_texts_lack_the_found_lines(spark, small):
    found = {(r.article_id, r.line_no) for r in queries.QUERIES["p6_found"](spark, small).collect()}
    texts = {r.id: r.content_text for r in spark.read.parquet(f"{small}/news_articles.parquet").collect()}
    clean = {r.id: r.clean_text for r in queries.QUERIES["p6_clean"](spark, small).collect()}
    assert set(clean) == set(texts)
    for i, text in texts.items():
        if text is None:
            assert clean[i] is None
        else:
            kept = [x for n, x in enumerate(text.split("\n"), 1) if (i, n) not in found]
            left = iter(kept)
            assert all(any(x == y for y in left) for x in clean[i].split("\n")) or clean[i] == ""
