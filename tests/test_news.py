import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.html import text_of
from tidemark.functions.text import clean_symbols, content_hash, symbol_list, truncate
from tidemark.functions.times import instant_us
from tidemark.operators import alerts, ingest, retention, search, upsert
from tidemark.sources import frames


def _col(spark, values, kind, make):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_instants(spark):
    values = ["2022-01-03T00:00:01Z", "2022-01-03 00:00:01.5", "2022-01-02T19:00:01-05:00", "2022-01-03", "2022-01-03T00:00:01.123456789Z", "yesterday", "", None, "2022", "2022-13-40T00:00:00Z", "n/a", "2022-01-03 01:00+01:00", "2022-01-03T00:00"]
    base = 1_641_168_001_000_000
    got = _col(spark, values, "string", instant_us)
    assert got == [base, base + 500_000, base, base - 1_000_000, base + 123_456, None, None, None, None, None, None, base - 1_000_000, base - 1_000_000]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert _col(spark, values, "string", instant_us) == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_symbols(spark):
    assert _col(spark, ['["aapl", " MSFT ", "aapl", "", null]', "[]", None, "not json", '["\\tb\\n"]'], "string", symbol_list) == [["AAPL", "MSFT"], [], [], [], ["B"]]
    assert _col(spark, [["x", None, " X"], None], "array<string>", clean_symbols) == [["X"], []]


def test_hash_and_truncate(spark):
    import hashlib

    want = hashlib.sha256(b"h\0\0c").hexdigest()
    assert _col(spark, ["h"], "string", lambda c: content_hash(c, F.lit(None), F.lit("c"))) == [want]
    assert _col(spark, ["hello", "hello world", "ab   cdef", None], "string", lambda c: truncate(c, 8)) == ["hello", "hello...", "ab...", None]


def test_html():
    assert text_of("<p>Tom &amp; Jerry &lt;news&gt;</p>") == "Tom & Jerry <news>"
    assert text_of("<p>a</p><!-- no --><script>x()</script><b> b\xa0 c</b>") == "a b c"
    assert text_of(None) is None and text_of("") == ""


FEED = "id long, headline string, symbols array<string>, summary string, author string, created_at string, updated_at string, content_html string, content_text string, url string, source string, received_at string, latency_ms long, is_content_present int, n long"


def _states(spark, rows):
    full = [(i, h, s, m, None, None, u, None, None, None, None, f"r{n}", lat, 0, n) for n, (i, h, s, m, u, lat) in enumerate(rows)]
    return upsert.apply_updates(spark.createDataFrame(full, FEED), ["n"])


def test_updates_fold_in_order(spark):
    rows = [(1, "a", ["X"], "s", "u1", None), (1, "a", ["X"], None, None, 7), (1, "a", ["X", "Y"], None, None, 9), (1, "b", ["Y", "X"], None, "u1", None), (1, "b", ["X", "Y"], "t", None, None), (2, None, [], None, None, None)]
    states = _states(spark, rows).orderBy("n").collect()
    assert [(r.was_new, r.content_changed, r.changed, r.update_count) for r in states] == [(True, False, False, 0), (False, False, False, 0), (False, False, True, 1), (False, True, True, 2), (False, True, True, 3), (True, False, False, 0)]
    last = upsert.current(_states(spark, rows)).filter("id = 1").first()
    assert (last.summary, last.updated_at, last.latency_ms, last.first_seen_at, last.last_seen_at) == ("t", "u1", 7, "r0", "r4")
    assert upsert.new_versions(_states(spark, rows)).count() == 4
    assert {(r.status, r.n) for r in ingest.outcomes(_states(spark, rows)).collect()} == {("new", 2), ("updated", 3), ("duplicate", 1)}
    index = upsert.symbol_index(upsert.current(_states(spark, rows)))
    assert sorted(r.symbol for r in index.collect()) == ["X", "Y"]


ART = "id long, headline string, summary string, content_text string, symbols array<string>, received_us long, latest_us long, latency_ms long"


def _alerts(spark, text, symbols=(), interest=(), rules=None, received=0, latest=0):
    df = spark.createDataFrame([(1, text, None, None, list(symbols), received, latest, None)], ART)
    return {r.category: r for r in alerts.article_alerts(df, rules or alerts.Rules(), list(interest)).collect()}


def test_alert_severity_and_direction(spark):
    got = _alerts(spark, "Acme acquires Beta; merger raises outlook", ["ACME"])
    assert got["mna_keyword"].severity == "high" and got["mna_keyword"].matches == ["acquires", "merger"] and got["mna_keyword"].direction == "bullish"
    assert _alerts(spark, "Bankruptcy of Acme")["halt_risk_keyword"].severity == "critical"
    assert _alerts(spark, "The sec looks")["legal_regulatory_keyword"].severity == "low"
    hit = _alerts(spark, "The sec looks", ["ACME"], ["ACME"])
    assert hit["legal_regulatory_keyword"].severity == "high" and hit["held_or_interested_symbol"].symbols == ["ACME"]
    assert _alerts(spark, "Unsecured notestand, offers") == {}
    assert set(_alerts(spark, "Alert: markets")) == {"breaking_keyword"}
    assert _alerts(spark, "x", received=40_000_000, latest=1_000_000)["high_latency"].severity == "medium"
    assert _alerts(spark, None) == {}


def test_rule_layers(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text(json.dumps({"Chips": {"phrases": ["Fab"], "critical_phrases": ["outage"], "phrase": ["no"]}, "mna": {"phrases": ["deal", "tie-up"]}, "bad": 3}))
    rules = alerts.Rules().extended(alerts.read_overrides(str(path)))
    assert rules.groups["Chips"] == ["fab", "outage"] and rules.groups["mna"][-1] == "tie-up" and rules.groups["mna"].count("deal") == 1
    assert _alerts(spark, "outage at a fab", rules=rules)["custom_keyword"].severity == "critical"
    assert alerts.read_overrides(str(tmp_path / "none")) == {}


def test_copies_alert_once_a_day(spark):
    day = 86_400_000_000
    rows = [(1, "c", "h", 0), (1, "c", "h", 5), (2, "c", "h", day), (3, "c", "h", day + 1), (4, "c", "h", day + 2), (5, "d", "h", 1), (6, "c", None, 1), (7, "c", None, 1)]
    df = spark.createDataFrame(rows, "article_id long, category string, content_hash string, created_us long")
    assert sorted(r.article_id for r in alerts.without_copies(df).collect()) == [1, 3, 5, 6, 7]


def test_status_alerts(spark):
    rows = [("A", 1, "H", None), ("B", 1, "H", None), ("C", 1, "T", None), ("D", 1, "x", "Trading resumed"), ("E", 1, "x", None), ("F", 1, None, "volatility pause")]
    df = spark.createDataFrame(rows, "symbol string, ts_us long, status_code string, status_msg string")
    got = {r.symbol: (r.category, r.severity) for r in alerts.status_alerts(df, spark.createDataFrame([("A",)], "symbol string")).collect()}
    assert got == {"A": ("trading_halt", "critical"), "B": ("trading_halt", "low"), "C": ("trading_resume", "low"), "D": ("trading_resume", "low"), "F": ("trading_halt", "low")}


DOCS = [(1, "MegaCorp acquires TinyStartup", None, None), (2, "Apple ships new product", "hidden gem", "buried treasure"), (3, "Acquisition of assets; Apple beats earnings", None, "u.s. rules"), (4, None, None, None)]


def _found(spark, query):
    df = spark.createDataFrame(DOCS, "id long, headline string, summary string, content_text string")
    return [r.id for r in search.search_or_substring(df, query, 10, df).collect()]


def test_search(spark):
    assert _found(spark, "acquire") == [1] and _found(spark, "acquisitions") == [3]
    assert _found(spark, "apple earnings") == [3] and sorted(_found(spark, "APPLE")) == [2, 3]
    assert _found(spark, "gem") == [2] and _found(spark, "treasures") == [2]
    assert _found(spark, "cquir") == [1] and _found(spark, '" ( )') == [] and _found(spark, "U.S.") == [3]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("cease", "ceas"), ("sky", "sky"), ("été", "été")])
def test_stems(word, want):
    assert search.stem(word) == want


def test_frames_are_routed(spark):
    t = "2026-04-28T20:30:00.123456789Z"
    items = [
        {"T": "t", "S": "aapl", "i": 5, "x": "V", "p": 1.5, "s": 10, "c": ["@", "I"], "z": "C", "t": t}, {"T": "t", "S": "A", "p": None, "t": t}, {"T": "t", "S": "A", "p": True, "t": t},
        {"T": "q", "S": "A", "bp": 1, "ap": 2, "bs": 1, "as": 2, "t": t}, {"T": "b", "S": "A", "o": 1, "c": 2, "v": 3, "t": t}, {"T": "d", "S": "A", "c": 2, "t": t}, {"T": "b", "S": "A", "t": "bad"},
        {"T": "s", "S": "A", "sc": "H", "t": t}, {"T": "l", "S": "A", "u": 2.0, "d": 1.0, "t": t}, {"T": "c", "S": "A"}, {"x": 1},
    ]
    values = spark.createDataFrame([(json.dumps(items),), (json.dumps({"T": "x"}),), ("[1, 2]",)], "value string")
    out = frames.route(frames.decode(values))
    trade = out["trades"].collect()
    assert len(trade) == 1 and (trade[0].symbol, trade[0].conditions, trade[0].trade_id) == ("AAPL", "@,I", 5) and trade[0].ts_us % 1_000_000 == 123_456
    assert {k: v.count() for k, v in out.items()} == {"trades": 1, "quotes": 1, "bars": 2, "statuses": 1, "bands": 1, "raw": 8}
    assert {r.timeframe for r in out["bars"].collect()} == {"1min", "1day"}


def test_articles_are_normalised(spark):
    good = {"T": "n", "id": "7", "headline": None, "created_at": "2020-01-01T00:00:00Z", "updated_at": "bogus", "content": "<p>x</p>", "symbols": ["b", " a"], "future": {"x": 1}}
    values = spark.createDataFrame([(json.dumps(x),) for x in (good, {"id": 8, "symbols": "msft"}, {"T": "trade", "id": 1}, {"T": "n", "headline": "no id"}, {"id": "x1"})], "value string")
    rows, bad = frames.articles(frames.decode(values), F.lit("2020-01-01 00:00:01.5").cast("timestamp"))
    a, b = rows.orderBy("id").collect()
    assert (a.id, a.headline, a.symbols, a.content_text, a.latency_ms, a.updated_at, a.is_content_present) == (7, "", ["A", "B"], "x", 1500, None, True)
    assert json.loads(a.raw_json)["future"] == {"x": 1} and (b.symbols, b.latency_ms, b.is_content_present) == (["MSFT"], None, False)
    assert bad.count() == 3


def test_pages_follow_their_tokens(spark, tmp_path):
    from tidemark.sources.pages import JsonPages

    (tmp_path / "first.json").write_text(json.dumps({"news": [{"id": 1}, 3], "next_page_token": "p2"}))
    (tmp_path / "p2.json").write_text(json.dumps({"news": [{"id": 2}], "next_page_token": None}))
    spark.dataSource.register(JsonPages)
    got = spark.read.format("json_pages").option("path", str(tmp_path)).load().collect()
    assert [(json.loads(r.value)["id"], r.page) for r in got] == [(1, 0), (2, 1)]


def test_retention_and_replay(spark):
    arts = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id long, seen long")
    gone = retention.expired(arts, F.col("seen"), 10)
    kids = spark.createDataFrame([(1,), (2,), (3,), (None,)], "article_id long")
    assert {r.article_id for r in retention.keep_children(kids, gone).collect()} == {2, 3, None}
    raw = spark.createDataFrame([("a", "2", "queue_overflow_drop", "{}", False), ("b", "1", "queue_overflow_drop", "nope", None), ("c", "0", "other", "{}", False)], "event_id string, received_at string, endpoint string, raw_json string, replayed boolean")
    batch = ingest.to_replay(raw, limit=1)
    assert [r.event_id for r in batch.collect()] == ["b"]
    assert [r.event_id for r in ingest.to_replay(ingest.mark_replayed(raw, batch)).collect()] == ["a"]
    assert [r.parsed is None for r in ingest.parsed_or_text(raw).orderBy("event_id").collect()] == [False, True, False]


def test_gap_fill_starts(spark):
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    bars = spark.createDataFrame([("A", "1min", 99_000), ("C", "1min", 5)], "symbol string, timeframe string, ts long")
    starts = ingest.fill_starts(wanted, bars, 100_000)
    assert {(r.symbol, r.start) for r in starts.collect()} == {("A", 99_000), ("B", 96_400), ("C", 13_600)}
    fetched = spark.createDataFrame([("A", 98_999), ("A", 99_000), ("B", 96_400)], "symbol string, ts long")
    assert {(r.symbol, r.ts) for r in ingest.since_own_start(fetched, starts).collect()} == {("A", 99_000), ("B", 96_400)}
