"""The registered queries of the training-data problems tagged llm, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import source_name, symbol_list
from tidemark.llm import automata, boilerplate, bpe, cooccur, nearest, packing, spans
from tidemark.operators.deliveries import TRADE_IDENTITY, first_deliveries
from tidemark.session import spread
from tidemark.sources.tables import table

TOLERANCE_US = 2_000_000


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each first-delivered trade with the nearest valid quote of its symbol within two seconds."""
    trades = first_deliveries(table(spark, d, "stock_trades").select(*TRADE_IDENTITY, "ingest_seq"))
    quotes = table(spark, d, "stock_quotes").filter("bid_price > 0 AND ask_price > 0")
    pairs = nearest.nearest_in_time(trades, quotes, "symbol", "ts_us", "ingest_seq", TOLERANCE_US)
    return pairs.select(F.col("left_seq").alias("trade_seq"), F.col("right_seq").alias("quote_seq"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "news_articles").select("id", symbol_list("symbols_json").alias("symbols"))
    return cooccur.pair_counts(articles, "id", "symbols", min_count=5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of symbols named together in at least 5 articles and 4 times as often as by chance."""
    return cooccur.above_chance(_pairs(spark, d), 4).select(F.col("item_a").alias("symbol_a"), F.col("item_b").alias("symbol_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs in at least 5 articles with their counts, ratio to independence and odds ratio."""
    pairs = _pairs(spark, d)
    return pairs.select(F.col("item_a").alias("symbol_a"), F.col("item_b").alias("symbol_b"), "n_ab", "n_a", "n_b", "n_all", "ratio", "odds_ratio")


def _article_lines(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "news_articles").select("id", "source", "content_text")
    return boilerplate.article_lines(articles, "id", source_name("source"), "content_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each place of a line that at least 5 articles and 2 % of its source's articles have."""
    lines = _article_lines(spark, d)
    wanted = boilerplate.repeated_lines(lines, boilerplate.Excess(), exact=True)
    return boilerplate.occurrences(lines, wanted).select(F.col("key").alias("article_id"), "line_no")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every article's text without the lines of its source's near-duplicate clusters that are in too many articles."""
    lines = _article_lines(spark, d)
    wanted = boilerplate.repeated_lines(lines, boilerplate.Excess(), exact=False)
    gone = boilerplate.occurrences(lines, wanted)
    return boilerplate.without_lines(table(spark, d, "news_articles"), "id", "content_text", gone, "clean_text")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.with_ids(_documents(spark, d))


#: Limits beside the capacity in ``p8_limits``: documents of a container, and percent of the capacity that may bear loss.
SEGMENTS, LOSS_PERCENT = 16, 75


def _packs(spark: SparkSession, d: str) -> DataFrame:
    items = bpe.with_token_count(_documents(spark, d), count="tokens").withColumn("loss", F.col("tokens"))
    return packing.pack_all(items, "doc_id", table(spark, d, "pack_capacity"))


def _limited(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed under three limits; a document's first line is its prompt, what follows bears loss."""
    texts = _documents(spark, d).withColumn("prompt", F.when(F.contains("text", F.lit("\n")), F.substring_index("text", "\n", 1)))
    items = bpe.with_token_count(bpe.with_token_count(texts, count="tokens"), text="prompt", count="asked")
    items = items.withColumn("loss", F.greatest(F.lit(0), F.col("tokens") - F.col("asked")))
    return packing.pack_all(items, "doc_id", table(spark, d, "pack_capacity"), SEGMENTS, LOSS_PERCENT)


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or piece of a document larger than a container, for each capacity."""
    return _packs(spark, d).drop("piece_loss")


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """The same under limits on tokens, documents and loss-bearing tokens of a container at once."""
    return _limited(spark, d)


def _fill(packs: DataFrame, capacities: DataFrame, limits: str, fewest: Column) -> DataFrame:
    sums = packs.groupBy("pack_name", "container_id").agg(F.sum("piece_tokens").alias("t"), F.sum("piece_loss").alias("l"), F.count(F.lit(1)).alias("s"))
    totals = sums.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.sum("l").alias("loss"), F.sum("s").alias("segments"))
    room = F.col("containers") * F.col("capacity_tokens")
    known = totals.join(capacities, "pack_name")
    return known.select("pack_name", F.lit(limits).alias("limits"), "containers", "tokens", fewest.cast("long").alias("fewest"), ((room - F.col("tokens")) / room).alias("unused"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity, with the token limit only and with all three: the number of containers, a lower bound of it, and the share of room left unused."""
    capacities = table(spark, d, "pack_capacity").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    least = lambda used, most: F.ceil(F.col(used) / most)
    tokens = least("tokens", F.col("capacity_tokens"))
    every = F.greatest(tokens, least("segments", F.lit(SEGMENTS)), least("loss", F.expr(f"capacity_tokens * {LOSS_PERCENT} div 100")))
    return _fill(_packs(spark, d), capacities, "tokens", tokens).unionAll(_fill(_limited(spark, d), capacities, "tokens, segments, loss", every))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of 200 or more characters of a document that also stands in another one."""
    return spans.shared_spans(_documents(spark, d), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p9_reference(spark: SparkSession, d: str) -> DataFrame:
    """The same for the documents whose id is divisible by 20, against all documents, by broadcast suffix automata."""
    found = automata.reference_spans(_documents(spark, d), "doc_id", "text", F.col("doc_id") % 20 == 0)
    return found.withColumnRenamed("doc", "doc_id")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document is shared."""
    documents = _documents(spark, d)
    return spans.shared_share(documents, "doc_id", "text", spans.shared_spans(documents, "doc_id", "text")).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_pairs, p6_found, p6_clean, p7_ids, p8_packs, p8_limits, p8_fill, p9_found, p9_reference, p9_share)}

_FIRST = f"SELECT {', '.join(TRADE_IDENTITY)}, min(ingest_seq) AS ingest_seq FROM stock_trades GROUP BY {', '.join(TRADE_IDENTITY)}"

_PAIRS = """
  WITH s AS (
    SELECT DISTINCT id, upper(trim(x)) AS s FROM (SELECT id, unnest(from_json(symbols_json, '["VARCHAR"]')) AS x FROM news_articles) WHERE x IS NOT NULL AND trim(x) <> ''),
  c AS (SELECT s, count(*) AS n FROM s GROUP BY s),
  p AS (SELECT a.s AS symbol_a, b.s AS symbol_b, count(*) AS n_ab FROM s a JOIN s b ON a.id = b.id AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 5)
  SELECT symbol_a, symbol_b, n_ab, ca.n AS n_a, cb.n AS n_b, (SELECT count(DISTINCT id) FROM s) AS n_all,
         n_ab::DOUBLE * (SELECT count(DISTINCT id) FROM s) / (ca.n::DOUBLE * cb.n) AS ratio,
         (n_ab + 0.5::DOUBLE) * ((SELECT count(DISTINCT id) FROM s) - ca.n - cb.n + n_ab + 0.5::DOUBLE) / ((ca.n - n_ab + 0.5::DOUBLE) * (cb.n - n_ab + 0.5::DOUBLE)) AS odds_ratio
  FROM p JOIN c ca ON ca.s = symbol_a JOIN c cb ON cb.s = symbol_b"""

ORACLES = {
    "p2_found": f"""
      WITH t AS ({_FIRST}),
      q AS (SELECT symbol, ts_us, min(ingest_seq) AS quote_seq FROM stock_quotes WHERE bid_price > 0 AND ask_price > 0 GROUP BY 1, 2),
      b AS (SELECT t.ingest_seq AS trade_seq, q.quote_seq, t.ts_us - q.ts_us AS off FROM t ASOF JOIN q ON t.symbol = q.symbol AND t.ts_us >= q.ts_us),
      a AS (SELECT t.ingest_seq AS trade_seq, q.quote_seq, q.ts_us - t.ts_us AS off FROM t ASOF JOIN q ON t.symbol = q.symbol AND t.ts_us < q.ts_us),
      r AS (SELECT *, row_number() OVER (PARTITION BY trade_seq ORDER BY off, later) AS k
            FROM (SELECT *, 0 AS later FROM b UNION ALL SELECT *, 1 FROM a) WHERE off <= 2000000)
      SELECT trade_seq, quote_seq FROM r WHERE k = 1""",
    "p3_found": f"SELECT symbol_a, symbol_b FROM ({_PAIRS}) WHERE n_ab::HUGEINT * n_all >= 4 * n_a::HUGEINT * n_b",
    "p3_pairs": _PAIRS,
    "p6_found": r"""
      WITH a AS (SELECT id, lower(trim(source, ' ')) AS source, string_split(content_text, chr(10)) AS parts FROM news_articles WHERE source IS NOT NULL AND content_text <> ''),
      l AS (SELECT id, source, generate_subscripts(parts, 1) AS line_no, trim(regexp_replace(unnest(parts), '[ \t\r\x{00A0}]+', ' ', 'g'), ' ') AS line FROM a),
      n AS (SELECT source, count(*) AS articles FROM a GROUP BY 1),
      r AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT id) AS c FROM l WHERE line <> '' GROUP BY 1, 2) JOIN n USING (source) WHERE c >= 5 AND c * 100 >= articles * 2)
      SELECT id AS article_id, CAST(line_no AS BIGINT) AS line_no FROM l JOIN r USING (source, line)""",
}
