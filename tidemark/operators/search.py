"""Search over articles: stemmed terms ranked by BM25, and plain substrings as a second way.

Tokens are runs of letters and digits, lower-cased and without accents, stemmed by
Porter's rules. Every word of a query must occur; a word with inner punctuation is a
phrase of its tokens within one field. Either one scan counts the terms of each article
and the corpus figures, or a :class:`TermIndex` built beforehand gives the postings of the query's terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

FIELDS = ["headline", "summary", "content_text"]
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased tokens without accents."""
    if not text:
        return []
    plain = unicodedata.normalize("NFKD", text.lower())
    return _WORD.findall("".join(c for c in plain if not unicodedata.combining(c)))


#: The suffixes of Porter's steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _shape(word)))


def _closes_short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of an English word; words with other letters or digits stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(rest):
                word = rest
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _closes_short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _closes_short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def phrases(query: str) -> list[list[str]]:
    """The stems of each word of a query; words without letters and digits drop out."""
    found = [[stem(t) for t in tokens(w)] for w in query.split()]
    return [p for p in found if p]


def _count(stems: list[str], phrase: list[str]) -> int:
    if len(phrase) == 1:
        return stems.count(phrase[0])
    return sum(stems[i : i + len(phrase)] == phrase for i in range(len(stems) - len(phrase) + 1))


def term_counts(articles: DataFrame, query: str) -> DataFrame:
    """``articles`` with ``n_tokens`` and ``hits``, the occurrences of each phrase of the query."""
    wanted = phrases(query)

    @F.pandas_udf("struct<n_tokens: long, hits: array<long>>")
    def count(headline: pd.Series, summary: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for texts in zip(headline, summary, content, strict=True):
            fields = [[stem(t) for t in tokens(x)] for x in texts]
            out.append((sum(map(len, fields)), [sum(_count(f, p) for f in fields) for p in wanted]))
        return pd.DataFrame(out, columns=["n_tokens", "hits"])

    return articles.withColumn("_c", count(*FIELDS)).select(*articles.columns, "_c.n_tokens", "_c.hits")


def _ranked(counted: DataFrame, facts: dict[str, float], count: int) -> DataFrame:
    """``id`` and ``score`` of rows (``id``, ``n_tokens``, ``hits``) that have all ``count`` phrases; ``facts`` holds ``n``, ``mean`` and the articles ``n0``, ``n1``, ... of each phrase."""
    score, every = F.lit(0.0), F.lit(True)
    for i in range(count):
        tf = F.col("hits")[i].cast("double")
        odds = (facts["n"] - facts[f"n{i}"] + 0.5) / (facts[f"n{i}"] + 0.5)
        weight = F.greatest(F.ln(F.lit(odds)), F.lit(1e-6))
        score = score + weight * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("n_tokens") / F.lit(facts["mean"] or 1.0)))
        every = every & (F.col("hits")[i] > 0)
    return counted.filter(every).select("id", score.alias("score"))


def scores(articles: DataFrame, query: str) -> DataFrame:
    """``id`` and ``score`` of the articles with every phrase, by one scan over all texts; an empty query finds nothing.

    ``id`` must be unique. Phrases in more than half of the articles weigh next to nothing.
    """
    wanted = phrases(query)
    counted = term_counts(articles.select("id", *FIELDS), query).select("id", "n_tokens", "hits")
    if not wanted:
        return counted.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    # the texts are read into terms once; the counts are few bytes an article
    counted = materialize(counted, "term-counts")
    have = [F.count_if(F.col("hits")[i] > 0).alias(f"n{i}") for i in range(len(wanted))]
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"), *have).first().asDict()
    return _ranked(counted, facts, len(wanted))


def search(articles: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """The articles of :func:`scores` with their ``score``; with a ``limit``, equal scores go by ``id``, and the caller orders the rows."""
    found = scores(articles, query)
    if limit is not None:
        found = found.orderBy(F.desc("score"), "id").limit(limit)
    return articles.join(found, "id")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x + by)


class TermIndex:
    """Postings of all articles in a folder: built once, then a query reads the postings of its own terms only.

    ``terms`` has a row for each term, article and field with the places of the term, in files by a hash of the
    term and ordered by it, so that the filter on terms reaches the scan. ``sizes`` has the tokens of each article.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def build(self, articles: DataFrame) -> TermIndex:
        """Read all texts into postings; an index that is there is replaced."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                texts = [batch.column(f).to_pylist() for f in FIELDS]
                for n, i in enumerate(batch.column("id").to_pylist()):
                    total = 0
                    for field, column in enumerate(texts):
                        at: dict[str, list[int]] = {}
                        for place, token in enumerate(tokens(column[n])):
                            at.setdefault(stem(token), []).append(place)
                            total += 1
                        rows += [(term, i, field, places) for term, places in at.items()]
                    rows.append(("", i, total, []))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "id", "field", "places"])

        made = articles.select("id", *FIELDS).mapInArrow(kernel, "term string, id long, field int, places array<int>")
        made = made.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))
        # a frequent term's postings are dealt over the tasks of its bucket
        spread = made.repartition("bucket", F.pmod("id", F.lit(8))).sortWithinPartitions("bucket", "term", "id", "field")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.home}/terms")
        # the empty term holds the number of tokens of an article
        sizes = self._terms([""]).select("id", F.col("field").cast("long").alias("n_tokens"))
        sizes.write.mode("overwrite").parquet(f"{self.home}/sizes")
        sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/facts")
        return self

    def _terms(self, wanted: list[str]) -> DataFrame:
        rows = self.spark.read.schema("term string, id long, field int, places array<int>, bucket int").parquet(f"{self.home}/terms")
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.BUCKETS)).cast("int")).collect()]
        return rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted)).drop("bucket")

    def scores(self, query: str) -> DataFrame:
        """What :func:`scores` gives, without reading a text."""
        wanted = phrases(query)
        if not wanted:
            return self.spark.createDataFrame([], "id long, score double")
        hits = None
        for i, phrase in enumerate(wanted):
            found = self._terms(sorted(set(phrase)))
            if len(phrase) == 1:
                one = found.groupBy("id").agg(F.sum(F.size("places")).alias(f"h{i}"))
            else:
                starts = [_moved(F.col(f"_p{j}"), -j) for j in range(len(phrase))]
                lists = [F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"_p{j}") for j, t in enumerate(phrase)]
                met = found.groupBy("id", "field").agg(*lists)
                both = reduce(F.array_intersect, starts)
                one = met.withColumn("_n", F.coalesce(F.size(both), F.lit(0))).filter("_n > 0").groupBy("id").agg(F.sum("_n").alias(f"h{i}"))
            hits = one if hits is None else hits.join(one, "id", "full")
        counts = [f"h{i}" for i in range(len(wanted))]
        hits = materialize(hits.select("id", F.array(*(F.coalesce(c, F.lit(0)) for c in counts)).alias("hits")), "term-hits")
        have = hits.agg(*(F.count_if(F.col("hits")[i] > 0).alias(f"n{i}") for i in range(len(wanted)))).first().asDict()
        facts = self.spark.read.parquet(f"{self.home}/facts").first().asDict() | have
        every = reduce(lambda a, b: a & b, (F.col("hits")[i] > 0 for i in range(len(wanted))))
        return _ranked(hits.filter(every).join(self.spark.read.parquet(f"{self.home}/sizes"), "id"), facts, len(wanted))


def containing(articles: DataFrame, query: str) -> DataFrame:
    """Articles with ``query`` as a substring of any field, whatever the case."""
    return articles.filter(any_field_contains(query))


def any_field_contains(query: str) -> Column:
    test = F.lit(False)
    for f in FIELDS:
        test = test | F.coalesce(F.contains(F.lower(f), F.lit(query.lower())), F.lit(False))
    return test


def search_or_substring(rows: DataFrame, query: str, limit: int, corpus: DataFrame, index: TermIndex | None = None) -> DataFrame:
    """The best ``limit`` of ``rows`` by the scores they have in the whole ``corpus``, or if there are none, substring matches (score 0)."""
    found = materialize(index.scores(query) if index else scores(corpus, query), "scores")
    ranked = rows.join(found, "id").orderBy(F.desc("score"), "id").limit(limit)
    if ranked.isEmpty():
        return containing(rows, query).withColumn("score", F.lit(0.0)).limit(limit)
    return ranked.orderBy(F.desc("score"), "id")
