"""Lines repeated across the documents of one site, and the documents without them.

1. Each distinct line of a source is counted by the articles it stands in, before
   the shuffle on the map side as well.
2. Lines are masked (dates, numbers, names), so copies that differ in those only
   become one form. Lines of which masking leaves less than three words are their own form.
3. Forms of a source are clustered by locality-sensitive hashing: MinHash over
   shingles of five words, bands, and within each band bucket a comparison with
   the bucket's representative (its smallest number) that must reach the similarity.
4. What that misses is found by an exact prefix filter: with shingles in one order,
   rarest first, two forms of the similarity share one of their first few. Forms that
   share one and are not yet in one cluster are compared, in blocks of bounded size.
5. Clusters are the connected components of all links.
6. A cluster whose lines stand in enough articles of the source is boilerplate.

The first links cost linear work and leave few comparisons to the exact step. Forms are
told apart by numbers given to them once, not by a hash.

Defined cases: null sources and null or empty texts take no part; lines are compared
after white space runs became one space, and blank lines are no lines; a line counts
once per article; rows with the same id are one article, of which the smallest text
counts; shorter lines than five words are one shingle. Empty input gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 4, 3
#: Counters by which shingles are ordered; sharing one changes the order, never the result.
COUNTERS = 1 << 20
#: Parts into which the places of a line are dealt where the wanted lines are too many to be sent.
SALTS = 16
#: Words that must be left of a masked line.
LEAST_WORDS = 3
#: Lines of a bucket that one block of the exact comparison holds, on average.
BLOCK = 1000

#: The names of months, by which dates are masked.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
)
DATE = rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b|\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\.?(?:,?\s+\d{{4}})?\b"
NUMBER = r"\d[\d.,:/]*+"
#: A capitalised word within a sentence and those that follow it; possessive, so that matching a very long run needs no stack.
NAME = r"(?<=[^.!?:] )\p{Lu}[\p{L}'’\-]++(?:\s++\p{Lu}[\p{L}'’\-]++)*+"


@dataclass(frozen=True)
class Excess:
    """When a line is repeated too often: in at least ``articles`` articles and ``share`` percent of the source's articles."""

    articles: int = 5
    percent: int = 2


def squeezed(text: Column) -> Column:
    """Runs of spaces, tabs, carriage returns and no-break spaces as one space."""
    return F.regexp_replace(text, "[ \\t\\r\\u00a0]+", " ")


def masked(line: Column) -> Column:
    """The line with dates, numbers and names within sentences replaced by marks; itself if less than three words are left."""
    dated = F.lit(False)
    for hint in dict.fromkeys(["-", *(m[:3] for m in MONTHS.split("|"))]):
        dated = dated | F.contains(line, F.lit(hint))
    # most lines can have no date, and a plain search for its marks is far cheaper than the pattern
    undated = F.when(dated, F.regexp_replace(line, DATE, "<d>")).otherwise(line)
    uncounted = F.when(line.rlike("[0-9]"), F.regexp_replace(undated, NUMBER, "<0>")).otherwise(line)
    form = F.regexp_replace(uncounted, NAME, "<n>")
    left = lambda f: F.size(F.filter(F.split(f, " "), lambda w: ~F.startswith(w, F.lit("<"))))
    # through an array, so that the form is computed once for both of its uses
    return F.get(F.transform(F.array(form), lambda f: F.when(left(f) >= LEAST_WORDS, f).otherwise(line)), 0)


def article_lines(articles: DataFrame, key: str, source: Column, text: str) -> DataFrame:
    """``key``, ``source`` and the array ``lines`` of each article that takes part."""
    rows = articles.select(F.col(key).alias("key"), source.alias("source"), F.col(text).alias("text"))
    rows = rows.filter(F.col("source").isNotNull() & (F.col("text") != "") & F.col("key").isNotNull())
    # reads the ids only; texts are shuffled only where ids repeat
    ids = articles.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND key IS NOT NULL")
    if not ids.isEmpty():
        rows = rows.groupBy("key").agg(F.min(F.struct("text", "source")).alias("_one")).select("key", "_one.source", "_one.text")
    return rows.select("key", "source", F.transform(F.split(squeezed(F.col("text")), "\n"), lambda x: F.trim(x)).alias("lines"))


def line_counts(lines: DataFrame) -> DataFrame:
    """``source``, ``line``, ``n`` articles it stands in, and its masked ``form``; the empty line counts the source's articles."""
    distinct = F.array_distinct(F.filter("lines", lambda x: x != ""))
    each = lines.select("source", F.explode(F.concat(distinct, F.array(F.lit("")))).alias("line"))
    counted = each.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("form", masked(F.col("line")))


def _signatures(forms: DataFrame) -> DataFrame:
    """Band keys of each masked form, as rows (source, mask, band)."""
    rng = np.random.default_rng(20)
    odd = (rng.integers(1, 1 << 62, BANDS * ROWS, dtype="uint64") << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 1 << 62, BANDS * ROWS, dtype="uint64")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, sizes = _shingles(batch.column("form").to_pylist())
            starts = np.cumsum(sizes) - sizes
            keys = np.empty((batch.num_rows, BANDS), "int64")
            for b in range(BANDS):
                mixed = np.full(batch.num_rows, b + 1, "uint64")
                for r in range(b * ROWS, (b + 1) * ROWS):
                    # the high bits of a product are well mixed
                    least = np.minimum.reduceat((flat * odd[r] + add[r]) >> np.uint64(16), starts)
                    mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                keys[:, b] = mixed.view("int64")
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS), keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("mask"), bands], names=["source", "mask", "bands"])

    made = forms.select("source", "mask", "form").mapInArrow(kernel, "source string, mask long, bands array<long>")
    return made.select("source", "mask", F.explode("bands").alias("band"))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        data = word.encode()
        found = zlib.crc32(data) << 32 | zlib.adler32(data) ^ len(data)
        if len(self) < 1 << 18:
            self[word] = found
        return found


_WORDS = _Words()


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of five words of all texts, one after the other, and their number in each; a shorter text is one shingle. Repeated shingles repeat."""
    split = [t.split() for t in texts]
    count = np.fromiter(map(len, split), "int64", len(split))
    many = np.maximum(count - SHINGLE + 1, 1)
    word = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(split)), "uint64", int(count.sum()))
    word = (word ^ word >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    word = np.concatenate([word ^ word >> np.uint64(29), np.zeros(SHINGLE, "uint64")])
    owner = np.repeat(np.arange(len(split)), many)
    first = np.cumsum(count) - count
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    end = (first + count)[owner]
    out = np.full(len(at), 0x2545F4914F6CDD1D, "uint64")
    for j in range(SHINGLE):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(at + j < end, word[np.minimum(at + j, len(word) - 1)], np.uint64(j + 1))
        out ^= out >> np.uint64(32)
    return out, many


def _shingle_sets(texts: list[str]) -> list[frozenset[int]]:
    flat, sizes = _shingles(texts)
    ends = np.cumsum(sizes)
    values = flat.tolist()
    return [frozenset(values[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _similar(one: list[str], two: list[str], similarity: float) -> np.ndarray:
    """Whether the texts at the same place of both lists have at least that Jaccard similarity."""

    def marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = _shingles(texts)
        row = np.repeat(np.arange(len(texts)), sizes)
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        first = np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])] if len(flat) else np.zeros(0, bool)
        return flat[first], row[first]

    (a, at), (b, bt) = marked(one), marked(two)
    flat, row = np.concatenate([a, b]), np.concatenate([at, bt])
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    met = np.bincount(row[1:][(flat[1:] == flat[:-1]) & (row[1:] == row[:-1])], minlength=len(one))
    return met >= similarity * (np.bincount(row, minlength=len(one)) - met)


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """Rows of ``pairs`` whose texts ``form`` and ``other`` have at least that Jaccard similarity."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _similar(batch.column("form").to_pylist(), batch.column("other").to_pylist(), similarity)
                yield batch.filter(pa.array(keep, pa.bool_())).select(["source", "mask", "rep"])

    return pairs.select("source", "mask", "rep", "form", "other").mapInArrow(kernel, "source string, mask long, rep long")


def _prefixes(forms: DataFrame, similarity: float) -> DataFrame:
    """The shingles of each masked form of which two alike forms share at least one, as rows (source, mask, shingle)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, "int64")
        for batch in batches:
            seen += np.bincount(_counter(_shingles(batch.column("form").to_pylist())[0]), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    told = forms.select("form").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(COUNTERS, "int64")
    often[told["at"].to_numpy("int64")] = told["n"].to_numpy("int64")
    sent = forms.sparkSession.sparkContext.broadcast(often)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = sent.value
        for batch in batches:
            flat, sizes = _shingles(batch.column("form").to_pylist())
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, n_of[_counter(flat)], row))
            flat, row = flat[order], row[order]
            if len(flat):
                new = np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]
                flat, row = flat[new], row[new]
            size = np.bincount(row, minlength=batch.num_rows)
            many = size - np.ceil(similarity * size - 1e-9).astype("int64") + 1
            place = np.arange(len(flat)) - (np.cumsum(size) - size)[row]
            kept = place < many[row]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.minimum(many, size))]), flat[kept].view("int64"))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("mask"), lists], names=["source", "mask", "first"])

    made = forms.select("source", "mask", "form").mapInArrow(kernel, "source string, mask long, first array<long>")
    return made.select("source", "mask", F.explode("first").alias("shingle"))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return ((shingles ^ shingles >> np.uint64(32)) % np.uint64(COUNTERS)).astype("int64")


def _rest_links(forms: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (source, mask, rep) that join the clusters of ``known`` wherever two forms of different ones are alike."""
    own = forms.select("source", "mask", "form").join(known, ["source", "mask"], "left").withColumn("cluster", F.coalesce("cluster", "mask"))
    first = materialize(_prefixes(forms, similarity).join(own.drop("form"), ["source", "mask"]), "line-prefixes")
    buckets = first.groupBy("source", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("_a"), F.max("cluster").alias("_b"))
    buckets = buckets.filter("_a <> _b").select("source", "shingle", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("_blocks"))
    rows = first.join(buckets, ["source", "shingle"]).withColumn("_own", F.pmod(F.xxhash64("mask"), "_blocks"))
    # each pair of blocks meets once; a row goes to the pairs of its own block
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other"))
    keys = ["source", "shingle", "low", "high"]
    rows = rows.join(own.drop("cluster"), ["source", "mask"]).select(*keys, (F.col("_own") == F.col("high")).alias("late"), "mask", "cluster", "form")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []
        for batch in batches:
            out = []
            *columns, forms_ = (c.to_pylist() for c in batch.columns)
            for *key, late, mask, cluster, shingles in zip(*columns, _shingle_sets(forms_), strict=True):
                if key != at:
                    out += _block_links(at, block, similarity)
                    at, block = key, []
                block.append((late, mask, cluster, shingles))
            yield _link_batch(out)
        yield _link_batch(_block_links(at, block, similarity))

    return rows.mapInArrow(kernel, "source string, mask long, rep long").distinct()


def _link_batch(links: list[tuple[str, int, int]]) -> pa.RecordBatch:
    source, mask, rep = zip(*links, strict=True) if links else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(mask, pa.int64()), pa.array(rep, pa.int64())], names=["source", "mask", "rep"])


def _block_links(key: list | None, block: list[tuple[bool, int, int, frozenset[int]]], similarity: float) -> list[tuple[str, int, int]]:
    """Links that join all clusters of a block of which two forms are alike; forms of one cluster are not compared."""
    if key is None or len({cluster for _, _, cluster, _ in block}) < 2:
        return []
    source, _, low, high = key
    one = low == high
    root: dict[int, int] = {cluster: cluster for _, _, cluster, _ in block}
    # forms of each cluster that later rows meet: all of them within one block, else those of the lower block
    met: dict[int, list[tuple[int, frozenset[int]]]] = {}
    out = []

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    if not one:
        for late, mask, cluster, mine in block:
            if not late:
                met.setdefault(cluster, []).append((mask, mine))
    for late, mask, cluster, mine in block:
        if not one and not late:
            continue
        here = top(cluster)
        for other in list(met):
            if other == here:
                continue
            for rep, theirs in met[other]:
                few, many = sorted((len(mine), len(theirs)))
                both = len(mine & theirs) if few >= similarity * many - 1e-9 else 0
                if both and both >= similarity * (few + many - both):
                    out.append((source, max(mask, rep), min(mask, rep)))
                    root[other] = here
                    met.setdefault(here, []).extend(met.pop(other))
                    break
        if one:
            met.setdefault(here, []).append((mask, mine))
    return out


def components(links: DataFrame) -> DataFrame:
    """``source``, ``mask``, ``cluster`` of every mask but the smallest of each connected component of the links (source, mask, rep < mask).

    Large and small stars in turn: a node's greater neighbours go to its smallest one, then
    the node and its smaller neighbours do, until every link leads to the smallest of all.
    """
    edges = materialize(links.select("source", "mask", "rep").distinct(), "line-links")
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("source", "mask", "rep"))).first()
    before = print_of(edges)
    while True:
        back = edges.select("source", F.col("rep").alias("mask"), F.col("mask").alias("rep"))
        near = edges.unionAll(back)
        least = near.groupBy("source", "mask").agg(F.min("rep").alias("_m")).withColumn("_m", F.least("_m", "mask"))
        large = near.join(least, ["source", "mask"]).filter("rep > mask").select("source", F.col("rep").alias("mask"), F.col("_m").alias("rep"))
        large = materialize(large.distinct(), "line-stars")
        least = large.groupBy("source", "mask").agg(F.min("rep").alias("_m"))
        moved = large.join(least, ["source", "mask"]).filter("rep <> _m").select("source", F.col("rep").alias("mask"), F.col("_m").alias("rep"))
        edges = materialize(least.select("source", "mask", F.col("_m").alias("rep")).unionAll(moved).distinct(), "line-links")
        after = print_of(edges)
        if after == before:
            return edges.select("source", "mask", F.col("rep").alias("cluster"))
        before = after


def clusters(forms: DataFrame, similarity: float = SIMILARITY, whole: bool = True) -> DataFrame:
    """``source``, ``mask``, ``cluster`` of the masked forms that belong to another one's cluster; all others are their own.

    ``forms`` has one row per source and mask. Two forms of a source are in one cluster exactly if a
    chain of forms leads from one to the other with each step of at least the similarity. Without
    ``whole`` only the links found by hashing count, which is enough where clusters don't change the result.
    """
    bands = materialize(_signatures(forms), "line-bands")
    buckets = bands.groupBy("source", "band").agg(F.min("mask").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = bands.join(buckets, ["source", "band"]).filter(F.col("mask") != F.col("rep")).select("source", "mask", "rep").distinct()
    texts = forms.select("source", "mask", "form")
    with_texts = pairs.join(texts, ["source", "mask"]).join(texts.select("source", F.col("mask").alias("rep"), F.col("form").alias("other")), ["source", "rep"])
    found = components(_alike(with_texts, similarity))
    if not whole:
        return found
    links = found.select("source", "mask", F.col("cluster").alias("rep"))
    return components(links.unionAll(_rest_links(forms, found, similarity)))


def _threshold(counts: DataFrame, totals: DataFrame, n: str, rule: Excess) -> DataFrame:
    enough = (F.col(n) >= rule.articles) & (F.col(n) * 100 >= F.col("articles") * rule.percent)
    return counts.join(totals, "source").filter(enough).drop("articles")


def repeated_lines(lines: DataFrame, rule: Excess, exact: bool, similarity: float = SIMILARITY) -> DataFrame:
    """``source``, ``line``, ``cluster`` of boilerplate.

    Clusters whose lines together have enough articles are found first. With
    ``exact``, a line of such a cluster must then itself be repeated enough. Else the
    distinct articles of the cluster decide. The articles of a cluster are never fewer than
    those of one of its lines, so ``exact`` loses none, however the lines are clustered, and
    takes the clusters that hashing alone finds.
    """
    counted = materialize(line_counts(lines), "line-counts")
    totals = counted.filter("line = ''").select("source", F.col("n").alias("articles"))
    counted = counted.filter("line <> ''")
    forms = counted.groupBy("source", "form").agg(F.sum("n").alias("n"))
    # the numbers are written out, so that all uses see the same ones
    forms = materialize(forms.withColumn("mask", F.monotonically_increasing_id()), "line-forms")
    links = clusters(forms, similarity, whole=not exact)
    placed = forms.join(links, ["source", "mask"], "left").withColumn("cluster", F.coalesce("cluster", "mask"))
    heavy = _threshold(placed.groupBy("source", "cluster").agg(F.sum("n").alias("total")), totals, "total", rule)
    members = placed.drop("n", "mask").join(heavy.select("source", "cluster"), ["source", "cluster"])
    found = counted.join(members, ["source", "form"])
    if exact:
        return _threshold(found, totals, "n", rule).select("source", "line", "cluster")
    found = materialize(found.select("source", "line", "cluster"), "cluster-lines")
    stands = occurrences(lines, found).groupBy("source", "cluster").agg(F.count_distinct("key").alias("total"))
    return found.join(_threshold(stands, totals, "total", rule).select("source", "cluster"), ["source", "cluster"]).select("source", "line", "cluster")


def occurrences(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key``, ``line_no`` (from 1) and the columns of ``wanted``, for each place where a wanted line stands.

    The wanted lines are sent to all executors if they are few; else both sides are
    shuffled by source and line, and the places of each line are dealt into parts.
    """
    wanted, sent = broadcast_if_small(wanted, "wanted-lines", 200_000, 48 << 20)
    places = lines.select("key", "source", F.posexplode("lines").alias("at", "line")).filter(F.col("line") != "")
    keys = ["source", "line"]
    if not sent:
        places = places.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        wanted = wanted.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        keys.append("_salt")
    return places.join(wanted, keys).select("key", (F.col("at") + 1).cast("long").alias("line_no"), *(c for c in wanted.columns if c != "_salt"))


def without_lines(articles: DataFrame, key: str, text: str, drop: DataFrame, out: str) -> DataFrame:
    """``key`` and the text as ``out``, without the lines (``key``, ``line_no``) of ``drop``; other lines stay as they are."""
    gone = drop.groupBy("key").agg(F.collect_set("line_no").alias("_gone"))
    rows = articles.select(F.col(key), F.col(text).alias("_text")).join(gone.withColumnRenamed("key", key), key, "left")
    kept = F.filter(F.split("_text", "\n"), lambda _, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    return rows.select(key, F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias(out))
