"""Long spans that documents share word for word.

A character is shared if it lies in a window of ``length`` characters that stands in
another document too. The windows of a document are grouped by their minimizer: the
gram of ``GRAM`` characters with the smallest hash inside the window. Equal windows
have the same minimizer at the same place, so they meet under its hash, whichever
documents they are in; a document has about one minimizer for 50 characters.

Long texts are cut into pieces that overlap by one window less a character, so every
window lies in one piece and no task hashes more than a piece at once.

1. Each minimizer stands for a stretch of window starts; all stretches are written once.
   Minimizers found in one document only are dropped; they are counted before the shuffle.
2. Stretches with equal surroundings in two documents are shared as a whole. They are
   grouped by a hash of the surroundings, so copies never meet in pairs.
3. Where a minimizer has different surroundings, the windows of one stretch for each
   surrounding are compared by hash, which gives the exact ends of a span.
4. Overlapping and touching windows of a document are joined.

Every window is decided, whatever the number of documents that share it, and groups
are only ever aggregated. Windows are compared by 128 bits of hash.

Defined cases: null and short texts share nothing; rows with the same id are one
document; repetition inside a document does not count; offsets are code points.
Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, materialize

LENGTH = 200
GRAM = 100
SLICE_CHARS = 1 << 20
#: Low bits of a key that hold a place in a slice; a piece with its overlap is below that.
PLACE_BITS = 22
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SENT_ROWS, SENT_BYTES = 1_000_000, 48 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, "uint64")
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Hashes:
    """Polynomial hashes of all stretches of a text, for one base."""

    def __init__(self, mixed: np.ndarray, base: int) -> None:
        size = max(SLICE_CHARS, 1 << int(len(mixed)).bit_length()) + 1
        powers, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(mixed) + 1, "uint64")
        np.cumsum(mixed * powers[: len(mixed)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of at most ``SLICE_CHARS`` characters together; a longer text alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _codes(texts: list[str]) -> np.ndarray:
    return _mix(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("uint64"))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[: len(keys) - (width - done)], keys[width - done :]) if done < width else keys


def stretches(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each minimizer: text, first and last window start in it, hash of the gram, hash of the surroundings."""
    sizes = np.array([len(t) for t in texts], "int64")
    empty = np.empty(0, "int64")
    if sizes.sum() < length:
        return (empty,) * 5
    mixed = _codes(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    one, two = (Hashes(mixed, b) for b in BASES)
    at = np.arange(len(mixed) - gram + 1)
    grams = one.of(at, at + gram)
    low = np.uint64(PLACE_BITS)
    place = _least(grams >> low << low | at.astype("uint64"), length - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)
    start = np.flatnonzero(owner[: len(mixed) - length + 1] == owner[length - 1 :])
    if not len(start):
        return (empty,) * 5
    place = place[start].astype("int64")
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[start[1:]] != owner[start[:-1]])])
    first, last, place = start[new], start[np.r_[new[1:], len(start)] - 1], place[new]
    around = two.of(first, last + length)
    around = _mix(around ^ _mix(((place - first) << 32 | (last - place + length)).astype("uint64")))
    text = owner[first]
    return text, first - begin[text], last - begin[text], grams[place].view("int64"), around.view("int64")


def _pieces(documents: DataFrame, key: str, text: str, length: int, slice_chars: int) -> DataFrame:
    """``doc``, ``base`` and ``text`` of each piece: the window starts from ``base`` on, ``slice_chars`` of them at most."""
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")).filter((F.length("_text") >= length) & F.col("doc").isNotNull())
    last = F.expr(f"(length(_text) - {length}) div {slice_chars}").cast("int")
    cut = docs.select("doc", "_text", F.explode(F.sequence(F.lit(0), last)).alias("_piece"))
    part = F.substring("_text", F.col("_piece") * slice_chars + 1, F.lit(slice_chars + length - 1))
    return cut.select("doc", (F.col("_piece") * slice_chars).alias("base"), F.when(F.length("_text") < slice_chars + length, F.col("_text")).otherwise(part).alias("text"))


def _stretch_rows(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, base, texts = batch.column("doc").to_numpy(), batch.column("base").to_numpy(), batch.column("text").to_pylist()
            for a, b in _slices(texts):
                text, low, high, grams, around = stretches(texts[a:b], length, gram)
                found = [ids[a:b][text], base[a:b][text], low.astype("int32"), high.astype("int32"), grams, around]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["doc", "base", "low", "high", "gram", "around"])

    return pieces.select("doc", "base", "text").mapInArrow(kernel, "doc long, base int, low int, high int, gram long, around long")


def _window_rows(docs: DataFrame, length: int) -> DataFrame:
    """The hash of each window of the wanted stretches: ``gram``, ``window``, ``least``, ``most``, ``doc``, ``start``, ``open``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _windows(batch.slice(i, 1), length)

    return docs.mapInArrow(kernel, "gram long, window long, least long, most long, doc long, start int, open boolean")


def _windows(row: pa.RecordBatch, length: int) -> pa.RecordBatch:
    hashes = Hashes(_codes(row.column("text").to_pylist()), BASES[1])
    wanted = row.column("wanted").flatten()
    low, high, gram, least, most, open_ = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten())
    size = (high - low + 1).astype("int64")
    which = np.repeat(np.arange(len(size)), size)
    start = low[which] + np.arange(size.sum()) - (np.cumsum(size) - size)[which]
    base = row.column("base").to_numpy()
    values = [gram[which], hashes.of(start, start + length).view("int64"), least[which], most[which], np.repeat(row.column("doc").to_numpy(), size.sum()), (base + start).astype("int32"), open_[which]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["gram", "window", "least", "most", "doc", "start", "open"])


def shared_spans(documents: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``doc``, ``span_start``, ``span_end`` of each longest run of shared characters."""
    pieces = _pieces(documents, key, text, length, slice_chars)
    ends = lambda low, high: [F.min(low).alias("least"), F.max(high).alias("most")]
    several = F.col("least") != F.col("most")

    every = materialize(_stretch_rows(pieces, length, gram), "stretches")
    grams = every.groupBy("gram").agg(*ends("doc", "doc"), (F.min("around") != F.max("around")).alias("mixed")).filter(several)
    grams, _ = broadcast_if_small(grams.select("gram", "mixed"), "shared-grams", SENT_ROWS, SENT_BYTES)
    found = materialize(every.join(grams, "gram"), "shared-stretches")

    around = found.groupBy("gram", "around").agg(*ends("doc", "doc"))
    judged = materialize(found.join(around, ["gram", "around"]).withColumn("open", ~several), "judged-stretches")
    whole = judged.filter(several).select("doc", (F.col("base") + F.col("low")).alias("a"), (F.col("base") + F.col("high") + length).alias("b"))

    apart = judged.filter(F.col("mixed") & (F.col("open") | (F.col("doc") == F.col("least"))))
    wanted = apart.groupBy("doc", "base").agg(F.collect_list(F.struct("low", "high", "gram", "least", "most", "open")).alias("wanted"))
    wanted, _ = broadcast_if_small(wanted, "wanted-stretches", 100_000, SENT_BYTES)
    windows = materialize(_window_rows(pieces.join(wanted, ["doc", "base"]).select("doc", "base", "text", "wanted"), length), "window-hashes")
    met = windows.groupBy("gram", "window").agg(*ends("least", "most")).filter(several).select("gram", "window")
    parts = windows.filter("open").join(met, ["gram", "window"]).select("doc", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    return joined(whole.unionAll(parts))


def joined(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (``doc``, ``a``, ``b``) as one."""
    order = Window.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("_new", (reach.isNull() | (F.col("a") > reach)).cast("long"))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc", "_run").agg(F.min("a").cast("long").alias("span_start"), F.max("b").cast("long").alias("span_end"))
    return runs.select("doc", "span_start", "span_end")


def shared_share(documents: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """``doc``, ``n_chars``, ``shared_chars`` and ``share`` of every document; null texts have 0 characters and share 0."""
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    sums = spans.groupBy("doc").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    both = docs.join(sums, "doc", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return both.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
