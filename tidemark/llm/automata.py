"""Spans that documents of a reference set share with any other document, by suffix automata of the reference set.

1. Reference documents are dealt into shards of bounded size. One task builds the suffix
   automaton of a shard; it is kept as flat arrays, about 48 bytes a character.
2. Automata are sent to all executors, as many at a time as a measured bound allows, and
   documents are streamed through them for matching statistics. A window of ``length``
   characters that stands in the shard is one state of its automaton; states met by
   a document other than the one they come from are marked.
3. Each shard's documents walk through its automaton once more and give the windows
   whose states are marked.

Only stretches of documents are streamed that share a minimizer with a reference document,
without which they share no window either. Rounds grow with the reference set, each reads the
candidates of its own shards only.

Defined cases: as in ``spans.py``. Windows are compared character by character.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans
from tidemark.session import materialize

#: Characters of a shard, and bytes of automata that are sent at a time.
SHARD_CHARS = 1 << 17
SENT_BYTES = 64 << 20
#: Codes from here on stand between documents; no character has them.
BETWEEN = 0x110000
SEVERAL = -2


class Automaton:
    """A suffix automaton as flat arrays: suffix links, longest lengths, and the transitions of each state ordered by code."""

    def __init__(self, link: array, size: array, first: array, code: array, to: array) -> None:
        self.link, self.size, self.first, self.code, self.to = link, size, first, code, to

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Automaton:
        """The automaton of all substrings of the texts, given as codes."""
        after: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for n, text in enumerate(texts):
            for c in [*text.tolist(), BETWEEN + n]:
                made = len(after)
                after.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in after[p]:
                    after[p][c] = made
                    p = link[p]
                if p >= 0:
                    q = after[p][c]
                    if size[q] == size[p] + 1:
                        link[made] = q
                    else:
                        copy = len(after)
                        after.append(after[q].copy())
                        size.append(size[p] + 1)
                        link.append(link[q])
                        while p >= 0 and after[p].get(c) == q:
                            after[p][c] = copy
                            p = link[p]
                        link[q] = link[made] = copy
                last = made
        first, code, to = array("i", [0]), array("i"), array("i")
        for step in after:
            keys = sorted(step)
            code.extend(keys)
            to.extend([step[k] for k in keys])
            first.append(len(code))
        return cls(array("i", link), array("i", size), first, code, to)

    def parts(self) -> tuple[array, ...]:
        return self.link, self.size, self.first, self.code, self.to

    def to_bytes(self) -> bytes:
        return np.array([len(a) for a in self.parts()], "int64").tobytes() + b"".join(a.tobytes() for a in self.parts())

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        ends = np.cumsum(np.frombuffer(data[:40], "int64") * 4) + 40
        parts = []
        for a, b in zip([40, *ends[:-1]], ends, strict=True):
            part = array("i")
            part.frombytes(data[a:b])
            parts.append(part)
        return cls(*parts)

    def windows(self, text: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """Start and state of each window of the text that stands in the automaton: the matching statistics cut at ``length``."""
        link, size, first, code, to = self.parts()
        state, matched = 0, 0
        for at, c in enumerate(text.tolist()):
            while True:
                a, b = first[state], first[state + 1]
                i = a if b - a == 1 else bisect_left(code, c, a, b)
                if i < b and code[i] == c:
                    state = to[i]
                    matched += 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = size[state]
            if matched >= length:
                # the suffix of that length, which the next character extends
                while size[link[state]] >= length:
                    state = link[state]
                matched = length
                yield at - length + 1, state


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<i4")


def _owners(automaton: Automaton, ids: list[int], texts: list[np.ndarray], length: int) -> dict[int, int]:
    """The document of each window's state, ``SEVERAL`` if there is more than one."""
    owner: dict[int, int] = {}
    for i, text in zip(ids, texts, strict=True):
        for _, state in automaton.windows(text, length):
            if owner.setdefault(state, i) != i:
                owner[state] = SEVERAL
    return owner


def _built(shards: DataFrame, length: int) -> DataFrame:
    """``shard``, its ``docs``, the ``automaton`` and the owners of window states as two arrays."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                docs = one.column("docs")[0].as_py()
                texts = [_codes(d["text"]) for d in docs]
                automaton = Automaton.of(texts)
                owner = _owners(automaton, [d["doc"] for d in docs], texts, length)
                made = [pa.array([automaton.to_bytes()], pa.binary()), pa.array([list(owner)], pa.list_(pa.int32())), pa.array([list(owner.values())], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([one.column("shard"), one.column("docs"), *made], names=["shard", "docs", "automaton", "states", "owners"])

    return shards.mapInArrow(kernel, "shard int, docs array<struct<doc: bigint, base: int, text: string>>, automaton binary, states array<int>, owners array<bigint>")


def _marks(candidates: DataFrame, sent: dict[int, tuple[bytes, list[int], list[int]]], length: int) -> DataFrame:
    """Distinct ``shard``, ``state`` of windows met by a document that is not their only one."""
    held = candidates.sparkSession.sparkContext.broadcast(sent)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[Automaton, dict[int, int]]] = {}
        for batch in batches:
            met: set[tuple[int, int]] = set()
            for doc, shard, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "shard", "text")), strict=True):
                if shard not in known:
                    data, states, owners = held.value[shard]
                    known = {shard: (Automaton.from_bytes(data), dict(zip(states, owners, strict=True)))}
                automaton, owner = known[shard]
                met.update((shard, s) for _, s in automaton.windows(_codes(text), length) if owner[s] != doc)
            pairs = list(zip(*met, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int32()), pa.array(pairs[1], pa.int32())], names=["shard", "state"])

    rows = candidates.filter(F.col("shard").isin(list(sent))).repartition("shard", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("shard")
    return rows.select("doc", "shard", "text").mapInArrow(kernel, "shard int, state int").distinct()


def _marked_spans(built: DataFrame, length: int) -> DataFrame:
    """``doc``, ``a``, ``b`` of the runs of windows whose state is among a shard's ``marks``, or has several documents."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                automaton = Automaton.from_bytes(row["automaton"])
                marked = {s for s, o in zip(row["states"], row["owners"], strict=True) if o == SEVERAL} | set(row["marks"] or ())
                for d in row["docs"]:
                    begin, end = -1, -1
                    for at, state in automaton.windows(_codes(d["text"]), length):
                        if state in marked:
                            if at > end:
                                out += [(d["doc"], d["base"] + begin, d["base"] + end)] if end >= 0 else []
                                begin = at
                            end = at + length
                    out += [(d["doc"], d["base"] + begin, d["base"] + end)] if end >= 0 else []
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "a", "b"])

    return built.mapInArrow(kernel, "doc long, a long, b long")


def reference_spans(documents: DataFrame, key: str, text: str, reference: Column, length: int = spans.LENGTH, gram: int = spans.GRAM, shard_chars: int = SHARD_CHARS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """What ``spans.shared_spans`` gives for the documents for which ``reference`` is true: the spans they share with any document of all."""
    both = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.coalesce(reference, F.lit(False)).alias("_ref"))
    pieces = spans._pieces(both, "doc", "text", length, shard_chars)
    ids = both.filter("_ref").select("doc").distinct()
    every = materialize(spans._stretch_rows(pieces, length, gram), "stretches")
    refs = materialize(pieces.join(ids, "doc"), "reference-pieces")
    total = refs.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // shard_chars))
    shard_of = F.pmod(F.xxhash64("doc", "base"), F.lit(count)).cast("int")
    shards = refs.groupBy(shard_of.alias("shard")).agg(F.collect_list(F.struct("doc", "base", "text")).alias("docs"))
    built = materialize(_built(shards.repartition(count, "shard"), length), "automata")

    own = every.join(ids, "doc").select("gram", shard_of.alias("shard"), "doc").groupBy("gram", "shard").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b"))
    near = every.join(own, "gram").filter("doc <> _a OR doc <> _b").select("doc", "base", "shard", "low", "high")
    regions = spans.joined(near.select(F.struct("doc", "base", "shard").alias("doc"), F.col("low").alias("a"), (F.col("high") + length).alias("b")))
    cut = regions.select("doc.*", F.col("span_start").alias("a"), F.col("span_end").alias("b")).join(pieces, ["doc", "base"])
    candidates = materialize(cut.select("doc", "shard", F.substring("text", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")).alias("text")), "candidates")

    size = F.length("automaton") + 12 * F.size("states")
    sizes = sorted((r["shard"], r["n"]) for r in built.select("shard", size.cast("long").alias("n")).toLocalIterator())
    marks, group, held = None, [], 0
    for shard, n in [*sizes, (None, sent_bytes)]:
        if group and (shard is None or held + n > sent_bytes):
            rows = built.filter(F.col("shard").isin(group)).select("shard", "automaton", "states", "owners").collect()
            one = materialize(_marks(candidates, {r["shard"]: (bytes(r["automaton"]), r["states"], r["owners"]) for r in rows}, length), "marks")
            marks = one if marks is None else marks.unionAll(one)
            group, held = [], 0
        group.append(shard)
        held += n
    if marks is None:
        return documents.sparkSession.createDataFrame([], "doc long, span_start long, span_end long")
    listed = marks.groupBy("shard").agg(F.collect_list("state").alias("marks"))
    found = _marked_spans(built.join(listed, "shard", "left").repartition(count, "shard").select("docs", "automaton", "states", "owners", "marks"), length)
    return spans.joined(found)
