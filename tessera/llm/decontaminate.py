"""Operator 2, benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to words (A-Z lowered; runs of letters, digits and all
characters from U+0080). Words of the items are numbered; every window of `window`
consecutive item words is a pattern of numbers, so matches keep to words. A document's
words become numbers by the same table, 0 where no item has the word, and are scanned
once, runs without a 0 that could hold a pattern; matches give word positions, which are mapped back to code-point offsets of the
original text.

The automaton has a node for each distinct beginning of a pattern, about 50 bytes here
and in each worker, so it holds at most MAX_NODES of them (windows times their words,
counted before it is built; 100 MB). A larger benchmark is cut into segments, dealt to
as many parts as that takes, and documents pass one automaton after the other; each
pass reads and writes the documents once. A part's words are all of the benchmark that
the driver holds at a time.

Null texts have no words: nothing is hit, they are kept. Items without words have
no windows. Windows of an item without an id mark words but name no item.
Repeated items count once; repeated documents each get their row. A very long document
is held whole by its task, a very long item is cut into segments that overlap by a
window. Empty tables give no rows, or no hits. Columns are kept whatever their names; one
of a result's name, under any case, is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: The word pattern, and its bytes as a translation (anything else is a space).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
LOWER_STR = {c: c + 32 for c in range(65, 91)}
MAX_NODES = 2 << 20
SEGMENT = 4096
#: sets of groups whose items a worker has counted
REMEMBERED = 10_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def segments(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, body, nodes): words of items, SEGMENT windows at a time, and how many
    nodes their windows make at most."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in batches:
            item, body, nodes = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                n = min(window, len(w))
                for at in range(0, len(w) - n + 1 if n else 0, SEGMENT):
                    own = w[at : at + SEGMENT + n - 1]
                    item.append(i), body.append(b" ".join(own)), nodes.append((len(own) - n + 1) * n)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(body, pa.binary()), pa.array(nodes, pa.int64())], ["item", "body", "nodes"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    return items.mapInArrow(step, "item string, body binary, nodes bigint")


@dataclass
class Patterns:
    """The automaton over numbered words, each pattern's length and its group: the set of
    items that have the pattern, which patterns of the same items share."""

    numbers: dict[bytes, int]
    automaton: ahocorasick.Automaton
    length: list[int]
    group: list[int]
    groups: list[frozenset]
    shortest: int = 0
    known: dict[frozenset, tuple[int, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, parts: list[tuple[str | None, bytes]], window: int) -> Patterns:
        numbers: dict[bytes, int] = {}
        at: dict[tuple[int, ...], int] = {}
        items: list[set] = []
        for item, body in parts:
            w = [numbers.setdefault(x, len(numbers) + 1) for x in body.split()]
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                k = at.setdefault(tuple(w[i : i + n]), len(items))
                if k == len(items):
                    items.append({item})
                else:
                    items[k].add(item)
        groups: dict[frozenset, int] = {}
        group = [groups.setdefault(frozenset(x), len(groups)) for x in items]
        out = cls(numbers, ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), [len(p) for p in at], group, list(groups), min(map(len, at), default=0))
        for pattern, k in at.items():
            out.automaton.add_word(pattern, k)
        if at:
            out.automaton.make_automaton()
        return out

    def items_of(self, groups: frozenset) -> set:
        return {i for g in groups for i in self.groups[g] if i is not None}

    def told(self, groups: frozenset) -> tuple[int, str]:
        """How many items, and the digest of their sorted names; once for each distinct
        set of groups."""
        if groups not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[groups] = told(self.items_of(groups))
        return self.known[groups]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], frozenset]:
        """(words, merged word ranges that are hit, groups of items)."""
        w = words(text)
        if not w or not self.group:
            return len(w), [], frozenset()
        own = np.fromiter(map(self.numbers.get, w, repeat(0)), np.int32, len(w))
        turn = np.flatnonzero(np.diff(np.concatenate([[False], own != 0, [False]])))
        hits = [(a + e, k) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True) if b - a >= self.shortest for e, k in self.automaton.iter(tuple(own[a:b].tolist()))]
        if not hits:
            return len(w), [], frozenset()
        edge = np.zeros(len(w) + 1, np.int64)
        last = np.array([e for e, _ in hits]) + 1
        np.add.at(edge, last - [self.length[k] for _, k in hits], 1)
        np.add.at(edge, last, -1)
        hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
        turn = np.flatnonzero(np.diff(hit))
        return len(w), list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)), frozenset(self.group[k] for _, k in hits)


def told(items: set) -> tuple[int, str]:
    return len(items), hashlib.sha256(",".join(sorted(items)).encode("utf-8", "surrogatepass")).hexdigest()


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) code points of the original text."""
    at = [m.span() for m in WORD.finditer(text.translate(LOWER_STR))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RANGES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", keep: list[str] | None = None, spans: bool = True, max_nodes: int = MAX_NODES) -> DataFrame:
    """The kept columns of docs (all, if none are named) with n_words, n_hit,
    n_items, items_sha256, contaminated and, unless switched off, spans: the
    hit passages as [start, end) code points."""
    spark = docs.sparkSession
    common.small_batches(spark)
    keep = common.others(docs.columns if keep is None else keep, RESULTS)
    bodies = common.materialise(segments(benchmark, window), "segments", rows=0)
    parts = common.materialise(common.gapless(bodies, [], ["item", "body"], "at", weight="nodes").select("item", "body", F.expr(f"at div {max_nodes}").alias("part")), "parts", rows=0)
    last = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    none = [F.lit(None).cast(t).alias(n) for n, t in (("words", "bigint"), ("ranges", "array<struct<s:int,e:int>>"), ("items", "array<string>"), ("n", "bigint"), ("sha", "string"), ("places", "array<struct<s:int,e:int>>"))]
    state = docs.select(*common.numbered(keep), common.quoted(text_col).alias("text"), *none)
    names = state.columns

    for part in range(last + 1):
        own = [tuple(r) for r in parts.where(F.col("part") == part).select("item", "body").collect()]  # max_nodes / window words, about
        patterns = spark.sparkContext.broadcast(Patterns.of(own, window))
        final = part == last

        def step(batches: Iterator[pa.RecordBatch], patterns=patterns, final=final) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = list(batch.columns[:-7])
                texts, _, old_r, old_i, *_ = batch.columns[-7:]
                ns, rs, its, counts, digests, places = [], [], [], [], [], []
                for i, x in enumerate(texts):
                    text = x.as_py()
                    n, r, groups = patterns.value.scan(text)
                    before = old_i[i].as_py() if old_r[i].is_valid else None
                    if old_r[i].is_valid:
                        r = merged(r + [(q["s"], q["e"]) for q in old_r[i].as_py()])
                    # names of items go from pass to pass only where there is another one
                    its.append([] if final else sorted(patterns.value.items_of(groups).union(before or ())))
                    count, digest = (patterns.value.told(groups) if not before else told(patterns.value.items_of(groups).union(before))) if final else (None, None)
                    counts.append(count)
                    digests.append(digest)
                    ns.append(n)
                    rs.append([{"s": a, "e": b} for a, b in r])
                    places.append([{"s": a, "e": b} for a, b in offsets(text, r)] if final and spans and r else [])
                done = pa.nulls(batch.num_rows, pa.string()) if final else texts  # the text goes no further
                yield pa.RecordBatch.from_arrays([*cols, done, pa.array(ns, pa.int64()), pa.array(rs, RANGES), pa.array(its, pa.list_(pa.string())), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(places, RANGES)], names)

        new = state.mapInArrow(step, state.schema)
        if not final:
            before, new = state, common.materialise(new, "scan")
            patterns.destroy()
            if part:
                common.discard(before)
        state = new
    common.discard(bodies, parts)
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    out = state.select(*[f"c{i}" for i in range(len(keep))], F.col("words").alias("n_words"), hit.alias("n_hit"), F.col("n").alias("n_items"), F.col("sha").alias("items_sha256"), (hit > 0).alias("contaminated"), *([F.transform("places", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"))).alias("spans")] if spans else []))
    return common.renamed(out, keep)
