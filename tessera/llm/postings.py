"""Inverted-index postings to links: one pass over postings sorted by key, with
bounded memory and no pair output. Used by the two near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: A posting of up to this many members is compared in one place; a larger one is
#: dealt to blocks, and every pair of blocks is compared on its own.
POSTING_CAP = 4096
OUT_ROWS = 1 << 14
FEW = 128

#: members (sorted, distinct) -> (member, root) arrays of a star forest
Star = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def star_forest(members: np.ndarray, near: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the members by breadth-first search; near(rest, x)
    marks those linked to x. Every member but the first of its component comes
    with that first one, so m members make fewer than m links."""
    rest, got, roots = members, [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            mark = near(rest, frontier.pop())
            if mark.any():
                found, rest = rest[mark], rest[~mark]
                frontier.extend(found)
                got.append(found)
                roots.append(np.full(len(found), root))
    if not got:
        return members[:0], members[:0]
    return np.concatenate(got), np.concatenate(roots)


def few_links(k: np.ndarray, m: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links within many short postings: all that are a distance apart at a time. A
    posting with more links than members gives its forest instead."""
    first, second = [], []
    for d in range(1, len(k)):
        i = np.flatnonzero(k[d:] == k[:-d])
        if not len(i):
            break
        i = i[linked(m[i], m[i + d])]
        first.append(i), second.append(i + d)
    if not first:
        return m[:0], m[:0]
    first, second = np.concatenate(first), np.concatenate(second)
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    ends = np.append(starts[1:], len(k))
    posting = np.searchsorted(starts, first, side="right") - 1
    many = np.bincount(posting, minlength=len(starts)) >= ends - starts
    sparse = ~many[posting]
    got, roots = [m[second[sparse]]], [m[first[sparse]]]
    for p in np.flatnonzero(many):
        a, b = star_forest(m[starts[p] : ends[p]], linked)
        got.append(a), roots.append(b)
    return np.concatenate(got), np.concatenate(roots)


def runs(batches: Iterator[pa.RecordBatch], cap: int | None, few: int = 2) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Sorted (key, member) batches as ("few", keys, members) for all postings of up
    to `few` at once, ("run", keys, members) for each larger one and ("hot", keys,
    members) for parts of those over cap. Repeated members of a posting count once."""
    keys = members = None
    hot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if hot is not None:
            n = int(np.searchsorted(k != hot, True))
            if n:
                yield "hot", k[:n], m[:n]
            if n == len(k):
                continue
            hot, k, m = None, k[n:], m[n:]
        if keys is not None:
            k, m = np.concatenate([keys, k]), np.concatenate([members, m])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        k, m = k[new], m[new]
        last = int(np.searchsorted(k == k[-1], True))
        yield from _closed(k[:last], m[:last], cap, few)
        keys, members = k[last:], m[last:]
        if cap and len(keys) > cap:
            hot = keys[0]
            yield "hot", keys, members
            keys = members = None
    if keys is not None:
        yield from _closed(keys, members, cap, few)


def _closed(k: np.ndarray, m: np.ndarray, cap: int | None, few: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    if len(k) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    short = np.repeat((sizes > 1) & (sizes <= few), sizes)
    if short.any():
        yield "few", k[short], m[short]
    long_ = sizes > few
    for s, n in zip(starts[long_].tolist(), sizes[long_].tolist(), strict=True):
        yield "hot" if cap and n > cap else "run", k[s : s + n], m[s : s + n]


def posting_links(postings: DataFrame, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], cap: int = POSTING_CAP, rows: int | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """postings: (key, member), longs. linked(a, b) tells which members (arrays or
    a scalar) are linked. Returns (a, b), the links of a forest that joins
    exactly the members that links within postings join. rows: an estimate of
    the distinct links, for the size of files. again: makes other postings of the
    members (key, member) of those over cap, in which all of their links meet; they
    are tried once before postings are compared in blocks."""

    def scan(limit: int | None):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.alone()
            def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

            held, size = [], 0
            for kind, x, y in runs(batches, limit, FEW):
                if kind == "few":
                    x, y = few_links(x, y, linked)
                elif kind == "run":
                    x, y = star_forest(y, linked)
                else:
                    yield out(y, x, True)
                    continue
                held.append((x, y))
                size += len(x)
                if size > OUT_ROWS:
                    yield out(*map(np.concatenate, zip(*held)), False)
                    held, size = [], 0
            if size:
                yield out(*map(np.concatenate, zip(*held)), False)

        return step

    schema = "a bigint, b bigint, hot boolean"
    sorted_ = postings.repartition("key").sortWithinPartitions("key", "member")
    found = common.materialise(sorted_.mapInArrow(scan(cap), schema).distinct(), "links", rows)
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("b").alias("key"), F.col("a").alias("member"))
    if hot.isEmpty():
        return links
    if again:
        return links.unionByName(posting_links(again(hot), linked, cap, rows))
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (cap // 2)).alias("n"))
    dealt = hot.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("member"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    paired = dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "member")
    rest = paired.repartition("key").sortWithinPartitions("key", "member").mapInArrow(scan(None), schema)
    return links.unionByName(common.materialise(rest, "links").select("a", "b"))
