"""Operator 7, SimHash near-duplicates through a byte-position inverted index.

A fingerprint of 64 bits is eight positional bytes. Two that differ in at most
d bits differ in at most d bytes, so they share at least 8 - d: the guaranteed
minimum of matches.

1. Each distinct fingerprint is posted under `width` of its positional bytes at a
   time. Not all sets of that many positions are needed: `cover` picks few sets so
   that whichever 8 - d positions two fingerprints share, one set lies within them
   (for d = 4: 5 single positions, 8 pairs, 23 triples or 70 fours).
2. Pairs that meet in a posting have all their shared positional bytes tallied;
   those under the guaranteed minimum go. The rest are verified by counting bits.
3. The width follows the number of fingerprints, so that a posting's expected length
   stays under SHORT: single bytes up to 16 thousand, pairs up to 4 million, triples
   up to a billion. Any width gives the same links.
4. Postings over POSTING_CAP members, as families of near copies make, are not
   compared there: their members are posted anew under four bytes at a time, and
   postings that are still that long are compared in blocks.

Postings give forests, not pairs, so a family of thousands of versions makes
thousands of links. Links go to a distributed union-find.

Null and empty texts, or those of white space only, have fingerprint zero and
link like any other. Other columns are ignored, whatever their names; rows that
repeat a doc_id, or all of a row, each get their own row; the smallest doc_id names
a component, and a null one only a component without any other. A very long text is
held whole by its task, its hashes STEP at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.postings import POSTING_CAP, posting_links

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
STEP = 1 << 15
SHORT = 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, STEP):  # a very long text takes no more memory than a step
        set_ += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    common.small_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(common.quoted(id_col).cast("bigint").alias("doc_id"), common.quoted(text_col).alias("text"))
    return src.mapInArrow(step, "doc_id bigint, fp bigint")


def fingerprint_column(text: Column, words: int = 4) -> Column:
    """The fingerprint as 16 hex digits."""

    @F.arrow_udf("string")
    def digits(texts: pa.Array) -> pa.Array:
        return pa.array([f"{fingerprint(x.as_py(), words):016x}" for x in texts])

    return digits(F.coalesce(text, F.lit("")))


def cover(width: int, least: int) -> list[tuple[int, ...]]:
    """Sets of `width` positions such that any `least` of the eight hold one of them;
    greedily, the set that lies within most of those not yet served first."""
    sets = list(combinations(range(8), width))
    open_ = set(combinations(range(8), least))
    chosen = []
    while open_:
        best = max(sets, key=lambda s: sum(set(s) <= set(x) for x in open_))
        chosen.append(best)
        open_ = {x for x in open_ if not set(best) <= set(x)}
    return chosen


def width_for(fingerprints: int, least: int) -> int:
    return next((w for w in range(1, least) if fingerprints <= SHORT << 8 * w), least)


def linker(distance: int):
    """linked(a, b): shared positional bytes are tallied, then bits counted."""
    least = 8 - distance

    def linked(a, b):
        x = np.bitwise_xor(a, b).view(np.uint64)
        # a byte that differs leaves its lowest bit set: folded, masked, counted
        folded = x | x >> np.uint64(4)
        folded |= folded >> np.uint64(2)
        folded |= folded >> np.uint64(1)
        tally = 8 - np.bitwise_count(folded & np.uint64(0x0101010101010101))
        mark = tally >= least
        mark[mark] = np.bitwise_count(x[mark]) <= distance
        return mark

    return linked


def posted(fps: DataFrame, sets: list[tuple[int, ...]], salt: int) -> DataFrame:
    """(key, member): each fp under its bytes at each set of positions."""
    masks = [sum(0xFF << 8 * p for p in at) for at in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(salt + i)) for i, m in enumerate(signed)])
    return fps.select(F.explode(keys).alias("key"), F.col("fp").alias("member"))


def fingerprint_links(fps: DataFrame, distance: int, rows: int, width: int | None = None, cap: int = POSTING_CAP) -> DataFrame:
    """fps: (fp), distinct, a table. Links (a, b) of a forest that joins exactly the
    fingerprints that distance joins."""
    least = 8 - distance
    width = width or width_for(rows, least)
    again = (lambda hot: posted(hot.select(F.col("member").alias("fp")).distinct(), cover(least, least), 1000)) if width < least else None
    return posting_links(posted(fps, cover(width, least), 0), linker(distance), cap=cap, rows=rows, again=again)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, width: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    if not 0 < distance < 8:
        raise ValueError("distance must be 1 to 7")
    fp = common.materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    rows = fp.count()
    least = common.materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct", rows)
    links = fingerprint_links(least.select("fp"), distance, rows, width)
    comp = common.connected_components(links, rows)
    rooted = least.join(comp, least.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "copies")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.materialise(rooted.join(ids, "root").select("fp", "component_id", "copies"), "named", rows)
    common.discard(least, links, comp)
    out = common.by_key(fp, named, ["fp"], "copies", rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
