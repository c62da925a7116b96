"""Operator 4, packing by non-negative least squares.

A document's ids are cut at multiples of the window; what is left over is a
piece shorter than it. Only the histogram of piece lengths, one number a length,
comes to the driver, and the plan is made on it:

1. Shallow combinations that fill a window are enumerated: the window itself,
   all pairs, and triples of which two lengths are among the most frequent.
2. Non-negative least squares solve for repeat counts against the histogram.
3. Counts are rounded down and kept within what there is of each length.
4. Pieces left over are packed greedily, the longest first and the longest that
   fits after it, again by counts. What a window then lacks is padding, except
   that a total that is a power of two is left as it is.

The plan says for each length which ranks go to which sequences and where. Pieces
are ranked within their length (blocks, no single task for a common length), look
their rank up in the plan, and so get sequence and offset. The plan's size depends
on the window, not on the corpus.

Null texts count as empty: a document of the end id alone. Rows that repeat a
doc_id, or all of a row, are packed each. Ties of pieces of one length go by doc_id,
start and CRC; which of two equal pieces comes first is open. Very long texts make many
pieces. Other columns are not read, so their names can't clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.tokens import encoder, tokenizer_source

WINDOW = 1024
FREQUENT = 64
SWEEPS = 60
BLOCKS = 256
#: a length's rows are ranked in blocks of about so many at most
BLOCK_ROWS = 500_000


def combinations_of(hist: np.ndarray, window: int, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Up to three lengths that fill a window, among those that occur."""
    there = [n for n in range(1, window) if hist[n]]
    out = [(a, window - a) for a in there if 2 * a <= window and hist[window - a]]
    top = sorted(sorted(there, key=lambda n: (-hist[n], n))[:frequent])
    triples = {tuple(sorted((a, b, window - a - b))) for a, b in combinations_with_replacement(top, 2) if 0 < window - a - b and hist[window - a - b]}
    return out + sorted(triples)


def nnls(combos: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 with the least |A x - hist|, by coordinate descent: column c of A
    counts the lengths of combination c."""
    cols = []
    for c in combos:
        n, k = np.unique(c, return_counts=True)
        cols.append((n.tolist(), k.tolist(), float((k * k).sum())))
    x, rest = [0.0] * len(cols), hist.astype(float).tolist()  # rest: hist - A x
    for _ in range(sweeps):
        moved = 0.0
        for i, (n, k, square) in enumerate(cols):
            new = max(0.0, x[i] + sum(rest[a] * b for a, b in zip(n, k)) / square)
            step = new - x[i]
            if step:
                x[i] = new
                moved = max(moved, abs(step))
                for a, b in zip(n, k):
                    rest[a] -= b * step
        if moved < 0.25:
            break
    return np.array(x)


def plan(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); uses up the histogram."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        n, k = np.unique(lengths, return_counts=True)
        times = int(min(times, (left[n] // k).min()))
        if times > 0:
            left[n] -= k * times
            out.append((lengths, times))

    if left[window]:
        take((window,), int(left[window]))
    combos = combinations_of(left, window)
    x = nnls(combos, left)
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 1:
            break
        take(combos[i], int(x[i]))
    for c in combos:  # what rounding down has left of pairs and triples
        if (left[list(c)] > 0).all():
            take(c, 1 << 62)
    while left.any():
        gap, lengths, have = window, [], left.copy()
        while gap:
            fits = np.flatnonzero(have[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            lengths.append(n)
            have[n] -= 1
            gap -= n
        take(tuple(lengths), 1 << 62)
    return out


def places(chosen: list[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """For each length the rank intervals, in order: key (length and first rank),
    first sequence, offset."""
    used = np.zeros(window + 1, np.int64)
    rows, first = [], 0
    for lengths, times in chosen:
        offset = 0
        for n in lengths:
            rows.append((n, int(used[n]), first, offset))
            used[n] += times
            offset += n
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 50 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            for part, texts in enc.groups(batch, 1):
                doc, start, length, crc, total, raw = [], [], [], [], [], []
                for d, ids in zip(part.column(0).to_pylist(), texts, strict=True):
                    whole = np.append(ids.astype("<u4"), np.uint32(end_id))
                    for s in range(0, len(whole), window):
                        piece = whole[s : s + window].tobytes()
                        doc.append(d), start.append(s), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(whole))
                        if keep_ids:
                            raw.append(piece)
                cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)] + [pa.array(raw, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    return docs.select(common.quoted(id_col).cast("bigint").alias("doc_id"), F.coalesce(common.quoted(text_col), F.lit("")).alias("text")).mapInArrow(step, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with keep_ids the ids as little-endian 32 bits."""
    pieces = common.materialise(token_pieces(docs, tokenizer, end_id, window, id_col, text_col, keep_ids), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for n, k in pieces.groupBy("length").count().collect():  # `window` rows at most
        hist[n] = k
    table = places(plan(hist, window), window)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    ranked = common.gapless(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "rank", blocks=max(BLOCKS, -(-int(hist.sum()) // BLOCK_ROWS)))
    names = [*pieces.columns, "sequence_id", "offset"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(t["key"], length << 50 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names) - 2)), pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*pieces.columns, "rank").mapInArrow(step, schema)
