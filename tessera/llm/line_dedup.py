"""Operator 6, fuzzy line deduplication by MinHash.

Lines that are equal, or whose sets of character shingles have a Jaccard
similarity of at least `threshold`, are linked; of each connected component of
lines one occurrence stays: the first by doc_id, then position.

1. Each line's shingles are hashed once; a signature is the least hash in each of
   BANDS x ROWS bins (one-permutation MinHash, empty bins filled from others by
   fixed probes). At similarity 0.8 a pair shares a band with probability 0.998.
2. Distinct lines are entered under their band keys, 16 bytes a posting; texts are
   not shuffled here. Members of each posting of two or more are candidates; equal
   sets of members from several bands count once.
3. A bitmap of fixed size names the candidate lines; the second scan writes all
   lines' places, and the texts of those only, which then meet their sets. There the exact similarity of
   shingle sets decides, and each set gives a forest of links, not all pairs.
   Sets over POSTING_CAP are dealt to blocks and every pair of blocks is compared.
   Shingles are compared as 44-bit codes first; what they link is confirmed on the
   shingles themselves.
4. Links go to a distributed union-find.
5. The first place of each distinct line, added up on the map side, meets the line's
   component; the first of these of each component survives. Places of lines that
   repeat or have links (again by a bitmap) and are not among the survivors are
   dropped: an anti-join on the place, so no line or component is a key by which rows
   are dealt. Documents that lose nothing are not shuffled.

A line is known by its MD5 digest, all 128 bits of it; postings hold the first 64, and
a line that shares those with another joins its candidate sets, where texts decide. Lines end at a line feed. Lines
of white space only are left as they are. Lines of fewer characters than a shingle link
only to equal ones. Null texts stay null. Documents that lose all lines stay with an
empty text, or what blank lines they have. Ties of a first place go by doc_id (null
first), text hash, position; rows that repeat doc_id and text are one document to this
operator and get the same result. Very long lines are compared two at a time. An empty
table gives an empty result. Columns of docs are kept, whatever their names; n_lines and
n_removed are added, or replaced if there under any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm.postings import POSTING_CAP, runs, star_forest

SHINGLE = 8
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
THRESHOLD = 0.8
BLANK = " \t\r\x0b\x0c"
LINE_BATCH = 2000
LINE_CHARS = 1 << 19
#: lines of a set of which all pairs are compared at once, and shingles that are sorted at a time
FEW = 4
SORTED = 1 << 18
EMPTY = np.uint32(0xFFFFFFFF)
PRIME = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _mix32(h: np.ndarray) -> np.ndarray:
    """In place."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _probes() -> np.ndarray:
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(BINS) for _ in range(64)])


PROBES = _probes()
BAND_SALT = _mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(PRIME)) | np.uint64(1)


def windows(lines: list[str], k: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial codes of all k characters in a row within a line, as whole numbers
    of a kind, and how many each line has."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    p, width, bits = PRIME, 1, np.dtype(kind).itemsize * 8
    while width < k:  # windows of twice the width from two of them
        code = code[: len(code) - width] * kind(p % (1 << bits)) + code[width:]
        p, width = p * p, 2 * width
    within = np.ones(len(code), bool)
    last = (np.cumsum(size)[:, None] - np.arange(1, k)).ravel()  # starts that run into the next line
    if size.min(initial=k) < k - 1:
        last = last[(np.arange(1, k) <= size[:, None]).ravel()]
    within[last[(last >= 0) & (last < len(code))]] = False
    return code[within], np.maximum(size - k + 1, 0)


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all lines, and how many each line has."""
    code, counts = windows(lines, k, np.uint64)
    return _mix(code), counts


def band_keys(lines: list[str]) -> np.ndarray:
    """lines x BANDS keys; every line has SHINGLE characters at least. A shingle's
    hash falls into the bin of its range and counts there by its size."""
    h, counts = windows(lines, SHINGLE, np.uint32)
    h = _mix32(h)
    slot = np.repeat(np.arange(0, len(lines) * BINS, BINS), counts)
    slot += (h >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16)
    sig = np.full(len(lines) * BINS, EMPTY, np.uint32)
    np.minimum.at(sig, slot, h)
    sig = sig.reshape(-1, BINS)
    full = sig.copy()
    row, col = np.nonzero(sig == EMPTY)
    for probe in PROBES:
        if not len(row):
            break
        got = sig[row, probe[col]]
        full[row, col] = got
        still = got == EMPTY
        row, col = row[still], col[still]
    if len(row):
        full[row, col] = sig[row].min(axis=1)
    mixed = _mix((full.astype(np.uint64) + np.uint64(1)) * BAND_SALT)
    return _mix(mixed.reshape(len(lines), BANDS, ROWS).sum(axis=2, dtype=np.uint64)).view(np.int64)


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip(BLANK)]


def line_id(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def id_halves(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(ids), ">i8").reshape(-1, 2).astype(np.int64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Distinct lines, some thousand or some megabytes at a time."""
    held: dict[str, None] = {}
    size = 0
    for batch in batches:
        for text in batch.column(0):
            for line in lines_of(text.as_py()):
                if line not in held:
                    held[line] = None
                    size += len(line)
            if len(held) >= LINE_BATCH or size >= LINE_CHARS:
                yield list(held)
                held, size = {}, 0
    if held:
        yield list(held)


def signatures(texts: DataFrame) -> DataFrame:
    """(line, rest, b0, b1, ...) of the distinct lines long enough to be fuzzy."""
    names = ["line", "rest", *(f"b{i}" for i in range(BANDS))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for lines in _batches(batches):
            lines = [x for x in lines if len(x) >= SHINGLE]
            if lines:
                keys = band_keys(lines)
                yield pa.RecordBatch.from_arrays([*map(pa.array, id_halves([line_id(x) for x in lines])), *(pa.array(np.ascontiguousarray(keys[:, i])) for i in range(BANDS))], names)

    rows = texts.mapInArrow(step, ", ".join(f"{n} bigint" for n in names))
    return rows.groupBy("line", "rest").agg(*[F.min(n).alias(n) for n in names[2:]])


def candidate_sets(postings: DataFrame, cap: int = POSTING_CAP, rows: int | None = None) -> DataFrame:
    """(key, member) postings to (set, line) of those with two members or more."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        def out(sets: np.ndarray, lines: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(lines, pa.int64()), pa.array(np.full(len(lines), hot))], ["set", "line", "hot"])

        def name(members: np.ndarray) -> np.ndarray:
            return _mix(members.view(np.uint64) + np.uint64(PRIME))

        for kind, x, y in runs(batches, cap):
            if kind == "few":
                x, y = y[::2], y[1::2]
                sets = (name(np.ascontiguousarray(x)) + name(np.ascontiguousarray(y))).view(np.int64)
                yield out(np.concatenate([sets, sets]), np.concatenate([x, y]), False)
            elif kind == "run":
                yield out(np.full(len(y), name(np.ascontiguousarray(y)).sum(dtype=np.uint64).view(np.int64)), y, False)
            else:
                yield out(x, y, True)

    dealt = postings.repartition("key").sortWithinPartitions("key", "member")
    found = common.materialise(dealt.mapInArrow(step, "set bigint, line bigint, hot boolean").distinct(), "sets", rows)
    sets = found.where("not hot").select("set", "line")
    hot = found.where("hot")
    if not hot.isEmpty():
        hot = hot.select("set", "line")
        blocks = hot.groupBy("set").agg(F.ceil(F.count(F.lit(1)) / (cap // 2)).alias("n"))
        dealt = hot.join(blocks, "set").withColumn("i", F.pmod(F.xxhash64("line"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        paired = dealt.select(F.xxhash64("set", F.least("i", "j"), F.greatest("i", "j")).alias("set"), "line")
        sets = sets.unionByName(common.materialise(paired.distinct(), "blocks"))
    return sets


def grams(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(len(line) - k + 1)}


def packed_grams(line: str) -> np.ndarray | None:
    """The distinct shingles themselves, sorted: eight characters under 256 are a number
    of 64 bits. None for a line with other characters."""
    try:
        data = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return np.unique(np.ndarray(len(data) - SHINGLE + 1, "<u8", data, strides=(1,)))


class Shingled:
    """The distinct shingles of many lines, each line's sorted, in one array."""

    def __init__(self, lines: list[str], k: int = SHINGLE):
        self.lines = lines
        self.packed = lru_cache(64)(lambda i: packed_grams(lines[i]))
        h, counts = shingle_hashes(lines, k)
        line = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
        code = np.sort(line << np.uint64(44) | h >> np.uint64(20))
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        self.size = np.bincount((code >> np.uint64(44)).astype(np.int64), minlength=len(lines))
        self.end = np.cumsum(self.size)
        self.code = code & np.uint64((1 << 44) - 1)

    def of(self, i: int) -> np.ndarray:
        return self.code[self.end[i] - self.size[i] : self.end[i]]

    def near(self, rest: np.ndarray, x: int, threshold: float) -> np.ndarray:
        """Which of the lines rest are as similar to line x as threshold asks."""
        out = self._near(rest, x, threshold)
        at = np.flatnonzero(out)
        if len(at):
            own = self.packed(int(x))
            for k, i in zip(at.tolist(), rest[at].tolist(), strict=True):
                mine, other = own, self.packed(i)
                if mine is None or other is None:
                    mine, other = grams(self.lines[x]), grams(self.lines[i])
                    shared = len(mine & other)
                else:
                    both = np.sort(np.concatenate([mine, other]))
                    shared = np.count_nonzero(both[1:] == both[:-1])
                out[k] = shared >= threshold * (len(mine) + len(other) - shared) - 1e-9
        return out

    def _near(self, rest: np.ndarray, x: int, threshold: float) -> np.ndarray:
        out = np.zeros(len(rest), bool)
        size = self.size[rest]
        fit = np.flatnonzero((size >= threshold * self.size[x] - 1e-9) & (self.size[x] >= threshold * size - 1e-9))
        if not len(fit):
            return out
        chosen, own = rest[fit], self.of(x)
        if chosen[-1] - chosen[0] + 1 == len(chosen):
            flat = self.code[self.end[chosen[0]] - self.size[chosen[0]] : self.end[chosen[-1]]]
        else:
            flat = np.concatenate([self.of(i) for i in chosen])
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size[fit]) - size[fit])
        out[fit] = shared >= threshold * (size[fit] + self.size[x] - shared) - 1e-9
        return out


def long_lines_near(lines: list[str], threshold: float):
    """near(rest, x) that holds the shingles of two lines at a time."""

    def near(rest: np.ndarray, x: int) -> np.ndarray:
        return np.array([Shingled([lines[x], lines[r]]).near(np.array([1]), 0, threshold)[0] for r in rest])

    return near


def pairs_near(lines: list[bytes], pairs: list[tuple[int, int]], threshold: float) -> np.ndarray:
    """Which pairs of lines in Latin-1 are as similar as threshold asks. Shingles are numbers
    of 64 bits; rows of them are sorted, those of short lines filled up by their last one."""
    data = b"".join(lines)
    code = np.ndarray(len(data) - SHINGLE + 1, "<u8", data, strides=(1,))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start, last = np.cumsum(size) - size, size - SHINGLE
    a, b = np.array(pairs).T
    longest = np.maximum(last[a], last[b])
    out, order, at = np.zeros(len(a), bool), np.argsort(longest), 0

    def distinct(rows: np.ndarray) -> np.ndarray:
        rows.sort(axis=1)
        return 1 + np.count_nonzero(rows[:, 1:] != rows[:, :-1], axis=1)

    while at < len(order):
        # as many pairs as the longest of them lets into a block
        end = at + max(1, SORTED // (2 * int(longest[order[at]]) + 2))
        end = at + max(1, min(len(order) - at, SORTED // (2 * int(longest[order[min(end, len(order)) - 1]]) + 2)))
        own = order[at:end]
        step = np.arange(longest[own[-1]] + 1)
        both = [code[start[i][:, None] + np.minimum(step, last[i][:, None])] for i in (a[own], b[own])]
        x, y = map(distinct, both)
        shared = x + y - distinct(np.concatenate(both, axis=1))
        out[own] = shared >= threshold * (x + y - shared) - 1e-9
        at = end
    return out


def few_links(sets: list[dict[bytes, str]], threshold: float) -> dict[int, tuple[list[bytes], list[bytes]]]:
    """The links of the sets of up to FEW lines, all in Latin-1, by the set's place."""
    lines, pairs, places = [], [], {}
    for place, own in enumerate(sets):
        if 2 <= len(own) <= FEW:
            try:
                data = [x.encode("latin-1") for x in own.values()]
            except UnicodeEncodeError:
                continue
            places[place] = len(lines)
            pairs += [(len(lines) + i, len(lines) + j) for i in range(len(own)) for j in range(i + 1, len(own))]
            lines += data
    if not pairs:
        return {}
    linked = {x for x, t in zip(pairs, pairs_near(lines, pairs, threshold).tolist(), strict=True) if t}
    out = {}
    for place, base in places.items():
        ids = list(sets[place])
        near = lambda rest, x: np.array([(min(r, x), max(r, x)) in linked for r in rest.tolist()], bool)
        if len(ids) == 2:
            got, roots = ([base + 1], [base]) if (base, base + 1) in linked else ([], [])
        else:
            got, roots = star_forest(np.arange(base, base + len(ids)), near)
        out[place] = [ids[i - base] for i in got], [ids[i - base] for i in roots]
    return out


def set_links(sets: list[dict[bytes, str]], threshold: float) -> tuple[list[bytes], list[bytes]]:
    """Links between the lines of each set, by the exact Jaccard similarity of their
    shingles. The sets' lines are shingled together, unless they are very long; of sets of
    few lines, all pairs are compared at once."""
    a: list[bytes] = []
    b: list[bytes] = []
    together = sum(len(x) for own in sets for x in own.values()) <= 4 * LINE_CHARS
    few = few_links(sets, threshold) if together else {}
    rest = [x for place, own in enumerate(sets) if place not in few for x in own.values()]
    s = Shingled(rest) if together and rest else None
    first = 0
    for place, own in enumerate(sets):
        if place in few:
            a += few[place][0]
            b += few[place][1]
            continue
        ids = list(own)
        near = (lambda rest, x: s.near(rest, x, threshold)) if together else long_lines_near(list(own.values()), threshold)
        base = first if together else 0
        got, roots = star_forest(np.arange(base, base + len(ids)), near)
        a += [ids[i - base] for i in got]
        b += [ids[i - base] for i in roots]
        first += len(ids)
    return a, b


def verified_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(set, id, text) to links (a, b) between line ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        held: list[dict[bytes, str]] = []
        size = 0
        row = next(rows, None)
        while row:
            own, members = row[0], {}
            while row and row[0] == own:
                if len(row[2]) >= SHINGLE:
                    members[row[1]] = row[2]
                    size += len(row[2])
                row = next(rows, None)
            if len(members) > 1:
                held.append(members)
            if held and (not row or size >= LINE_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in set_links(held, threshold)], ["a", "b"])
                held, size = [], 0

    return sets.repartition("set").sortWithinPartitions("set", "id").mapInArrow(step, "a binary, b binary")


def occurrences(docs: DataFrame, candidates: DataFrame, log2_bits: int) -> DataFrame:
    """(doc_id, text_key, pos, id, line, text) of all lines but blank ones; text is
    there only for lines that the bitmap of candidates lets through, and once for
    the equal lines of some hundred documents."""
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap_bytes(common.key_bitmap(candidates, "line", log2_bits), log2_bits))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        bitmap = np.frombuffer(bits.value, np.uint8)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                counts, pos, ids, lines = [], [], [], []
                for text in batch.column(2):
                    own = [(i, x) for i, x in enumerate((text.as_py() or "").split("\n")) if x.strip(BLANK)]
                    counts.append(len(own))
                    pos += [i for i, _ in own]
                    lines += [x for _, x in own]
                ids = [line_id(x) for x in lines]
                short = id_halves(ids)[0]
                at = short & ((1 << log2_bits) - 1)
                there = np.zeros(len(ids), bool)
                there[np.unique(np.frombuffer(b"".join(ids), "V16"), return_index=True)[1]] = True
                there &= (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)
                texts = pa.array([x if t else None for x, t in zip(lines, there.tolist(), strict=True)], pa.string())
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(pos, pa.int32()), pa.array(ids, pa.binary()), pa.array(short), texts], ["doc_id", "text_key", "pos", "id", "line", "text"])

    key = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    added = T._parse_datatype_string("pos int, id binary, line bigint, text string").fields
    return key.mapInArrow(step, T.StructType([key.schema["doc_id"], key.schema["text_key"], *added]))


def surplus(places: DataFrame, components: DataFrame) -> DataFrame:
    """places: (doc_id, text_key, pos, id). Those that are not the first of their
    line's component; components: (node, root) of ids."""
    place = F.struct("doc_id", "text_key", "pos")
    firsts = places.groupBy("id").agg(F.min(place).alias("first"))
    named = firsts.join(components, firsts.id == components.node, "left")
    survivors = named.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    kept = survivors.select(F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t"), F.col("first.pos").alias("p"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("pos") == F.col("p"))
    return places.join(kept, same, "left_anti")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with shortened texts, n_lines and n_removed."""
    spark = docs.sparkSession
    common.small_batches(spark)
    src = docs.select(common.quoted(id_col).alias("doc_id"), common.quoted(text_col).alias("text"))
    rows = docs.count()  # sizes the files of intermediate tables, no more
    sig = signatures(src.select("text"))
    postings = sig.select(F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("key"), F.col("line").alias("member"))
    sets = candidate_sets(postings, rows=2 * rows)
    common.release(spark)

    occ = common.materialise(occurrences(src, sets, common.bitmap_log2(sets.count())), "lines")
    texts = occ.where("text is not null").select("line", "id", "text").distinct()
    links = verified_links(sets.join(texts, "line").select("set", "id", "text"))
    comp = common.connected_components(links, rows)
    common.discard(sets)
    common.release(spark)

    occ = occ.select("doc_id", "text_key", "pos", "id")
    repeated = occ.groupBy("id").count().where("count > 1").select("id").unionByName(comp.select(F.col("node").alias("id")))
    repeated = common.materialise(repeated.select(F.xxhash64("id").alias("k")), "repeated", 4 * rows)
    bits = common.bitmap_log2(repeated.count())
    bitmap = common.materialise(common.key_bitmap(repeated, "k", bits), "bitmap", rows=0)
    chosen = common.in_bitmap(occ.withColumn("k", F.xxhash64("id")), bitmap, "k", bits).drop("k")
    chosen = common.materialise(chosen, "occurrences", 4 * rows)
    drops = surplus(chosen, comp).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("drop"))
    drops = common.materialise(drops.withColumn("key", F.xxhash64("doc_id", "text_key")), "drops", rows)
    common.discard(chosen, occ, comp, repeated, bitmap)
    common.release(spark)

    # documents that lose a line meet their drops; the others pass
    keep = common.others(docs.columns, ("n_lines", "n_removed"))
    keyed = docs.select(*common.numbered(keep), common.quoted(id_col).alias("__id"), common.quoted(text_col).alias("__text"))
    keyed = keyed.withColumn("__text_key", F.xxhash64("__text")).withColumn("__key", F.xxhash64("__id", "__text_key"))
    bits = common.bitmap_log2(drops.count())
    touched = common.materialise(common.key_bitmap(drops, "key", bits), "bitmap", rows=0)
    hit = common.in_bitmap(keyed, touched, "__key", bits)
    missed = common.in_bitmap(keyed, touched, "__key", bits, inside=False)
    kept = [f"c{i}" for i in range(len(keep))]
    joined = hit.join(drops, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__text_key") == F.col("text_key")), "left").select(*kept, "drop")
    schema = T.StructType(joined.schema.fields[:-1] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    at = next(i for i, c in enumerate(keep) if c.lower() == text_col.lower())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for b in batches:
            out, n_lines, n_removed = [], [], []
            for text, drop in zip(b.column(at), b.column(b.num_columns - 1)):
                lines, gone = (text.as_py() or "").split("\n"), set(drop.as_py() or ()) if drop.is_valid else set()
                n_lines.append(len(lines) if text.is_valid else 0)
                n_removed.append(len(gone))
                out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if text.is_valid else None)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], schema.names)

    lines = F.when(F.col("__text").isNull(), 0).otherwise(F.size(F.split("__text", "\n"))).cast("bigint")
    whole = missed.select(*kept, lines.alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"))
    return common.renamed(joined.mapInArrow(cut, schema).unionByName(whole), keep)
