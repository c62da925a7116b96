"""Operator 12, n-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word n-grams. For two sets of a and b
elements, Jaccard similarity of `percent` means that the symmetric difference D has at
most (a + b) (100 - percent) / (100 + percent) elements.

1. Sketches. XOR-hashing each element into a bit of a sketch gives parities; an element of
   the symmetric difference flips one bit, so the Hamming distance of two sketches is at
   most D: it bounds D from below.
2. Size bands. A band's largest size is its smallest one over the similarity, WIDTH times, so
   that a set links only with sets of its own band and the two beside it. A pair meets in the
   band of its smaller set: a set is posted in its own band and, if it may be the larger of a
   pair with a set of the band below, there too. A band fixes the sketch's length.
3. Pigeonhole. The sketch is cut into parts; of so many that flips of a pair can't put more than
   `tolerance` into each, one part holds `tolerance` at most. That part is cut again, into
   `pieces` words of 64 bits, of which all but `tolerance` are equal. Every choice of that many
   words of a part is a key. A set links with larger ones of limited size only, so its own size
   says how many flips that may be: it is posted under the first parts of that number alone. The
   larger of a pair is posted under as many or more, so two sets that link share a key. Keys of
   words with few bits, which unrelated sets share, are left out: a part that has one doesn't
   count towards that number, and a set that runs out of parts is posted under all keys. Keys
   are joined by a shuffle. TOLERANCE grows with the number of sets, as longer keys meet by
   chance less often; any gives the same links.
4. Verification. The members of a posting of up to FEW are tested against each other, those
   of a longer one against its first (a star); the links found are joined by union-find.
   Longer postings whose members are not all in one component by then are tested further,
   in a task for those around one component (or, if it is long, for each pair of its blocks),
   pairs of one component and those without a posting in common being left out. So no link between
   components is lost, while thousands of versions of a text make thousands of tests, not
   millions. A test first compares sketches of one or two bits an element, kept of each
   document: their Hamming distance alone may be too much already (longer ones are folded to
   the length of the shorter). What passes is decided on the whole sets, which are made
   again from the texts of these few; of each set the likeliest pair is decided first, and
   others only where they would join two components.

Equal sets count once: a task posts a set it has posted before no more.

Elements and sets are told apart by 64-bit hashes. Null texts and those without words have
an empty set, link with nothing and are a component each; texts of fewer words than n have
one element, the whole sequence. Repeated rows each get their row; the smallest doc_id of
all documents reachable names a component, a null one only a component without any other.
Other columns are ignored, whatever their names. A text is held whole by its task, its
words STEP bytes at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: A-Z to a-z, white space to a space
LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = 1 << 22
SEEN = 200_000
#: most sets: (flips that a part may hold, words of a part)
TOLERANCE = ((4_000_000, (1, 3)), (400_000_000, (2, 5)), (1 << 62, (3, 7)))
#: a band's largest size is its smallest one, so many times over the similarity
WIDTH = 2
#: a key of so few bits says too little; and one part more for so many, to do without such keys
WEAK = 1
SPARE = 8
#: members of a posting that are compared in one task
CAP = 512
SALT = 1024
#: postings of up to so many members are pairs; and so many pairs a member may come of a longer one
FEW = 4
OUT = 1 << 15
#: postings whose members are matched at a time
STRETCH = 4096

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def salts(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _A + np.array([salt], np.uint64) * _B)


kept_salts = lru_cache(maxsize=2048)(salts)


def salted(n: int, salt: int) -> np.ndarray:
    """salts, kept for sets that are not long."""
    return kept_salts(n, salt) if n <= 1024 else salts(n, salt)


def elements_of(data: bytes, n: int) -> np.ndarray:
    """The sorted hashes of the distinct n-grams of a text in UTF-8."""
    data = data.translate(LOWER)
    hashes, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    w = hashes[0] if len(hashes) == 1 else np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    k = min(n, len(w))
    if not k:
        return w
    grams = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        grams = (grams ^ (grams >> np.uint64(29))) * _A + w[i : len(w) - k + 1 + i]
    return np.unique(mix(grams))


def set_of(text: str | None, n: int = 4) -> np.ndarray:
    return elements_of((text or "").encode("utf-8", "surrogatepass"), n)


def sketch_of(elements: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: a power of two of bits, one and a half an element or more."""
    words = 1
    while words * 128 < len(elements) * 3:
        words *= 2
    sketch = np.zeros(words, np.uint64)
    at = elements & np.uint64(words * 64 - 1)
    np.bitwise_xor.at(sketch, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return sketch


def distances(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """The Hamming distances of a sketch and others."""
    out, sizes = np.zeros(len(ys), np.int64), np.fromiter(map(len, ys), np.int64, len(ys))
    for words in np.unique(sizes):
        at = np.flatnonzero(sizes == words)
        m = min(len(x), int(words))
        y = np.bitwise_xor.reduce(np.stack([ys[i] for i in at]).reshape(len(at), -1, m), axis=1)
        out[at] = np.bitwise_count(y ^ np.bitwise_xor.reduce(x.reshape(-1, m), axis=0)).sum(axis=1, dtype=np.int64)
    return out


def set_id(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) if len(elements) else 0


# --------------------------------------------------------------------- sketches


def farthest(sizes, percent: int):
    """The largest symmetric difference of two sets of so many elements together."""
    return sizes * (100 - percent) // (100 + percent)


def partner(size: int, percent: int) -> int:
    """The largest size of a set that links with one of this size."""
    return size * 100 // percent


@lru_cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest size of each band."""
    lows, highs, low = [], [], 1
    while low < 1 << 40:
        high = low
        for _ in range(WIDTH):
            high = partner(high, percent)
        lows.append(low), highs.append(high)
        low = high + 1
    return np.array(lows), np.array(highs)


def flips_of(size: int, percent: int) -> int:
    """The largest symmetric difference of a set of this size and a larger one that links."""
    return farthest(size + partner(size, percent), percent)


@lru_cache(maxsize=512)
def scheme(band: int, percent: int, tolerance: int, pieces: int) -> tuple[int, int, int, int, np.ndarray]:
    """(parts, parts needed at most, words of a part, flips that one part may hold, choices of
    words) of a band's sketches."""
    d = flips_of(int(bands(percent)[1][band]), percent)
    if not d:
        return 1, 1, 1, 0, np.array([[0]])
    t = min(tolerance, d)
    p = pieces if t == tolerance else t + 1
    most = d // (t + 1) + 1
    return most + most // SPARE, most, p, t, np.array(list(combinations(range(p), p - t)))


def homes(size: int, percent: int) -> list[int]:
    """The bands in which a set is posted, its own first."""
    lows, highs = bands(percent)
    own = int(np.searchsorted(lows, size, side="right")) - 1
    return [own, own - 1] if own and partner(int(highs[own - 1]), percent) >= size else [own]


def keys_of(elements: np.ndarray, band: int, percent: int, tolerance: int, pieces: int) -> np.ndarray:
    """The keys under which a set is posted in a band.

    Of a pair, take the set whose parts end first, or one that is not under all keys. More of
    its counted parts than the pair's flips can spoil lie before that end, so one of them has
    words equal in both sets, enough of them and with enough bits: both sets have that key."""
    parts, most, words, t, choices = scheme(band, percent, tolerance, pieces)
    length, needed = parts * words, min(most, flips_of(len(elements), percent) // (t + 1) + 1)
    slot = (elements >> np.uint64(32)) * np.uint64(length) >> np.uint64(32)
    sketch = np.zeros(length, np.uint64)
    np.bitwise_xor.at(sketch, slot.astype(np.int64), np.uint64(1) << (elements & np.uint64(63)))
    mixed, bits = mix(sketch + salted(length, band)).reshape(parts, words).T, np.bitwise_count(sketch).reshape(parts, words).T
    keys, strong = np.empty((len(choices), parts), np.uint64), np.empty((len(choices), parts), bool)
    for i, c in enumerate(choices):
        keys[i] = salted(parts, 1000 + i)
        for word in c:
            keys[i] += mixed[word]
        strong[i] = bits[c].sum(axis=0) > WEAK
    full = np.cumsum(strong.all(axis=0))
    if full[-1] < needed:
        return mix(keys.ravel())
    stop = int(np.searchsorted(full, needed)) + 1
    return mix(keys[:, :stop][strong[:, :stop]])


# ------------------------------------------------------------------- candidates


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(common.quoted(id_col).cast("bigint").alias("doc_id"), F.coalesce(common.quoted(text_col), F.lit("")).cast("binary").alias("text"))


def sized_sets(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, set, sketch) of each document: its set's size, id and sketch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in batches:
            size, ids, sketches = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column(1)):
                own = elements_of(text.as_py(), n)
                size[i], ids[i] = len(own), set_id(own)
                sketches.append(sketch_of(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(ids.view(np.int64)), pa.array(sketches, pa.binary())], ["doc_id", "size", "set", "sketch"])

    return texts.mapInArrow(step, "doc_id bigint, size bigint, set bigint, sketch binary")


def _once(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(id, elements) of the sets that are not empty; those seen lately are left out."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column(0):
            own = elements_of(text.as_py(), n)
            me = set_id(own)
            if len(own) and me not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(me)
                yield me, own


def postings(texts: DataFrame, n: int, percent: int, tolerance: int, pieces: int) -> DataFrame:
    """(key, member, size): a set under each of its keys; size is negative in the band below
    the set's own."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        keys, members, sizes, held = [], [], [], 0
        for me, own in _once(batches, n):
            for b, size in zip(homes(len(own), percent), (len(own), -len(own))):
                k = keys_of(own, b, percent, tolerance, pieces)
                keys.append(k), members.append(np.full(len(k), me, np.uint64)), sizes.append(np.full(len(k), size, np.int32))
                held += len(k)
            if held >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(members).view(np.int64)), pa.array(np.concatenate(sizes))], ["key", "member", "size"])
                keys, members, sizes, held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(members).view(np.int64)), pa.array(np.concatenate(sizes))], ["key", "member", "size"])

    return texts.select("text").mapInArrow(step, "key bigint, member bigint, size int")


def meetings(posted: DataFrame, percent: int) -> DataFrame:
    """Postings of two members or more, as rows (a, b, star): either a candidate pair (any of
    a posting of up to FEW members, else the first member and another), or (posting, member)
    of a longer posting. Postings of the same members are the same posting."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()

        def out(a, b, star: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), star))], ["a", "b", "star"])

        def closed(k, m, s, head=None) -> Iterator[pa.RecordBatch]:
            """Whole postings, or what follows the head (member, size) of an open one."""
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(starts, len(k)))
            first, small = np.repeat(m[starts], count), np.repeat(s[starts], count)
            if head:
                first, small = np.full(len(k), head[0]), np.full(len(k), head[1])
            x, y = np.abs(small).astype(np.int64), np.abs(s).astype(np.int64)
            fits = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((small > 0) | (s > 0)) & (m != first)
            if fits.any():
                yield out(first[fits], m[fits], True)
            if not head:
                short = np.repeat((count > 2) & (count <= FEW), count)
                for d in range(1, FEW - 1):
                    # pairs d apart of which the first is not the posting's first: these are there already
                    i = np.flatnonzero(short[:-d] & (k[d:] == k[:-d]) & (m[:-d] != first[:-d]))
                    lo, hi = np.minimum(y[i], y[i + d]), np.maximum(y[i], y[i + d])
                    i = i[(100 * lo >= percent * hi) & ((s[i] > 0) | (s[i + d] > 0))]
                    if len(i):
                        yield out(m[i], m[i + d], True)
            # a posting's name is a digest of its members, which are sorted
            many = np.repeat(count > FEW, count) if not head else np.ones(len(k), bool)
            if many.any():
                if head:
                    yield out(k, m, False)
                    return
                spread = mix(m.view(np.uint64) + _A)
                name = np.repeat(mix(np.add.reduceat(spread, starts) + count.astype(np.uint64) * _B), count).view(np.int64)
                yield out(name[many], m[many], False)

        keys = members = sizes = None
        head = open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, m, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if open_ is not None:
                # the rest of a posting too long to be held
                i = int(np.searchsorted(k != open_, True))
                if i:
                    yield from closed(k[:i], m[:i], s[:i], head)
                if i == len(k):
                    continue
                head, open_, k, m, s = None, None, k[i:], m[i:], s[i:]
            if keys is not None:
                k, m, s = np.concatenate([keys, k]), np.concatenate([members, m]), np.concatenate([sizes, s])
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
            k, m, s = k[new], m[new], s[new]
            last = int(np.searchsorted(k == k[-1], True))
            if last:
                yield from closed(k[:last], m[:last], s[:last])
            keys, members, sizes = k[last:], m[last:], s[last:]
            if len(keys) > OUT:
                head, open_ = (members[0], sizes[0]), keys[0]
                yield from closed(keys, members, sizes, head)
                keys = members = sizes = None
        if keys is not None:
            yield from closed(keys, members, sizes)

    dealt = posted.repartition("key").sortWithinPartitions("key", "member")
    return dealt.mapInArrow(step, "a bigint, b bigint, star boolean").distinct()


# ----------------------------------------------------------------- verification


def shared(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """How many values of each of the sorted ys are in the sorted x."""
    count = np.fromiter(map(len, ys), np.int64, len(ys))
    if not len(x) or not count.any():
        return np.zeros(len(ys), np.int64)
    all_ = np.concatenate(ys)
    there = x[np.minimum(np.searchsorted(x, all_), len(x) - 1)] == all_
    ends, stops = np.cumsum(np.concatenate([[0], there.astype(np.int64)])), np.cumsum(count)
    return ends[stops] - ends[stops - count]


def differ(nx: int, x: np.ndarray, ny: np.ndarray, ys: list[np.ndarray], percent: int, whole: bool) -> np.ndarray:
    """By how much sets (of sizes ny) differ from x (of size nx), or -1 where that is more than
    a link allows. Of whole sets that is exact; of sketches no more than it is, so that none
    that links is left out."""
    out = np.full(len(ys), -1, np.int64)
    at = np.flatnonzero(100 * np.minimum(ny, nx) >= percent * np.maximum(ny, nx))
    if len(at):
        cut = [ys[i] for i in at]
        d = len(x) + np.fromiter(map(len, cut), np.int64, len(cut)) - 2 * shared(x, cut) if whole else distances(x, cut)
        out[at] = np.where(d <= farthest(ny[at] + nx, percent), d, -1)
    return out


def sets_again(texts: DataFrame, sized: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(member, size, elements) of the needed sets, made from a document of each."""
    of = sized.where("size > 0").groupBy(F.col("set").alias("member")).agg(F.min("doc_id").alias("doc_id")).join(needed, "member", "left_semi")
    keys = common.materialise(of.select(F.xxhash64("doc_id").alias("k")), "wanted")
    bits = common.bitmap_log2(keys.count())
    bitmap = common.materialise(common.key_bitmap(keys, "k", bits), "bitmap", rows=0)
    chosen = common.in_bitmap(texts.withColumn("k", F.xxhash64("doc_id")), bitmap, "k", bits)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for me, own in _once(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(np.array([me], np.uint64).view(np.int64)), pa.array([len(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["member", "size", "elements"])

    made = chosen.select("text").mapInArrow(step, "member bigint, size bigint, elements binary").join(needed, "member", "left_semi")
    # tasks may have made the same set of repeated rows, which then is compared twice
    return common.materialise(made, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """The pairs (a, b) that pass, and by how much they differ, by whole sets or sketches
    (member, size, elements). b's elements
    come to a's, about SALT of them at most to a task's stretch of a; of these one batch is
    held at a time."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    dealt = common.materialise(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt")), "pairs")
    heads = dealt.select("a", "salt").distinct().join(sets, F.col("a") == F.col("member")).select("a", "salt", F.lit(None).cast("bigint").alias("b"), "size", "elements")
    rest = dealt.join(sets, F.col("b") == F.col("member")).select("a", "salt", "b", "size", "elements")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        at, nx, x = None, 0, None
        for batch in batches:
            a, b, n = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            own, ny, ys, got = [], [], [], ([], [], [])

            def test():
                d = differ(nx, x, np.array(ny), ys, percent, whole)
                for i in np.flatnonzero(d >= 0):
                    got[0].append(at), got[1].append(own[i]), got[2].append(d[i])

            for i, e in enumerate(batch.column(4)):
                elements = np.frombuffer(e.as_py(), np.uint64)
                if b[i] is None:
                    if own:
                        test()
                        own, ny, ys = [], [], []
                    at, nx, x = a[i], n[i], elements
                else:
                    own.append(b[i]), ny.append(n[i]), ys.append(elements)
            if own:
                test()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["a", "b", "d"])

    sorted_ = heads.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return common.materialise(sorted_.mapInArrow(step, "a bigint, b bigint, d bigint"), "linked")


def open_tasks(lists: DataFrame, components: DataFrame, cap: int) -> DataFrame:
    """(task, member, root, side, postings) of postings (posting, member) in more than one
    component. Postings of which the largest component is the same make a group, in which a
    member comes once with all its postings, unless that would make more rows than the
    postings by themselves. Long groups or postings are a task for each pair of their blocks,
    side being a member's block."""
    blocks = lambda n: F.when(n <= cap, 1).otherwise(F.ceil(n / (cap // 2))).cast("bigint")
    sized = components.join(components.groupBy("root").agg(F.count(F.lit(1)).alias("nodes")), "root")
    own = lists.join(sized, F.col("member") == F.col("node"), "left")
    rooted = common.materialise(own.select("posting", "member", F.coalesce("root", "member").alias("root"), F.coalesce("nodes", F.lit(1)).alias("nodes")), "rooted")
    open_ = rooted.groupBy("posting").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("nodes", F.xxhash64("root").alias("hub"))).alias("most")).where("lo < hi")
    met = common.materialise(rooted.join(open_.select("posting", "members", "most.hub"), "posting").drop("nodes"), "open")
    distinct = met.groupBy("hub", "member").agg(F.sum(blocks(F.col("members"))).alias("rows")).groupBy("hub").agg(F.count(F.lit(1)).alias("all"), F.sum("rows").alias("rows"))
    as_one = F.col("all") * blocks(F.col("all")) <= F.col("rows")
    grouped = met.join(distinct, "hub").select("member", "root", "posting", F.when(as_one, F.col("hub")).otherwise(F.col("posting")).alias("group"), F.when(as_one, F.col("all")).otherwise(F.col("members")).alias("n"))
    once = grouped.groupBy("group", "member", "root", "n").agg(F.collect_set("posting").alias("postings"))
    dealt = once.withColumn("blocks", blocks(F.col("n"))).withColumn("side", F.pmod(F.xxhash64("member"), "blocks"))
    paired = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return paired.select(F.xxhash64("group", F.least("side", "j"), F.greatest("side", "j")).alias("task"), "member", "root", "side", "postings")


def together(postings: list[np.ndarray], sides: np.ndarray) -> np.ndarray:
    """Which members of a task, as a matrix, have a posting in common; of two blocks, which
    of different blocks."""
    names, at = np.unique(np.concatenate(postings), return_inverse=True)
    row = np.repeat(np.arange(len(postings)), np.fromiter(map(len, postings), np.int64, len(postings)))
    out = np.zeros((len(postings), len(postings)), bool)
    for low in range(0, len(names), STRETCH):
        own = (at >= low) & (at < low + STRETCH)
        there = np.zeros((len(postings), min(STRETCH, len(names) - low)), np.float32)
        there[row[own], at[own] - low] = 1
        out |= there @ there.T > 0
    return out & (sides[:, None] != sides) if (sides != sides[0]).any() else out


def compared(tasks: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Within each task, members of different components that have a posting in common. Of whole sets: links (a, b), as many
    as join the components they join. Of sketches: what is left to be compared on whole sets,
    as pairs (a, b, true), or, where that is fewer rows, as (task, member, false) of the
    members of these pairs. A pair of several postings is given once by a worker's batches."""
    met = tasks.join(sets, "member").select("task", "member", "root", "size", "side", "postings", "elements")
    names = ["a", "b"] if whole else ["a", "b", "pair"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        seen: set[tuple[int, int]] = set()

        def within(task: int, rows: list[tuple]) -> pa.RecordBatch:
            members, group, sizes, elements = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[5] for r in rows]
            meet = together([r[4] for r in rows], np.array([r[3] for r in rows]))
            got, some, pairs = ([], []), np.zeros(len(rows), bool), 0
            for i, x in enumerate(elements):
                other = i + 1 + np.flatnonzero(meet[i, i + 1 :] & (group[i + 1 :] != group[i]))
                if not len(other):
                    continue
                near = other[differ(int(sizes[i]), x, sizes[other], [elements[k] for k in other], percent, whole) >= 0]
                if not whole:
                    some[near] = True
                    some[i] |= len(near) > 0
                    pairs += len(near)
                    if pairs <= FEW * len(rows):
                        got[0].extend([members[i]] * len(near)), got[1].extend(members[j] for j in near)
                    continue
                for j in near:
                    if group[j] != group[i]:
                        got[0].append(members[i]), got[1].append(members[j])
                        group[group == group[j]] = group[i]
            as_pairs = not whole and pairs <= min(FEW * len(rows), int(some.sum()))
            if as_pairs:
                new = [x for x in zip(*got, strict=True) if x not in seen]
                if len(seen) < SEEN:
                    seen.update(new)
                got = [a for a, _ in new], [b for _, b in new]
            elif not whole:
                at = np.flatnonzero(some)
                got = [task] * len(at), [members[i] for i in at]
            columns = [pa.array(c, pa.int64()) for c in got]
            return pa.RecordBatch.from_arrays(columns if whole else [*columns, pa.array(np.full(len(got[0]), as_pairs))], names)

        now, rows = None, []
        for batch in batches:
            for task, *row, p, e in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), batch.column(6), strict=True):
                if task != now:
                    if len(rows) > 1:
                        yield within(now, rows)
                    now, rows = task, []
                rows.append((*row, p.values.to_numpy().copy(), np.frombuffer(e.as_py(), np.uint64)))
        if len(rows) > 1:
            yield within(now, rows)

    dealt = met.repartition("task").sortWithinPartitions("task", "member")
    return common.materialise(dealt.mapInArrow(step, "a bigint, b bigint" if whole else "a bigint, b bigint, pair boolean").distinct(), "compared")


def ngram_links(docs: DataFrame, ngram: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", tolerance: tuple[int, int] | None = None, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(sized, components): (doc_id, size, set) of each document, and (node, root) of the sets
    that link with another."""
    if ngram < 1 or not 50 <= percent < 100:
        raise ValueError("ngram is 1 or more, percent 50 to 99")
    texts = _texts(docs, id_col, text_col)
    sized = common.materialise(sized_sets(texts, ngram), "sized")
    distinct = sized.select("set").distinct().count()
    flips, pieces = tolerance or next(t for most, t in TOLERANCE if distinct <= most)
    met = common.materialise(meetings(postings(texts, ngram, percent, flips, pieces), percent), "met")
    common.release(docs.sparkSession)
    pairs = met.where("star").select("a", "b")
    lists = met.where("not star").select(F.col("a").alias("posting"), F.col("b").alias("member"))
    ends = lambda df: df.select(F.col("a").alias("member")).unionByName(df.select(F.col("b").alias("member")))
    needed = ends(pairs).unionByName(lists.select("member")).distinct()
    sketches = common.materialise(sized.select(F.col("set").alias("member"), "size", F.col("sketch").alias("elements")).join(needed, "member", "left_semi").dropDuplicates(["member"]), "sketches")
    near = verified(pairs, sketches, percent, whole=False)
    common.release(docs.sparkSession)
    sets = sets_again(texts, sized, ends(near).distinct(), ngram)
    first = near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select("x.a", "b")
    links = verified(first, sets, percent, whole=True).select("a", "b")
    n = links.count()
    components = common.connected_components(links, n)
    of = lambda c: components.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = near.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    rest = common.materialise(apart.join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest, sets, percent, whole=True).select("a", "b"))
        n = links.count()
        components = common.connected_components(links, n)
    common.discard(sets)
    common.release(docs.sparkSession)
    tasks = common.materialise(open_tasks(lists, components, cap), "tasks")
    left = compared(tasks, sketches, percent, whole=False)
    if not left.isEmpty():
        near = left.where("pair").select("a", "b")
        few = left.where("not pair").select(F.col("a").alias("task"), F.col("b").alias("member"))
        sets = sets_again(texts, sized, ends(near).unionByName(few.select("member")).distinct(), ngram)
        more = verified(near, sets, percent, whole=True).select("a", "b")
        if not few.isEmpty():
            more = more.unionByName(compared(tasks.join(few, ["task", "member"], "left_semi"), sets, percent, whole=True))
        if not more.isEmpty():
            components = common.connected_components(links.unionByName(more), n + more.count())
        common.discard(sets)
    common.discard(met, sketches, tasks)
    return sized, components


def ngram_join(docs: DataFrame, ngram: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", tolerance: tuple[int, int] | None = None, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    sized, components = ngram_links(docs, ngram, percent, id_col, text_col, tolerance, cap)
    some = sized.where("size > 0")
    rows = sized.count()
    least = some.groupBy("set").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    rooted = common.materialise(least.join(components, least["set"] == components["node"], "left").select("set", F.coalesce("root", "set").alias("root"), "first", "copies"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.materialise(rooted.join(ids, "root").select("set", "component_id", "copies"), "named")
    out = common.by_key(some, named, ["set"], "copies", rows).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    none = sized.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none)
