"""Token arrays: the byte tokenizer, end ids and length rules."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions.encoder import GROUP, Encoder, tokenizer_source
from tessera.functions.text import EOS

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: ids that are made texts at once
AT_ONCE = 1 << 17


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be of 4 MB, so that what a task holds of them (both ways, in the
    JVM and the worker) does not go with the size of rows. A session that sets another
    bound keeps it. The setting stays, as plans read it when they run."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def arrow_function(f: Callable, kind: str) -> Callable[..., Column]:
    """An Arrow function over batches of bounded size."""
    small_batches(SparkSession.active())
    return F.arrow_udf(f, kind)


def _bytes(texts: pa.Array) -> pa.Array:
    """Offsets and bytes are taken over as they are."""
    data = texts.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if data.buffers()[2] else np.zeros(0, np.uint8)
    lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(raw.astype(np.int32)))
    return lists


def byte_tokens(c: Column | str) -> Column:
    """UTF-8 bytes as ids 0 to 255."""
    return arrow_function(_bytes, "array<int>")(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _blake2b(values: pa.Array) -> pa.Array:
    def side(v: str | bytes | None) -> str | None:
        if v is None:
            return None
        data = v.encode() if isinstance(v, str) else bytes(v)
        return "val" if int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little") % 10_000 < 200 else "train"

    return pa.array([side(v) for v in values.to_pylist()], pa.string())


def blake2b_split(c: Column | str) -> Column:
    """Split by BLAKE2b of 64 bits, little-endian, at two percent; of texts or bytes."""
    return arrow_function(_blake2b, "string")(c)


def _text_of_bytes(ids: pa.Array) -> pa.Array:
    return pa.array([None if x is None else bytes(i for i in x if i < 256).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())


def byte_text(ids: Column | str) -> Column:
    """The text of byte ids; other ids have none, and a cut character becomes U+FFFD."""
    return arrow_function(_text_of_bytes, "string")(ids)


_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _encoder(path: str) -> Encoder:
    if (path, "encoder") not in _loaded:
        _loaded[path, "encoder"] = Encoder(tokenizer_source(path))
    return _loaded[path, "encoder"]


def _parts(rows: pa.Array, sizes: pa.Array, at_once: int = AT_ONCE) -> Iterator[pa.Array]:
    """Rows in slices of about at_once in size, a larger row alone."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, side="right")))
        yield rows.slice(i, j - i)
        i = j


def library_tokens(path: str) -> Callable[..., Column]:
    """Ids by a tokenizers file, which each worker loads once; the encoder remembers pieces."""

    def encode(texts: pa.Array) -> pa.Array:
        own, found, counts = _encoder(path), [], [0]
        for part in _parts(texts, pc.binary_length(texts), GROUP):
            ids = own.encode([t or "" for t in part.to_pylist()])
            found.append(np.concatenate([np.asarray(x, np.int32) for x in ids]))
            counts.extend(map(len, ids))
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(flat))

    return arrow_function(encode, "array<int>")


def _spellings(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The bytes of all tokens of a byte-level vocabulary in a row, and where each id's begin
    and how many they are, the last being no id's; None where another decoder is named."""
    if (path, "bytes") not in _loaded:
        tokenizer, found = _tokenizer(path), None
        if (json.loads(tokenizer.to_str()).get("decoder") or {}).get("type") == "ByteLevel":
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
            # a token with any other character stands for itself
            names = [tokenizer.id_to_token(i) or "" for i in range(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)]
            spelt = [bytes(map(byte_of.__getitem__, t)) if all(map(byte_of.__contains__, t)) else t.encode() for t in names] + [b""]
            size = np.fromiter(map(len, spelt), np.int64, len(spelt))
            found = np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(size) - size, size
        _loaded[path, "bytes"] = found
    return _loaded[path, "bytes"]


def _spelt(ids: pa.Array, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[str]:
    """Texts of lists of ids, bytes that make no character becoming U+FFFD as in the library."""
    at = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.where((at < 0) | (at >= len(size)), len(size) - 1, at)
    ends = np.cumsum(np.concatenate([[0], size[at]]))
    data = flat[np.repeat(first[at] - ends[:-1], size[at]) + np.arange(ends[-1])].tobytes()
    bounds = ends[np.cumsum(np.concatenate([[0], pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64))]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]


def library_texts(path: str) -> Callable[..., Column]:
    """Texts of ids by a tokenizers file. Byte-level vocabularies are spelt from a table."""

    def decode(ids: pa.Array) -> pa.Array:
        table, texts = _spellings(path), []
        for part in _parts(ids, pc.list_value_length(ids)):
            if table:
                texts.extend(_spelt(part, *table))
            else:
                texts.extend(_tokenizer(path).decode_batch([x or [] for x in part.to_pylist()], skip_special_tokens=False))
        return pa.array(texts, pa.string())

    return arrow_function(decode, "string")


def append_eos(ids: Column, eos: int = EOS) -> Column:
    """Null for no ids; the end id is added unless it is there."""
    return F.when(F.size(ids) > 0, F.when(F.element_at(ids, -1) == eos, ids).otherwise(F.array_append(ids, F.lit(eos))))


def truncate_eos(ids: Column, max_tokens: int, eos: int = EOS) -> Column:
    """At most max_tokens ids, the last of a cut list being the end id."""
    return F.when(F.size(ids) > max_tokens, F.concat(F.slice(ids, 1, max_tokens - 1), F.array(F.lit(eos)))).otherwise(ids)


def tail(ids: Column, n: int) -> Column:
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def total(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x)


def decoded_split(ids: Column, path: str, head: int = 2048) -> Column:
    """The split of a chunk of ids by the text of its first ones."""
    return blake2b_split(library_texts(path)(F.slice(ids, 1, head)))
