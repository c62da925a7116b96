"""Operator 8, a deterministic sharded WARC writer, and its reader.

Pages are dealt by ranges of their id to shards (as many as the payloads' bytes
ask for, ranges holding about equal bytes) and sorted; each shard is written in gzip files, a member for each
record, that roll once their compressed size passes `roll_bytes`. All headers are
made anew: Content-Length, block and payload digests, and record ids, made of the
page id, the payload's digest and the row's number among equal ones. Nothing depends on the clock, the
task or the attempt, so a task that runs again writes the same bytes. Files appear
under their final names by a move, and the manifest, a table, is committed last.

Of records with equal payloads of at least `revisit_bytes`, the one of the largest
page id is a response and the others revisit it. That is settled on digests alone;
the decisions, two words a page, then meet the pages in the shuffle that sorts
them, so payloads move once.

Null payloads count as empty. Rows that repeat a page id each get a record; of
those with the same payload too, all but one revisit it. Null page ids come first
and never serve as the response of a group that has another. Ties of page id and
payload go by url. Very long payloads pass through one record's buffer. Other columns
are not read, so their names can't clash. An empty table writes no files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.files import Folder

REVISIT_BYTES = 1000
ROLL_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
HEAD_BYTES = 700
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha: bytes, copy: int) -> str:
    """copy counts the rows of one page id and payload."""
    return f"<urn:tessera:page:{'none' if page_id is None else page_id}:{sha.hex()}:{copy}>"


def page_of(record: str) -> int | None:
    name = record.strip("<>").split(":")[3]
    return None if name == "none" else int(name)


def record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))])
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + c.flush()


def page_record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """A response, or a revisit of the page refers_to of the same payload."""
    sha, refers = hashlib.sha1(payload).digest(), refers_to is not None
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, sha, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload))]
    if refers:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha, 0))]
    return record(headers, http if refers else http + payload, level)


def write_warc(pages: DataFrame, out: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, level: int = 6) -> str:
    """Write the archive and return its folder, which holds `files` and `manifest`."""
    spark = pages.sparkSession
    common.small_batches(spark)
    out = out or common.scratch(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    light = common.materialise(src.select("page_id", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("n")), "payloads")
    size, total = light.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    weighed = light.select("page_id", (F.col("n") + HEAD_BYTES).cast("bigint").alias("n"))
    edges = np.array(common.range_edges(weighed, "page_id", "n", -(-size // shard_bytes)), np.int64)

    long_ = light.where(F.col("n") >= revisit_bytes)
    kept = long_.groupBy("sha", "n").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    told = common.by_key(long_, kept, ["sha", "n"], "rows", total).groupBy("page_id", "sha", "keep").agg(F.count(F.lit(1)).alias("same"))
    # decisions come first in their page: kind 0, then its records by payload
    empty = F.lit(None)
    decisions = told.select("page_id", F.lit(0).alias("kind"), "sha", empty.cast("string").alias("url"), empty.cast("binary").alias("payload"), "keep")
    records = src.select("page_id", F.lit(1).alias("kind"), F.unhex(F.sha1("payload")).alias("sha"), "url", "payload", empty.cast("bigint").alias("keep"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).fill_null(-(1 << 63)).to_numpy()
            at = np.searchsorted(edges, own, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], ["shard", *b.schema.names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(f"{out}/files")
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        row, part, last, keeps, copies = next(rows, None), {}, object(), {}, {}
        while row:
            own = row[0]
            part[own] = part.get(own, -1) + 1
            name = f"pages-{own:06d}-{part[own]:05d}.warc.gz"
            whole, n_bytes, n = hashlib.sha1(), 0, 0
            with folder.write(name) as stream:

                def put(data: bytes) -> None:
                    nonlocal n_bytes
                    stream.write(data)
                    whole.update(data)
                    n_bytes += len(data)

                put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:tessera:file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                while row and row[0] == own and n_bytes < roll_bytes:
                    _, page, kind, sha, url, body, keep = row
                    if page != last:
                        last, keeps, copies = page, {}, {}
                    if kind == 0:
                        keeps[sha] = keep
                    else:
                        copy = copies[sha] = copies.get(sha, -1) + 1
                        put(page_record(page, copy, url, body, keeps[sha] if sha in keeps and (keeps[sha] != page or copy) else None, level))
                        n += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, own, part[own], n, n_bytes, whole.hexdigest())], ["name", "shard", "part", "records", "bytes", "sha1"])

    schema = "page_id bigint, kind int, sha binary, url string, payload binary, keep bigint"
    dealt = decisions.unionByName(records).mapInArrow(shard, f"shard int, {schema}").repartitionById(len(edges) + 1, "shard")
    ordered = dealt.sortWithinPartitions("shard", "page_id", "kind", "sha", "url")
    ordered.mapInArrow(write, "name string, shard bigint, part bigint, records bigint, bytes bigint, sha1 string").write.parquet(f"{out}/manifest")
    common.discard(light)
    return out


def records_of(stream, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip file, member by member."""
    pending, data, eof = b"", bytearray(), False
    while True:
        d = zlib.decompressobj(31)
        data.clear()
        while not d.eof:
            if not pending and not eof:
                pending = stream.read(piece)
                eof = not pending
            if not pending and eof:
                if data:
                    raise ValueError("a record is cut off")
                return
            data += d.decompress(pending)
            pending = d.unused_data if d.eof else b""
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The page records of the files that the manifest lists: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url and, on demand,
    the payload. Digests of blocks and payloads are checked."""
    common.small_batches(spark)
    manifest = spark.read.schema("name string, shard bigint, part bigint, records bigint, bytes bigint, sha1 string").parquet(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(f"{folder}/files")
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 6 + with_payload]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 6 + with_payload]

        def rows(name: str) -> Iterator[tuple]:
            with files.read(name) as f:
                for h, block in records_of(f):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    if _digest(block) != h["WARC-Block-Digest"]:
                        raise ValueError(f"{name}: a block's digest is wrong")
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
                    revisit = h["WARC-Type"] == "revisit"
                    if not revisit and (len(body) != size or _digest(body) != h["WARC-Payload-Digest"]):
                        raise ValueError(f"{name}: a payload's digest is wrong")
                    sha = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    out = (page_of(h["WARC-Record-ID"]), size, sha, h["WARC-Type"], page_of(h["WARC-Refers-To"]) if revisit else None, h["WARC-Target-URI"])
                    yield (*out, None if revisit else body) if with_payload else out

        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for r in rows(name):
                    held.append(r)
                    if len(held) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    files = max(1, manifest.count())
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * with_payload
    return manifest.select("name").repartition(min(files, 10_000), "name").mapInArrow(read, schema)
