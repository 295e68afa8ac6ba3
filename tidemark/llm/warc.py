"""WARC archives with revisits, a two-level capture index, and range reads through it.

Archives and index lie in a folder that driver and executors share, reached through ``pyarrow.fs`` (file, hdfs, s3, gs).
A task writes files of names of its own and the rows that point into them; rows of lost or doubled attempts never come
to count, and what they point to is never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove_at_end, shared_dir, table

#: Lines of a compressed index block, captures of an index shard (about), index shards at most, bytes of an archive file (about).
BLOCK_LINES, SHARD_LINES, MOST_SHARDS, FILE_BYTES = 1000, 100_000, 4096, 512 << 20
#: Bytes of one archive that one task reads back, about.
READ_BYTES = 16 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def surt(url: str | None) -> str:
    """Host parts reversed, then path and query, without scheme, user, fragment and default port: com,example)/a?b."""
    m = re.match(r"(?is)^\s*(?:([a-z][a-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d*)?([^#]*)", url or "")
    if not m:
        return "-)" + (url or "").split("#")[0]
    port = "" if m[3] in (None, ":", ":80" if (m[1] or "").lower() == "http" else ":443") else m[3]
    host = ",".join(reversed(m[2].lower().strip(".").split(".")))
    return f"{host}{port}){m[4] or '/'}".replace("\n", "%0A").replace("\t", "%09")


def key_of(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'' if page_id is None else format(page_id, '020d')}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit without it."""
    name = "null" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    header = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        header += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    header += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(header).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of a record; checks length and, where the body is the payload, its digest."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:] if ": " in line)
    head = {k.lower(): v for k, v in head.items()}
    size = int(head["content-length"])
    body = rest[:size]
    if rest[size:] != b"\r\n\r\n" or head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{digest(body)}":
        raise ValueError(f"damaged record {head.get('warc-record-id')}")
    return head, body


@dataclass
class Archive:
    """Where an archive lies, the first key of each of its index shards with the shard's file, and bytes of records."""

    root: str
    firsts: list[str]
    files: list[str]
    size: int = 0


def _payload(column: str = "html"):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, first): pages whose payload, of at least so many bytes, another page of smaller id has."""
    slim = cut(pages.select("page_id", F.sha1(_payload()).alias("sha1"), F.octet_length(_payload()).alias("size")))
    groups = slim.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    again = slim.join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first")))
    return again.select("page_id", "sha1", "first").distinct()


def write(pages: DataFrame, root: str, least_bytes: int = 0) -> Archive:
    """Write a record per row of ``pages`` (page_id, url, html) and the index.

    Null html is an empty payload, a null url an empty one, a null page_id sorts first and is never referred to. Of
    equal payloads the smallest page_id is kept as response; repeated rows with that id are responses each. Other
    columns play no part. An empty table gives an archive without files.
    """
    first = revisits(pages, least_bytes).select(F.col("page_id").alias("again"), F.col("sha1").alias("again_sha1"), "first")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), _payload().alias("payload"))
    rows = rows.join(first, F.col("page_id").eqNullSafe(F.col("again")) & (F.sha1("payload") == F.col("again_sha1")), "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, payload, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page_id, url, payload, refers)
                out.write(member)
                found.append((key_of(url, page_id), name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    files, base = _open(root)
    files.create_dir(base, recursive=True)
    captures = cut(rows.select("page_id", "url", "payload", "first").mapInArrow(put, "key string, file string, offset long, length long"))
    made = captures.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")).first()
    shards = max(1, min(MOST_SHARDS, math.ceil(made.n / SHARD_LINES)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        out, name, at, first, lines, directory = None, uuid.uuid4().hex, 0, "", [], []

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = files.open_output_stream(f"{base}/{name}.cdx", compression=None)
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append([lines[0].split("\t")[0], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first = first or row[0]
                lines.append("\t".join(map(str, row)))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{base}/{name}.dir", compression=None) as sparse:
                sparse.write("\n".join(map(json.dumps, directory)).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "file"])

    order = ["key", "file", "offset"]
    indexed = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(index, "first string, file string")
    tops = sorted((r.first, r.file) for r in cut(indexed.select("first", "file")).toPandas().itertuples(index=False))  # MOST_SHARDS at most
    return Archive(root, [t[0] for t in tops], [t[1] for t in tops], made["size"] or 0)


def locate(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length): all captures under each of ``keys`` (key string, each once).

    The shard follows by binary search among the shards' first keys, the block among the shard's sparse directory, the
    line within the block.
    """
    firsts, names, root = archive.firsts, archive.files, archive.root

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(k, i) for k in batch.column(0).to_pylist() for i in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([i for _, i in own], pa.int32())], names=["key", "shard"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        open_shard, source, directory, heads, blocks = None, None, [], [], {}
        for batch in batches:
            found = []
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != open_shard:
                    if source is not None:
                        source.close()
                    source = files.open_input_file(f"{base}/{names[i]}.cdx")
                    with files.open_input_file(f"{base}/{names[i]}.dir") as sparse:
                        directory = [json.loads(line) for line in sparse.read().decode().split("\n")]
                    open_shard, heads, blocks = i, [d[0] for d in directory], {}
                for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
                    if b not in blocks:
                        if len(blocks) > 3:
                            blocks.clear()
                        lines = [x.split("\t") for x in zlib.decompress(source.read_at(directory[b][2], directory[b][1])).decode().split("\n")]
                        blocks[b] = [x[0] for x in lines], lines
                    have, lines = blocks[b]
                    for x in lines[bisect.bisect_left(have, key) : bisect.bisect_right(have, key)]:
                        found.append((x[0], x[1], int(x[2]), int(x[3])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["key", "file", "offset", "length"])
        if source is not None:
            source.close()

    routed = keys.select("key").mapInArrow(shard, "key string, shard int")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(find, "key string, file string, offset long, length long")


def fetch(archive: Archive, places: DataFrame) -> DataFrame:
    """key, page_id, url, record_type, payload_digest, payload_bytes, refers_to and body of the records at ``places``.

    How many tasks read follows from the bytes of the archive: the places themselves are a few bytes each, and a count of
    tasks made from them would put most of an archive into one.
    """
    root = archive.root

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                for key, file, offset, length in zip(*[c.to_pylist() for c in batch.slice(start, 500).columns], strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, files.open_input_file(f"{base}/{file}")
                    head, body = parse(source.read_at(length, offset))
                    number = lambda field: None if head.get(field, "null>").endswith("null>") else int(head[field].rpartition(":")[2][:-1])  # noqa: B023, E731
                    rows.append((key, number("warc-record-id"), head.get("warc-target-uri", ""), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), number("warc-refers-to"), body))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "body"])
        if source is not None:
            source.close()

    near = places.select("key", "file", "offset", "length").repartition(max(1, math.ceil(archive.size / READ_BYTES)), "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, "key string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, body binary")


def keys_of(pages: DataFrame) -> DataFrame:
    """(key): the index key of each row, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    return pages.select("page_id", "url").mapInArrow(run, "key string").distinct()


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records, then found by the index and read back. The archive goes when the session ends."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    root = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    remove_at_end(spark, root)
    archive = write(pages, root)
    back = fetch(archive, locate(archive, keys_of(pages)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
