"""WARC archives with a two-level capture index.

Writing: every page becomes a gzip member of a WARC file in the shared folder. Of pages
with equal payloads of ``min_revisit`` bytes or more, the one with the largest page id is a
``response``; the others are ``revisit`` records that refer to it and carry no payload.
Index: captures are range-sorted by reversed-host URL key into shards; each shard packs its
sorted lines into compressed blocks and keeps a sparse directory (first key of each block).
Lookup: binary search over shards, then over the shard's directory, then in the block,
which is fetched by one range read; the record itself is another range read. A repeated key may
fill several blocks and shards; each shard's part is looked up by itself, block by block.

Scale: HTML moves once (to learn which record is a revisit), everything after is a line a
page. Shards and their names are as many as partitions, which bounds what a lookup task is
given: a repeated key is cut by shard as any other rows; a directory is read only where a key falls
into it, and block and directory caches work because lookups arrive in key order. Sort keys include the page id, so one host or URL
with a third of all rows spans many shards. Archives roll over at ``ROLL_BYTES``. A retried
task writes new files under new names, and the index, a committed table, names only the
files of tasks that succeeded.

Files are opened through ``pyarrow.fs``, so the shared folder may be any store it knows.

Defined results: null html is an empty payload, a null URL an empty key. A null page id
sorts first and never wins over another id. Rows that repeat both page id and payload share
the outcome; if they hold the largest id, all of them are responses. An empty table gives an
empty result. Columns beside the three named ones are not archived.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_size, partitions, work_path, work_table

ROLL_BYTES = 1 << 28
BLOCK_LINES = 512
_FOUND = 4096
_NONE = -(2**63)  # stands for a null page id in keys
_SPACE = uuid.UUID("6f1b1a52-7a57-4c1e-9b33-000000000000").int >> 64 << 64


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: ``http://www.a.example.com:80/x?y`` -> ``com,example,a)/x?y``."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?", "", url).partition("#")[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)\Z", rest, re.S).groups()
    host = re.sub(r":(80|443)?$", "", host.rpartition("@")[2].lower())
    host = re.sub(r"^www\d*\.", "", host)
    name, colon, port = host.partition(":")
    return f"{','.join(reversed(name.split('.')))}{colon}{port})/{path}"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | (page + 2**63))}>"


def _page_of(record_id: str) -> int:
    return (uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)) - 2**63


def _key(url: str | None, page: int) -> str:
    """Sort key of a capture: the URL key, then the page id in fixed width."""
    return f"{_clean(surt(url))} {page + 2**63:020d}"


@lru_cache(16)
def _filesystem(uri: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(uri)[0]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    root = "/".join(uri.split("/", 3)[:3]) + "/"
    return _filesystem(root), pafs.FileSystem.from_uri(uri)[1]


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path if re.match(r"[a-z0-9+.-]+:/", path) else f"file://{path}")


def record(url: str | None, page: int, payload: bytes, sha1: str, refers: int | None, date: str) -> bytes:
    """One WARC record, a gzip member of its own."""
    revisit = refers is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


_CAPTURE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE_DDL = "key string, file string, offset long, length long"


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        out, name, at = None, "", 0
        try:
            for batch in by_size(batches, "_payload"):
                rows = []
                for url, page, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > ROLL_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    page = _NONE if page is None else page
                    member = record(url, page, payload, sha1, refers, date)
                    out.write(member)
                    rows.append((_key(url, page), name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)
        finally:
            if out:
                out.close()

    return run


def write(pages: DataFrame, folder: str, min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC files in ``folder``; the captures, from a work table."""
    fs, path = _open(_uri(folder))
    fs.create_dir(path, recursive=True)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("url").alias("_url"), F.col("page_id").alias("_page"), payload.alias("_payload")).withColumn("_sha1", F.sha1("_payload"))
    slim = pages.select(F.col("page_id").alias("_page"), payload.alias("_payload")).where(F.length("_payload") >= min_revisit)
    again = slim.groupBy(F.sha1("_payload").alias("_digest")).agg(F.max("_page").alias("_target"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _target is not null")
    again = work_table(again.select("_digest", "_target"), "digests")  # small on disk, Spark broadcasts it: by size; large, it is shuffled
    joined = rows.join(again, (rows["_sha1"] == again["_digest"]) & (F.length("_payload") >= min_revisit), "left")
    refers = F.when(~F.col("_page").eqNullSafe(F.col("_target")), F.col("_target"))
    out = joined.select("_url", "_page", "_payload", "_sha1", refers.alias("_refers"))
    return work_table(out.mapInArrow(_write(_uri(folder), date), _CAPTURE_DDL), "captures")


_SHARD = pa.schema([("first", pa.string()), ("last", pa.string()), ("blocks", pa.string()), ("directory", pa.string())])


def _shard(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name, out, at, entries, lines, last = uuid.uuid4().hex, None, 0, [], [], ""

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}.cdx.gz", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = packer.compress("".join(lines).encode()) + packer.flush()
            out.write(block)
            entries.append((lines[0].split("\t", 1)[0], at, len(block)))
            at += len(block)
            lines = []

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(f"{key}\t{file}\t{offset}\t{length}\n")
                last = key
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{path}/{name}.idx", compression=None) as f:
            f.write("".join(f"{k}\t{a}\t{n}\n" for k, a, n in entries).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (entries[0][0], last, f"{name}.cdx.gz", f"{name}.idx")], schema=_SHARD)

    return run


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str, str]]:
    """Sort captures into compressed blocks in ``folder``; the shards, as many as partitions at most."""
    n = partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    shards = work_table(ordered.mapInArrow(_shard(_uri(folder)), "first string, last string, blocks string, directory string"), "shards")
    return sorted(tuple(r) for r in shards.collect())


class CaptureIndex:
    """Binary search over shards, directory and block; keeps the last directories and blocks."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str, str]]):
        self.fs, self.path = _open(folder)
        self.shards = shards
        self.directory, self.block = lru_cache(4)(self._directory), lru_cache(8)(self._block)

    def _directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            rows = [x.split("\t") for x in f.read().decode().splitlines()]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, name: str, offset: int, length: int) -> tuple[list[str], list[list[str]]]:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            rows = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")[:-1]]
        return [r[0] for r in rows], rows

    def lookup(self, key: str, shard: int) -> Iterator[list[tuple[str, int, int]]]:
        """File, offset and length of every capture with this key in a shard, a block at a time."""
        _, _, name, directory = self.shards[shard]
        firsts, places = self.directory(directory)
        # the block before the first that begins with the key may end with it
        for b in range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key)):
            keys, rows = self.block(name, *places[b])
            own = rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            if own:
                yield [(r[1], int(r[2]), int(r[3])) for r in own]


def shards_of(key: str, shards: list[tuple[str, str, str, str]], lasts: list[str]) -> Iterator[int]:
    """The shards, in order of their keys, that may have a key."""
    s = bisect.bisect_left(lasts, key)
    while s < len(shards) and shards[s][0] <= key:
        yield s
        s += 1


def _lookup(folder: str, shards: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, found = CaptureIndex(folder, shards), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)

        for b in batches:
            for key, shard in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for places in index.lookup(key, shard):
                    found += [(key, *place) for place in places]
                    if len(found) >= _FOUND:
                        yield batch()
                        found = []
        if found:
            yield batch()

    return run


def _keys(shards: list):
    lasts = [s[1] for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(url, _NONE if page is None else page) for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            pairs = [(k, s) for k in keys for s in shards_of(k, shards, lasts)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([s for _, s in pairs], pa.int32())], ["key", "shard"])

    return run


def lookup(pages: DataFrame, folder: str, shards: list[tuple[str, str, str, str]]) -> DataFrame:
    """The captures of the distinct ``(url, page_id)`` of ``pages``, found through the index."""
    n = partitions(pages.sparkSession)
    keys = pages.select("url", "page_id").mapInArrow(_keys(shards), "key string, shard int").distinct()
    return keys.repartitionByRange(n, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(_lookup(_uri(folder), shards), _CAPTURE_DDL)


_RECORD_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_GAP, _SPAN, _ROWS = 1 << 16, 1 << 23, 512


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)

        def spans() -> Iterator[tuple[str, list[tuple[int, int]]]]:
            """Neighbouring records of a file, to be fetched by one range read."""
            now, group = "", []
            for b in batches:
                for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if group and (file != now or offset - group[-1][0] - group[-1][1] > _GAP or offset - group[0][0] > _SPAN or len(group) >= _ROWS):
                        yield now, group
                        group = []
                    now = file
                    group.append((offset, length))
            if group:
                yield now, group

        opened, handle = "", None
        for file, group in spans():
            if file != opened:
                if handle:
                    handle.close()
                opened, handle = file, fs.open_input_file(f"{path}/{file}")
            start = group[0][0]
            data = handle.read_at(group[-1][0] + group[-1][1] - start, start)
            rows = []
            for offset, length in group:
                fields, http, payload = parse(data[offset - start : offset - start + length])
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} in {file} at {offset} is not what its headers say")
                page, refers = _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Refers-To")
                rows.append((None if page == _NONE else page, fields.get("WARC-Target-URI"), payload if with_payload else None, size, digest, fields["WARC-Type"], _page_of(refers) if refers else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)
        if handle:
            handle.close()

    return run


def read(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at the given places, read in the order in which they lie in the archives.

    A response whose body differs in length or SHA-1 from its headers fails the read."""
    n = partitions(captures.sparkSession)
    near = captures.repartition(n, "file", (F.col("offset") / F.lit(_SPAN)).cast("long")).sortWithinPartitions("file", "offset")
    return near.mapInArrow(_read(_uri(folder), with_payload), _RECORD_DDL)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = work_path(spark, "warc")
    shards = build_index(write(pages, folder), folder)
    records = read(lookup(pages, folder, shards), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
