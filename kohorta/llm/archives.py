"""WARC archives of pages with a two-level capture index.

Archives hold one gzip member a record.  Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the
one with the least id is a response record, the others are revisit records, which keep the HTTP header (and
thus the payload's length) and the digest, and refer to the response.  Smaller payloads are all responses.

The index sorts keys (the URL with its host reversed, then the page id) and cuts them into gzip blocks of
``BLOCK_LINES`` lines.  Each index part ends with a sparse directory of its blocks' first keys, and the parts'
own first keys are the level above.  A capture is found by binary search in the parts, in the directory and in
one block, and then read with one range read of its archive.

Files are written under names of their own by each attempt of a task, and only those that a task's result
names are used.  Defined results: null html is an empty payload; a null URL has an empty key and an empty
target; rows that repeat the least id of their payload are responses all; repeated rows keep one record each; a null id
is no page to refer to, so its record is a response, stored under the least integer.  Ids are whole numbers, or texts
of them: others raise.
"""

from __future__ import annotations

import bisect
import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import file_system, frugal, shared_path, slices, small_batches, stored
from .url_rules import host_of

MIN_REVISIT = 100
NULL_ID = -(2**63)
BLOCK_LINES = 1000
ARCHIVE_BYTES = 64 << 20
#: Payloads of several pages up to which they are broadcast (a digest and an id each), so that pages are not shuffled.
BROADCAST_DIGESTS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FOOTER = struct.Struct("<QQ8s")
_MAGIC = b"KCDX1\0\0\0"


def capture_key(url: Column) -> Column:
    """Host labels from the last to the first, then the path, query and fragment: ``com,example,www)/a?b``."""
    u = F.coalesce(url, F.lit(""))
    labels = F.array_join(F.reverse(F.split(host_of(u), r"\.")), ",")
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    key = F.when(F.instr(u, "://") > 0, F.concat(labels, F.lit(")"), rest)).otherwise(u)
    return F.regexp_replace(key, r"[\x00-\x20]", "_")


def record(page: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says: type, page, url, digest, refers_to, payload (None in a revisit), payload_bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda name: int(fields[name][len("<urn:page:") : -1]) if name in fields else None
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if response and (len(payload) != size or sha256(payload).hexdigest() != digest):
        raise ValueError(f"a damaged payload of page {page('WARC-Record-ID')}")
    return {"type": fields["WARC-Type"], "page": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "digest": digest, "refers_to": page("WARC-Refers-To"), "payload": payload if response else None, "payload_bytes": size}


def records(data: bytes) -> Iterator[bytes]:
    """The records of a whole archive, one gzip member each."""
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data) + member.flush()
        data = member.unused_data


@frugal
def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    fs = out = None
    uri, at = "", 0
    for batch in slices(batches, "html", 8 << 20):
        made = []
        for page, url, html, digest, first, key in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "first", "key")), strict=True):
            if out is None or at > ARCHIVE_BYTES:
                if out is not None:
                    out.close()
                uri, at = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz", 0
                fs, path = file_system(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            data = gzip.compress(record(page, url, html.encode(), digest, first, date), 6, mtime=0)
            out.write(data)
            made.append((key, page, uri, at, len(data)))
            at += len(data)
        columns = zip(*made, strict=True)
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["key", "page", "uri", "at", "size"])
    if out is not None:
        out.close()


def _line_key(key: str, page: int) -> bytes:
    return f"{key} {page + 2**63:020d}".encode()


@frugal
def _index(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """One index part: blocks, then their directory."""
    out, uri, at, directory, block = None, f"{folder}/index-{uuid.uuid4().hex}", len(_MAGIC), [], []

    def flush() -> None:
        nonlocal at
        data = gzip.compress(b"\n".join(a + b" " + json.dumps(b).encode() for a, b in block), 6, mtime=0)
        directory.append((block[0][0].decode(), at, len(data)))
        out.write(data)
        at += len(data)
        block.clear()

    for batch in batches:
        for key, page, *place in zip(*(batch.column(c).to_pylist() for c in ("key", "page", "uri", "at", "size")), strict=True):
            if out is None:
                fs, path = file_system(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                out.write(_MAGIC)
            block.append((_line_key(key, page), place))
            if len(block) == lines:
                flush()
    if out is None:
        return
    if block:
        flush()
    data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
    out.write(data + _FOOTER.pack(at, len(data), _MAGIC))
    out.close()
    yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([uri])], ["first", "uri"])


class CaptureIndex:
    """Search in the index parts [(first key, uri)]; keeps the block and archive that were read last."""

    def __init__(self, parts: list[tuple[str, str]]):
        parts = sorted((a.encode(), b) for a, b in parts)
        self.firsts, self.uris = [a for a, _ in parts], [b for _, b in parts]
        self._part: tuple = ("",)
        self._block: tuple = ("",)
        self._archive: tuple = ("",)

    def _open(self, uri: str) -> None:
        if self._part[0] != uri:
            if len(self._part) > 1:
                self._part[1].close()
            fs, path = file_system(uri)
            f = fs.open_input_file(path)
            at, size, magic = _FOOTER.unpack(f.read_at(_FOOTER.size, f.size() - _FOOTER.size))
            if magic != _MAGIC:
                raise ValueError(f"not an index: {uri}")
            directory = json.loads(gzip.decompress(f.read_at(size, at)))
            self._part = (uri, f, [x[0].encode() for x in directory], directory)

    def _lines(self, part: int, block: int) -> tuple[list[bytes], list[bytes]]:
        self._open(self.uris[part])
        name = (self.uris[part], block)
        if self._block[0] != name:
            _, at, size = self._part[3][block]
            lines = gzip.decompress(self._part[1].read_at(size, at)).split(b"\n")
            self._block = (name, [b" ".join(x.split(b" ", 2)[:2]) for x in lines], lines)
        return self._block[1], self._block[2]

    def places(self, key: str, page: int | None = None) -> Iterator[tuple[str, int, int]]:
        """(archive, first byte, size) of the key's captures, or of those of one page."""
        low = _line_key(key, -(2**63) if page is None else page)
        high = _line_key(key, 2**63 - 1) if page is None else low
        part = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while part < len(self.uris) and self.firsts[part] <= high:
            self._open(self.uris[part])
            firsts = self._part[2]
            block = max(0, bisect.bisect_left(firsts, low) - 1)
            while block < len(firsts) and firsts[block] <= high:
                keys, lines = self._lines(part, block)
                for i in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                    yield tuple(json.loads(lines[i].split(b" ", 2)[2]))
                block += 1
                self._open(self.uris[part])
            part += 1

    def read(self, place: tuple[str, int, int]) -> dict:
        uri, at, size = place
        if self._archive[0] != uri:
            if len(self._archive) > 1:
                self._archive[1].close()
            fs, path = file_system(uri)
            self._archive = (uri, fs.open_input_file(path))
        return parse(gzip.decompress(self._archive[1].read_at(size, at)))


def write_archives(pages: DataFrame, folder: str, url: str = "url", html: str = "html", key: str = "page_id", date: str = DATE, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes archives and index; returns the index parts (first, uri)."""
    small_batches(pages.sparkSession)
    made = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    made = made.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= MIN_REVISIT
    firsts = made.where(large).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL").drop("n")
    firsts = stored(firsts, "firsts")
    joined = made.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts, "digest", "left")
    ready = joined.select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "url", "html", "digest", F.when(F.col("id") != F.col("least"), F.col("least")).alias("first"), capture_key(F.col("url")).alias("key"))
    captures = stored(ready.mapInArrow(lambda it: _write(it, folder, date), "key string, page bigint, uri string, at bigint, size bigint"), "captures")
    ordered = captures.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "uri", "at")
    return stored(ordered.mapInArrow(lambda it: _index(it, folder, block_lines), "first string, uri string"), "index")


@frugal
def _read(batches: Iterator[pa.RecordBatch], parts: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    index = CaptureIndex(parts)
    for batch in batches:
        made, seen = [], {}
        for key, page in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist(), strict=True):
            found = sorted(index.places(key, page))
            turn = seen[key, page] = seen.get((key, page), -1) + 1  # repeated rows take their records one after the other
            made.append((page, found[turn % len(found)]))
        order = sorted(range(len(made)), key=lambda i: made[i][1])
        rows = [index.read(made[i][1]) for i in order]
        if any(r["page"] != made[i][0] for i, r in zip(order, rows, strict=True)):
            raise ValueError("the index names another page's record")
        columns = {
            "page_id": pa.array([r["page"] for r in rows], pa.int64()),
            "payload_bytes": pa.array([r["payload_bytes"] for r in rows], pa.int64()),
            "payload_digest": pa.array([r["digest"] for r in rows], pa.string()),
            "record_type": pa.array([r["type"] for r in rows], pa.string()),
            "refers_to": pa.array([r["refers_to"] for r in rows], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_captures(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """The records of (key, page) rows, each found by the index and read from its archive."""
    top = [(r["first"], r["uri"]) for r in parts.collect()]  # one row an index part
    spread = wanted.repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    found = spread.mapInArrow(lambda it: _read(it, top), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return found.withColumn("page_id", F.when(F.col("page_id") != NULL_ID, F.col("page_id")))


def round_trip(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    parts = write_archives(pages, folder, url, html, key)
    wanted = pages.select(capture_key(F.col(url)).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("page"))
    return read_captures(wanted, parts)
