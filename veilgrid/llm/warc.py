"""WARC: a Python data source that writes and reads archives of web pages.

What is written: ``.warc.gz`` files, a gzip member for each record, each member with the skip-lengths field ``sl`` that the
format's standard describes: with it a reader passes over a record without inflating it.

What is read: WARC 1.0 and 1.1 of any writer, plain or in gzip members of one record or many, with any record ids. The
reader plans partitions of about ``split_bytes``: small files together, largest first, and of larger files whose members
have skip lengths ranges, which begin at the first member that a chain of members over the whole range bears out. A large
file without skip lengths, and a plain one, is one task; in a plain one what is not wanted is passed over by a seek.
Filters on record_type, target_uri, record_id and page_id are pushed down: a record's headers come first and are compared,
and the payload is inflated only if the record is wanted and a column that needs the payload was asked for. Files are
opened through the file system of their URI.

Cases: null html counts as empty; null page_ids are written as ``null`` and read as null, as are ids of other writers,
which record_id has; a null url becomes an empty one; line ends in a url are escaped; records of any length; revisits of
other writers have no length of their payload (null); broken, cut short and partly skippable split files raise ValueError;
repeated rows are written each, and of pages with equal payloads all that share the smallest page_id are responses; an
empty table gives readable files without records; other columns of the input are ignored, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = (
    "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, "
    "record_id string, refers_to_id string, date string"
)
#: Bytes of archives in a partition; bytes of payload in a batch; bytes that are inflated to look for a header's end.
SPLIT_BYTES, BATCH_BYTES, HEAD_BYTES = 64 << 20, 4 << 20, 1024
_KINDS = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string(), "date": pa.string()}
_PUSHED = ("record_type", "target_uri", "page_id", "record_id")
#: The date in all records: archives of equal pages are equal.
_DATE = "1970-01-01T00:00:00Z"


def file_system(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page_id of an id that this module wrote; null for others."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record's bytes, not compressed: a response with an HTTP block, or a revisit without a payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member of ``raw`` with the skip-lengths field: the lengths of the whole member and of ``raw``."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 12 + 12 + len(body) + 8, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(data: bytes) -> dict[str, str]:
    """The fields of a record, names in lower case; a line that begins with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", data.decode("utf-8", "replace")).split("\r\n")
    if not re.fullmatch(r"WARC/[0-9]+\.[0-9]+", lines[0]):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Plain:
    """A file's bytes from a place on; what is skipped is not read."""

    STEP = 1 << 20

    def __init__(self, f, at: int = 0):
        self.f, self.at, self.end, self.held, self.base = f, at, f.size(), b"", at

    def peek(self, n: int) -> bytes:
        """``n`` bytes from here, or what there is."""
        here = self.at - self.base
        if here < 0 or (len(self.held) - here < n and self.base + len(self.held) < self.end):
            self.f.seek(self.at)
            self.held, self.base, here = self.f.read(max(n, self.STEP)), self.at, 0
        return self.held[here : here + n]

    def skip(self, n: int) -> None:
        if self.at + n > self.end:
            raise ValueError("the archive is cut short")
        self.at += n

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(n)
        return out


class _Inflated:
    """What a gzip file holds, member after member."""

    STEP = 1 << 16

    def __init__(self, raw: _Plain):
        self.raw, self.inflate, self.held, self.at, self.sums = raw, None, b"", 0, (0, 0)

    def _more(self) -> bool:
        if self.inflate is None:
            if not self.raw.peek(1):
                return False
            self.raw.skip(gzip_header(self.raw)[0])
            self.inflate, self.sums = zlib.decompressobj(-15), (0, 0)
        data = self.raw.peek(self.STEP)
        if not data:
            raise ValueError("the archive is cut short")
        new = self.inflate.decompress(data)
        self.sums = zlib.crc32(new, self.sums[0]), self.sums[1] + len(new)
        self.raw.skip(len(data) - len(self.inflate.unused_data))
        if self.inflate.eof:
            self.inflate = None
            if self.raw.take(8) != struct.pack("<II", self.sums[0], self.sums[1] & 0xFFFFFFFF):
                raise ValueError("a broken member")
        self.held, self.at = self.held[self.at :] + new if self.at < len(self.held) else new, 0
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        return self.held[self.at : self.at + n]

    def skip(self, n: int) -> None:
        while n > len(self.held) - self.at:
            n -= len(self.held) - self.at
            self.held, self.at = b"", 0
            if not self._more():
                raise ValueError("the archive is cut short")
        self.at += n

    def take(self, n: int) -> bytes:
        parts, left = [], n  # so that a long payload is joined once
        while left:
            if self.at == len(self.held):
                self.held, self.at = b"", 0
                if not self._more():
                    raise ValueError("the archive is cut short")
            parts.append(self.held[self.at : self.at + left])
            left -= len(parts[-1])
            self.at += len(parts[-1])
        return b"".join(parts)


def gzip_header(raw: _Plain) -> tuple[int, int | None]:
    """Length of a member's header, and of the whole member where it says so."""
    data = raw.peek(1024)
    if data[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    flags, at, size = data[3], 10, None
    if flags & 4:
        end = at + 2 + struct.unpack_from("<H", data, at)[0]
        data = raw.peek(end + 1024)
        at += 2
        while at + 4 <= end:
            name, n = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
            if name == b"sl" and n == 8:
                size = struct.unpack_from("<I", data, at + 4)[0]
            at += 4 + n
        at = end
    for flag in (8, 16):  # a name, a comment
        if flags & flag:
            while (stop := data.find(b"\0", at)) < 0:
                more = raw.peek(len(data) + 1024)
                if len(more) == len(data):
                    raise ValueError("the archive is cut short")
                data = more
            at = stop + 1
    return at + (2 if flags & 2 else 0), size


def _chain(raw: _Plain, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(place, length of the header, length) of the members from ``start`` to the first one at or after ``end``; None if
    they do not follow one another, and if one has no skip lengths."""
    out, raw.at = [], start
    while raw.at < min(end, raw.end):
        try:
            head, size = gzip_header(raw)
        except (ValueError, struct.error):
            return None
        if size is None or size < head + 8 or raw.at + size > raw.end:
            return None
        out.append((raw.at, head, size))
        raw.at += size
    return out


def _members(raw: _Plain, start: int, end: int) -> list[tuple[int, int, int]]:
    """The members that begin in a range of a file whose members have skip lengths."""
    at = start
    while at < min(end, raw.end):
        if (found := _chain(raw, at, end)) is not None:
            return found
        if not start:
            raise ValueError("members without skip lengths, or a file that is cut short")
        at += 1
        while at < end:
            raw.at = at
            data = raw.peek(1 << 16)
            hit = data.find(b"\x1f\x8b\x08")
            at += hit if hit >= 0 else max(1, len(data) - 2)
            if hit >= 0 or len(data) < 3:
                break
    return []


@dataclass
class Files(InputPartition):
    #: path, and the first and last place (not included) of the range in which its members begin
    ranges: list


@dataclass
class Done(WriterCommitMessage):
    path: str | None


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = file_system(self.path)
        one = store.get_file_info(path)
        found = [one] if one.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        ranges = []
        for x in found:
            if x.is_file and x.base_name[0] not in "._" and x.base_name.endswith((".warc", ".warc.gz")):
                cuts = range(0, max(1, x.size), self.split if x.base_name.endswith(".gz") else max(1, x.size))
                ranges += [(min(x.size - a, cuts.step), x.path, a, a + cuts.step) for a in cuts]
        total = sum(r[0] for r in ranges)
        bins = [(0, k, []) for k in range(max(1, min(len(ranges), -(-total // self.split))))]
        for n, *r in sorted(ranges, reverse=True):  # the next largest to the emptiest
            held, k, own = bins[0]
            heapq.heapreplace(bins, (held + n, k, [*own, r]))
        return [Files(r) for *_, r in bins]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        schema = pa.schema([(n, _KINDS[n]) for n in self.names])
        rows, held = [], 0
        for path, start, end in partition.ranges:
            with store.open_input_file(path) as f:
                for row in self._rows(f, start, end):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _rows(self, f, start: int, end: int) -> Iterator[dict]:
        raw = _Plain(f)
        if not raw.end:
            return
        if raw.peek(2)[:2] != b"\x1f\x8b":
            yield from self._records(raw) if start == 0 else ()
        elif gzip_header(raw)[1] is None:
            # where the next member begins is known only by inflating this one
            yield from self._records(_Inflated(raw)) if start == 0 else ()
        else:
            for at, head, size in _members(raw, start, end):
                yield from self._member(raw, at, head, size)

    def _needs(self, kind: str | None) -> bool:
        return kind != "revisit" and not {"payload", "payload_bytes", "payload_digest"}.isdisjoint(self.names)

    def _wants(self, row: dict) -> bool:
        return all(row[name] in values for name, values in self.wanted)

    @staticmethod
    def _described(head: dict[str, str]) -> dict:
        return {
            "page_id": _page(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": (head.get("warc-target-uri") or "").removeprefix("<").removesuffix(">") if "warc-target-uri" in head else None,
            "refers_to": _page(head.get("warc-refers-to")), "record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to"), "date": head.get("warc-date"),
        }

    def _row(self, row: dict, head: dict[str, str], block: bytes | None) -> dict:
        """The columns asked for; ``block`` is what the record holds, where it is needed."""
        payload = block
        if block is not None and head.get("content-type", "").startswith("application/http") and block.startswith(b"HTTP/") and (cut := block.find(b"\r\n\r\n")) >= 0:
            payload = block[cut + 4 :]
        if payload is not None:
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload)}
        else:
            said = head.get("x-payload-length")
            row |= {"payload": None, "payload_bytes": int(said) if said else None, "payload_digest": head["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in head else None}
        return {n: row[n] for n in self.names}

    def _records(self, stream: _Plain | _Inflated) -> Iterator[dict]:
        """Records one after another."""
        while data := stream.peek(1):
            if data[:1] in (b"\r", b"\n"):
                stream.skip(1)
                continue
            n = HEAD_BYTES
            while (cut := (data := stream.peek(n)).find(b"\r\n\r\n")) < 0:
                if len(data) < n:
                    raise ValueError("a record without an end of its headers")
                n *= 2
            head = parse_headers(data[:cut])
            if not head.get("content-length", "").isdigit():
                raise ValueError("a record without a length")
            stream.skip(cut + 4)
            row, size = self._described(head), int(head["content-length"])
            if not self._wants(row):
                stream.skip(size)
            elif self._needs(row["record_type"]):
                yield self._row(row, head, stream.take(size))
            else:
                stream.skip(size)
                yield self._row(row, head, None)

    def _member(self, raw: _Plain, at: int, start: int, size: int) -> Iterator[dict]:
        """The record of a member whose length is known: its headers are inflated first, from its first bytes."""
        raw.at = at
        body = raw.peek(min(size, 1 << 16))[start:size]
        inflate = zlib.decompressobj(-15)
        found, used = inflate.decompress(body, HEAD_BYTES), False
        while b"\r\n\r\n" not in found:
            more = inflate.decompress(inflate.unconsumed_tail, HEAD_BYTES) if inflate.unconsumed_tail else b""
            if not more:
                if used or start + len(body) >= size:
                    raise ValueError("a record without an end of its headers")
                used, body = True, raw.peek(size)[start:size]
                inflate = zlib.decompressobj(-15)
                found, more = b"", inflate.decompress(body, HEAD_BYTES)
            found += more
        cut = found.index(b"\r\n\r\n") + 4
        head = parse_headers(found[: cut - 4])
        row = self._described(head)
        if not self._wants(row):
            return
        if not self._needs(row["record_type"]):
            yield self._row(row, head, None)
            return
        raw.at = at
        body = raw.peek(size)[start:size]
        found = zlib.decompress(body[:-8], -15)
        if body[-8:] != struct.pack("<II", zlib.crc32(found), len(found) & 0xFFFFFFFF):
            raise ValueError("a broken member")
        length = int(head["content-length"])
        if len(found) > cut + length + 4:
            raise ValueError("a member with skip lengths and more than one record")
        yield self._row(row, head, found[cut : cut + length])


class WarcWriter(DataSourceArrowWriter):
    """Writes a file for each task, with columns page_id, url, html, refers_to, revisit. A file gets its name only when
    the whole write is committed, so that a lost or repeated task leaves nothing behind."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        name, out = f"{path}/_part-{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    out = out or store.open_output_stream(name, compression=None)
                    out.write(member(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], bool(row["revisit"]))))
        finally:
            if out:
                out.close()
        return Done(name if out else None)

    def commit(self, messages) -> None:
        store, path = file_system(self.path)
        for m in messages:
            if m is not None and m.path:
                store.move(m.path, m.path.replace("/_part-", "/part-"))

    def abort(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").schema(some of SCHEMA).load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Of pages with equal payloads of at least ``min_bytes`` the one with the
    smallest page_id is kept as response. The groups are counted by digest alone, a row a task and digest; the payloads
    move once, and a digest that many pages share is a skewed key of a plain join, which Spark splits at run time."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha2("html", 256)
    firsts = rows.select(key.alias("k"), "page_id").groupBy("k").agg(F.min("page_id").alias("first"))
    joined = rows.withColumn("k", key).join(firsts, "k")
    # a null page_id is a response only where the payload has no other
    revisit = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)
