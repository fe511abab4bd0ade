"""WARC records packed in ZIP archives, written and range-read in place.

Each archive is a ZIP with two stored members: ``data.warc.gz``, one gzip member per
record, and ``index.cdxj`` with every record's offset and length inside it. The reader
takes the end of the archive, follows the end-of-central-directory records (the ZIP64
ones where sizes call for them), finds the stored members through the central
directory, reads the index, and fetches each record by one range read; nothing is
extracted. Archives lie in a folder that all executors share, on any file system that
pyarrow can open. A task's archives have names of their own, so a task that runs again
writes others; only those that a finished task reports are read.

Records with equal payloads: that with the smallest page_id is the response, the others
are revisits without payload that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, map_batches, shared_dir

DATA, INDEX = "data.warc.gz", "index.cdxj"
#: An archive is closed when its records have so many bytes.
ARCHIVE_BYTES = 16 << 20
#: Records whose places are this close are fetched by one range read of at most READ_BYTES.
READ_BYTES = 1 << 20
_M32, _M16 = 0xFFFFFFFF, 0xFFFF


# ------------------------------------------------------------------------ records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{_plain(page_id)}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{_plain(refers_to)}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _plain(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def _page(field: str | None) -> int | None:
    number = (field or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """Header fields (lower-case names), ``length`` and ``payload`` of the HTTP message."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"fields": fields, "length": int(lengths[0]) if lengths else len(payload), "payload": payload}


# ----------------------------------------------------------------------- archives


class ZipWriter:
    """Stored members one after the other, then a central directory. With ``zip64`` all
    sizes and offsets go to ZIP64 fields, as they must beyond 4 GB."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        start, crc, n = self.at, zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, n, n) if self.zip64 else b""
        size = _M32 if self.zip64 else n
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, size, size, len(name.encode()), len(extra)) + name.encode() + extra)
        self._write(data)
        self.members.append((name.encode(), crc, n, start))

    def close(self) -> None:
        start = self.at
        for name, crc, n, offset in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, n, n, offset) if self.zip64 else b""
            size, place = (_M32, _M32) if self.zip64 else (n, offset)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, size, size, len(name), len(extra), 0, 0, 0, 0, place) + name + extra)
        n, size = len(self.members), self.at - start
        if self.zip64:
            end = self.at
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            n, size, start = _M16, _M32, _M32
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


class ZipReader:
    """Members of an archive that can be read by ranges; ``read(offset, n)`` gives bytes."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - 65535 - 20)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP archive")
        n, n_bytes, start = struct.unpack_from("<HII", tail, end + 10)
        if (n == _M16 or n_bytes == _M32 or start == _M32) and end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            at = struct.unpack_from("<Q", tail, end - 12)[0]
            n, n_bytes, start = struct.unpack_from("<QQQ", read(at, 56), 32)
        self.members = self._directory(read(start, n_bytes), n)

    @staticmethod
    def _directory(data: bytes, n: int) -> dict[str, tuple[int, int, int]]:
        """Name to (method, size, offset of the local header)."""
        out, at = {}, 0
        for _ in range(n):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, _, _, _, packed, size, n_name, n_extra, n_note = struct.unpack_from("<HHHIIIHHH", data, at + 10)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name, extra = data[at + 46 : at + 46 + n_name], data[at + 46 + n_name : at + 46 + n_name + n_extra]
            i = 0
            while i + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, i)
                if tag == 1:  # 64-bit values of the fields that are full, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, i + 4))
                    size = next(values) if size == _M32 else size
                    packed = next(values) if packed == _M32 else packed
                    offset = next(values) if offset == _M32 else offset
                i += 4 + length
            out[name.decode()] = (method, packed, offset)
            at += 46 + n_name + n_extra + n_note
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Place and size of a stored member's bytes in the archive."""
        method, size, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        n_name, n_extra = struct.unpack_from("<HH", self.read(offset, 30), 26)
        return offset + 30 + n_name + n_extra, size


def read_archive(path: str, fs=None) -> Iterator[bytes]:
    """Every record of an archive, in the order of its index."""
    if fs is None:
        fs, path = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(path) as f:
        read = lambda at, n: f.read_at(n, at)
        archive = ZipReader(read, f.size())
        start, size = archive.locate(INDEX)
        places = [json.loads(line.split(b" ", 2)[2]) for line in read(start, size).splitlines()]
        base, _ = archive.locate(DATA)
        i = 0
        while i < len(places):
            j, at, end = i, int(places[i]["offset"]), int(places[i]["offset"])
            while j < len(places) and int(places[j]["offset"]) == end and (j == i or end + int(places[j]["length"]) - at <= READ_BYTES):
                end += int(places[j]["length"])
                j += 1
            data = read(base + at, end - at)
            for p in places[i:j]:
                a = int(p["offset"]) - at
                yield zlib.decompress(data[a : a + int(p["length"])], 31)
            i = j


# -------------------------------------------------------------------------- Spark

#: Digests of several records that are broadcast at most (about 100 bytes each); more are joined
#: by a shuffle, where the rows of a digest are dealt to so many parts.
BROADCAST_DIGESTS, DIGEST_PARTS = 100_000, 32
#: Archives that a task reads.
ARCHIVES_EACH = 4


def _with_first(rows: DataFrame) -> DataFrame:
    """``rows (page_id, url, payload)`` with ``first``, the smallest page_id of an equal
    payload. Only digests are grouped, and only those of several records are joined, so
    payloads stay where they are, or are spread evenly, however many are equal."""
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    several = cut(rows.groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("least")).where("n > 1").select("sha1", "least"))
    if several.count() <= BROADCAST_DIGESTS:
        met = rows.join(F.broadcast(several), "sha1", "left")
    else:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(DIGEST_PARTS)).cast("int"))
        met = dealt.join(several.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DIGEST_PARTS - 1)))), ["sha1", "part"], "left")
    return met.select("page_id", "url", "payload", F.coalesce("least", "page_id").alias("first"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the archives
    ``(path, n_records)``, already written. A null html has an empty payload."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        data, index, at, n = [], [], 0, 0

        def close():
            name = f"{base}/{uuid.uuid4().hex}.warc.zip"
            with fs.open_output_stream(name) as f:
                out = ZipWriter(f)
                out.add(DATA, b"".join(data))
                out.add(INDEX, b"".join(index))
                out.close()
            return {"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_records": [n]}

        for batch in batches:
            for page_id, url, payload, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")]):
                kind = "response" if page_id == first or first is None else "revisit"
                z = zlib.compressobj(6, wbits=31)
                member = z.compress(record(page_id, url, payload, kind, first)) + z.flush()
                index.append(f"{_plain(page_id) or '-'} 19700101000000 {json.dumps({'offset': str(at), 'length': str(len(member)), 'filename': DATA})}\n".encode())
                data.append(member)
                at, n = at + len(member), n + 1
                if at >= ARCHIVE_BYTES:
                    yield close()
                    data, index, at, n = [], [], 0, 0
        if n:
            yield close()

    return cut(map_batches(_with_first(rows), write, "path string, n_records long"))


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads the records back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` and, if wanted, ``payload``. A response's length and digest are those of
    the bytes read; a revisit's those its record states."""

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for data in read_archive(path):
                    r = parse_record(data)
                    f, kind = r["fields"], r["fields"]["warc-type"]
                    whole = kind == "response"
                    rows.append((_page(f["warc-record-id"]), len(r["payload"]) if whole else r["length"], digest(r["payload"]) if whole else f["warc-payload-digest"].removeprefix("sha1:"), kind, _page(f.get("warc-refers-to")) if not whole else None, r["payload"] if payloads else None))
                    if len(rows) == 1000:
                        yield dict(zip(names, zip(*rows)))
                        rows = []
                if rows:
                    yield dict(zip(names, zip(*rows)))

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism, archives.count() // ARCHIVES_EACH)
    paths = archives.select("path").repartition(tasks)
    return map_batches(paths, read, schema).select(*(names if payloads else names[:-1]))


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per page, from records written and read back. Of pages with equal payloads
    the smallest page_id is the response; rows that repeat it are responses too. A null
    page_id is a revisit of the smallest page_id of its payload, or a response without
    one. Empty and null html are payloads of 0 bytes."""
    return read_archives(write_archives(pages))
