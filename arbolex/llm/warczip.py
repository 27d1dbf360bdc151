"""WARC records inside ZIP archives, written and read back by byte ranges.

Each task packs its records into archives of at most about ``ARCHIVE_BYTES``: a ZIP with two stored members,
``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdx`` (a line of JSON per record with its
place in the other member). The reader finds the end record, follows the ZIP64 locator where there is one, parses the
central directory, locates the two members, and then fetches records by their byte ranges; nothing is extracted.

Archives go to the shared folder under names that no other attempt uses; the written manifest lists those of the
attempts that counted, so a repeated task leaves no record twice.

Defined results. A null payload is empty. Payloads of at least 1000 bytes that are equal are written once, as the
response with the largest page id; the others are revisits that refer to it and carry its length and digest. Rows that
repeat that very id are responses too. Shorter payloads are all responses. A null page id is smaller than any other; a
group without any id has only responses. Columns other than id, url and html are neither read nor touched.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.session import materialize, new_path

LEAST_SHARED, ARCHIVE_BYTES = 1000, 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the ZIP format: signatures of its records.
LOCAL, CENTRAL, END, END64, LOCATOR = (b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE = "2024-01-01T00:00:00Z"


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; ``zip64`` keeps sizes and places in the 64-bit records even where 32 would do."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, raw, crc = len(out), name.encode(), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= FULL32
        size = FULL32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        version = 45 if wide else 20
        out += LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += CENTRAL + struct.pack(
            "<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at
        )
        central += raw + extra
    start, n = len(out), len(members)
    out += central
    if zip64 or n >= FULL16 or start + len(central) >= FULL32:
        at = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), start)
        out += LOCATOR + struct.pack("<IQI", 0, at, 1)
        out += END + struct.pack("<HHHHIIH", FULL16, FULL16, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        out += END + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), start, 0)
    return bytes(out)


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """(method, place of the data, stored size) of each member; ``read(at, n)`` fetches a byte range of the archive."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 in (n,) or FULL32 in (length, start):
        found = tail_at + at - 20
        signature, _, place, _ = struct.unpack("<4sIQI", read(found, 20)) if found >= 0 else (b"", 0, 0, 0)
        if signature == LOCATOR:
            head = read(place, 56)
            if head[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", head, 32)
    table, at, members = read(start, length), 0, {}
    for _ in range(n):
        if table[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, names, extras, comments, place = (
            *struct.unpack_from("<H", table, at + 10), *struct.unpack_from("<IIHHH", table, at + 20), *struct.unpack_from("<I", table, at + 42),
        )
        name = table[at + 46 : at + 46 + names].decode()
        field, end = at + 46 + names, at + 46 + names + extras
        while field + 4 <= end:
            kind, width = struct.unpack_from("<HH", table, field)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", table, field + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                place = next(wide) if place == FULL32 else place
            field += 4 + width
        local = read(place, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no member at the place of {name}")
        skip = sum(struct.unpack_from("<HH", local, 26))
        members[name] = (method, place + 30 + skip, packed)
        at = end + comments
    return members


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds only the HTTP header of the payload it stands for."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page: {json.dumps([page_id, refers_to])}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if not response:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page id, payload bytes, hex digest, type, referred page, payload) of one record.

    Length and digest of a response are those of the payload that was read; if its headers differ, it is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page_id, refers_to = json.loads(fields["X-Page"])
    if fields["WARC-Type"] == "response":
        found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != (length, digest):
            raise ValueError(f"page {page_id}: payload of {found[0]} bytes, SHA-1 {found[1]}; its headers say {length}, {digest}")
        length, digest = found
    return page_id, length, digest, fields["WARC-Type"], refers_to, payload


def planned(pages: DataFrame) -> DataFrame:
    """Each page with its payload, the payload's digest and, for a revisit, the page it refers to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    shared = (
        rows.where(F.length("payload") >= LEAST_SHARED)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha1", "first_id")
    )
    rows = rows.join(shared, "sha1", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Pack the planned rows into archives below ``folder``; (path, bytes, records) of each, from a written manifest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)

        def close(data: bytearray, lines: list[str]) -> pa.RecordBatch:
            archive = zip_stored([(DATA, bytes(data)), (INDEX, "\n".join(lines).encode())])
            name = f"part-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(archive)
            values = ([f"{folder}/{name}"], [len(archive)], [len(lines)])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["path", "bytes", "records"])

        data, lines = bytearray(), []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            for page_id, url, payload, sha1, refers_to in zip(*columns, strict=True):
                refers_to, digest = refers_to.as_py(), sha1.as_py()
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), digest, refers_to is None, refers_to)
                coder = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = coder.compress(raw) + coder.flush()
                lines.append(json.dumps({"offset": len(data), "length": len(packed), "digest": digest}))
                data += packed
                if len(data) >= ARCHIVE_BYTES:
                    yield close(data, lines)
                    data, lines = bytearray(), []
        if lines:
            yield close(data, lines)

    return materialize(rows.mapInArrow(pack, "path string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload) of every record listed."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    members = directory(lambda at, n, f=file: f.read_at(n, at), file.size())
                    if any(members[m][0] for m in (DATA, INDEX)):
                        raise ValueError(f"{path}: only stored members can be read by ranges")
                    _, start, _ = members[DATA]
                    index = file.read_at(members[INDEX][2], members[INDEX][1]).decode()
                    rows = []
                    for place in map(json.loads, index.splitlines()):
                        raw = zlib.decompress(file.read_at(place["length"], start + place["offset"]), 31)
                        rows.append(parse(raw)[: 5 + with_payload])
                        if len(rows) == 500:
                            yield _batch(rows, names, types)
                            rows = []
                    if rows:
                        yield _batch(rows, names, types)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # one archive is one unit of work
    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(fetch, schema + ", payload binary" * with_payload)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def warc_round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write every page as a WARC record into archives in the shared folder and read them back."""
    folder = new_path(pages.sparkSession, "wacz")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(planned(pages), folder), with_payload)
