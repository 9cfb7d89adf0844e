"""WARC records in ZIP-packaged web archives, read by ranges.

``write`` packs rows into archives: ZIP files with two *stored* members, the
records (each its own gzip member, so it can be read alone) and an index with
the offset and length of every record in them. ``read`` never extracts a
member: it reads the end of the file, the central directory (ZIP64 fields and
locator included), the local header and the index, and then only the byte
ranges of records.

Equal payloads of at least ``min_bytes`` bytes are stored once: the record of
the least key is a response, the others are revisits that refer to it. Keys
that are null come last; of rows with the same key the first one is taken.

Archives are written below the shared folder under a name of their own for
each attempt of a task, and only the names that reach the manifest are read,
so a lost executor or a repeated task leaves at worst an unused file. A task
holds one archive of about ``ARCHIVE_BYTES`` at a time.

Defined results: a null payload is empty; null and odd URLs are written
percent-encoded (null: about:blank); repeated rows are records of their own;
an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ROW

ARCHIVE_BYTES = 16 << 20
TASK_BYTES = 4 << 20  # of archives that a reading task gets
SMALL = 200_000  # rows of digests or of row numbers that are broadcast: below 20 MB
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
BIG32, BIG16 = 0xFFFFFFFF, 0xFFFF


def filesystem(uri: str):
    """(pyarrow file system, path) of a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# --- ZIP ---------------------------------------------------------------------


def _extra64(*values: int) -> bytes:
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """Parts of a ZIP file of stored members; ZIP64 fields where needed or asked for."""
    at, directory = 0, b""
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= BIG32
        extra = _extra64(size, size) if wide else b""
        short = BIG32 if wide else size
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra
        far = zip64 or at >= BIG32
        extra = _extra64(*([size, size] if wide else []), *([at] if far else []))
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide or far else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, BIG32 if far else at) + raw + extra
        yield head
        yield data
        at += len(head) + size
    n, size = len(members), len(directory)
    yield directory
    if zip64 or at >= BIG32 or size >= BIG32 or n >= BIG16:
        yield END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at)
        yield LOCATOR64 + struct.pack("<IQI", 0, at + size, 1)
        yield END + struct.pack("<HHHHIIH", 0, 0, BIG16, BIG16, BIG32, BIG32, 0)
    else:
        yield END + struct.pack("<HHHHIIH", 0, 0, n, n, size, at, 0)


def zip_directory(source) -> dict[str, tuple[int, int]]:
    """(begin, length) of the data of each stored member of an open file."""
    length = source.size()
    tail_at = max(0, length - 65_557)
    tail = source.read_at(length - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0 or len(tail) < end + 22:
        raise ValueError("no end of central directory")
    _, _, _, count, size, at, _ = struct.unpack_from("<HHHHIIH", tail, end + 4)
    if BIG16 == count or BIG32 in (size, at):
        signature, _, place, _ = struct.unpack("<4sIQI", source.read_at(20, tail_at + end - 20))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        wide = source.read_at(56, place)
        if wide[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, at = struct.unpack_from("<QQQ", wide, 32)
    directory, place, out = source.read_at(size, at), 0, {}
    for _ in range(count):
        if directory[place : place + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, n, e, c, header = (struct.unpack_from(f, directory, place + o)[0] for f, o in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        name = directory[place + 46 : place + 46 + n].decode()
        extra = directory[place + 46 + n : place + 46 + n + e]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = next(values) if full == BIG32 else full
                packed = next(values) if packed == BIG32 else packed
                header = next(values) if header == BIG32 else header
            extra = extra[4 + width :]
        if method == 0:
            local = source.read_at(30, header)
            if local[:4] != LOCAL:
                raise ValueError("broken local header")
            out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        place += 46 + n + e + c
    return out


# --- WARC --------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: int | None, row: int | None) -> str:
    """Ids may be null or repeat, so the number of the row makes a record's name unique."""
    return f"<urn:quern:page:{'null' if key is None else key}:{row}>"


def _key_of(record_id: str) -> int | None:
    text = record_id.strip("<>").rsplit(":", 2)[1]
    return None if text == "null" else int(text)


def warc_record(key: int | None, row: int, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: tuple[int | None, int] | None) -> bytes:
    """One record: HTTP head and payload of a response, the head of a revisit (no payload)."""
    uri = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else "about:blank"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_record_id(key, row)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_record_id(*refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Fields of one gzip member that holds one record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (digest_of(payload) != told or len(payload) != length):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "key": _key_of(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": told,
        "record_type": fields["warc-type"],
        "refers_to": _key_of(fields["warc-refers-to"]) if revisit else None,
    }


# --- Spark -------------------------------------------------------------------


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, folder: str | None = None, zip64: bool = False) -> DataFrame:
    """Manifest (archive, n_records, n_bytes) of the archives written.

    Payloads are not shuffled unless more than ``SMALL`` rows repeat others: each
    digest is computed once, in the scan, and only digests with the numbers of
    their rows are grouped; the rows that become revisits leave their payload
    behind. A very common payload costs one row for each task that holds it.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    target = folder or common.shared_path(spark, "warc")
    html = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = common.with_row(pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), html.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "bytes": F.length("payload").cast("long")}))
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col(ROW).alias(ROW))
    ids = rows.where(F.col("bytes") >= min_bytes).select("digest", order.alias("o"))
    first = common.checkpoint(ids.groupBy("digest").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    again = rows.where(F.col("bytes") >= min_bytes).select(ROW, "digest").join(common.sized(first, SMALL), "digest").where(F.col("first")[ROW] != F.col(ROW))
    again = common.checkpoint(again.select(ROW, F.struct(F.col("first")["key"].alias("key"), F.col("first")[ROW].alias("row")).alias("refers_to")))
    told = rows.join(common.sized(again, SMALL), ROW, "left").select(ROW, "key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "bytes", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(target)
        fs.create_dir(path, recursive=True)
        body, lines = bytearray(), []

        def pack() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            size = 0
            with fs.open_output_stream(f"{path}/{name}") as out:
                for part in zip_stored([(RECORDS, bytes(body)), (INDEX, ("\n".join(lines) + "\n").encode())], zip64):
                    out.write(part)
                    size += len(part)
            done = pa.RecordBatch.from_pydict({"archive": [f"{target}/{name}"], "n_records": [len(lines)], "n_bytes": [size]}, schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))
            body.clear()
            lines.clear()
            return done

        for batch in batches:
            for r in batch.to_pylist():
                refers_to = r["refers_to"] and (r["refers_to"]["key"], r["refers_to"]["row"])
                digest = base64.b32encode(r["digest"]).decode()
                raw = warc_record(r["key"], r[ROW], r["url"], r["payload"], r["bytes"], digest, refers_to)
                lines.append(f"{digest} 20240101000000 " + json.dumps({"offset": len(body), "length": len(raw)}))
                body.extend(raw)
                if len(body) >= ARCHIVE_BYTES:
                    yield pack()
        if lines:
            yield pack()

    return common.checkpoint(told.mapInArrow(run, "archive string, n_records long, n_bytes long"))


def index(manifest: DataFrame) -> DataFrame:
    """(archive, begin, length) of every record, from the archives' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                fs, path = filesystem(archive)
                with fs.open_input_file(path) as source:
                    members = zip_directory(source)
                    begin, length = members[INDEX]
                    lines = [json.loads(x.split(" ", 2)[2]) for x in source.read_at(length, begin).decode().splitlines()]
                base = members[RECORDS][0]
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(lines)), pa.array([base + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], names=["archive", "begin", "length"])

    return manifest.select("archive").mapInArrow(run, "archive string, begin long, length long")


RECORD = "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives, by range reads spread over tasks.

    There is a task for each ``TASK_BYTES`` of the archives, so the number
    grows with them; a task gets neighbouring records in one piece.
    """
    total = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    spread = index(manifest).repartition(max(1, -(-total // TASK_BYTES)), "archive", F.floor(F.col("begin") / (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for r in batch.to_pylist():
                wanted.setdefault(r["archive"], []).append((r["begin"], r["length"]))
            for archive, ranges in wanted.items():
                fs, path = filesystem(archive)
                with fs.open_input_file(path) as source:
                    out = [parse_record(source.read_at(n, at)) for at, n in sorted(ranges)]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return spread.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of each row, read back."""
    back = read(write(pages, key))
    return back.select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
