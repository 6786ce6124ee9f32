"""WARC records in ZIP packages: written by tasks, found through the ZIP directory, range-read in place.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (each record
its own gzip stream) and ``indexes/index.cdxj`` (a line with offset and length for each record). A reader
takes the end of the file, the central directory (ZIP64 where needed) and the index, and then reads
just the bytes of the records it wants.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm.storage import new_file, opened, reading_tasks, shared_folder
from fathomline.session import settle

# Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
# Bytes of records in one package, and in one range read.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
# Parts that the rows of one payload are dealt into.
SALTS = 16

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"


def assign_records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every page.

    Of equal payloads of at least ``least_shared`` bytes the largest page_id is the response (all rows with
    that id are), the others revisit it; rows without a page_id revisit it too, and are responses where none
    has an id. Smaller payloads are always responses. The groups are counted before the pages are joined
    to them, and the rows of a payload meet its group in ``SALTS`` parts.
    """
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    told = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"),
    ).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    shared = (
        told.where(F.col("payload_bytes") >= least_shared).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1 and winner is not null")
        .select("payload_digest", "payload_bytes", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = told.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shared, ["payload_digest", "payload_bytes", "salt"], "left")
    revisit = F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"),
    )


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    digits = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def write_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; it names its response and the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> dict:
    """Fields and payload of one uncompressed record; a payload that does not fit its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
    return {
        "page_id": _page_of(fields["warc-record-id"]), "record_type": kind, "payload": payload,
        "payload_bytes": len(payload) if kind == "response" else int(fields["x-payload-length"]), "payload_digest": digest,
        "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


class _Package:
    """A package being written: records go straight to the stream, index lines are kept until the end."""

    def __init__(self, folder: str) -> None:
        self.path, self.stream = new_file(folder, ".wacz")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, record: bytes, url: str | None, digest: str) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        key = quote(url or "", safe=":/?#=&.-_") or "-"
        self.lines.append(f"{key} 20240101000000 " + json.dumps({"digest": f"sha1:{digest}", "filename": "data.warc.gz", "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.size


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """path, records and bytes of the packages written under ``folder``; each task writes its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for b in batches:
            for at in range(0, len(b), 64):
                for r in b.slice(at, 64).to_pylist():
                    if package is None or package.size >= package_bytes:
                        if package:
                            done.append(package.close())
                        package = _Package(folder)
                    record = write_record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                    package.add(record, r["url"], r["payload_digest"])
        if package:
            done.append(package.close())
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return settle(records.mapInArrow(run, "path string, records long, bytes long"))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    start: int  # of its data within the package


_EOCD, _LOCATOR, _EOCD64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"


def members(file) -> list[Member]:
    """Members of a ZIP file from its central directory; only the directory and the local headers are read."""
    size = file.size()
    tail_at = max(0, size - 65557 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(_EOCD)
    if at < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[at + 10:at + 20])
    locator = at - 20
    if locator >= 0 and tail[locator:locator + 4] == _LOCATOR:
        where = struct.unpack("<Q", tail[locator + 8:locator + 16])[0]
        big = file.read_at(56, where)
        if big[:4] != _EOCD64:
            raise ValueError("the ZIP64 directory is not where its locator says")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    directory = file.read_at(length, start)
    out, p = [], 0
    for _ in range(count):
        if directory[p:p + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        method, = struct.unpack("<H", directory[p + 10:p + 12])
        packed, full, n, m, k = struct.unpack("<IIHHH", directory[p + 20:p + 34])
        offset, = struct.unpack("<I", directory[p + 42:p + 46])
        name = directory[p + 46:p + 46 + n].decode()
        extra = directory[p + 46 + n:p + 46 + n + m]
        e = 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[e:e + 4])
            if tag == 1:  # ZIP64: just the values that did not fit, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[e + 4:e + 4 + width // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            e += 4 + width
        local = file.read_at(30, offset)
        if local[:4] != _LOCAL:
            raise ValueError(f"no member begins at {offset}")
        a, b = struct.unpack("<HH", local[26:30])
        out.append(Member(name, method, packed, offset + 30 + a + b))
        p += 46 + n + m + k
    return out


def stored(found: list[Member], name: str) -> Member:
    member = next((m for m in found if m.name == name), None)
    if member is None:
        raise ValueError(f"the package has no {name}")
    if member.method:
        raise ValueError(f"{name} is compressed, so it cannot be read in ranges")
    return member


RANGES = "path string, start long, ends array<long>"


def find_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start and ends: runs of neighbouring records, from the indexes of the packages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                system, inner = opened(path)
                rows: list[tuple[str, int, list[int]]] = []
                with system.open_input_file(inner) as file:
                    found = members(file)
                    index, base = stored(found, INDEX), stored(found, ARCHIVE).start
                    lines = file.read_at(index.size, index.start).decode().split("\n") if index.size else []
                spans = sorted((x["offset"], x["length"]) for x in (json.loads(line.split(" ", 2)[2]) for line in lines))
                for offset, length in spans:
                    end = base + offset + length
                    if rows and rows[-1][2][-1] == base + offset and end - rows[-1][1] <= range_bytes:
                        rows[-1][2].append(end)
                    else:
                        rows.append((path, base + offset, [end]))
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["path", "start", "ends"]
                )

    return packages.select("path").mapInArrow(run, RANGES)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def read_packages(packages: DataFrame, *, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the packages (a column ``path``); payload is null where ``payloads`` is off.

    Ranges of all packages are dealt out anew, so that one large package keeps many tasks busy. Packages
    with compressed members or without an index are an error.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, inner = opened(r["path"])
                with system.open_input_file(inner) as file:
                    data = file.read_at(r["ends"][-1] - r["start"], r["start"])
                rows, at = [], 0
                for end in r["ends"]:
                    rows.append(read_record(gzip.decompress(data[at:end - r["start"]])))
                    at = end - r["start"]
                columns = [[None] * len(rows) if n == "payload" and not payloads else [x[n] for x in rows] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

    # The rows of ranges are tiny and the work on them is not, so the number of tasks is given, not left to sizes of rows.
    ranges = settle(find_ranges(packages, range_bytes))
    return ranges.repartition(reading_tasks(ranges), "path", "start").mapInArrow(run, RECORDS)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to packages in the shared folder and read every record back, without payloads.

    A null html is an empty payload, a null url an empty one; repeated rows are repeated records; an empty
    table writes none; extra columns are ignored.
    """
    packages = write_packages(assign_records(pages), shared_folder(spark, "packages"))
    return read_packages(packages, payloads=False).drop("payload")
