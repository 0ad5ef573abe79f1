"""WARC records in ZIP-packaged archives: written by tasks, read again by byte ranges.

An archive is a ZIP file of stored (uncompressed) members: record files, in which
every record is a gzip member of its own, and one index with a line per record. The
reader parses the end of the file, its ZIP64 parts and the central directory, reads
the index, and then only the ranges it wants; nothing is extracted. Files are reached
through ``pyarrow.fs`` by URI, so every executor can read what another has written,
as long as the folder is shared.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.plans.materialize import materialize, shared_folder

#: An archive, and a record file in it, is closed once it has so many bytes; an index stays in a task's memory.
ARCHIVE_BYTES, MEMBER_BYTES = 256 << 20, 64 << 20
#: Records in neighbouring ranges that are read at once.
READ_BYTES = 4 << 20
#: Index lines in a unit of reading, and bytes of records that a task reads.
UNIT_RECORDS, TASK_BYTES = 2_000, 8 << 20
WARC_DATE = "2020-01-01T00:00:00Z"
INDEX = "indexes/index.cdxj"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(record: str | None) -> str | None:
    """The page of a record id; ids that this module has not made stay as they are."""
    if record and record.startswith("<urn:page:"):
        return record[len("<urn:page:") : -1] or None
    return record.strip("<>") or None if record else None


def sort_key(url: str) -> str:
    """The address with its host turned round, as indexes are sorted: ``org,example)/path``."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        host = ""
    key = f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower() if host else url
    return "".join(quote(c) if c.isspace() else c for c in key) or "-"


def index_line(record: bytes, member: str, offset: int, length: int) -> str:
    """A CDXJ line: sort key, time, and a JSON object that says where the record is."""
    warc, http, _ = parse_record(record)
    entry = {
        "url": warc.get("warc-target-uri", ""), "mime": http.get("content-type", "").partition(";")[0] or "warc/revisit",
        "status": "200", "digest": warc.get("warc-payload-digest", ""), "length": str(length), "offset": str(offset),
        "filename": member.rpartition("/")[2],
    }
    time = "".join(c for c in warc.get("warc-date", "") if c.isdigit())[:14]
    return f"{sort_key(entry['url'])} {time} {json.dumps(entry, separators=(',', ':'))}"


def read_index(raw: bytes) -> list[tuple[str, int, int]]:
    """``(file name, offset, length)`` of every line of a CDXJ index, plain or gzipped, in the order of the records."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    out = []
    for line in raw.decode("utf-8").splitlines():
        brace = line.find("{")
        if brace >= 0 and not line.startswith("!"):
            entry = json.loads(line[brace:])
            out.append((entry["filename"], int(entry["offset"]), int(entry["length"])))
    return sorted(out)


def make_record(page: object, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: object) -> bytes:
    """A response with its payload, or a revisit of the record of page ``refers_to`` (``payload`` is None)."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + f"Content-Length: {size}\r\n\r\n".encode() + (payload or b"")
    uri = "".join(c for c in url or "" if c not in "\r\n")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Target-URI", uri),
        ("WARC-Date", WARC_DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; names in lower case."""

    def headers(part: bytes) -> dict[str, str]:
        lines = part.decode("utf-8").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if x)}

    top, _, rest = raw.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = headers(top)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


class ArchiveWriter:
    """Writes records into one ZIP archive, member by member, without seeking."""

    def __init__(self, target: BinaryIO) -> None:
        self.target = target
        self.zip = zipfile.ZipFile(target, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.members, self.at, self.bytes = None, 0, 0, 0
        self.index: list[str] = []

    def add(self, page: object, record: bytes) -> None:
        data = gzip.compress(record, 6, mtime=0)
        if self.member is None or self.at >= MEMBER_BYTES:
            self._close_member()
            self.name = f"archive/records-{self.members:05d}.warc.gz"
            self.member = self.zip.open(zipfile.ZipInfo(self.name), "w", force_zip64=True)
            self.members, self.at = self.members + 1, 0
        self.member.write(data)
        self.index.append(index_line(record, self.name, self.at, len(data)))
        self.at += len(data)
        self.bytes += len(data)

    def _close_member(self) -> None:
        if self.member is not None:
            self.member.close()
            self.member = None

    def close(self) -> None:
        self._close_member()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in sorted(self.index):
                index.write(line.encode() + b"\n")
        with self.zip.open(zipfile.ZipInfo("datapackage.json"), "w") as package:
            package.write(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": INDEX}]}).encode())
        self.zip.close()
        self.target.close()


@dataclass
class Member:
    name: str
    method: int
    header_at: int
    size: int


def read_directory(file: pa.NativeFile, size: int) -> list[Member]:
    """The members of a ZIP file from its central directory; ZIP64 fields are followed where a field is full."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator_at = tail_at + end - 20
        locator = file.read_at(20, locator_at)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = file.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, at, members = file.read_at(length, start), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, name_len, extra_len, note_len = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (header_at,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + name_len].decode("utf-8")
        extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: only the fields that are full, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header_at = next(values) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + width :]
        members.append(Member(name, method, header_at, packed))
        at += 46 + name_len + extra_len + note_len
    return members


def data_start(file: pa.NativeFile, member: Member) -> int:
    """Where a member's bytes begin, behind its local header."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is not stored")
    header = file.read_at(30, member.header_at)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name_len, extra_len = struct.unpack("<HH", header[26:30])
    return member.header_at + 30 + name_len + extra_len


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        writer, name, done = None, "", []

        def close() -> None:
            nonlocal writer
            if writer is not None:
                done.append((f"{folder}/{name}", len(writer.index)))
                writer.close()
                writer = None

        for batch in batches:
            for page, url, html, refers, leads in zip(*(batch.column(c) for c in ("page", "url", "html", "refers_to", "leads"))):
                if writer is None:
                    # a name of its own for every attempt: the list of archives names those that count
                    name = f"{uuid.uuid4().hex}.wacz"
                    writer = ArchiveWriter(system.open_output_stream(f"{path}/{name}"))
                payload = (html.as_py() or "").encode("utf-8")
                body = payload if leads.as_py() else None
                writer.add(
                    page.as_py(),
                    make_record(page.as_py(), url.as_py(), body, payload_digest(payload), len(payload), refers.as_py()),
                )
                if writer.bytes >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["archive", "records"]
        )

    return run


def decide_records(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page, url, html, refers_to, leads)``: which record of equal payloads is the response that the others revisit.

    The largest page id leads; rows that repeat it are responses too. Null ids
    come last, and if all are null all are responses. Payloads under
    ``least_bytes`` are all responses. Only checksums meet in the grouping; a hot
    payload's rows meet one row of the other side.
    """
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"),
        F.sha1(body).alias("__sha1"), F.octet_length(body).alias("__size"),
    )
    leaders = (
        rows.where(F.col("__size") >= least_bytes)
        .groupBy("__sha1")
        .agg(F.max("page").alias("leader"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("__sha1", "leader")
    )
    leads = F.col("leader").isNull() | F.col("leader").eqNullSafe(F.col("page"))
    return rows.join(leaders, "__sha1", "left").select(
        "page", "url", "html", F.when(~leads, F.col("leader")).alias("refers_to"), leads.alias("leads")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as of ``decide_records``) into archives below ``folder``: ``(archive, records)``, one row each.

    Each task writes its rows as they come and starts a new file at
    ``ARCHIVE_BYTES``. A repeated task writes files of other names; the returned
    list, stored once, names only those of the attempt that was kept.
    """
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return materialize(records.mapInArrow(_write(folder), "archive string, records bigint"))


_INDEXES = (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")


def _list(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            system, path = _open(archive)
            size = system.get_file_info(path).size
            with system.open_input_file(path) as file:
                wanted = ("archive/", "indexes/")
                members = {m.name: m for m in read_directory(file, size) if m.name.startswith(wanted) and m.size}
                starts = {name: data_start(file, m) for name, m in members.items()}
                named = [n for n in members if n.startswith("indexes/") and n.endswith(_INDEXES)]
                lines = [x for n in named for x in read_index(file.read_at(members[n].size, starts[n]))]
            at = {n: starts[n] for n in members} | {n.rpartition("/")[2]: starts[n] for n in members if n.startswith("archive/")}
            for low in range(0, len(lines), 10_000):
                part = lines[low : low + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([archive] * len(part), pa.string()),
                        pa.array([(low + i) // unit for i in range(len(part))], pa.int64()),
                        pa.array([at[name] + offset for name, offset, _ in part], pa.int64()),
                        pa.array([length for *_, length in part], pa.int64()),
                    ],
                    ["archive", "unit", "start", "length"],
                )


_RECORD = T.StructType(
    [
        T.StructField("page", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _parse(raw: bytes, payload: bool) -> tuple:
    warc, http, body = parse_record(raw)
    response, told = warc["warc-type"] == "response", warc.get("warc-payload-digest", "")
    digest = told.removeprefix("sha1:") or (payload_digest(body) if response else None)
    if response and (told.startswith("sha1:") or not told) and payload_digest(body) != digest:
        raise ValueError(f"the payload of {warc['warc-record-id']} has another digest")
    size = http.get("content-length")
    return (
        _page(warc["warc-record-id"]), warc.get("warc-target-uri") or None, warc["warc-type"], digest,
        len(body) if response else int(size) if size else None, _page(warc.get("warc-refers-to")),
        body if response and payload else None,
    )


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        for batch in batches:
            archives = batch.column("archive").to_pylist()
            starts, lengths = (batch.column(c).to_pylist() for c in ("start", "length"))
            i = 0
            while i < len(archives):
                j, stop = i + 1, starts[i] + lengths[i]
                while (  # neighbouring records are read at once
                    j < len(archives) and archives[j] == archives[i] and starts[j] == stop
                    and stop + lengths[j] - starts[i] <= READ_BYTES
                ):
                    stop += lengths[j]
                    j += 1
                if opened != archives[i]:
                    if file is not None:
                        file.close()
                    system, path = _open(archives[i])
                    file, opened = system.open_input_file(path), archives[i]
                data = file.read_at(stop - starts[i], starts[i])
                rows = [
                    _parse(gzip.decompress(data[s - starts[i] : s - starts[i] + n]), payload)
                    for s, n in zip(starts[i:j], lengths[i:j])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column, kind)
                        for column, kind in zip(
                            zip(*rows),
                            [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()],
                        )
                    ],
                    _RECORD.names,
                )
                i = j
        if file is not None:
            file.close()

    return run


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the files in ``archives`` (column ``archive``), with its payload if asked.

    Indexes are CDXJ, plain or gzipped, as any tool writes them; records that no
    index names are not read. The index lines, stored, are dealt out in units to as
    many tasks as the records' bytes ask for, so one large archive is read by many
    tasks; each reads its ranges in order. A response whose payload
    does not have its digest, and a broken archive, stop the query. Null page ids
    and urls stay null (an empty url becomes null).
    """
    ranges = archives.select("archive").mapInArrow(partial(_list, unit=UNIT_RECORDS), "archive string, unit bigint, start bigint, length bigint")
    ranges = materialize(ranges)
    tasks = max(1, -(-(ranges.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = ranges.repartition(tasks, "archive", "unit").sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(_read(payload), _RECORD)


def archive_folder(spark) -> str:
    """A new folder for archives below this application's shared folder."""
    folder = shared_folder(spark)
    return f"{folder if ':' in folder else f'file://{folder}'}/archives-{uuid.uuid4().hex}"
