"""WARC records in ZIP-packaged archives (operator 6).

Writing: equal payloads of at least LEAST bytes are grouped by digest and size with partial aggregation; the largest page_id answers,
the others revisit it. Each task writes its records to archives in the shared folder: gzipped WARC records in a stored member, their
index (JSON lines with offset, length and digest) in another. An archive gets its last name when it is complete and the task's attempt
lists it; lists of failed attempts are dropped by Spark's commit, so a lost executor leaves only unlisted files.

Reading: each archive's end record, ZIP64 locator and end record, and central directory are parsed, the stored members located from their
local headers, and the records range-read by index, in one seek for each READ_BYTES; nothing is extracted to disk.

Paths go through pyarrow's file systems, so the folder may be a local mount or a store that pyarrow knows.

Defined cases: a null html is the empty payload; a null url is written as `urn:page:`; rows that share the largest page_id of a group are all
responses, and in a group without any page_id all are; a null page_id beside others revisits; smaller payloads are all responses; payloads of any length are
one record each; an empty table writes nothing and reads back no rows; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._tables import documents, new_path, shared_folder, written

LEAST = 1000
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 4 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def file_system(uri: str):
    """(file system, path) of a folder or file by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def header_lines(fields: list[tuple[str, object]], first: str) -> bytes:
    return "".join([f"{first}\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit that has the HTTP header alone."""
    http = header_lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{x}>"
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name("" if page_id is None else page_id)),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", (url or "urn:page:").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if revisit:
        fields[5:5] = [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(refers_to))]
    return header_lines(fields, "WARC/1.1") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record's fields and its payload, the digest and lengths verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's block is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its digest")
    number = lambda x: int(x) if x else None
    page = lambda k: number(fields[k].removeprefix("<urn:page:").removesuffix(">")) if k in fields else None
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """A ZIP of stored members, written front to back in one stream; sizes follow their data in ZIP64 descriptors."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.member = {"name": name.encode(), "at": self.at, "crc": 0, "size": 0}
        n = self.member["name"]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 8, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra)) + n + extra)

    def add(self, data: bytes) -> None:
        self.member["crc"] = zlib.crc32(data, self.member["crc"])
        self.member["size"] += len(data)
        self._write(data)

    def end(self) -> None:
        m = self.member
        self._write(struct.pack("<4sIQQ", b"PK\7\x08", m["crc"], m["size"], m["size"]))
        self.members.append(m)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["at"])
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 8, 0, 0, 0x21, m["crc"], 0xFFFFFFFF, 0xFFFFFFFF, len(m["name"]), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + m["name"] + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n if n < 0xFFFF else 0xFFFF, n if n < 0xFFFF else 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        self.out.close()


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of the ZIP in a random-access file: name to (first byte of the data, length, CRC). Reads its end and its directory alone."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    _, count, length, start, _ = struct.unpack("<HHIIH", tail[end + 8 : end + 22])
    if tail[end - 20 : end - 16] == b"PK\6\7":
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        record = read(at, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    entries, found, p = read(start, length), {}, 0
    for _ in range(count):
        if entries[p : p + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method, _, _, crc, packed, plain, n, m, k = struct.unpack("<HHHIIIHHH", entries[p + 10 : p + 34])
        (at,) = struct.unpack("<I", entries[p + 42 : p + 46])
        name, extra = entries[p + 46 : p + 46 + n].decode(), entries[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            tag, size_of = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{size_of // 8}Q", extra[4 : 4 + size_of // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                at = wide.pop(0) if at == 0xFFFFFFFF else at
            extra = extra[4 + size_of :]
        if method:
            raise ValueError(f"{name} is not stored")
        local = read(at, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        found[name] = (at + 30 + sum(struct.unpack("<HH", local[26:30])), packed, crc)
        p += 46 + n + m + k
    return found


def _archives(folder: str, least_bytes: int):
    """Writes the rows (page_id, url, html, digest, revisit, refers_to) of a task to archives; yields their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        writer, made = None, []

        def finish() -> None:
            writer.end()
            writer.begin(INDEX)
            writer.add("".join(index).encode())
            writer.end()
            writer.close()
            store.move(f"{name}.part", name)
            made.append((name, len(index), writer.at))

        for batch in batches:
            for page_id, url, html, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name, index = f"{top}/{uuid.uuid4().hex}.zip", []
                    writer = ArchiveWriter(store.open_output_stream(f"{name}.part"))
                    writer.begin(RECORDS)
                record = gzip.compress(make_record(page_id, url, html.encode(), digest, revisit, refers_to), 3, mtime=0)
                index.append(json.dumps({"page_id": page_id, "offset": writer.member["size"], "length": len(record), "digest": digest}) + "\n")
                writer.add(record)
                if writer.at >= least_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' records to archives in the folder; returns the list of archives."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), (F.octet_length(body) >= least).alias("_large"))
    shown = rows.select("page_id", "digest", "_large")
    groups = shown.filter("_large").groupBy(F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last")).filter("_n > 1 AND _last IS NOT NULL")
    groups = written(groups, "warc-groups")  # a plain shuffle on both sides of the join, which adaptive execution can split
    joined = rows.join(groups, F.col("_large") & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    records = joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))
    return written(records.mapInArrow(_archives(folder, archive_bytes), MANIFEST), "warc-manifest")


def _records(scheme: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, kinds, strict=True)], names)

        store, _ = file_system(scheme)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    members = directory(f, f.size())
                    at, length, crc = members[INDEX]
                    f.seek(at)
                    raw = f.read(length)
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"{path}: the index is damaged")
                    entries, base, i = [json.loads(x) for x in raw.decode().splitlines()], members[RECORDS][0], 0
                    while i < len(entries):
                        j, first = i + 1, entries[i]["offset"]
                        while j < len(entries) and entries[j]["offset"] + entries[j]["length"] - first <= READ_BYTES:
                            j += 1
                        f.seek(base + first)
                        data = f.read(entries[j - 1]["offset"] + entries[j - 1]["length"] - first)
                        found = [parse_record(gzip.decompress(data[e["offset"] - first : e["offset"] - first + e["length"]])) for e in entries[i:j]]
                        yield batch_of(found if payloads else [x | {"payload": None} for x in found])
                        i = j

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the listed archives, one archive to a task at a time."""
    folder, paths = shared_folder(manifest.sparkSession), manifest.select("path")
    n = max(1, min(4096, paths.count()))
    return paths.repartition(n).mapInArrow(_records(folder, payloads), RECORD)


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(documents(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) AS last FROM d),
r AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r
"""
