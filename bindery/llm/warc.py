"""WARC: legacy ARC archives to WARC records and back from archives.

`read_arcs` parses ARC files of version 1 and 2 (the version block names the
fields of the header lines; each record's length is declared on its line) and
synthesises what WARC asks for: record ids, ISO timestamps, record types,
content types and SHA-1 digests.  `mark_revisits` finds equal payloads,
`write_warcs` writes one gzip member per record, `read_warcs` reads them.
Archives are rows (archive, data) of a few MB, as binary columns or from
spark.read.format("binaryFile").
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import dealt_join, piece
from ._store import written

ARCHIVE_BYTES = 4 << 20
BATCH_BYTES = 16 << 20
PIECE_BYTES = 32 << 10
ARCHIVES = "archive string, data binary"
RECORD = "archive string, position long, record_id string, record_type string, uri string, date string, ip string, content_type string, http_head binary, payload binary, payload_bytes long, payload_digest string, key long"
READ = "archive string, record_id string, record_type string, uri string, date string, content_type string, payload binary, payload_bytes long, payload_digest string, block_digest string, key long, refers_to_id string, refers_to long"
#: Field names of the two ARC versions.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY = "X-Record-Key"


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Stream:
    """Bytes of a file from the front, whatever gzip members it has; what was taken is let go, so no whole archive is unpacked."""

    def __init__(self, data: bytes | pa.Buffer):
        self.rest, self.at, self.position = memoryview(data).cast("B"), 0, 0
        self.member = zlib.decompressobj(31) if bytes(self.rest[:2]) == b"\x1f\x8b" else None
        self.ready = bytearray()

    def _more(self) -> bool:
        """Unpack a little more into `ready`; False at the end."""
        if self.at >= len(self.rest):
            return False
        if self.member is None:
            self.ready += self.rest[self.at : self.at + PIECE_BYTES]
            self.at += PIECE_BYTES
            return True
        piece = self.rest[self.at : self.at + PIECE_BYTES]
        self.ready += self.member.decompress(piece, 32 * PIECE_BYTES)
        self.at += len(piece) - len(self.member.unconsumed_tail)
        if self.member.eof:  # the next member, or bytes behind the last one
            self.at -= len(self.member.unused_data)
            self.member = zlib.decompressobj(31)
            if bytes(self.rest[self.at : self.at + 2]) != b"\x1f\x8b":
                self.at = len(self.rest)
        return True

    def _drop(self, n: int) -> bytes:
        out = bytes(self.ready[:n])
        del self.ready[:n]
        self.position += len(out)
        return out

    def skip(self, blanks: bytes) -> bool:
        """Past any of these bytes; False at the end of the file."""
        while True:
            n = 0
            while n < len(self.ready) and self.ready[n] in blanks:
                n += 1
            self._drop(n)
            if self.ready:
                return True
            if not self._more():
                return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next `mark`, which is passed; None where there is no more of it."""
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self._more():
                return None
        out = self._drop(at)
        self._drop(len(mark))
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, or as many as are left."""
        while len(self.ready) < n and self._more():
            pass
        return self._drop(n)


def arc_bytes(name: str, version: str, rows: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An uncompressed ARC file: rows are (url, ip, 14-digit date, content type, content)."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 {'reserved ' if version == '2' else ''}bindery\n{' '.join(fields)}\n".encode()

    def line(url: str, ip: str, date: str, kind: str, size: int, code: str, check: str, offset: int) -> bytes:
        values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Archive-length": str(size), "Result-code": code, "Checksum": check, "Location": "-", "Offset": str(offset), "Filename": name}
        return " ".join(values[f] for f in fields).encode() + b"\n"

    out = [line(f"filedesc://{name}", "0.0.0.0", rows[0][2] if rows else "19960101000000", "text/plain", len(about), "200", "-", 0), about, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, content in rows:
        code = content[9:12].decode("latin-1") if content[:5] == b"HTTP/" else "-"
        head = line(urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") or "-", ip, date, kind, len(content), code, digest(content) if version == "2" else "-", at)
        out += [head, content, b"\n"]
        at += len(head) + len(content) + 1
    return b"".join(out)


def arc_records(data: bytes | pa.Buffer) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, content) of each record after the version block of a file, plain or gzipped.

    A header line is split by the fields that the version block declares.  A line
    that does not fit them, or a declared length beyond the file, ends the archive
    with a ValueError: what follows cannot be found.
    """
    stream, fields = _Stream(data), ARC_FIELDS["1"]
    while stream.skip(b"\r\n"):
        at = stream.position
        found = stream.until(b"\n")
        line = (found or b"").decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc:")
        parts = line.split(" ")
        names = ARC_FIELDS["2"] if first and len(parts) == 10 else ARC_FIELDS["1"] if first else fields
        if len(parts) > len(names):  # blanks in an unescaped URL
            parts = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        if found is None or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at {at}")
        size = int(parts[-1])
        content = stream.take(size)
        if len(content) != size:
            raise ValueError(f"the record at {at} declares {size} bytes, {len(content)} are left")
        if first:
            lines = content.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            fields = lines[1].split() if len(lines) > 1 and lines[1].startswith("URL") else ARC_FIELDS.get(version, names)
        else:
            yield at, dict(zip(names, parts, strict=True)), content


def iso_date(date: str) -> str:
    """A 14-digit (or 12-digit) ARC date as a WARC date; the epoch when it is none."""
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?", date)
    return "{}-{}-{}T{}:{}:{}Z".format(*m.groups(default="00")) if m else "1970-01-01T00:00:00Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and body; content that is no HTTP message has no head."""
    if content[:5] != b"HTTP/":
        return b"", content
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (at := content.find(mark)) >= 0:
            return content[: at + len(mark)], content[at + len(mark) :]
    return content, b""


def _http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def record_from_arc(archive: str, at: int, fields: dict[str, str], content: bytes) -> dict:
    """The WARC view of an ARC record: equal input gives equal ids on any executor."""
    uri, date = fields["URL"], iso_date(fields["Archive-date"])
    head, payload = split_http(content)
    key = _http_field(head, _KEY)
    kind = "response" if head or uri.startswith("dns:") else "resource"
    mime = "application/http; msgtype=response" if head else "text/dns" if uri.startswith("dns:") else fields["Content-type"]
    return {
        "archive": archive, "position": at, "record_id": uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{at}#{uri}#{date}").urn, "record_type": kind, "uri": uri, "date": date, "ip": fields["IP-address"],
        "content_type": mime, "http_head": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest(payload), "key": int(key) if key and re.fullmatch(r"-?\d{1,19}", key) else None,
    }


def _rows(parts: Iterator[pa.RecordBatch], schema: pa.Schema, one, size: int = 256, held_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of all archives, in batches of at most `size` rows and, but for a single larger row, `held_bytes` of payload."""
    held: list[dict] = []
    filled = 0
    for part in parts:
        for archive, data in zip(part["archive"], part["data"], strict=True):
            if data.is_valid:
                for row in one(archive.as_py(), data.as_buffer()):
                    more = len(row["payload"] or b"")
                    if held and (len(held) >= size or filled + more > held_bytes):
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, filled = [], 0
                    held.append(row)
                    filled += more
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def read_arcs(archives: DataFrame) -> DataFrame:
    """RECORD rows of ARC files (archive, data), plain or gzipped.

    Null or empty data has none, so an empty table gives an empty result; equal rows
    are each read; other columns are ignored, whatever their names.  A record is held
    whole (up to 2 GB, Arrow's limit for a value), an archive is not.
    """
    schema = _schema(RECORD)
    one = lambda archive, data: (record_from_arc(archive, *r) for r in arc_records(data))
    return archives.select("archive", "data").mapInArrow(lambda parts: _rows(parts, schema, one), RECORD)


def _name(contents: Iterable[bytes]) -> str:
    total = hashlib.sha1()
    for c in contents:
        total.update(hashlib.sha1(c).digest())
    return total.hexdigest()[:20]


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """ARC files of bounded size, of version 1 and 2 in turn: a page's body as UTF-8 behind an HTTP head that names its id.

    A null body is empty, a null url becomes urn:page:<id>, a null id is left out of the head.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").cast("binary").alias("body"))
    schema = _schema(ARCHIVES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            file = f"{_name(x[-1] for x in held)}.arc"  # by its contents: a task that runs again writes the same
            return pa.RecordBatch.from_pylist([{"archive": file, "data": arc_bytes(file, "12"[number % 2], held)}], schema)

        for part in parts:
            for page, url, body in zip(part["id"].to_pylist(), part["url"].to_pylist(), part["body"], strict=True):
                body = body.as_py() or b""
                own = f"{_KEY}: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode()
                held.append((url if url else f"urn:page:{page}", "0.0.0.0", date, "text/html", head + body))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return rows.mapInArrow(run, ARCHIVES)


def mark_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """`records` with `refers_to` (key, record_id, uri, date), null for a record that keeps its payload.

    Of the records with equal payloads of at least `least` bytes the one with the
    smallest (key, record_id) is kept; rows that repeat that key and payload are
    kept too.  Records without a key come last, by their id.  Equal payloads meet
    as one row per task and digest; the answer goes back by digest, and a payload
    that many records share is dealt to as many tasks as they ask for.  An empty
    table stays empty; other columns are kept, but for names that start with `_`.
    """
    rank = F.struct(F.col("key").isNull().alias("unkeyed"), "key", "record_id", "uri", "date")
    same = ["payload_digest", "payload_bytes"]
    groups = records.where(F.col("payload_bytes") >= least).groupBy(*same).agg(F.min(rank).alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = written(groups, compact=True)
    total = groups.agg(F.sum("_n")).first()[0] or 0
    joined = dealt_join(records, groups.drop("_n"), same, F.col("record_id"), groups.drop("_kept"), piece(total), "left")
    own = (F.col("_kept.record_id") == F.col("record_id")) | F.coalesce(F.col("_kept.key") == F.col("key"), F.lit(False))
    target = F.struct(F.col("_kept.key").alias("key"), F.col("_kept.record_id").alias("record_id"), F.col("_kept.uri").alias("uri"), F.col("_kept.date").alias("date"))
    return joined.withColumn("refers_to", F.when(F.col("_kept").isNotNull() & ~own, target)).drop("_kept")


def warc_record(row: dict) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit holds the HTTP head alone."""
    target = row["refers_to"]
    block = row["http_head"] + (b"" if target else row["payload"])
    head = {"WARC-Type": "revisit" if target else row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": row["date"], "WARC-Target-URI": row["uri"], "WARC-IP-Address": row["ip"], "Content-Type": row["content_type"], "Content-Length": str(len(block)), "WARC-Block-Digest": f"sha1:{digest(block)}", "WARC-Payload-Digest": f"sha1:{row['payload_digest']}"}
    if row["key"] is not None:
        head["X-Record-Key"] = str(row["key"])
    if target:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{target['record_id']}>", "WARC-Refers-To-Target-URI": target["uri"], "WARC-Refers-To-Date": target["date"], "X-Payload-Length": str(row["payload_bytes"])}
        if target["key"] is not None:
            head["X-Refers-To-Key"] = str(target["key"])
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warcs(records: DataFrame, level: int = 3) -> DataFrame:
    """WARC files of bounded size (archive, data), one gzip member per record, of `records` from mark_revisits.

    No records, no files; a record larger than ARCHIVE_BYTES ends its file; other
    columns are ignored, and equal rows are each written.
    """
    schema = _schema(ARCHIVES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for i in range(part.num_rows):
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                held.append(member.compress(warc_record(part.slice(i, 1).to_pylist()[0])) + member.flush())
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist([{"archive": f"{_name(held)}.warc.gz", "data": b"".join(held)}], schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([{"archive": f"{_name(held)}.warc.gz", "data": b"".join(held)}], schema)

    return records.mapInArrow(run, ARCHIVES)


def warc_records(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, plain or gzipped."""
    stream = _Stream(data)
    while stream.skip(b"\r\n"):
        at = stream.position
        found = stream.until(b"\r\n\r\n")
        if found is None or found[:5] != b"WARC/":
            raise ValueError(f"no WARC record at {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in found.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(head["content-length"])
        block = stream.take(size)
        if len(block) != size:
            raise ValueError(f"the record at {at} declares {size} bytes, {len(block)} are left")
        yield head, block


def _read(archive: str, data: bytes | pa.Buffer) -> Iterator[dict]:
    for head, block in warc_records(data):
        kind = head["warc-type"]
        _, payload = split_http(block) if head.get("content-type", "").startswith("application/http") else (b"", block)
        told = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if head.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}" or kind != "revisit" and told not in (None, digest(payload)):
            raise ValueError(f"{archive}: a digest of {head.get('warc-record-id')} does not match")
        link = head.get("warc-refers-to")
        yield {
            "archive": archive, "record_id": head["warc-record-id"].strip("<>"), "record_type": kind, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": head.get("content-type"),
            "payload": None if kind == "revisit" else payload, "payload_bytes": int(head["x-payload-length"]) if kind == "revisit" and "x-payload-length" in head else len(payload), "payload_digest": told or digest(payload), "block_digest": digest(block),
            "key": int(head["x-record-key"]) if "x-record-key" in head else None, "refers_to_id": link.strip("<>") if link else None, "refers_to": int(head["x-refers-to-key"]) if "x-refers-to-key" in head else None,
        }


def read_warcs(archives: DataFrame) -> DataFrame:
    """READ rows of WARC files (archive, data), plain or gzipped; digests are checked, a wrong one is an error.

    Null or empty data has no records, so an empty table gives an empty result; equal
    rows are each read; other columns are ignored, whatever their names.
    """
    schema = _schema(READ)
    return archives.select("archive", "data").mapInArrow(lambda parts: _rows(parts, schema, _read), READ)
