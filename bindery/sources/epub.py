"""EPUB archives: entries, package facts, covers and encryption, read from binary columns with the standard library.

`inspect` gives, per file, the facts that scoring reads.  One archive is one row of
work, bounded by LIMITS; nothing of it is kept beyond the batch.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Limits of an archive (fixed values): entries, bytes in all, bytes an entry, ratios, nodes and depth of a page.
LIMITS = {"entries": 10_000, "total": 512 << 20, "entry": 64 << 20, "ratio": 200, "ratio_from": 1 << 20, "all_ratio": 100, "all_from": 10 << 20, "nodes": 25_000, "depth": 256, "spine": 5_000}
#: Encryption that only hides fonts (fixed values).
FONT_OBFUSCATION = {"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"}
TEXTS = ["problems", "authors", "languages", "dates", "identifiers", "missing_spine", "broken_refs", "remote_refs", "empty_chapters", "repeated_refs"]
FACTS = ", ".join(f"{c} array<string>" for c in TEXTS) + ", title string, date string, strong_identifier string, cover boolean, cover_width int, cover_height int, navigation boolean, spine int, chars long, entries int, encryption string"


class Problem(Exception):
    """What disqualifies a file; the message is the problem's code."""


def resolve(base: str, reference: str) -> str | None:
    """A reference against the folder of an entry, without fragment and query; None when it leaves the archive."""
    path = re.split(r"[?#]", reference, maxsplit=1)[0].replace("\\", "/")
    out = [] if path.startswith("/") else base.split("/")[:-1]
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def open_archive(data: bytes) -> zipfile.ZipFile:
    """The archive, after all limits hold and every name is safe and unique."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error) as e:
        raise Problem("CannotOpen") from e
    infos = archive.infolist()
    if any(i.flag_bits & 1 for i in infos):
        raise Problem("Encrypted")
    total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    swollen = any(i.file_size > LIMITS["ratio_from"] and i.file_size > LIMITS["ratio"] * max(1, i.compress_size) for i in infos)
    if len(infos) > LIMITS["entries"] or total > LIMITS["total"] or any(i.file_size > LIMITS["entry"] for i in infos) or swollen or (total > LIMITS["all_from"] and total > LIMITS["all_ratio"] * max(1, packed)):
        raise Problem("LimitExceeded")
    names = [i.filename for i in infos]
    unsafe = any(n.startswith(("/", "\\")) or ":" in n or ".." in n.replace("\\", "/").split("/") for n in names)
    if unsafe or len({n.lower() for n in names}) != len(names):
        raise Problem("UnsafeArchive")
    return archive


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _xml(data: bytes):
    if b"<!ENTITY" in data:
        raise Problem("PackageMalformed")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Problem("PackageMalformed") from e


class _Page(HTMLParser):
    """Readable characters and references of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.chars, self.depth, self.nodes = 0, 0, 0, 0
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.nodes += 1
        self.depth += 1
        if self.nodes > LIMITS["nodes"] or self.depth > LIMITS["depth"] * 4:
            raise Problem("LimitExceeded")
        self.hidden += tag in ("script", "style", "nav")
        self.found += [v for k, v in attrs if k in ("src", "href", "poster", "xlink:href") and v]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.depth -= 1
        self.hidden -= tag in ("script", "style", "nav") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.chars += sum(c.isalpha() or c.isdecimal() for c in data)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, extended WEBP, baseline or progressive JPEG, or SVG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xC3:
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
        return None
    if m := re.search(rb"<svg\b[^>]*>", data[:4096]):
        sides = [re.search(rb"\b" + s + rb"\s*=\s*[\"']\s*(\d+)", m[0]) for s in (b"width", b"height")]
        return (int(sides[0][1]), int(sides[1][1])) if all(sides) else None
    return None


def encryption(archive: zipfile.ZipFile) -> str:
    if "META-INF/encryption.xml" not in archive.namelist():
        return "None"
    kinds = {e.get("Algorithm", "") for e in _xml(archive.read("META-INF/encryption.xml")).iter() if _local(e.tag) == "encryptionmethod"}
    return "FontObfuscation" if kinds <= FONT_OBFUSCATION else "Encrypted"


def _clipped(values) -> list[str]:
    return sorted({v.strip()[:512] for v in values if v and v.strip()})[:100]


def _is_isbn(value: str) -> bool:
    digits = re.sub("[^0-9X]", "", value.upper())
    if re.fullmatch("[0-9X]{10}", digits):
        return sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(digits)) % 11 == 0
    return bool(re.fullmatch("[0-9]{13}", digits)) and sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(digits)) % 10 == 0


def inspect_archive(data: bytes) -> dict:
    """FACTS of one EPUB file; a problem empties the rest."""
    empty = {c: [] for c in TEXTS} | {"title": None, "date": None, "strong_identifier": None, "cover": False, "cover_width": None, "cover_height": None, "navigation": False, "spine": 0, "chars": 0, "entries": 0, "encryption": "None"}
    try:
        with open_archive(data) as archive:
            return empty | _inspect(archive)
    except Problem as e:
        return empty | {"problems": [str(e)]}
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, NotImplementedError, zipfile.zlib.error):
        return empty | {"problems": ["Unreadable"]}


def _inspect(archive: zipfile.ZipFile) -> dict:
    state = encryption(archive)
    if state == "Encrypted":
        raise Problem("Encrypted")
    names = set(archive.namelist())
    if "META-INF/container.xml" not in names:
        raise Problem("PackageMalformed")
    root = next((e.get("full-path") for e in _xml(archive.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile"), None)
    if not root or root not in names:
        raise Problem("PackageMalformed")
    package = _xml(archive.read(root))
    values: dict[str, list[str]] = {}
    manifest, spine, cover_id = {}, [], None
    for e in package.iter():
        tag = _local(e.tag)
        if tag == "item":
            manifest[e.get("id", "")] = (resolve(root, e.get("href", "")), e.get("media-type", ""), (e.get("properties") or "").split())
        elif tag == "itemref":
            spine.append(e.get("idref", ""))
        elif tag == "meta" and e.get("name") == "cover":
            cover_id = e.get("content")
        elif tag in ("title", "creator", "language", "date", "identifier"):
            values.setdefault(tag, []).append("".join(e.itertext()))
    if len(spine) > LIMITS["spine"]:
        raise Problem("LimitExceeded")
    missing, empty, broken, remote, repeated, chars, seen = [], [], [], [], [], 0, {}
    for number, idref in enumerate(spine):
        seen[idref] = seen.get(idref, 0) + 1
        if seen[idref] > 1:
            repeated.append(f"spine:{idref}#{seen[idref]}")
            continue
        path = manifest.get(idref, (None, "", []))[0]
        if path is None or path not in names:
            missing.append(idref or f"#{number}")
            continue
        page = _Page()
        page.feed(archive.read(path).decode("utf-8", "replace"))
        chars += page.chars
        if page.chars < 100:
            empty.append(path)
        for reference in page.found:
            if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#:]*))?", reference):
                remote.append(f"scheme:{m[1].lower()};host:{(m[2] or '').lower()}")
            elif not reference.startswith("#") and resolve(path, reference) not in names:
                broken.append(f"{path}>{reference}"[:512])
    cover = next((m for m in manifest.values() if "cover-image" in m[2]), manifest.get(cover_id))
    has_cover = cover is not None and cover[0] in names
    size = image_size(archive.read(cover[0])) if has_cover else None
    if has_cover and size is None:
        size = (0, 0)  # a header that cannot be read
    identifiers = _clipped(values.get("identifier", []))
    return {
        "authors": _clipped(values.get("creator", [])), "languages": _clipped(values.get("language", [])), "dates": _clipped(values.get("date", [])), "identifiers": identifiers, "missing_spine": sorted(missing), "broken_refs": sorted(set(broken)), "remote_refs": sorted(set(remote)),
        "empty_chapters": sorted(empty), "repeated_refs": sorted(repeated), "title": next(iter(_clipped(values.get("title", []))), None), "date": next(iter(_clipped(values.get("date", []))), None), "strong_identifier": next((i for i in identifiers if _is_isbn(i)), None), "cover": has_cover,
        "cover_width": size[0] if size else None, "cover_height": size[1] if size else None, "navigation": any("nav" in m[2] for m in manifest.values()) or any(m[1] == "application/x-dtbncx+xml" and m[0] in names for m in manifest.values()), "spine": len(spine), "chars": chars, "entries": len(names), "encryption": state,
    }


def _arrow_schema(key: pa.DataType) -> pa.Schema:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([("key", key)] + [(n, kinds[k]) for n, k in (f.split() for f in FACTS.split(", "))])


def inspect(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, FACTS) of files, such as spark.read.format("binaryFile"); a null content is Unreadable."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = _arrow_schema(part.schema.field("key").type)
            for k, data in zip(part["key"].to_pylist(), part["content"], strict=True):
                yield pa.RecordBatch.from_pylist([{"key": k} | inspect_archive(data.as_py() or b"")], schema)

    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {FACTS}").withColumnRenamed("key", key)


def summary(facts: DataFrame, key: str = "path", most: int = 100, cut: int = 512) -> DataFrame:
    """(key, ...): the bounded copy of an inspection that an assessment keeps; lists end at `most` values of `cut` characters.

    `opened` and `parsed` are false where a problem stopped the inspection before; counts are of the whole file.
    """
    short = lambda c: F.transform(F.slice(c, 1, most), lambda v: F.substring(v, 1, cut))
    stopped = lambda *codes: F.arrays_overlap("problems", F.array(*map(F.lit, codes)))
    opened = ~stopped("CannotOpen", "Unreadable", "UnsafeArchive", "ChangedDuringInspection")
    return facts.select(
        key, opened.alias("opened"), (opened & (F.size("problems") == 0)).alias("parsed"), F.substring("title", 1, cut).alias("title"), *[short(c).alias(c) for c in ("authors", "languages", "dates", "identifiers")], "strong_identifier", "cover", "cover_width", "cover_height", "navigation",
        F.col("spine").alias("spine_items"), F.col("entries").alias("local_resources"), F.size("missing_spine").alias("missing_spine_items"), F.size("empty_chapters").alias("empty_chapters"), F.size("broken_refs").alias("broken_references"), F.col("chars").alias("readable_characters"), "encryption",
    )


def entries(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, name, size, packed, encrypted): the entries of each archive; what is no archive has none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema([("key", part.schema.field("key").type), ("name", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("encrypted", pa.bool_())])
            for k, data in zip(part["key"].to_pylist(), part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py() or b"")) as archive:
                        rows = [{"key": k, "name": i.filename, "size": i.file_size, "packed": i.compress_size, "encrypted": bool(i.flag_bits & 1)} for i in archive.infolist()]
                except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error):
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, name string, size long, packed long, encrypted boolean").withColumnRenamed("key", key)
