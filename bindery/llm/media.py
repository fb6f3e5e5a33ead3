"""Media columns: ISO base media files, written and indexed without touching sample payloads.

`index_media` walks the nested boxes of a file (32-bit, 64-bit and to-the-end
sizes), decodes the sample tables of each track (stsd, stts, stsc, stsz or
stz2, stco or co64, stss), and those of movie fragments (tfhd, trun, under the
defaults of trex), and returns codec, duration and the byte ranges of the keyframes.  `write_media` stores bytes losslessly as 8-bit samples: frames
of 8 by 8 RGB pixels, 192 bytes each, uncompressed ('raw ').
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._labelled import batches

FRAME = 192
RATE = 25
KEY_EVERY = 16
BATCH_BYTES = 16 << 20
CHUNK_FRAMES = 64
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}
TRACK = "struct<track_id:long,kind:string,codec:string,width:int,height:int,timescale:long,duration:long,seconds:double,samples:long,sample_bytes:long,keyframes:array<struct<sample:long,start:long,length:long>>>"


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
_FTYP = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")


def write_media(payload: bytes) -> bytes:
    """A movie of one raw RGB track holding `payload`, a positive multiple of FRAME bytes."""
    frames, odd = divmod(len(payload), FRAME)
    if odd or not frames:
        raise ValueError("the payload must be a positive multiple of a frame")
    chunks = -(-frames // CHUNK_FRAMES)
    entry = struct.pack(">6xH16xHHIIIH32shH", 1, 8, 8, 72 << 16, 72 << 16, 0, 1, b"", 24, 65535)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != CHUNK_FRAMES)
    keys = range(1, frames + 1, KEY_EVERY)
    wide = len(payload) > (1 << 32) - 4096

    def moov(start: int) -> bytes:
        at = range(start, start + len(payload), CHUNK_FRAMES * FRAME)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, n, 1) for a, n in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *at)) if wide else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *at)),
        )
        handler = _full(b"hdlr", b"\0\0\0\0vide", bytes(12), b"\0")
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), handler, _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table))
        track = _full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, frames, 1 << 16, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    start = len(_FTYP) + len(moov(0)) + len(head)
    return b"".join((_FTYP, moov(start), head, payload))


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end of the content) of the boxes in a range; stops quietly at a box that runs over the end."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> dict:
    """Nested boxes by kind, each a list of (start, end) or, for containers, of dicts."""
    found: dict[bytes, list] = {}
    for kind, lo, hi in walk(data, start, end):
        found.setdefault(kind, []).append(boxes(data, lo, hi) if kind in _NESTED else (lo, hi))
    return found


def _table(data: memoryview, span: tuple[int, int], width: int = 1, kind: str = ">u4", skip: int = 8) -> np.ndarray:
    """Rows of a counted full box: version and flags, count, then rows of `width` numbers."""
    lo, hi = span
    n = min(struct.unpack_from(">I", data, lo + skip - 4)[0], (hi - lo - skip) // (width * np.dtype(kind).itemsize))
    return np.frombuffer(data, kind, n * width, lo + skip).astype(np.int64).reshape(n, width)


def sample_table(data: memoryview, table: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte position and size of every sample, and the numbers (from 0) of its sync samples."""
    if b"stsz" in table:
        lo, hi = table[b"stsz"][0]
        fixed, n = struct.unpack_from(">II", data, lo + 4)
        size = np.full(n, fixed, np.int64) if fixed else _table(data, (lo, hi), skip=12)[:, 0]
    elif b"stz2" in table:
        lo, hi = table[b"stz2"][0]
        bits, n = struct.unpack_from(">3xBI", data, lo + 4)
        raw = np.frombuffer(data, np.uint8, hi - lo - 12, lo + 12)
        size = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64) if bits == 4 else raw[:n].astype(np.int64) if bits == 8 else raw[: 2 * n].view(">u2").astype(np.int64)
    else:
        size = np.empty(0, np.int64)
    chunk = _table(data, table[b"co64"][0], kind=">u8")[:, 0] if b"co64" in table else _table(data, table[b"stco"][0])[:, 0] if b"stco" in table else np.empty(0, np.int64)
    runs = _table(data, table[b"stsc"][0], 3) if b"stsc" in table else np.empty((0, 3), np.int64)
    if not len(runs) or not len(chunk):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunk))))[: len(chunk)]
    owner = np.repeat(np.arange(len(each)), each)[: len(size)]
    size = size[: len(owner)]
    before = np.cumsum(size) - size
    first = np.zeros(len(chunk), np.int64)
    starts = np.cumsum(each) - each
    first[: len(starts)] = before[np.minimum(starts, max(0, len(before) - 1))] if len(before) else 0
    position = chunk[owner] + before - first[owner]
    keys = _table(data, table[b"stss"][0])[:, 0] - 1 if b"stss" in table else np.arange(len(size))
    return position, size, keys[(keys >= 0) & (keys < len(size))]


def _fields(data: memoryview, span: tuple[int, int], at: int, flags: int, names: list[tuple[int, str, str]]) -> tuple[dict, int]:
    """The optional fields of a full box, in order: those whose bit is set; and where the next one begins."""
    found = {}
    for bit, name, kind in names:
        if flags & bit:
            found[name] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return found, at


def fragment_samples(data: memoryview, top: list[tuple[int, dict]], track: int, extends: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(positions, sizes, sync samples from 0, duration) that the movie fragments of a file add to a track.

    `top` has the place of each moof and its boxes.  Offsets count from tfhd's base,
    or from the moof (its first run, also where no flag says so); a later run without
    an offset follows the one before.  A sample is a sync sample unless its flags
    say otherwise.
    """
    position, size, sync, duration = [], [], [], 0
    for start, moof in top:
        for traf in moof.get(b"traf", []):
            if b"tfhd" not in traf:
                continue
            lo, hi = traf[b"tfhd"][0]
            flags, number = struct.unpack_from(">II", data, lo)
            if number != track:
                continue
            own, _ = _fields(data, (lo, hi), lo + 8, flags, [(1, "base", ">Q"), (2, "entry", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")])
            default = extends | own
            base = next_at = own.get("base", start)
            for lo, hi in traf.get(b"trun", []):
                flags, n = struct.unpack_from(">II", data, lo)
                flags &= 0xFFFFFF
                run, at = _fields(data, (lo, hi), lo + 8, flags, [(1, "offset", ">i"), (4, "first", ">I")])
                columns = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
                if columns:
                    n = min(n, (hi - at) // (4 * len(columns)))
                rows = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns)) if columns else np.empty((n, 0), np.int64)
                column = lambda name, rows=rows, columns=columns, n=n, default=default: rows[:, columns.index(name)] if name in columns else np.full(n, default.get(name, 0), np.int64)
                sizes, marks = column("size"), column("flags").copy()
                if n and "first" in run and "flags" not in columns:
                    marks[0] = run["first"]
                first = base + run["offset"] if "offset" in run else next_at
                position.append(first + np.cumsum(sizes) - sizes)
                next_at = first + int(sizes.sum())
                size.append(sizes)
                sync.append(marks >> 16 & 1 == 0)
                duration += int(column("duration").sum())
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    return np.concatenate(position), np.concatenate(size), np.flatnonzero(np.concatenate(sync)), duration


def track_samples(data: memoryview, top: list[tuple[int, dict]], movie: dict, number: int, table: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions, sizes and sync samples of a track, from its tables and then its fragments, and what these add to its duration."""
    position, size, keys = sample_table(data, table)
    if not top:
        return position, size, keys, 0
    extends = {}
    for lo, _ in movie.get(b"mvex", [{}])[0].get(b"trex", []):
        if struct.unpack_from(">I", data, lo + 4)[0] == number:
            extends = dict(zip(("entry", "duration", "size", "flags"), struct.unpack_from(">4I", data, lo + 8), strict=True))
    more = fragment_samples(data, top, number, extends)
    return np.concatenate([position, more[0]]), np.concatenate([size, more[1]]), np.concatenate([keys, more[2] + len(size)]), more[3]


def _fragments(data: memoryview) -> list[tuple[int, dict]]:
    found, at = [], 0
    for kind, lo, hi in walk(data):
        if kind == b"moof":
            found.append((at, boxes(data, lo, hi)))
        at = hi
    return found


def _number(data: memoryview, trak: dict) -> int:
    if b"tkhd" not in trak:
        return 0
    lo = trak[b"tkhd"][0][0]
    return struct.unpack_from(">I", data, lo + (20 if data[lo] == 1 else 12))[0]


def _times(data: memoryview, span: tuple[int, int]) -> tuple[int, int]:
    """Timescale and duration of an mvhd or mdhd box."""
    return struct.unpack_from(">IQ", data, span[0] + 20) if data[span[0]] == 1 else struct.unpack_from(">II", data, span[0] + 12)


def tracks(media: bytes) -> list[dict]:
    """What TRACK says of each track; a track without tables has no samples, bytes that are no ISO media have no tracks."""
    data = memoryview(media).cast("B")
    out, top = [], _fragments(data)
    for movie in boxes(data).get(b"moov", []):
        for trak in movie.get(b"trak", []):
            mdia = trak.get(b"mdia", [{}])[0]
            table = mdia.get(b"minf", [{}])[0].get(b"stbl", [{}])[0]
            if b"mdhd" not in mdia:
                continue
            scale, duration = _times(data, mdia[b"mdhd"][0])
            kind = bytes(data[mdia[b"hdlr"][0][0] + 8 :][:4]).decode("latin-1") if b"hdlr" in mdia else ""
            codec, width, height = "", 0, 0
            for entry, lo, hi in walk(data, table[b"stsd"][0][0] + 8, table[b"stsd"][0][1]) if b"stsd" in table else ():
                codec = entry.decode("latin-1")
                if kind == "vide" and hi - lo >= 28:
                    width, height = struct.unpack_from(">HH", data, lo + 24)
                break
            number = _number(data, trak)
            position, size, keys, more = track_samples(data, top, movie, number, table)
            if more:  # the header tells the duration of the whole only where there are no fragments
                duration = more + (duration if b"stts" in table and _table(data, table[b"stts"][0], 2).any() else 0)
            out.append({"track_id": number, "kind": kind, "codec": codec, "width": width, "height": height, "timescale": scale, "duration": duration, "seconds": duration / scale if scale else 0.0, "samples": len(size), "sample_bytes": int(size.sum()), "keyframes": [{"sample": int(k), "start": int(position[k]), "length": int(size[k])} for k in keys]})
    return out


def read_samples(media: bytes, track: int = 0) -> bytes:
    """The bytes of a track's samples, in order, found through its tables."""
    data = memoryview(media).cast("B")
    movie = boxes(data)[b"moov"][0]
    trak = movie[b"trak"][track]
    position, size, _, _ = track_samples(data, _fragments(data), movie, _number(data, trak), trak[b"mdia"][0][b"minf"][0][b"stbl"][0])
    if not len(size):
        return b""
    cut = np.flatnonzero(position[1:] != position[:-1] + size[:-1]) + 1  # neighbours in one read
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(size)]]) - 1
    return b"".join(data[position[a] : position[b] + size[b]] for a, b in zip(first, last, strict=True))


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of a frame."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded, as an ISO media file.

    A null or empty text is one frame of spaces; rows are independent of each
    other, so repeated rows give repeated rows; null ids stay null.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi in batches(part["text"], 8 << 20):
                texts = [t or b"" for t in part["text"].slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].slice(lo, hi - lo), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([write_media(pad(t)) for t in texts], pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def index_media(files: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), samples: bool = False) -> DataFrame:
    """The columns `keep`, `tracks` (array of TRACK), and with `samples` the first track's bytes as `payload`.

    Null, empty or broken files have no tracks and no payload (an empty array, a null).
    One row per row, so repeated rows repeat and an empty table stays empty; columns
    that are not kept are ignored.  `keep` must not name `tracks`, `payload` or `_media`.
    """
    rows = files.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`").alias("_media"))
    fields = rows.drop("_media").schema.fields

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for lo, hi in batches(whole["_media"], BATCH_BYTES):
                part = whole.slice(lo, hi - lo)
                found, payloads = [], []
                for media in part["_media"]:
                    media = media.as_buffer()
                    try:
                        found.append(tracks(media) if media else [])
                        payloads.append(read_samples(media) if samples and found[-1] else None)
                    except (struct.error, ValueError, IndexError, KeyError, TypeError):
                        found.append([])
                        payloads.append(None)
                out = {f.name: part[f.name] for f in fields} | {"tracks": pa.array(found, _TRACKS)} | ({"payload": pa.array(payloads, pa.binary())} if samples else {})
                yield pa.RecordBatch.from_pydict(out)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"tracks array<{TRACK}>" + (", payload binary" if samples else "")
    return rows.mapInArrow(run, schema)


_TRACKS = pa.list_(pa.struct([("track_id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("samples", pa.int64()), ("sample_bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("sample", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])))]))
