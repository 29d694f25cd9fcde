"""Media columns: what a column of bytes holds is told by its signatures, whatever type it is declared to be.

One automaton (Aho-Corasick) finds the magic bytes of all formats in one pass over the bytes. A hit is only a place to
look at: the format's validator then walks the structure from there (chunks with their checksums, segments, pages,
sizes against sizes) and says where the object ends, or that there is none. An object at the beginning gives the true
type; the others are embedded and can be carved out.

Payloads are kept losslessly as 8-bit samples of sound or grey pictures 64 pixels wide, and read back by the type that
was found.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import bytes_column, map_arrow, small_batches, stored
from clipsieve.operators.video import GREY, PNG_MAGIC, png

#: Pixels in a line of the pictures that payloads become, and the unit that payloads are filled up to.
WIDTH = 64
RATE = 8_000
#: Bytes of media in one Arrow batch of written objects, but for a single one.
BATCH_BYTES = 8_000_000

#: Magic bytes, the format they announce, and how many bytes before them it begins.
SIGNATURES: dict[bytes, tuple[str, int]] = {
    PNG_MAGIC: ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"BM": ("bmp", 0),
    b"P5": ("pgm", 0),
    b"P6": ("ppm", 0),
    b"RIFF": ("riff", 0),
    b".snd": ("au", 0),
    b"FORM": ("aiff", 0),
    b"OggS": ("ogg", 0),
    b"ftyp": ("mp4", 4),
}
#: Forms of RIFF files, sizes of BMP headers, bytes of a sample by AU encoding, boxes of MP4 files.
RIFF_FORMS = {b"WAVE": ("wav", b"data"), b"WEBP": ("webp", b"VP8"), b"AVI ": ("avi", b"LIST")}
BMP_HEADERS = (12, 40, 52, 56, 64, 108, 124)
AU_BYTES = {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 8, 27: 1}
MP4_BOXES = {b"ftyp", b"styp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"meta", b"uuid", b"sidx", b"wide", b"pdin"}


class Media(NamedTuple):
    kind: str
    start: int
    end: int


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, (kind, before) in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (kind, before + len(magic) - 1))
    a.make_automaton()
    return a


_SIGNATURES = _automaton()


def _png(d: bytes, at: int) -> tuple[str, int] | None:
    """Chunks with right checksums, IHDR first, image data among them, IEND last."""
    p, first, data = at + 8, True, False
    while p + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + size > len(d) or (kind == b"IHDR") != first or zlib.crc32(d[p + 4 : p + 8 + size]) != struct.unpack_from(">I", d, p + 8 + size)[0]:
            return None
        p, first, data = p + 12 + size, False, data or kind == b"IDAT"
        if kind == b"IEND":
            return ("png", p) if data and not size else None
    return None


def _sub_blocks(d: bytes, p: int) -> int | None:
    while p < len(d):
        if not d[p]:
            return p + 1
        p += 1 + d[p]
    return None


def _gif(d: bytes, at: int) -> tuple[str, int] | None:
    """Screen, colour tables, extensions and images by their blocks, up to the trailer."""
    if at + 13 > len(d):
        return None
    p, images = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0), 0
    while p is not None and p < len(d):
        if d[p] == 0x3B:
            return ("gif", p + 1) if images else None
        if d[p] == 0x21:
            p = _sub_blocks(d, p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p, images = _sub_blocks(d, p + 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0)), images + 1
        else:
            return None
    return None


def _jpeg(d: bytes, at: int) -> tuple[str, int] | None:
    """Segments by their lengths, a frame before the scans, then up to the end marker."""
    p, frame = at + 2, False
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return None
        mark = d[p + 1]
        if mark == 0xD9:
            return None
        size = struct.unpack_from(">H", d, p + 2)[0]
        if size < 2 or mark < 0xC0 and mark != 0x01:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark == 0xDA:
            if not frame:
                return None
            # Coded data: a marker is an 0xFF that no zero, restart mark or further 0xFF follows.
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7 or d[p + 1] == 0xFF):
                p += 1 if d[p + 1] == 0xFF else 2
            if p < 0 or p + 1 >= len(d):
                return None
            if d[p + 1] == 0xD9:
                return "jpeg", p + 2
    return None


def _bmp(d: bytes, at: int) -> tuple[str, int] | None:
    """Sizes of file and headers that agree, and room for the lines."""
    if at + 26 > len(d):
        return None
    size, offset, header = struct.unpack_from("<I4xII", d, at + 2)
    if header not in BMP_HEADERS or at + size > len(d) or not 14 + header <= offset <= size:
        return None
    w, h, planes, bits = struct.unpack_from("<HHHH" if header == 12 else "<iiHH", d, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h:
        return None
    packed = header > 12 and struct.unpack_from("<I", d, at + 30)[0] not in (0, 3)
    return ("bmp", at + size) if packed or offset + (w * bits + 31) // 32 * 4 * abs(h) <= size else None


def _numbers(d: bytes, p: int, n: int) -> tuple[list[int], int] | None:
    """n decimal numbers of a PNM header, each after white space or comments, and the place of the samples."""
    out = []
    for _ in range(n):
        q = p
        while d[p : p + 1].isspace() or d[p : p + 1] == b"#":
            p = p + 1 if d[p : p + 1].isspace() else (d.find(b"\n", p) % (len(d) + 1))
        if p == q:
            return None
        q = p
        while d[p : p + 1].isdigit() and p - q < 10:
            p += 1
        if p == q:
            return None
        out.append(int(d[q:p]))
    return (out, p + 1) if d[p : p + 1].isspace() else None


def _pnm(d: bytes, at: int) -> tuple[str, int] | None:
    """Width, height and largest value, and all the samples that they call for."""
    if not (got := _numbers(d, at + 2, 3)):
        return None
    (w, h, most), p = got
    grey = d[at + 1 : at + 2] == b"5"
    end = p + w * h * (1 if grey else 3) * (1 if most < 256 else 2)
    return ("pgm" if grey else "ppm", end) if w and h and 0 < most < 65_536 and end <= len(d) else None


def _chunks(d: bytes, p: int, end: int, order: str) -> dict[bytes, tuple[int, int]] | None:
    """Places of chunks that fill a range exactly, each padded to an even length."""
    out = {}
    while p + 8 <= end:
        kind, size = struct.unpack_from(order + "4sI", d, p)
        out.setdefault(kind, (p + 8, size))
        p += 8 + size
        if p > end:
            return None
        p += size & 1 and p < end
    return out if p == end else None


def _riff(d: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    if form not in RIFF_FORMS or size < 4 or at + 8 + size > len(d) or (chunks := _chunks(d, at + 12, at + 8 + size, "<")) is None:
        return None
    kind, needed = RIFF_FORMS[form]
    return (kind, at + 8 + size) if any(c.startswith(needed) for c in chunks) and (kind != "wav" or chunks.get(b"fmt ", (0, 0))[1] >= 16) else None


def _aiff(d: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from(">I4s", d, at + 4)
    if form not in (b"AIFF", b"AIFC") or size < 4 or at + 8 + size > len(d) or (chunks := _chunks(d, at + 12, at + 8 + size, ">")) is None:
        return None
    return ("aiff", at + 8 + size) if b"COMM" in chunks else None


def _au(d: bytes, at: int) -> tuple[str, int] | None:
    if at + 24 > len(d):
        return None
    offset, size, coding, rate, channels = struct.unpack_from(">5I", d, at + 4)
    if offset < 24 or coding not in AU_BYTES or not 0 < channels <= 256 or not 0 < rate <= 1_000_000 or size % (AU_BYTES[coding] * channels):
        return None
    return ("au", at + offset + size) if at + offset + size <= len(d) else None


def _ogg_table() -> list[int]:
    out = []
    for k in range(256):
        v = k << 24
        for _ in range(8):
            v = (v << 1 ^ (0x04C11DB7 if v >> 31 else 0)) & 0xFFFFFFFF
        out.append(v)
    return out


_OGG = _ogg_table()


def _ogg(d: bytes, at: int) -> tuple[str, int] | None:
    """Pages with right checksums, the first one a beginning, up to the last that follows."""
    p, end = at, None
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        n = d[p + 26]
        size = 27 + n + sum(d[p + 27 : p + 27 + n])
        if d[p + 4] or p + size > len(d) or p == at and not d[p + 5] & 2:
            break
        crc = 0
        for c in d[p : p + 22] + bytes(4) + d[p + 26 : p + size]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ _OGG[crc >> 24 ^ c]
        if crc != struct.unpack_from("<I", d, p + 22)[0]:
            break
        p = end = p + size
    return ("ogg", end) if end else None


def _mp4(d: bytes, at: int) -> tuple[str, int] | None:
    """Boxes by their sizes from ftyp on, a moov among them; one that reaches to the end of the file has size 0."""
    p, kinds = at, set()
    while p + 8 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, p)
        if kind not in MP4_BOXES:
            break
        if size == 1 and p + 16 <= len(d):
            size = struct.unpack_from(">Q", d, p + 8)[0]
        size = len(d) - p if size == 0 else size
        if size < 8 or p + size > len(d):
            return None
        kinds.add(kind)
        p += size
    return ("mp4", p) if b"moov" in kinds or b"moof" in kinds else None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pgm": _pnm, "ppm": _pnm, "riff": _riff, "au": _au, "aiff": _aiff, "ogg": _ogg, "mp4": _mp4,
}


def sniff(data: bytes, inside: bool = False) -> list[Media]:
    """The objects in some bytes, by place. Those within another one are told only if asked for."""
    out: list[Media] = []
    end = 0
    hits = sorted((last - back, kind) for last, (kind, back) in _SIGNATURES.iter(data.decode("latin-1")))
    for start, kind in hits:
        if start >= 0 and (inside or start >= end) and (found := VALIDATORS[kind](data, start)):
            out.append(Media(found[0], start, found[1]))
            end = max(end, found[1])
    return out


def encode(kind: str, payload: bytes) -> bytes:
    """Bytes, a positive multiple of WIDTH of them, as the 8-bit samples of a sound or the pixels of a grey picture."""
    n, lines = len(payload), len(payload) // WIDTH
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload
    if kind == "au":
        return struct.pack(">4s5I", b".snd", 24, n, 2, RATE, 1) + payload
    if kind == "pgm":
        return f"P5\n{WIDTH} {lines}\n255\n".encode() + payload
    if kind == "bmp":
        palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
        offset = 54 + len(palette)
        return struct.pack("<2sI4xIIiiHHIIiiII", b"BM", offset + n, offset, 40, WIDTH, -lines, 1, 8, 0, n, 0, 0, 256, 0) + palette + payload
    if kind == "png":
        return png(payload, lines, WIDTH, GREY)
    raise ValueError(f"no samples can be kept as {kind}")


CARRIERS = ("wav", "au", "pgm", "bmp", "png")


def decode(kind: str, d: bytes) -> bytes:
    """The samples of an object that encode() may have made; another layout of the format raises."""
    if kind == "wav":
        chunks = _chunks(d, 12, 8 + struct.unpack_from("<I", d, 4)[0], "<")
        coding, _, _, _, _, bits = struct.unpack_from("<HHIIHH", d, chunks[b"fmt "][0])
        if (coding, bits) != (1, 8):
            raise ValueError("no 8-bit samples")
        at, size = chunks[b"data"]
        return d[at : at + size]
    if kind == "au":
        offset, size, coding = struct.unpack_from(">3I", d, 4)
        if coding != 2:
            raise ValueError("no 8-bit samples")
        return d[offset : offset + size]
    if kind == "pgm":
        (w, h, most), at = _numbers(d, 2, 3)
        if most != 255:
            raise ValueError("no 8-bit samples")
        return d[at : at + w * h]
    if kind == "bmp":
        offset, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", d, 10)
        if bits != 8 or packed or w % 4 or h > 0:
            raise ValueError("not 8-bit lines from the top without padding")
        return d[offset : offset - h * w]
    if kind == "png":
        w, h, depth, colour, _, _, lace = struct.unpack_from(">IIBBBBB", d, 16)
        if (depth, colour, lace) != (8, GREY, 0):
            raise ValueError("no 8-bit grey lines")
        p, parts = 8, []
        while p < len(d):
            size, name = struct.unpack_from(">I4s", d, p)
            if name == b"IDAT":
                parts.append(d[p + 8 : p + 8 + size])
            p += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w)
        if lines[:, 0].any():
            raise ValueError("the lines are filtered")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no samples can be read from {kind}")


def padded(text: bytes) -> bytes:
    """Filled up with zero bytes to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text as an object of a type that its bytes choose.

    declared is what a careless writer would say, chosen by the text's length, and mostly wrong. Null and empty texts are
    64 zero bytes. Repeated rows are written again, texts of any length whole.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate((batch[0].type, pa.int64(), pa.string(), pa.binary()))], ["id", "n_bytes", "declared", "media"])
            held.clear()
            return out

        size = 0
        for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            payload = padded(text)
            held.append((i, len(text), CARRIERS[len(text) % len(CARRIERS)], encode(CARRIERS[zlib.crc32(payload) % len(CARRIERS)], payload)))
            size += len(payload)
            if size > BATCH_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from each(b)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), bytes_column(text_col).alias("text"))
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "id long, n_bytes long, declared string, media binary")


def typed(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with found array<struct<kind, start, length>>: the objects in a column of bytes; null for null.

    The first has the true type if it starts at 0; any others are embedded.
    """
    return _sniffed(rows, media_col, with_content=False)


def carve(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows without the column of bytes, one for each object within it, those within others too: kind, start, content."""
    flat = _sniffed(rows, media_col, with_content=True).drop(media_col)
    others = [c for c in flat.columns if c != "found"]
    return flat.select(*others, F.explode("found").alias("f")).select(*others, "f.kind", "f.start", "f.content")


def _sniffed(rows: DataFrame, media_col: str, with_content: bool) -> DataFrame:
    kind = "array<struct<kind: string, start: bigint, length: bigint" + (", content: binary>>" if with_content else ">>")

    def found(media: bytes | None) -> list[dict] | None:
        if media is None:
            return None
        return [{"kind": m.kind, "start": m.start, "length": m.end - m.start} | ({"content": media[m.start : m.end]} if with_content else {}) for m in sniff(media, inside=with_content)]

    fields = [pa.field("kind", pa.string()), pa.field("start", pa.int64()), pa.field("length", pa.int64())] + [pa.field("content", pa.binary())] * with_content

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(media_col)
        out = pa.array([found(m) for m in batch[at].to_pylist()], pa.list_(pa.struct(fields)))
        return pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "found"])

    names = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return map_arrow(rows, each, f"{names}, found {kind}")


def feature(payload: bytes, found: list[Media], declared: str) -> str:
    """What the samples and the sniffing say: true and declared type, moments and entropy, and what is embedded."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = count[count > 0] / len(payload)
    mean = float(count @ np.arange(256)) / len(payload)
    about = {
        "type": found[0].kind, "declared": declared, "samples": len(payload), "distinct": int((count > 0).sum()), "mean": round(mean, 3),
        "deviation": round(math.sqrt(max(0.0, float(count @ np.square(np.arange(256.0))) / len(payload) - mean * mean)), 3), "entropy": round(abs(float(-(share * np.log2(share)).sum())), 3),
        "embedded": [[m.kind, m.start, m.end - m.start] for m in sniff(payload)],
    }
    return json.dumps(about, separators=(",", ":"))


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes every text as media into the shared folder, reads the bytes back and says what they hold.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and declared, media_type
    and corrected (whether the declared type is wrong). The payload is decoded by the type that sniffing finds, whatever is
    declared; bytes in which nothing is found raise. Null ids and repeated rows stay rows, other columns are ignored, and an
    empty table has no rows. Equal texts get equal values.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, n, declared, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = sniff(media)
            if not found or found[0].start or found[0].end != len(media):
                raise ValueError("a stored object is none of the known formats")
            payload = decode(found[0].kind, media)
            hashes = [hashlib.sha256(x).hexdigest() for x in (payload, media)]
            out.append((i, n, len(payload), hashes[0], zlib.crc32(payload[-WIDTH:]), len(media), hashes[1], feature(payload, found, declared), declared, found[0].kind, declared != found[0].kind))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    long, text = pa.int64(), pa.string()
    kinds = (long, long, long, text, long, long, text, text, text, text, pa.bool_())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "media_type", "corrected"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, corrected boolean"
    return map_arrow(stored(write(docs), "media", compression="zstd"), each, schema)
