"""Pictures of PNG files as rows of RGB pixels. Other formats attach as the hook decode_picture."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: How a PNG file begins, and the samples of a pixel by colour type (grey, RGB, palette, grey with alpha, RGB with alpha).
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(name, body) of the chunks of a PNG file up to its end; one with a wrong checksum or cut off raises ValueError."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("no PNG file")
    at, out = 8, []
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"the chunk {name!r} is broken")
        out.append((name, body))
        at += 12 + size
        if name == b"IEND":
            return out
    raise ValueError("the file ends before its last chunk")


def unfiltered(raw: bytes, lines: int, step: int, back: int) -> np.ndarray:
    """Lines of step bytes out of filtered ones, each led by its filter's number; back is the bytes of a whole pixel."""
    if len(raw) < lines * (step + 1):
        raise ValueError("the picture has too few lines")
    rows = np.frombuffer(raw, np.uint8, lines * (step + 1)).reshape(lines, step + 1)
    out = np.zeros((lines + 1, step + back), np.uint8)  # a line of zeros above, a pixel of zeros on the left
    for k in range(lines):
        kind, line, up = int(rows[k, 0]), rows[k, 1:], out[k]
        here = out[k + 1]
        if kind == 0:
            here[back:] = line
        elif kind == 2:
            here[back:] = line + up[back:]
        elif kind == 1:
            # Sums along the line, each sample of a pixel by itself, modulo 256.
            pad = np.zeros(-(-step // back) * back, np.uint8)
            pad[:step] = line
            here[back:] = np.add.accumulate(pad.reshape(-1, back), axis=0, dtype=np.uint8).reshape(-1)[:step]
        elif kind in (3, 4):
            now, above = bytearray(here.tobytes()), up.tobytes()
            for i, v in enumerate(line.tolist(), back):
                a, b, c = now[i - back], above[i], above[i - back]
                if kind == 3:
                    near = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = (v + near) & 255
            out[k + 1] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise ValueError(f"a line has the unknown filter {kind}")
    return out[1:, back:]


def png_pixels(data: bytes) -> tuple[int, int, bytes]:
    """(height, width, RGB bytes) of a PNG file. Alpha is dropped, 16 bits are cut to the upper 8, interlaced files raise."""
    parts = png_chunks(data)
    if not parts or parts[0][0] != b"IHDR":
        raise ValueError("the file doesn't begin with its header")
    w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", parts[0][1])
    if colour not in SAMPLES or depth not in DEPTHS[colour] or not w or not h:
        raise ValueError("the header's colours are unknown")
    if laced:
        raise ValueError("interlaced PNG files are not read")
    samples = SAMPLES[colour]
    try:
        raw = zlib.decompress(b"".join(body for name, body in parts if name == b"IDAT"))
    except zlib.error as e:
        raise ValueError(f"the picture can't be unpacked: {e}") from None
    lines = unfiltered(raw, h, -(-w * samples * depth // 8), max(1, samples * depth // 8))
    if depth == 16:
        values = lines.reshape(h, -1, 2)[:, :, 0]
    elif depth == 8:
        values = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
        values = bits.dot(1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
        if colour == 0:
            values = values * np.uint8(255 // ((1 << depth) - 1))
    pixels = values[:, : w * samples].reshape(h, w, samples)
    if colour == 3:
        palette = next((body for name, body in parts if name == b"PLTE"), b"")
        table = np.frombuffer(palette, np.uint8, len(palette) // 3 * 3).reshape(-1, 3)
        if int(pixels.max()) >= len(table):
            raise ValueError("a pixel's colour is not in the palette")
        rgb = table[pixels[:, :, 0]]
    else:
        rgb = pixels[:, :, :3] if samples > 2 else pixels[:, :, :1].repeat(3, axis=2)
    return h, w, rgb.tobytes()
