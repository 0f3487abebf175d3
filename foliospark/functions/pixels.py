"""PNG pictures as arrays of grey levels: decoding, ink boxes, connected blobs.

No picture library is needed: a PNG is chunks, a zlib stream and five row filters. Everything works on
one picture at a time inside Arrow-batched UDFs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Larger pictures count as undecodable, so that a small file cannot fill an executor's memory.
MAX_PIXELS = 64_000_000
#: Bytes of rows that are unfiltered at a time.
_SLAB = 1 << 20
# Grey level below which a pixel is ink in a crop, and in the search for blobs.
INK, BLOB_INK = 225, 150
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_SIZES = ["width", "height", "ink_x0", "ink_y0", "ink_x1", "ink_y1"]
_INTS = lambda names: T.StructType([T.StructField(n, T.IntegerType()) for n in names])
# Fixed values of the PNG standard: start and step of x and y in the passes of an interlaced picture.
_ADAM7 = [(0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2)]


def _unfilter(raw: bytes, height: int, stride: int, unit: int) -> np.ndarray:
    """Rows of bytes of one pass; raises ValueError on an unknown filter."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + unit), np.uint8)  # a zero row above and a zero unit to the left
    kinds, slab = rows[:, 0], max(1, _SLAB // (stride + 1))
    starts = np.flatnonzero(np.diff(kinds, prepend=kinds[0] ^ 1))
    for first, stop in zip(starts.tolist(), [*starts[1:].tolist(), height], strict=True):  # rows of one kind
        kind = int(kinds[first])
        if kind > 4:
            raise ValueError("unknown row filter")
        step = slab if kind < 3 else 1
        for y in range(first, stop, step):
            end = min(stop, y + step)
            lines, above, here = rows[y:end, 1:], out[y], out[y + 1 : end + 1]
            if kind == 0:
                here[:, unit:] = lines
            elif kind == 1:
                padded = np.zeros((end - y, -(-stride // unit) * unit), np.uint8)
                padded[:, :stride] = lines
                here[:, unit:] = np.cumsum(padded.reshape(end - y, -1, unit), axis=1, dtype=np.uint8).reshape(end - y, -1)[:, :stride]
            elif kind == 2:
                here[:, unit:] = np.cumsum(lines, axis=0, dtype=np.uint8) + above[unit:]
            else:
                up, now = above.tolist(), here[0].tolist()
                for x, v in enumerate(lines[0].tolist()):
                    a, b, c = now[x], up[x + unit], up[x]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    now[x + unit] = (v + guess) & 255
                here[0] = now
    return out[1:, unit:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) of 8 bits, palette indices as they are."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * channels * depth].reshape(len(rows), -1, depth)
        rows = bits.dot(1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return rows[:, : width * channels].reshape(len(rows), width, channels)


def decode(png: bytes | None) -> np.ndarray | None:
    """Grey levels (height, width) of a PNG, alpha ignored; None if it does not decode."""
    try:
        if not png or not png.startswith(SIGNATURE):
            return None
        at, head, palette, data = len(SIGNATURE), None, None, []
        while at + 12 <= len(png):
            (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
            body = png[at + 8 : at + 8 + n]
            if len(body) != n or zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
                return None
            at += 12 + n
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                data.append(body)
            elif kind == b"IEND":
                break
        if head is None:
            return None
        width, height, depth, colour, _, _, laced = head
        channels = _CHANNELS[colour]
        if not 0 < width * height <= MAX_PIXELS or (colour == 3 and palette is None):
            return None
        unit = max(1, channels * depth // 8)
        passes = _ADAM7 if laced else [(0, 1, 0, 1)]
        sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, dx, y, dy in passes]
        need = sum(h * (1 + -(-w * channels * depth // 8)) for w, h in sizes if w > 0 and h > 0)
        raw = zlib.decompressobj().decompress(b"".join(data), need)
        if len(raw) < need:
            return None
        out, start = np.zeros((height, width, channels), np.uint8), 0
        for (x, dx, y, dy), (w, h) in zip(passes, sizes, strict=True):
            if w > 0 and h > 0:
                stride = -(-w * channels * depth // 8)
                size = h * (stride + 1)
                out[y::dy, x::dx] = _samples(_unfilter(raw[start : start + size], h, stride, unit), w, channels, depth)
                start += size
        if colour == 3:
            out = palette[np.minimum(out[:, :, 0], len(palette) - 1)]
        elif depth < 8:
            out = (out.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        if out.shape[2] >= 3:
            r, g, b = (out[:, :, i].astype(np.uint32) for i in range(3))
            return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)
        return out[:, :, 0].copy()
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None


def encode(grey: np.ndarray) -> bytes:
    """A grey PNG of 8 bits."""
    h, w = grey.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), grey.astype(np.uint8)], axis=1).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def ink_box(grey: np.ndarray, level: int = INK) -> tuple[int, int, int, int] | None:
    """The box of all ink in pixels, ends exclusive."""
    ink = grey < level
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return (int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1) if len(rows) else None


def blobs(grey: np.ndarray, cell: int = 3, level: int = BLOB_INK) -> list[tuple[int, int, int, int]]:
    """Boxes in pixels of the connected blobs of ink, in order of their first row.

    Cells of cell x cell pixels with any ink are joined with their eight neighbours: each row of cells is
    a list of runs, and runs that touch runs of the row above are one set of a union-find forest.
    """
    h, w = grey.shape
    ink = np.zeros((-(-h // cell) * cell, -(-w // cell) * cell), bool)
    ink[:h, :w] = grey < level
    grid = ink.reshape(ink.shape[0] // cell, cell, ink.shape[1] // cell, cell).any(axis=(1, 3))
    parent: list[int] = []
    boxes: list[list[int]] = []
    above: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for y, row in enumerate(grid):
        steps = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        here, k = [], 0
        for start, stop in steps.reshape(-1, 2).tolist():
            me = len(parent)
            parent.append(me)
            boxes.append([start, y, stop, y + 1])
            while k < len(above) and above[k][1] < start:
                k += 1
            for a, b, other in above[k:]:
                if a > stop:
                    break
                if b >= start and (r := root(other)) != (m := root(me)):
                    keep, gone = min(r, m), max(r, m)
                    parent[gone] = keep
                    p, q = boxes[keep], boxes[gone]
                    boxes[keep] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
            here.append((start, stop, me))
        above = here
    return [tuple(v * cell for v in b) for i, b in enumerate(boxes) if parent[i] == i]


@F.pandas_udf(_INTS(_SIZES))
def measures(png: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Size and ink box of PNG bytes; all null if they do not decode, ink null if there is none."""
    for x in png:
        rows = []
        for b in x:
            grey = decode(b)
            rows.append((None,) * 6 if grey is None else (grey.shape[1], grey.shape[0], *(ink_box(grey) or (None,) * 4)))
        yield pd.DataFrame(rows, columns=_SIZES).astype("Int32")


@F.pandas_udf(T.ArrayType(_INTS(["x0", "y0", "x1", "y1"])))
def ink_blobs(png: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Blobs of ink of PNG bytes in pixels; null if they do not decode."""
    for x in png:
        yield x.map(lambda b: None if (grey := decode(b)) is None else [dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)) for box in blobs(grey)])
