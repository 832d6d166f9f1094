"""Baseline JPEG files: the entropy-coded scan as coefficient blocks, blocks as pixels, and pixels as files.

A file is decoded by itself in an Arrow batch: codes have no fixed places, so a scan is read from its
start, or from its restart markers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from struct import error, pack, unpack_from

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import COSINE
from ..functions.signal import CHROMINANCE, LUMINANCE, ZIGZAG
from .containers import jpeg

_ORDER = np.array(ZIGZAG)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Frame:
    """Tables and sizes of a file, and of each component its blocks of 64 coefficients in zigzag order."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical factor, table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    restart: int = 0
    blocks: list[np.ndarray] = field(default_factory=list)

    @property
    def most(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    def start(self) -> None:
        """Room for the blocks, whole coding units of all components."""
        h, v = self.most
        columns, rows = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.blocks = [np.zeros((rows * c[2], columns * c[1], 64), np.int32) for c in self.components]


@lru_cache(maxsize=64)
def _code_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that each 16 bits begin with; length 0 where none does."""
    lengths, values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    at = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            span = 1 << 16 - n
            lengths[at : at + span], values[at : at + span] = n, symbols[k]
            at, k = at + span, k + 1
    return lengths, values


class _Bits:
    """Bits of a piece of a scan, most significant first; behind the end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 4]) >> 32 - (self.at & 7) - n & (1 << n) - 1

    def code(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        word = self.peek(16)
        n = int(table[0][word])
        if not n or self.at >> 3 > len(self.data) - 8:
            raise ValueError("no such code")
        self.at += n
        return int(table[1][word])

    def signed(self, n: int) -> int:
        """A value of ``n`` bits; those that begin with 0 are negative."""
        if not n:
            return 0
        v = self.peek(n)
        self.at += n
        return v if v >> n - 1 else v - (1 << n) + 1


def _block(bits: _Bits, dc, ac, before: int, out: np.ndarray) -> int:
    now = before + bits.signed(bits.code(dc))
    out[0] = now
    k = 1
    while k < 64:
        run, n = divmod(bits.code(ac), 16)
        if not n:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a run beyond its block")
        out[k] = bits.signed(n)
        k += 1
    return now


def _scan(frame: Frame, header: bytes, data: bytes) -> None:
    chosen = [(next(i for i, c in enumerate(frame.components) if c[0] == header[1 + 2 * k]), header[2 + 2 * k]) for k in range(header[0])]
    places = []
    if len(chosen) == 1:  # a scan of one component goes by its own blocks
        i, _ = chosen[0]
        h, v = frame.most
        _, ch, cv, _ = frame.components[i]
        columns, rows = (-(-(-(-size * own // most)) // 8) for size, own, most in ((frame.width, ch, h), (frame.height, cv, v)))
        places = [[(0, y, x)] for y in range(rows) for x in range(columns)]
    else:
        _, first_h, first_v, _ = frame.components[chosen[0][0]]
        rows, columns = frame.blocks[chosen[0][0]].shape[0] // first_v, frame.blocks[chosen[0][0]].shape[1] // first_h
        inner = [(k, y, x, frame.components[i][1], frame.components[i][2]) for k, (i, _) in enumerate(chosen) for y in range(frame.components[i][2]) for x in range(frame.components[i][1])]
        places = [[(k, r * v + y, c * h + x) for k, y, x, h, v in inner] for r in range(rows) for c in range(columns)]
    tables = [(frame.codes[0, t >> 4], frame.codes[1, t & 15]) for _, t in chosen]
    step = frame.restart or len(places)
    for piece, begin in zip(_RESTART.split(data), range(0, len(places), max(step, 1)), strict=False):
        bits, before = _Bits(piece), [0] * len(chosen)
        for unit in places[begin : begin + step]:
            for k, y, x in unit:
                before[k] = _block(bits, *tables[k], before[k], frame.blocks[chosen[k][0]][y, x])


def decode(d: bytes) -> Frame | None:
    """Blocks of a sequential file of 8 bits; null for others. A file that breaks off leaves the rest of its blocks 0."""
    frame = Frame()
    try:
        return frame if _read(frame, d) and frame.blocks else None
    except (ValueError, IndexError, KeyError, StopIteration, error):
        return frame if frame.blocks else None


def _read(frame: Frame, d: bytes) -> bool:
    """Fill ``frame`` from the segments; false for a kind of file that is not sequential."""
    for _, code, at, size, _ in jpeg(d):
        body = d[at : at + size]
        if code in ("c0", "c1"):
            if len(body) < 6 or body[0] != 8:
                return False
            frame.height, frame.width = unpack_from(">HH", body, 1)
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not (frame.width and frame.height and all(c[1] and c[2] for c in frame.components)):
                return False
            frame.start()
        elif code in ("c2", "c3", "c5", "c6", "c7", "c9", "ca", "cb", "cd", "ce", "cf"):
            return False
        elif code == "db":
            while body:
                n = 128 if body[0] >> 4 else 64
                frame.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif code == "c4":
            while len(body) > 17:
                counts = body[1:17]
                frame.codes[body[0] >> 4, body[0] & 15] = _code_table(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif code == "dd":
            frame.restart = unpack_from(">H", body)[0]
        elif code == "da" and frame.blocks:
            n = unpack_from(">H", d, at - 2)[0] - 2
            _scan(frame, body[:n], body[n:])
    return True


def to_pixels(frame: Frame) -> np.ndarray:
    """(height, width, 3): blocks times their tables, transformed back, spread to full size, and from YCbCr to RGB."""
    h, v = frame.most
    planes = []
    for (_, ch, cv, table), blocks in zip(frame.components, frame.blocks, strict=True):
        x = np.zeros(blocks.shape)
        x[:, :, _ORDER] = blocks * frame.quant.get(table, np.ones(64, np.int32))
        y = np.einsum("ki,rckl,lj->rcij", COSINE, x.reshape(*blocks.shape[:2], 8, 8), COSINE) + 128
        plane = y.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
        planes.append(plane.repeat(v // cv, axis=0).repeat(h // ch, axis=1)[: frame.height, : frame.width])
    if len(planes) < 3:
        rgb = [planes[0]] * 3
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255).astype(np.uint8)


def array(d: bytes) -> np.ndarray | None:
    frame = decode(d)
    whole = frame is not None and all(len(frame.quant.get(c[3], ())) in (0, 64) for c in frame.components)
    return to_pixels(frame) if whole else None


def _scaled(table: tuple, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def _rest(known: list[int], first: int) -> list[int]:
    """Behind the ``known`` symbols the others by number, of runs 0 to 15 and sizes from ``first`` (10 at most)."""
    return known + [x for x in sorted(run << 4 | n for run in range(16) for n in range(1, 11)) if x not in known and (x & 15) >= first]


#: Codes of ITU-T T.81 annex K (fixed values): how many of each length from 1 to 16, and their symbols. The longest stand by number.
DC_LUMINANCE = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), list(range(12)))
DC_CHROMINANCE = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), list(range(12)))
AC_LUMINANCE = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), _rest([
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1,
    0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
], 1))
AC_CHROMINANCE = ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), _rest([
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1,
    0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
], 1))
CODES = ((0x00, DC_LUMINANCE), (0x10, AC_LUMINANCE), (0x01, DC_CHROMINANCE), (0x11, AC_CHROMINANCE))


def _words(codes: tuple[tuple[int, ...], list[int]]) -> dict[int, str]:
    """The bits of each symbol."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(codes[0], 1):
        for _ in range(count):
            out[codes[1][k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


_LUMINANCE_WORDS = _words(DC_LUMINANCE), _words(AC_LUMINANCE)
_CHROMINANCE_WORDS = _words(DC_CHROMINANCE), _words(AC_CHROMINANCE)


def part(code: int, body: bytes) -> bytes:
    return b"\xff" + bytes([code]) + pack(">H", len(body) + 2) + body


def headers(width: int, height: int, luminance: bytes, chrominance: bytes, factors: tuple[int, int] = (1, 1), restart: int = 0) -> bytes:
    """All of a three-component file in front of its scan; tables in zigzag order, ``factors`` of the first component."""
    dqt = b"\0" + luminance + b"\1" + chrominance
    dht = b"".join(bytes([k]) + bytes(counts) + bytes(symbols) for k, (counts, symbols) in CODES)
    sof = pack(">BHHB", 8, height, width, 3) + bytes((1, factors[0] << 4 | factors[1], 0, 2, 0x11, 1, 3, 0x11, 1))
    app = b"JFIF\0" + pack(">HBHHBB", 0x101, 0, 1, 1, 0, 0)
    dri = part(0xDD, pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + part(0xE0, app) + part(0xDB, dqt) + part(0xC0, sof) + dri + part(0xC4, dht) + part(0xDA, bytes((3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0)))


def file(px: np.ndarray, quality: int = 75) -> bytes:
    """A file of (height, width, 3) with chroma of full size."""
    height, width, _ = px.shape
    r, g, b = (px[:, :, k].astype(float) for k in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128]
    tables = [_scaled(LUMINANCE, quality), _scaled(CHROMINANCE, quality), _scaled(CHROMINANCE, quality)]
    rows, columns = -(-height // 8), -(-width // 8)
    blocks = []
    for plane, table in zip(planes, tables, strict=True):
        full = np.pad(plane, ((0, rows * 8 - height), (0, columns * 8 - width)), mode="edge") - 128
        x = full.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3)
        y = np.einsum("ik,rckl,jl->rcij", COSINE, x, COSINE).reshape(rows, columns, 64)
        q = np.round(y / table, 9)  # halves away from zero, whatever the last bits of the sums
        blocks.append(np.trunc(q + np.copysign(0.5, q))[:, :, _ORDER].astype(int))
    words = [_LUMINANCE_WORDS, _CHROMINANCE_WORDS, _CHROMINANCE_WORDS]
    signed = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    out, before = [], [0, 0, 0]
    for at in np.ndindex(rows, columns):
        for k in range(3):
            c = blocks[k][at].tolist()
            step, before[k] = c[0] - before[k], c[0]
            dc, ac = words[k]
            out += [dc[abs(step).bit_length()], signed(step)]
            run = 0
            for v in c[1:]:
                if not v:
                    run += 1
                    continue
                out += [ac[0xF0]] * (run // 16) + [ac[run % 16 << 4 | abs(v).bit_length()], signed(v)]
                run = 0
            if run:
                out.append(ac[0])
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    lum, chroma = (bytes(tables[k][_ORDER].tolist()) for k in (0, 1))
    return headers(width, height, lum, chroma) + scan + b"\xff\xd9"


def from_scan(width: int, height: int, kind: int, quality: int, restart: int | None, tables: bytes | None, scan: bytes) -> bytes | None:
    """The file of an RTP image (RFC 2435): types 0 and 1, and 64 and 65 with restart markers; null for other types or missing tables."""
    if kind & 63 not in (0, 1) or kind > 127 or not (width and height):
        return None
    if quality >= 128:
        if not tables or len(tables) < 128:
            return None
        lum, chroma = tables[:64], tables[64:128]
    elif 1 <= quality <= 99:
        lum, chroma = (bytes(_scaled(t, quality)[_ORDER].tolist()) for t in (LUMINANCE, CHROMINANCE))
    else:
        return None
    tail = b"" if scan.endswith(b"\xff\xd9") else b"\xff\xd9"
    return headers(width, height, lum, chroma, (2, 1 + (kind & 1)), restart or 0) + scan + tail


def rtp_files(scans: DataFrame) -> DataFrame:
    """Adds content, the JPEG file, to the images that ``payloads.jpeg_scans`` gives; null where there is none."""
    @F.pandas_udf("binary")
    def build(w: pd.Series, h: pd.Series, kind: pd.Series, quality: pd.Series, restart: pd.Series, tables: pd.Series, scan: pd.Series) -> pd.Series:
        return pd.Series([from_scan(int(a), int(b), int(c), int(d), None if pd.isna(e) else int(e), f, g) for a, b, c, d, e, f, g in zip(w, h, kind, quality, restart, tables, scan, strict=True)], dtype=object)

    return scans.withColumn("content", build("width", "height", "type", "quality", "restart", "tables", "scan"))


def coefficients(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, component, by, bx, coeff): the quantised blocks of each sequential file, zigzag order; others give no row."""
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, files.schema[key].dataType), *StructType.fromDDL("component int, by int, bx int, coeff array<int>").fields])

    def run(batches):
        for b in batches:
            for i, data in enumerate(b.column(1)):
                frame = decode(data.as_py()) if data.is_valid else None
                for c, blocks in enumerate(frame.blocks if frame else ()):
                    y, x = (a.ravel().astype(np.int32) for a in np.indices(blocks.shape[:2]))
                    coeff = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 64), pa.array(blocks.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(x), i))), pa.array(np.full(len(x), c, np.int32)), pa.array(y), pa.array(x), coeff], names=schema.names)

    return files.select(key, content).mapInArrow(run, schema)
