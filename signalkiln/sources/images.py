"""Pixels of bitmap, PNG and JPEG files: rows out of files and files out of rows, one image at a time in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .containers import png, sniff


def bmp_array(d: bytes) -> np.ndarray | None:
    """(height, width, 3) of an uncompressed bitmap of 24 or 32 bits; rows run upwards unless the height is negative."""
    if len(d) < 54 or d[:2] != b"BM":
        return None
    start, width, height, depth, packed = unpack_from("<I", d, 10)[0], *unpack_from("<ii", d, 18), unpack_from("<H", d, 28)[0], unpack_from("<I", d, 30)[0]
    if depth not in (24, 32) or packed not in (0, 3) or width <= 0:
        return None
    rows, stride = abs(height), (width * depth // 8 + 3) // 4 * 4
    if start + rows * stride > len(d):
        return None
    px = np.frombuffer(d, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    return px[::-1] if height > 0 else px


def bmp_file(px: np.ndarray) -> bytes:
    """A 24-bit bitmap of (height, width, 3)."""
    height, width, _ = px.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = px[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + pack("<IHHI", 54 + rows.size, 0, 0, 54) + pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of a PNG image without its filter."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line), np.uint8)
    for i in range(len(line)):
        a, b = int(out[i - step]) if i >= step else 0, int(above[i])
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = int(above[i - step]) if i >= step else 0
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (int(line[i]) + guess) & 255
    return out


def png_array(d: bytes) -> np.ndarray | None:
    """(height, width, 3) of a PNG of 8 bits a component, not interlaced; alpha is left out, grey and palettes become three components."""
    head, packed, palette = None, [], None
    for _, name, at, size, whole in png(d):
        if not whole:
            return None
        if name == "IHDR":
            head = unpack_from(">IIBBBBB", d, at)
        elif name == "PLTE":
            palette = np.frombuffer(d, np.uint8, size, at).reshape(-1, 3)
        elif name == "IDAT":
            packed.append(d[at : at + size])
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, step = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    px = out.reshape(height, width, step)
    if head[3] == 3:
        return None if palette is None else palette[px[:, :, 0]]
    return px[:, :, :3] if step >= 3 else np.repeat(px[:, :, :1], 3, axis=2)


def png_file(px: np.ndarray) -> bytes:
    """A PNG of (height, width, 3), lines without filter."""
    height, width, _ = px.shape
    raw = np.zeros((height, 1 + width * 3), np.uint8)
    raw[:, 1:] = px.reshape(height, -1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return pack(">I", len(body)) + name + body + pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


ARRAYS: dict[str, Callable[[bytes], np.ndarray | None]] = {"bmp": bmp_array, "png": png_array, "jpeg": jpeg.array}
FILES: dict[str, Callable[[np.ndarray], bytes]] = {"bmp": bmp_file, "png": png_file, "jpeg": jpeg.file}


def pixels(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, x, y, c0, c1, c2) of each bitmap, PNG or baseline JPEG; files of other kinds and broken ones give no row."""
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, files.schema[key].dataType), *StructType.fromDDL("x int, y int, c0 int, c1 int, c2 int").fields])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (name, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                px = ARRAYS[name](data.as_py()) if name in ARRAYS and data.is_valid else None
                if px is None or not px.size:
                    continue
                y, x = (a.ravel() for a in np.indices(px.shape[:2], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(x), i))), pa.array(x), pa.array(y), *(pa.array(px[:, :, k].ravel().astype(np.int32)) for k in range(3))], names=schema.names)

    return files.select(key, sniff(F.col(content)).alias("format"), content).mapInArrow(run, schema)


def image_files(rows: DataFrame, kind: str, key: str = "image_id") -> DataFrame:
    """(key, content): an image file of the pixels (x, y, c0, c1, c2) of each key; a pixel that is missing is black.

    Pixels are dealt by image, sorted and read as they pass; those of one image are held.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("content", BinaryType())])
    write = FILES[kind]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(parts: list[pa.RecordBatch]) -> bytes:
        x, y, *c = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(1, 6))
        px = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        for k in range(3):
            px[y, x, k] = c[k]
        return write(px)

    def run(batches) -> Iterator[pa.RecordBatch]:
        kind_of_key, held = None, []
        emit = lambda done: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind_of_key), pa.array([v for _, v in done], pa.binary())], names=schema.names)
        for b in batches:
            kind_of_key, done = b.schema.types[0], []
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode("encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                some = b.slice(low, high - low)
                if held and not held[0].column(0)[0].equals(some.column(0)[0]):
                    done.append((held[0].column(0)[0].as_py(), one(held)))
                    held = []
                held.append(some)
            yield emit(done)
        if held:
            yield emit([(held[0].column(0)[0].as_py(), one(held))])

    return rows.select(key, "x", "y", "c0", "c1", "c2").repartition(n, key).sortWithinPartitions(key).mapInArrow(run, schema)
