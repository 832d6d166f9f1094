"""Tracks of container files: one row a track, from the headers that a walker finds in one file."""

from __future__ import annotations

from collections.abc import Iterator
from struct import unpack_from

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import int_bytes
from .containers import bmff, box, ebml, ogg, riff, sniff

#: track id, media type, codec, rate, width, height, channels, bit depth, samples, duration in microseconds, language or name
Track = tuple[int, str, str, float | None, int | None, int | None, int | None, int | None, int | None, int | None, str | None]
SCHEMA = "track_id int, media_type string, codec string, rate double, width int, height int, channels int, bit_depth int, sample_count bigint, duration_us bigint, name string"
#: Media types of handler codes, stream codes and track numbers (fixed values of the formats).
HANDLERS = {"vide": "video", "soun": "audio", "text": "text", "sbtl": "text", "subt": "text"}
STREAMS = {"vids": "video", "auds": "audio", "txts": "text"}
EBML_TYPES = {1: "video", 2: "audio", 0x11: "text"}


def bmff_tracks(d: bytes) -> Iterator[Track]:
    """From the tkhd, mdhd, hdlr, stsd, stts and stsz boxes of each trak."""
    track: dict[str, int] = {}
    for depth, name, at, _, _ in [*bmff(d), (0, "trak", 0, 0, True)]:
        if name == "trak":
            if track:
                yield _bmff_track(d, track)
            track = {"trak": at} if depth else {}
        elif track and name in ("tkhd", "mdhd", "hdlr", "stsd", "stts", "stsz", "stz2"):
            track.setdefault(name, at)


def _bmff_track(d: bytes, t: dict[str, int]) -> Track:
    u32 = lambda at: unpack_from(">I", d, at)[0]
    wide = lambda name: d[t[name]] == 1
    number = u32(t["tkhd"] + (20 if wide("tkhd") else 12)) if "tkhd" in t else 0
    width = height = channels = depth = scale = duration = None
    rate, codec, language = None, "", None
    if "tkhd" in t:
        w, h = unpack_from(">II", d, t["tkhd"] + (88 if wide("tkhd") else 76))
        width, height = w >> 16, h >> 16
    if "mdhd" in t:
        if wide("mdhd"):
            scale, length = u32(t["mdhd"] + 20), unpack_from(">Q", d, t["mdhd"] + 24)[0]
        else:
            scale, length = u32(t["mdhd"] + 12), u32(t["mdhd"] + 16)
        duration = length * 1_000_000 // scale if scale else None
        code = unpack_from(">H", d, t["mdhd"] + (32 if wide("mdhd") else 20))[0]
        language = "".join(chr(96 + (code >> s & 31)) for s in (10, 5, 0))
    kind = HANDLERS.get(d[t["hdlr"] + 8 : t["hdlr"] + 12].decode("latin-1"), "data") if "hdlr" in t else "data"
    if "stsd" in t and u32(t["stsd"] + 4):
        entry = t["stsd"] + 8
        codec = d[entry + 4 : entry + 8].decode("latin-1")
        if kind == "audio":
            channels, depth = unpack_from(">HH", d, entry + 24)
            rate = u32(entry + 32) / 65536
        elif kind == "video":
            width, height = unpack_from(">HH", d, entry + 32)
            depth = unpack_from(">H", d, entry + 82)[0]
    count = u32(t["stsz"] + 8) if "stsz" in t else None
    if kind == "video" and count and duration:
        rate = count * 1e6 / duration
    return number, kind, codec, rate, width or None, height or None, channels, depth, count, duration, language


def ebml_tracks(d: bytes) -> Iterator[Track]:
    """From the track entries; the segment's duration counts in its time code scale; samples are the blocks of the track."""
    entry: dict[str, object] = {}
    entries: list[dict] = []
    scale, duration = 1_000_000, None
    blocks: dict[int, int] = {}
    for _, name, at, size, _ in ebml(d):
        raw = d[at : at + size]
        whole = int.from_bytes(raw)
        if name == "2ad7b1":
            scale = whole
        elif name == "4489":
            duration = unpack_from(">d" if size == 8 else ">f", raw)[0]
        elif name == "ae":
            entry = {}
            entries.append(entry)
        elif name in ("a1", "a3") and raw:
            n = 9 - raw[0].bit_length()
            number = int.from_bytes(raw[:n]) & ((1 << 7 * n) - 1)
            blocks[number] = blocks.get(number, 0) + 1
        elif entries and name in ("d7", "83", "b0", "ba", "9f", "6264", "23e383"):
            entry[name] = whole
        elif entries and name in ("86", "536e", "22b59c"):
            entry[name] = raw.rstrip(b"\0").decode("utf-8", "replace")
        elif entries and name == "b5":
            entry[name] = unpack_from(">d" if size == 8 else ">f", raw)[0]
    us = None if duration is None else round(duration * scale / 1000)
    for e in entries:
        kind = EBML_TYPES.get(e.get("83"), "data")
        rate = e.get("b5", 8000.0) if kind == "audio" else 1e9 / e["23e383"] if e.get("23e383") else None
        number = e.get("d7", 0)
        yield number, kind, e.get("86", ""), rate, e.get("b0"), e.get("ba"), e.get("9f", 1) if kind == "audio" else None, e.get("6264"), blocks.get(number, 0), us, e.get("536e") or e.get("22b59c")


def riff_tracks(d: bytes) -> Iterator[Track]:
    """A WAVE file's one track, or those of an AVI file's stream headers; samples are the chunks `NNdc`, `NNdb`, `NNwb`, `NNtx`."""
    headers: list[tuple[int, int]] = []
    formats: list[tuple[int, int]] = []
    chunks: dict[int, int] = {}
    data = 0
    wave = d[8:12] == b"WAVE"
    for _, name, at, size, _ in riff(d):
        if name == "strh":
            headers.append((at, size))
        elif name in ("strf", "fmt "):
            formats.append((at, size))
        elif name == "data":
            data = size
        elif name[:2].isdigit() and name[2:] in ("dc", "db", "wb", "tx"):
            chunks[int(name[:2])] = chunks.get(int(name[:2]), 0) + 1
    if wave and formats:
        at, size = formats[0]
        code, channels, rate, _, align, depth = unpack_from("<HHIIHH", d, at)
        count = data // align if align else None
        yield 0, "audio", f"{code:04x}", float(rate), None, None, channels, depth, count, count * 1_000_000 // rate if rate and count is not None else None, None
    for i, (at, _) in enumerate(headers) if not wave else ():
        kind, codec = (d[at + k : at + k + 4].decode("latin-1").rstrip("\0") for k in (0, 4))
        scale, rate, _, length = unpack_from("<IIII", d, at + 20)
        width = height = channels = depth = None
        if i < len(formats):
            f = formats[i][0]
            if kind == "vids":
                width, height, _, depth = unpack_from("<iiHH", d, f + 4)
                height = abs(height)
            elif kind == "auds":
                channels, depth = unpack_from("<H", d, f + 2)[0], unpack_from("<H", d, f + 14)[0]
                codec = codec or f"{unpack_from('<H', d, f)[0]:04x}"
        per = rate / scale if scale else None
        yield i, STREAMS.get(kind, "data"), codec, per, width, height, channels, depth, chunks.get(i, 0), round(length * 1e6 / per) if per else None, None


#: First bytes of the first packet of an Ogg stream, its codec and media type (fixed values of the formats).
OGG_CODECS = ((b"\x01vorbis", "vorbis", "audio"), (b"OpusHead", "opus", "audio"), (b"\x80theora", "theora", "video"), (b"\x7fFLAC", "flac", "audio"), (b"Speex   ", "speex", "audio"))


def ogg_stream_tracks(d: bytes) -> Iterator[Track]:
    """By serial number; the codec and its rate from the first page, the duration from the last granule of audio."""
    first: dict[int, bytes] = {}
    last: dict[int, int] = {}
    pages: dict[int, int] = {}
    for _, name, at, size, _ in ogg(d):
        _, _, serial, _, granule = name.split(":")
        s = int(serial)
        first.setdefault(s, d[at : at + size])
        last[s] = max(last.get(s, 0), int(granule))
        pages[s] = pages.get(s, 0) + 1
    for i, (s, head) in enumerate(first.items()):
        codec, kind = next(((c, k) for magic, c, k in OGG_CODECS if head.startswith(magic)), ("", "data"))
        rate = channels = width = height = None
        if codec == "vorbis" and len(head) >= 16:
            channels, rate = head[11], float(unpack_from("<I", head, 12)[0])
        elif codec == "opus" and len(head) >= 12:
            channels, rate = head[9], 48000.0
        elif codec == "theora" and len(head) >= 20:
            width, height = int.from_bytes(head[14:17]), int.from_bytes(head[17:20])
        us = round(last[s] * 1e6 / rate) if kind == "audio" and rate else None
        yield i, kind, codec, rate, width, height, channels, None, pages[s], us, str(s)


READERS = {"bmff": bmff_tracks, "ebml": ebml_tracks, "riff": riff_tracks, "ogg": ogg_stream_tracks}


def tracks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, format, track columns) of each file; formats without tracks and null contents give no row.

    One file is in memory at a time, and each is read by one task.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, files.schema[key].dataType), *StructType.fromDDL("format string, " + SCHEMA).fields])

    def run(batches):
        kinds = [to_arrow_type(f.dataType) for f in schema.fields[2:]]
        for b in batches:
            index, formats, rows = [], [], []
            for i, (name, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                for t in READERS[name](data.as_py()) if name in READERS and data.is_valid else ():
                    index.append(i)
                    formats.append(name)
                    rows.append(t)
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), pa.array(formats, pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return files.select(key, sniff(F.col(content)).alias("format"), content).mapInArrow(run, schema)


def bmff_file(sample_bytes: Column, sizes: Column, scale: int, step: int, width: int, height: int, codec: str = "mp4v") -> Column:
    """A file of one video track: ftyp, mdat with the samples, moov with their tables. ``sizes``: array<int> of the samples' bytes."""
    n = lambda *v: F.concat(*(int_bytes(x if isinstance(x, Column) else F.lit(x), 4) for x in v))
    zero = lambda k: F.lit(bytes(k))
    count = F.size(sizes)
    head = box("ftyp", F.lit(b"isom"), n(512), F.lit(b"isommp42"))
    media = box("mdat", sample_bytes)
    tkhd = box("tkhd", n(7, 0, 0, 1, 0), n(count * step), zero(52), n(width << 16, height << 16))
    mdhd = box("mdhd", n(0, 0, 0, scale), n(count * step), int_bytes(F.lit(0x55C4), 2), zero(2))
    hdlr = box("hdlr", n(0, 0), F.lit(b"vide"), zero(13))
    entry = box(codec, zero(6), int_bytes(F.lit(1), 2), zero(16), int_bytes(F.lit(width), 2), int_bytes(F.lit(height), 2), n(0x480000, 0x480000, 0), int_bytes(F.lit(1), 2), zero(32), int_bytes(F.lit(24), 2), int_bytes(F.lit(0xFFFF), 2))
    table = F.unhex(F.array_join(F.transform(sizes, lambda x: F.hex(int_bytes(x, 4))), ""))
    stbl = box("stbl", box("stsd", n(0, 1), entry), box("stts", n(0, 1), n(count, step)), box("stsz", n(0, 0), n(count), table), box("stsc", n(0, 1, 1), n(count, 1)), box("stco", n(0, 1), n(F.octet_length(head) + 8)))
    return F.concat(head, media, box("moov", box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", stbl)))))
