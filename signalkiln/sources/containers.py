"""Container files as rows: one walker a format turns bytes into nodes; tracks and samples are read from these.

Files come from Spark's ``binaryFile`` reader, so any store that Spark reads will do, and a name or size
filter reaches the listing. A walker sees one file; files are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import unpack_from

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bits_msb, int_bytes, join_bytes, let, u8, u16, uint

Node = tuple[int, str, int, int, bool]  # depth, identifier, data offset, data size, complete


def _end(at: int, size: int, limit: int) -> tuple[int, bool]:
    return (at + size, True) if at + size <= limit else (limit, False)


def riff(d: bytes, at: int = 0, limit: int | None = None, depth: int = 0) -> Iterator[Node]:
    """Chunks; RIFF, RF64 and LIST hold a subtype and further chunks; odd sizes are padded."""
    limit = len(d) if limit is None else limit
    wide = unpack_from("<Q", d, 20 + 8)[0] if d[:4] == b"RF64" and len(d) >= 36 else None
    while at + 8 <= limit:
        name, size = d[at : at + 4].decode("latin-1"), unpack_from("<I", d, at + 4)[0]
        if size == 0xFFFFFFFF:
            size = (wide or limit - at - 8) if name == "data" else limit - at - 8
        end, whole = _end(at + 8, size, limit)
        if name in ("RIFF", "RF64", "LIST"):
            yield depth, f"{name}:{d[at + 8 : at + 12].decode('latin-1')}", at + 8, size, whole
            yield from riff(d, at + 12, end, depth + 1)
        else:
            yield depth, name, at + 8, size, whole
        at = end + size % 2


PARENT_BOXES = frozenset("moov trak mdia minf stbl dinf edts mvex moof traf mfra udta tref meta".split())


def bmff(d: bytes, at: int = 0, limit: int | None = None, depth: int = 0) -> Iterator[Node]:
    """Boxes: size 1 means a 64-bit size behind the name, size 0 up to the end; uuid boxes carry 16 more bytes."""
    limit = len(d) if limit is None else limit
    while at + 8 <= limit:
        size, name, head = unpack_from(">I", d, at)[0], d[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1 and at + 16 <= limit:
            size, head = unpack_from(">Q", d, at + 8)[0], 16
        elif size == 0:
            size = limit - at
        if name == "uuid":
            head += 16
            name = "uuid:" + d[at + head - 16 : at + head].hex()
        if size < head:
            yield depth, name, at + head, 0, False
            return
        end, whole = _end(at, size, limit)
        yield depth, name, at + head, size - head, whole
        if name in PARENT_BOXES:
            yield from bmff(d, at + head + 4 * (name == "meta"), end, depth + 1)
        at = end


#: EBML elements that hold elements: header, segment, info, cluster, block group, tracks, track entry, video, audio, cues, tags.
EBML_PARENTS = frozenset(("1a45dfa3", "18538067", "1549a966", "1f43b675", "a0", "1654ae6b", "ae", "e0", "e1", "1c53bb6b", "1254c367"))


def ebml(d: bytes, at: int = 0, limit: int | None = None, depth: int = 0) -> Iterator[Node]:
    """Elements: an id of 1 to 4 bytes with its marker, a size of 1 to 8 without; all ones means unknown."""
    limit = len(d) if limit is None else limit
    while at < limit:
        n = 9 - d[at].bit_length()
        if n > 4 or at + n >= limit:
            return
        name, at = d[at : at + n].hex(), at + n
        m = 9 - d[at].bit_length()
        if m > 8 or at + m > limit:
            return
        size = int.from_bytes(d[at : at + m]) & ((1 << 7 * m) - 1)
        unknown, at = size == (1 << 7 * m) - 1, at + m
        end, whole = (limit, True) if unknown else _end(at, size, limit)
        yield depth, name, at, end - at if unknown else size, whole
        if name in EBML_PARENTS:
            yield from ebml(d, at, end, depth + 1)
        at = end


def ogg(d: bytes) -> Iterator[Node]:
    """Pages, named OggS:flags:serial:sequence:granule; a page without the capture pattern is searched for."""
    at = d.find(b"OggS")
    while 0 <= at <= len(d) - 27:
        flags, granule, serial, sequence, _, n = unpack_from("<xBqIIIB", d, at + 4)
        size, head = sum(d[at + 27 : at + 27 + n]), 27 + n
        end, whole = _end(at + head, size, len(d))
        yield 0, f"OggS:{flags}:{serial}:{sequence}:{granule}", at + head, size, whole
        at = d.find(b"OggS", end)


def asf(d: bytes, at: int = 0, limit: int | None = None, depth: int = 0) -> Iterator[Node]:
    """Objects: 16-byte identifier, 64-bit size with the 24-byte head; the header object holds objects behind 6 bytes."""
    limit = len(d) if limit is None else limit
    while at + 24 <= limit:
        name, size = d[at : at + 16].hex(), unpack_from("<Q", d, at + 16)[0]
        if size < 24:
            yield depth, name, at + 24, 0, False
            return
        end, whole = _end(at, size, limit)
        yield depth, name, at + 24, size - 24, whole
        if name == "3026b2758e66cf11a6d900aa0062ce6c":
            yield from asf(d, at + 30, end, depth + 1)
        at = end


def mxf(d: bytes) -> Iterator[Node]:
    """Key, length, value triplets; lengths by the basic encoding rules, the indefinite form ends the walk."""
    at = d.find(b"\x06\x0e\x2b\x34")
    while 0 <= at <= len(d) - 17:
        name, at = d[at : at + 16].hex(), at + 16
        size, at = d[at], at + 1
        if size >= 128:
            n = size & 127
            if not 0 < n <= 8:
                return
            size, at = int.from_bytes(d[at : at + n]), at + n
        end, whole = _end(at, size, len(d))
        yield 0, name, at, size, whole
        at = end


def gxf(d: bytes) -> Iterator[Node]:
    """Packets of a 16-byte head: 00 00 00 00 01, type, length with the head, reserved, E1 E2."""
    at = 0
    while at + 16 <= len(d) and d[at : at + 5] == b"\0\0\0\0\1" and d[at + 14 : at + 16] == b"\xe1\xe2":
        size = max(unpack_from(">I", d, at + 6)[0], 16)
        end, whole = _end(at, size, len(d))
        yield 0, f"{d[at + 5]:02x}", at + 16, size - 16, whole
        at = end


def real(d: bytes) -> Iterator[Node]:
    """Chunks of a name and a big-endian size that counts the 8-byte head; a size of 0 runs to the end."""
    at = 0
    while at + 8 <= len(d):
        size = unpack_from(">I", d, at + 4)[0]
        size = max(size, 8) if size else len(d) - at
        end, whole = _end(at, size, len(d))
        yield 0, d[at : at + 4].decode("latin-1"), at + 8, size - 8, whole
        at = end


#: First bytes of NUT's main, stream, syncpoint, index and info packets (fixed values of the format).
NUT_CODES = {b"NM\x7aV\x1fI\x04\xad": "main", b"NS\x11@[\xf2\xf9\xdb": "stream", b"NK\xe4\xad\xee\xcaEi": "syncpoint", b"NX\xddg/#\xe6N": "index", b"NI\xabh\xb5\x96\xbax": "info"}


def varint(d: bytes, at: int) -> tuple[int, int]:
    """Seven bits a byte, the high bit continues; the value and the place behind it."""
    v = 0
    while at < len(d):
        v = v << 7 | d[at] & 127
        at += 1
        if d[at - 1] < 128:
            break
    return v, at


def nut(d: bytes) -> Iterator[Node]:
    """Packets with a startcode; coded frames between them are not told apart."""
    at = 0
    while at + 9 <= len(d):
        name = NUT_CODES.get(d[at : at + 8])
        if name is None:
            at = min((i for c in NUT_CODES if (i := d.find(c, at + 1)) >= 0), default=len(d))
            continue
        size, start = varint(d, at + 8)
        end, whole = _end(start, size, len(d))
        yield 0, name, start, size, whole
        at = max(end, at + 9)


def start_codes(d: bytes) -> Iterator[Node]:
    """MPEG program and elementary streams: packets by 00 00 01; PES packets give their size, others end at the next."""
    at = d.find(b"\0\0\1")
    while 0 <= at <= len(d) - 4:
        code = d[at + 3]
        if code == 0xBA:
            two = at + 14 <= len(d) and d[at + 4] >> 6 == 1
            end, whole = _end(at, 14 + (d[at + 13] & 7) if two else 12, len(d))
        elif code >= 0xBB and at + 6 <= len(d):
            size = unpack_from(">H", d, at + 4)[0]
            nxt = d.find(b"\0\0\1", at + 6)
            end, whole = _end(at + 6, size, len(d)) if size else (nxt if nxt >= 0 else len(d), True)
        else:
            nxt = d.find(b"\0\0\1", at + 4)
            end, whole = (nxt if nxt >= 0 else len(d)), True
        head = 6 if code >= 0xBB else 4
        yield 0, f"{code:02x}", min(at + head, end), max(end - at - head, 0), whole
        at = d.find(b"\0\0\1", end)


def _crc8(d: bytes) -> int:
    """Of the polynomial x^8 + x^2 + x + 1."""
    r = 0
    for x in d:
        r ^= x
        for _ in range(8):
            r = (r << 1 ^ 0x07 if r & 0x80 else r << 1) & 0xFF
    return r


def _flac_header(d: bytes, at: int) -> int | None:
    """The number of the frame or sample that a frame header at ``at`` counts; null where none stands or its check fails."""
    if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8 or d[at + 3] & 1:
        return None
    size, rate = d[at + 2] >> 4, d[at + 2] & 15
    if not size or rate == 15 or d[at + 3] >> 4 > 10:
        return None
    lead = d[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if more < 0 or lead in (0xFE, 0xFF) and more > 6:
        return None
    end = at + 5 + more + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(d) or _crc8(d[at:end]) != d[end]:
        return None
    number = lead if lead < 0x80 else lead & (0x3F >> more)
    for x in d[at + 5 : at + 5 + more]:
        number = number << 6 | x & 0x3F
    return number


def flac(d: bytes) -> Iterator[Node]:
    """Metadata blocks by type number, then the frames by the number that each counts; a frame ends where a header with a right check begins."""
    if d[:4] != b"fLaC":
        return
    at, last = 4, False
    while not last and at + 4 <= len(d):
        last, kind, size = d[at] > 127, d[at] & 127, int.from_bytes(d[at + 1 : at + 4])
        end, whole = _end(at + 4, size, len(d))
        yield 0, str(kind), at + 4, size, whole
        at = end
    number = _flac_header(d, at)
    if at < len(d) and number is None:
        yield 0, "frames", at, len(d) - at, True
    while number is not None:
        nxt, following = at + 2, None
        while following is None and (nxt := d.find(b"\xff", nxt)) >= 0:
            following = _flac_header(d, nxt)
            nxt += following is None
        end = len(d) if following is None else nxt
        yield 0, f"frame:{number}", at, end - at, True
        at, number = end, following


def png(d: bytes) -> Iterator[Node]:
    at = 8
    while at + 8 <= len(d):
        size = unpack_from(">I", d, at)[0]
        end, whole = _end(at + 8, size + 4, len(d))
        yield 0, d[at + 4 : at + 8].decode("latin-1"), at + 8, size, whole
        at = end


def jpeg(d: bytes) -> Iterator[Node]:
    """Marker segments; the entropy-coded bytes behind a start of scan count as its last part."""
    at = 0
    while at + 2 <= len(d) and d[at] == 0xFF:
        code = d[at + 1]
        if code in (0xD8, 0xD9) or 0xD0 <= code <= 0xD7 or code == 1:
            yield 0, f"{code:02x}", at + 2, 0, True
            at += 2
            continue
        if at + 4 > len(d):
            return
        end, whole = _end(at + 2, unpack_from(">H", d, at + 2)[0], len(d))
        if code == 0xDA:
            while end < len(d) - 1 and not (d[end] == 0xFF and d[end + 1] != 0 and not 0xD0 <= d[end + 1] <= 0xD7):
                end += 1
        yield 0, f"{code:02x}", at + 4, end - at - 4, whole
        at = end


def bmp(d: bytes) -> Iterator[Node]:
    if len(d) >= 18:
        start, head = unpack_from("<I", d, 10)[0], unpack_from("<I", d, 14)[0]
        yield 0, "header", 14, head, 14 + head <= len(d)
        yield 0, "pixels", start, max(len(d) - start, 0), start <= len(d)


WALKERS = {"riff": riff, "bmff": bmff, "ebml": ebml, "ogg": ogg, "asf": asf, "mxf": mxf, "gxf": gxf, "real": real, "nut": nut, "mpeg": start_codes, "flac": flac, "png": png, "jpeg": jpeg, "bmp": bmp}

#: Magic bytes (hexadecimal), their place and the format; the first that fits counts.
MAGIC = [("52494646", 0, "riff"), ("52463634", 0, "riff"), ("66747970", 4, "bmff"), ("6D6F6F76", 4, "bmff"), ("1A45DFA3", 0, "ebml"), ("4F676753", 0, "ogg"), ("3026B275", 0, "asf"), ("060E2B34", 0, "mxf"), ("0000000001BC", 0, "gxf"), ("2E524D46", 0, "real"), ("6E75742F", 0, "nut"), ("000001", 0, "mpeg"), ("664C6143", 0, "flac"), ("89504E47", 0, "png"), ("FFD8", 0, "jpeg"), ("424D", 0, "bmp"), ("23217274", 0, "dump"), ("47", 0, "ts")]


def sniff(content: Column) -> Column:
    """Name of the format that the first bytes tell, or null."""
    out = None
    for magic, at, name in MAGIC:
        hit = F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of the files below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def write_files(files: DataFrame, path: str, suffix: str, key: str = "path", content: str = "content") -> DataFrame:
    """(key, file, bytes) of the files written below ``path``, one a row, named by their keys; nulls are left out.

    A task that runs again writes the same names anew.
    """
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, files.schema[key].dataType), *StructType.fromDDL("file string, bytes bigint").fields])
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        for b in batches:
            index, names, sizes = [], [], []
            for i, (k, data) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                if not data.is_valid:
                    continue
                with store.open_output_stream(f"{root}/{k}{suffix}") as out:
                    out.write(data.as_buffer())
                index.append(i)
                names.append(f"{uri}/{k}{suffix}")
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=schema.names)

    return files.select(key, content).mapInArrow(run, schema)


_SCHEMA = "ord int, depth int, parent int, identifier string, data_offset bigint, data_size bigint, complete boolean"


def nodes(files: DataFrame, format: str | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(key, format, ord, depth, parent, identifier, data_offset, data_size, complete) of each file.

    Without ``format`` each file's first bytes tell it; files of no known format and null contents give
    no row. A truncated node is given with complete = false.
    """
    from pyspark.sql.types import StructField, StructType

    kind = F.lit(format) if format else sniff(F.col(content))
    schema = StructType([StructField(key, files.schema[key].dataType), *StructType.fromDDL("format string, " + _SCHEMA).fields])

    def run(batches):
        for b in batches:
            index, formats, rows = [], [], []
            for i, (f, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                if f not in WALKERS or not data.is_valid:
                    continue
                above: list[int] = []
                for k, (depth, *rest) in enumerate(WALKERS[f](data.as_py())):
                    del above[depth:]
                    rows.append((k, depth, above[-1] if above else -1, *rest))
                    above.append(k)
                    index.append(i)
                    formats.append(f)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), pa.array(formats, pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    return files.select(key, kind.alias("__format"), content).mapInArrow(run, schema)


def read_at(content: Column, offset: Column, size: Column) -> Column:
    return F.substring(content, (offset + 1).cast("int"), size.cast("int"))


def write_at(content: Column, offset: Column, data: Column) -> Column:
    """``content`` with bytes replaced; what is written behind its end is appended."""
    return F.overlay(content, data, (offset + 1).cast("int"), F.octet_length(data))


# --- transport stream: fixed units, so no walker is needed ----------------------------------------


def ts_units(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, unit, error, starts, priority, pid, scrambling, adaptation, counter, pcr, payload) of 188-byte units.

    Pure column expressions. Units of 192 bytes (a time stamp of 4 in front) and of 204 (16 of error
    correction behind) are told by their sync bytes. Units without the sync byte are left out.
    """
    sync = lambda at: F.substring(content, at + 1, 1) == F.lit(b"G")
    short = F.octet_length(content) < 189
    step = F.when(sync(0) & (short | sync(188)), 188).when(sync(4) & sync(196), 192).when(sync(0) & sync(204), 204).otherwise(188)
    sized = files.select(key, content, step.alias("__step")).withColumn("__at", F.when(F.col("__step") == 192, 5).otherwise(1))
    n = F.floor((F.octet_length(content) - F.col("__at") - 187) / F.col("__step")).cast("int")
    unit = F.explode(F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("unit"), F.substring(F.col(content), i * F.col("__step") + F.col("__at"), F.lit(188)).alias("raw")))))
    rows = sized.select(key, unit.alias("u")).select(key, "u.unit", F.col("u.raw").alias("raw")).where(u8(F.col("raw"), 0) == 0x47)
    raw = F.col("raw")
    control = bits_msb(raw, 26, 2)
    room = F.when(control >= 2, 1 + u8(raw, 4)).otherwise(0)
    has_pcr = (control >= 2) & (u8(raw, 4) > 6) & (u8(raw, 5).bitwiseAND(F.lit(16)) != 0)
    return rows.select(
        key, "unit", (bits_msb(raw, 8, 1) == 1).alias("error"), (bits_msb(raw, 9, 1) == 1).alias("starts"), (bits_msb(raw, 10, 1) == 1).alias("priority"), bits_msb(raw, 11, 13).cast("int").alias("pid"),
        bits_msb(raw, 24, 2).cast("int").alias("scrambling"), control.cast("int").alias("adaptation"), bits_msb(raw, 28, 4).cast("int").alias("counter"),
        F.when(has_pcr, bits_msb(raw, 48, 33) * 300 + bits_msb(raw, 87, 9)).alias("pcr"),
        F.when(control % 2 == 1, F.substring(raw, (5 + room).cast("int"), F.lit(188))).alias("payload"),
    )


def ts_section(payload: Column) -> Column:
    """The section behind the pointer field of a unit that starts one."""
    return F.substring(payload, (2 + u8(payload, 0)).cast("int"), F.lit(184))


def program_map(section: Column) -> Column:
    """array<struct<program, pid>> of a program association section (table 0)."""
    n = F.floor((u16(section, 1).bitwiseAND(F.lit(0xFFF)) - 9) / 4).cast("int")
    one = lambda i: F.struct(u16(section, 8 + 4 * i).cast("int").alias("program"), u16(section, 10 + 4 * i).bitwiseAND(F.lit(0x1FFF)).cast("int").alias("pid"))
    return F.when((u8(section, 0) == 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), one))


def stream_types(section: Column) -> Column:
    """array<struct<stream_type, pid>> of a program map section (table 2); descriptors are stepped over."""
    end = 3 + u16(section, 1).bitwiseAND(F.lit(0xFFF)) - 4
    start = F.struct((12 + u16(section, 10).bitwiseAND(F.lit(0xFFF))).cast("int").alias("at"), F.array().cast("array<struct<stream_type:int,pid:int>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        row = F.struct(u8(section, s["at"]).cast("int").alias("stream_type"), u16(section, s["at"] + 1).bitwiseAND(F.lit(0x1FFF)).cast("int").alias("pid"))
        size = 5 + u16(section, s["at"] + 3).bitwiseAND(F.lit(0xFFF))
        return F.when(F.coalesce(s["at"] + 5 <= end, F.lit(False)), F.struct((s["at"] + size).cast("int").alias("at"), F.array_append(s["out"], row).alias("out"))).otherwise(s)

    return F.when(u8(section, 0) == 2, F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(F.octet_length(section) / 5).cast("int"), F.lit(1))), start, step, lambda s: s["out"]))


# --- tracks, samples, writers ---------------------------------------------------------------------


def wav_format(nodes_: DataFrame, files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, codec, channels, sample_rate, bits, data_offset, data_size) of WAVE files: two nodes of each file meet by one aggregation."""
    some = nodes_.where(F.col("identifier").isin("fmt ", "data")).groupBy(key).agg(F.min(F.when(F.col("identifier") == "fmt ", F.col("data_offset"))).alias("fmt"), F.min_by("data_offset", F.when(F.col("identifier") == "data", F.col("ord"))).alias("data_offset"), F.min_by("data_size", F.when(F.col("identifier") == "data", F.col("ord"))).alias("data_size"))
    rows = files.select(key, content).join(some.where("fmt is not null"), key).withColumn("head", F.substring(content, (F.col("fmt") + 1).cast("int"), F.lit(16)))
    get = lambda at, n: uint(F.col("head"), at, n, little=True).cast("int")
    return rows.select(key, get(0, 2).alias("codec"), get(2, 2).alias("channels"), get(4, 4).alias("sample_rate"), get(14, 2).alias("bits"), "data_offset", "data_size")


def wav_bytes(samples: Column, rate: int, channels: int = 1) -> Column:
    """A 16-bit PCM file of array<int> samples."""
    data = join_bytes(F.transform(samples, lambda x: int_bytes(x, 2, little=True)))
    n = F.size(samples) * 2
    le = lambda v, k: int_bytes(v if isinstance(v, Column) else F.lit(v), k, little=True)
    return F.concat(F.lit(b"RIFF"), le(n + 36, 4), F.lit(b"WAVEfmt "), le(16, 4), le(1, 2), le(channels, 2), le(rate, 4), le(rate * channels * 2, 4), le(channels * 2, 2), le(16, 2), F.lit(b"data"), le(n, 4), data)


def pcm16(content: Column, offset: Column, size: Column) -> Column:
    """array<int> of little-endian 16-bit samples."""
    n = F.floor(size / 2).cast("int")
    one = lambda i: uint(content, offset + 2 * i, 2, little=True).cast("int")
    return F.when(n > 0, F.transform(F.transform(F.sequence(F.lit(0), n - 1), one), lambda v: F.when(v > 32767, v - 65536).otherwise(v))).otherwise(F.array().cast("array<int>"))


def box(name: str, *parts: Column) -> Column:
    """A box with a 32-bit size."""
    return let(F.concat(*parts), lambda body: F.concat(int_bytes(F.octet_length(body) + 8, 4), F.lit(name.encode("latin-1")), body))


def riff_chunk(name: str, body: Column) -> Column:
    return let(body, lambda b: F.concat(F.lit(name.encode("latin-1")), int_bytes(F.octet_length(b), 4, little=True), b, F.when(F.octet_length(b) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))))


def bmff_samples(d: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(track, sample, offset, size, decode time) from the sample tables: durations, sizes, chunks and their offsets."""
    track, tables = 0, {}
    found = [*bmff(d), (0, "trak", 0, 0, True)]
    for depth, name, at, _, _ in found:
        if name == "trak":
            if {"stts", "stsz", "stsc"} <= tables.keys() and tables.keys() & {"stco", "co64"}:
                yield from _samples(d, track, tables)
            track, tables = track + 1, {}
        elif name in ("stts", "stsz", "stsc", "stco", "co64"):
            tables[name] = at


def _samples(d: bytes, track: int, t: dict[str, int]) -> Iterator[tuple[int, int, int, int, int]]:
    u = lambda at: unpack_from(">I", d, at)[0]
    fixed, count = u(t["stsz"] + 4), u(t["stsz"] + 8)
    sizes = [fixed or u(t["stsz"] + 12 + 4 * i) for i in range(count)]
    offsets = [u(t["stco"] + 8 + 4 * i) for i in range(u(t["stco"] + 4))] if "stco" in t else [unpack_from(">Q", d, t["co64"] + 8 + 8 * i)[0] for i in range(u(t["co64"] + 4))]
    runs = [(u(t["stsc"] + 8 + 12 * i), u(t["stsc"] + 12 + 12 * i)) for i in range(u(t["stsc"] + 4))]
    deltas = [(u(t["stts"] + 8 + 8 * i), u(t["stts"] + 12 + 8 * i)) for i in range(u(t["stts"] + 4))]
    times, now = [], 0
    for n, step in deltas:
        for _ in range(min(n, count - len(times))):
            times.append(now)
            now += step
    k = 0
    for chunk, offset in enumerate(offsets, 1):
        per = next((n for first, n in reversed(runs) if first <= chunk), 0)
        for _ in range(per):
            if k >= count:
                return
            yield track, k, offset, sizes[k], times[k] if k < len(times) else now
            offset += sizes[k]
            k += 1


def samples(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, track, sample, data_offset, data_size, decode_time) of ISO base media files."""
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, files.schema[key].dataType), *StructType.fromDDL("track int, sample int, data_offset bigint, data_size bigint, decode_time bigint").fields])

    def run(batches):
        for b in batches:
            got = [(i, *s) for i, data in enumerate(b.column(1)) if data.is_valid for s in bmff_samples(data.as_py())]
            cols = list(zip(*got, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=schema.names)

    return files.select(key, content).mapInArrow(run, schema)


def ogg_tracks(nodes_: DataFrame, key: str = "path") -> DataFrame:
    """(key, serial, pages, last_sequence, granules): pages of a stream combined before the shuffle."""
    p = F.split("identifier", ":")
    rows = nodes_.where(F.col("identifier").startswith("OggS:")).select(key, p[2].cast("bigint").alias("serial"), p[3].cast("bigint").alias("seq"), p[4].cast("bigint").alias("granule"))
    return rows.groupBy(key, "serial").agg(F.count("*").alias("pages"), F.max("seq").alias("last_sequence"), F.max("granule").alias("granules"))


def masked_label(key: Column) -> Column:
    """A 16-byte universal label without its registry and version bytes, for fuzzy equality of keys."""
    return F.overlay(key, F.lit(bytes(3)), F.lit(6), F.lit(3))
