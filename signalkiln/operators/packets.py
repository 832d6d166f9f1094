"""Packet headers: build, parse, validate, classify; compound control packets; payload formats.

All is column expressions on a binary column but for formats whose next record's place depends on
the record before (compound control packets, aggregated units), which are folds over the bytes or
generators in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import int_bytes, join_bytes, let, u8, u16, u32

#: Static payload types of RFC 3551: number, name, media, clock rate, channels (fixed values).
STATIC_TYPES = [
    (0, "PCMU", "audio", 8000, 1), (3, "GSM", "audio", 8000, 1), (4, "G723", "audio", 8000, 1), (5, "DVI4", "audio", 8000, 1), (6, "DVI4", "audio", 16000, 1), (7, "LPC", "audio", 8000, 1), (8, "PCMA", "audio", 8000, 1), (9, "G722", "audio", 8000, 1),
    (10, "L16", "audio", 44100, 2), (11, "L16", "audio", 44100, 1), (12, "QCELP", "audio", 8000, 1), (13, "CN", "audio", 8000, 1), (14, "MPA", "audio", 90000, 0), (15, "G728", "audio", 8000, 1), (16, "DVI4", "audio", 11025, 1), (17, "DVI4", "audio", 22050, 1), (18, "G729", "audio", 8000, 1),
    (25, "CELB", "video", 90000, 0), (26, "JPEG", "video", 90000, 0), (28, "NV", "video", 90000, 0), (31, "H261", "video", 90000, 0), (32, "MPV", "video", 90000, 0), (33, "MP2T", "video", 90000, 0), (34, "H263", "video", 90000, 0),
]


def build(payload: Column, seq: Column, timestamp: Column, ssrc: Column, payload_type: Column, marker: Column, csrc: Column | None = None, extension: tuple[Column, Column] | None = None, padding: int = 0) -> Column:
    """A version 2 packet. ``csrc``: array<bigint>; ``extension``: (flags, data in whole 32-bit words)."""
    count = F.lit(0) if csrc is None else F.least(F.size(csrc), F.lit(15))
    first = F.lit(0x80 | (0x20 if padding else 0) | (0x10 if extension else 0)) + count
    parts = [int_bytes(first, 1), int_bytes(payload_type + F.when(marker, 128).otherwise(0), 1), int_bytes(seq, 2), int_bytes(timestamp, 4), int_bytes(ssrc, 4)]
    if csrc is not None:
        parts.append(F.aggregate(F.slice(csrc, 1, 15), F.lit(b""), lambda a, x: F.concat(a, int_bytes(x, 4))))
    if extension:
        flags, data = extension
        parts += [int_bytes(flags, 2), int_bytes(F.octet_length(data) / 4, 2), data]
    parts.append(payload)
    if padding:
        parts.append(F.lit(bytes(padding - 1) + bytes([padding])))
    return F.concat(*parts)


def parse(b: Column) -> Column:
    """struct of the fixed header, contributing sources, extension, padding and payload; null fields beyond the end."""
    b0, b1 = u8(b, 0), u8(b, 1)
    cc, has_ext, has_pad = b0.bitwiseAND(F.lit(15)), b0.bitwiseAND(F.lit(16)) != 0, b0.bitwiseAND(F.lit(32)) != 0
    at = 12 + 4 * cc
    words = F.when(has_ext, F.coalesce(u16(b, at + 2), F.lit(0))).otherwise(0)
    ext = F.when(has_ext, 4 + 4 * words).otherwise(0)
    pad = F.when(has_pad, u8(b, F.octet_length(b) - 1)).otherwise(0)
    size = F.octet_length(b) - at - ext - pad
    return F.struct(
        F.shiftright(b0, 6).cast("int").alias("version"), has_pad.alias("padding"), has_ext.alias("extension"), cc.cast("int").alias("csrc_count"),
        (b1 >= 128).alias("marker"), b1.bitwiseAND(F.lit(127)).cast("int").alias("payload_type"), u16(b, 2).cast("int").alias("seq"), u32(b, 4).alias("rtp_ts"), u32(b, 8).alias("ssrc"),
        F.when(cc > 0, F.transform(F.sequence(F.lit(0), cc.cast("int") - 1), lambda i: u32(b, 12 + 4 * i))).otherwise(F.array().cast("array<bigint>")).alias("csrc"),
        F.when(has_ext, u16(b, at)).cast("int").alias("ext_flags"), words.cast("int").alias("ext_words"), F.when(has_ext, F.substring(b, (at + 5).cast("int"), (4 * words).cast("int"))).alias("ext_data"),
        F.when(size >= 0, F.substring(b, (at + ext + 1).cast("int"), size.cast("int"))).alias("payload"), pad.cast("int").alias("padding_len"),
        ((F.octet_length(b) >= 12) & (size >= 0)).alias("complete"),
    )


def rewrite(b: Column, payload_type: Column | None = None, seq: Column | None = None, timestamp: Column | None = None, ssrc: Column | None = None, marker: Column | None = None) -> Column:
    """The packet with the given header fields replaced in place."""
    if payload_type is not None or marker is not None:
        b1 = u8(b, 1)
        pt = b1.bitwiseAND(F.lit(127)) if payload_type is None else payload_type
        m = b1.bitwiseAND(F.lit(128)) if marker is None else F.when(marker, 128).otherwise(0)
        b = F.overlay(b, int_bytes(pt + m, 1), F.lit(2), F.lit(1))
    for value, at, n in ((seq, 3, 2), (timestamp, 5, 4), (ssrc, 9, 4)):
        if value is not None:
            b = F.overlay(b, int_bytes(value, n), F.lit(at), F.lit(n))
    return b


def valid(h: Column, known_types: list[int]) -> Column:
    """Version 2, a known type that control packets don't use, padding inside the payload, sources that fit."""
    room = F.coalesce(F.octet_length(h["payload"]), F.lit(-1))
    return (h["version"] == 2) & h["payload_type"].isin(known_types) & h["complete"] & (~h["padding"] | (h["padding_len"].between(1, 255) & (room >= 0)))


def _avp(h: Column) -> Column:
    static = [t[0] for t in STATIC_TYPES]
    return valid(h, [*static, *range(96, 128)]) & ~h["payload_type"].between(72, 76)


#: What the packets of a profile must be, as functions of a parsed header; users may add to it.
PROFILES = {
    "RTP/AVP": _avp,
    "redundant": lambda h: valid(h, list(range(96, 128))) & (F.size(redundant_blocks(h["payload"])) > 0),
    "access units": lambda h: valid(h, list(range(96, 128))) & (F.size(aac_units(h["payload"])) > 0),
}


def valid_for(h: Column, profile: str) -> Column:
    """Whether a parsed packet is one of the profile; false where that cannot be told."""
    return F.coalesce(PROFILES[profile](h), F.lit(False))


def is_control(b: Column) -> Column:
    """RFC 5761: second bytes 192 to 223 are control packets."""
    return u8(b, 1).between(192, 223)


def control_header(b: Column) -> Column:
    b0 = u8(b, 0)
    return F.struct(F.shiftright(b0, 6).cast("int").alias("version"), (b0.bitwiseAND(F.lit(32)) != 0).alias("padding"), b0.bitwiseAND(F.lit(31)).cast("int").alias("count"), u8(b, 1).cast("int").alias("packet_type"), u16(b, 2).cast("int").alias("length_words"), u32(b, 4).alias("ssrc"))


def control_header_ok(b: Column, mask: int = 0xE0FE, value: int = 0x80C8) -> Column:
    """First packet of a compound: version 2, no padding, a sender or receiver report."""
    return u16(b, 0).bitwiseAND(F.lit(mask)) == value


#: Control packets that one datagram can hold: each has at least 4 of 65,535 bytes, a bound of the format.
def split_compound(b: Column) -> Column:
    """array<binary> of the packets of a datagram; the walk ends at a bad version or a length beyond the end."""
    at_end = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        size = 4 + 4 * u16(b, s["at"] + 2)
        ok = (F.octet_length(b) >= s["at"] + size) & (F.shiftright(u8(b, s["at"]), 6) == 2)
        return F.when(F.coalesce(ok, F.lit(False)), F.struct((s["at"] + size).cast("int").alias("at"), F.array_append(s["out"], F.substring(b, (s["at"] + 1).cast("int"), size.cast("int"))).alias("out"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(F.octet_length(b) / 4).cast("int"), F.lit(1))), at_end, step, lambda s: s["out"])


def build_compound(packets: Column) -> Column:
    """Packets of one datagram in order, the last padded to whole words."""
    joined = join_bytes(packets)
    return F.concat(joined, F.substring(F.lit(bytes(3)), F.lit(1), F.pmod(-F.octet_length(joined), F.lit(4)).cast("int")))


def report_blocks(b: Column) -> Column:
    """array of the 24-byte blocks of a sender (200) or receiver (201) report."""
    start = F.when(u8(b, 1) == 200, 28).otherwise(8)
    n = F.least(u8(b, 0).bitwiseAND(F.lit(31)), F.floor((F.octet_length(b) - start) / 24)).cast("int")

    def one(i: Column) -> Column:
        at = start + 24 * i
        lost = u32(b, at + 4).bitwiseAND(F.lit(0xFFFFFF))
        return F.struct(
            u32(b, at).alias("block_ssrc"), u8(b, at + 4).cast("int").alias("fraction_lost"), F.when(lost >= 1 << 23, lost - (1 << 24)).otherwise(lost).cast("int").alias("cumulative_lost"),
            u32(b, at + 8).alias("ext_highest_seq"), u32(b, at + 12).alias("jitter"), u32(b, at + 16).alias("lsr"), u32(b, at + 20).alias("dlsr"),
        )

    return F.when(u8(b, 1).isin(200, 201) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), one))


def receiver_report(ssrc: Column, block_ssrc: Column, fraction: Column, lost: Column, ext_seq: Column, jitter: Column, lsr: Column, dlsr: Column) -> Column:
    return F.concat(F.lit(b"\x81\xc9\x00\x07"), int_bytes(ssrc, 4), int_bytes(block_ssrc, 4), int_bytes(fraction, 1), int_bytes(lost, 3), *(int_bytes(x, 4) for x in (ext_seq, jitter, lsr, dlsr)))


def sender_info(b: Column) -> Column:
    return F.when(u8(b, 1) == 200, F.struct(u32(b, 8).alias("ntp_seconds"), u32(b, 12).alias("ntp_fraction"), u32(b, 16).alias("rtp_ts"), u32(b, 20).alias("packets"), u32(b, 24).alias("octets")))


def bye_sources(b: Column) -> Column:
    n = u8(b, 0).bitwiseAND(F.lit(31)).cast("int")
    return F.when((u8(b, 1) == 203) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: u32(b, 4 + 4 * i)))


def feedback(b: Column) -> Column:
    """Feedback packets (205, 206): format, sender, media source, control information."""
    return F.when(u8(b, 1).isin(205, 206), F.struct(u8(b, 0).bitwiseAND(F.lit(31)).cast("int").alias("fmt"), u32(b, 4).alias("sender_ssrc"), u32(b, 8).alias("media_ssrc"), F.substring(b, F.lit(13), F.octet_length(b)).alias("fci")))


def nack_sequences(fci: Column) -> Column:
    """Lost sequence numbers of generic negative acknowledgements: an id and a bit mask of the next 16."""
    n = F.floor(F.octet_length(fci) / 4).cast("int")

    def one(k: Column) -> Column:
        # the word is read once: 17 bits from it on are the id itself and the mask
        lost = lambda w: F.filter(F.sequence(F.lit(0), F.lit(16)), lambda j: (j == 0) | (F.bit_get(w, F.greatest(j - 1, F.lit(0))) == 1))
        return let(u32(fci, 4 * k), lambda w: F.transform(lost(w), lambda j: ((F.shiftright(w, 16) + j) % 65536).cast("int")))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), one)))


def packetise(payload: Column, mtu: int) -> Column:
    """array<struct<pos, part>> of pieces of up to ``mtu`` bytes."""
    n = F.ceil(F.octet_length(payload) / mtu).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.substring(payload, i * mtu + 1, F.lit(mtu)).alias("part")))).otherwise(F.array().cast("array<struct<pos:int,part:binary>>"))


def join_parts(parts: Column) -> Column:
    """Pieces (pos, part) in order of pos as one payload."""
    return join_bytes(F.transform(F.array_sort(parts), lambda x: x["part"]))


def adts_header(profile: Column, rate_index: Column, channels: Column, length: Column) -> Column:
    """7 bytes in front of an AAC frame of ``length`` bytes; profile counts from 1, no checksum."""
    n = length + 7
    word = F.shiftleft(F.lit(0xFFF1).cast("bigint"), 40)
    low = F.shiftleft((profile - 1).cast("bigint"), 38) + F.shiftleft(rate_index.cast("bigint"), 34) + F.shiftleft(channels.cast("bigint"), 30) + F.shiftleft(n.cast("bigint"), 13) + F.lit(0x7FF << 2)
    return int_bytes(word + low, 7)


def _starts(sizes: Column) -> Column:
    """Where each of several parts in a row begins, from 0."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x.cast("int")))


def aac_units(b: Column) -> Column:
    """RFC 3640 access units, array<struct<ord, unit>>, with 13-bit sizes and 3-bit indices."""
    n = F.floor(u16(b, 0) / 16).cast("int")
    sizes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftright(F.coalesce(u16(b, 2 + 2 * i), F.lit(0)), 3).cast("int"))
    one = lambda i, size, starts: F.struct(i.alias("ord"), F.substring(b, 3 + 2 * n + F.get(starts, i), size).alias("unit"))
    return F.when(n > 0, let(sizes, lambda s: let(_starts(s), lambda at: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(i, F.get(s, i), at)))))


def redundant_blocks(b: Column) -> Column:
    """RFC 2198 blocks, array<struct<ord, payload_type, ts_offset, block>>; the last is the primary one.

    A head of 4 bytes has its top bit set; the first byte without it is the head of the primary block.
    """
    heads = F.regexp_extract(F.hex(b), "^((?:[89A-F][0-9A-F]{7})*+)[0-7]", 1)
    n = (F.length(heads) / 8).cast("int")
    word = lambda i: u32(b, 4 * i)
    every = F.sequence(F.lit(0), n)
    size = lambda i: F.when(i < n, word(i).bitwiseAND(F.lit(1023))).otherwise(F.octet_length(b)).cast("int")
    one = lambda i, at: F.struct(
        i.alias("ord"), u8(b, 4 * i).bitwiseAND(F.lit(127)).cast("int").alias("payload_type"), F.when(i < n, F.shiftright(word(i), 10).bitwiseAND(F.lit(16383))).otherwise(0).cast("int").alias("ts_offset"),
        F.substring(b, 4 * n + 2 + F.get(at, i), size(i)).alias("block"),
    )
    return F.when(F.hex(b).rlike("^(?:[89A-F][0-9A-F]{7})*+[0-7]"), let(_starts(F.transform(every, size)), lambda at: F.transform(every, lambda i: one(i, at))))


#: Formats whose records are found by columns alone.
COLUMN_SPLITTERS = {"aac": aac_units, "redundant": redundant_blocks}


# --- records whose place depends on the record before ---------------------------------------------


def _interleaved(data: bytes) -> Iterator[tuple]:
    """(offset, channel, payload) of `$` frames; channel -1 holds bytes between frames."""
    at = 0
    while at < len(data):
        start = data.find(b"$", at)
        if start < 0 or start + 4 > len(data):
            yield at, -1, data[at:]
            return
        if start > at:
            yield at, -1, data[at:start]
        end = start + 4 + int.from_bytes(data[start + 2 : start + 4])
        if end > len(data):
            yield start, -1, data[start:]
            return
        yield start, data[start + 1], data[start + 4 : end]
        at = end


def _h264(data: bytes) -> Iterator[tuple]:
    """RFC 6184 units (ord, nal type, first part, last part, bytes) of one payload."""
    if len(data) < 2:
        return
    kind = data[0] & 31
    if kind in (0, 30, 31):
        return
    if kind in (24, 25, 26, 27):
        at, extra, i = 1 + 2 * (kind != 24), {26: 3, 27: 4}.get(kind, 0), 0
        while at + 2 < len(data):
            n = int.from_bytes(data[at : at + 2])
            unit = data[at + 2 + extra : at + 2 + n] if extra else data[at + 2 : at + 2 + n]
            if unit:
                yield i, unit[0] & 31, True, True, unit
            at, i = at + 2 + n, i + 1
    elif kind in (28, 29):
        fu, body = data[1], data[2 + 2 * (kind == 29) :]
        head = bytes([(data[0] & 0xE0) | (fu & 31)]) if fu & 0x80 else b""
        yield 0, fu & 31, bool(fu & 0x80), bool(fu & 0x40), head + body
    else:
        yield 0, kind, True, True, data


def _sdes(data: bytes) -> Iterator[tuple]:
    """(ssrc, item type, value) of a source description packet."""
    at, chunks = 4, data[0] & 31 if data else 0
    for _ in range(chunks):
        if at + 4 > len(data):
            return
        ssrc = int.from_bytes(data[at : at + 4])
        at += 4
        while at < len(data) and data[at]:
            n = data[at + 1] if at + 1 < len(data) else 0
            yield ssrc, data[at], data[at + 2 : at + 2 + n].decode("utf-8", "replace")
            at += 2 + n
        at = (at // 4 + 1) * 4


#: Splitter, output columns.
SPLITTERS = {
    "interleaved": (_interleaved, "offset int, channel int, payload binary"),
    "h264": (_h264, "ord int, nal_type int, starts boolean, ends boolean, unit binary"),
    "sdes": (_sdes, "item_ssrc bigint, item_type int, value string"),
}


def split(rows: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """Every row once for each record of its ``column``, with the record's columns; without that column itself.

    By columns where the format allows it, else in Arrow batches beside the data; no shuffle. Null bytes give no row.
    """
    from pyspark.sql.types import StructType

    if kind in COLUMN_SPLITTERS:
        keep = [c for c in rows.columns if c != column]
        return rows.select(*keep, F.inline(COLUMN_SPLITTERS[kind](F.col(column))))
    walk, extra = SPLITTERS[kind]
    added = StructType.fromDDL(extra)
    keep = [c for c in rows.columns if c != column]
    schema = StructType([*(f for f in rows.schema.fields if f.name != column), *added.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            index, cols = [], [[] for _ in added.fields]
            for i, data in enumerate(b.column(b.schema.get_field_index(column)).to_pylist()):
                for record in walk(bytes(data)) if data is not None else ():
                    index.append(i)
                    for c, v in zip(cols, record, strict=True):
                        c.append(v)
            taken = [b.column(b.schema.get_field_index(c)).take(pa.array(index, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, added.fields, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
