"""Payload formats over several packets: fragments joined to units and frames, blocks joined to packets, headers of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import int_bytes, join_bytes, u8, u16, uint
from . import packets as pk


def h264_units(packets: DataFrame, frames: bool = False) -> DataFrame:
    """(ssrc, rtp_ts, unit, nal_type, complete, data) of packets (ssrc, rtp_ts, ext_seq, payload): aggregates split, fragments joined.

    A fragment run is complete if it has its first and last part and no number between is missing. Packets
    are dealt by frame, sorted once and folded as they pass; one unit is held. With ``frames`` each unit
    tells by key_frame whether its frame holds a type 5, and one frame is held.
    """
    from pyspark.sql.types import StructType

    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = "unit int, nal_type int, complete boolean, data binary" + (", key_frame boolean" if frames else "")
    schema = StructType([packets.schema["ssrc"], packets.schema["rtp_ts"], *StructType.fromDDL(added).fields])
    walk, _ = pk.SPLITTERS["h264"]

    def parts(batches) -> Iterator[tuple]:
        """(frame, number, ord, nal_type, starts, ends, bytes) in order; packets of one number go by the places of their parts."""
        at, same = None, []
        for b in batches:
            for ssrc, ts, seq, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (ssrc, ts, seq):
                    yield from ((at[:2], at[2], *r) for r in sorted(same, key=lambda r: (r[0], r[4])))
                    at, same = (ssrc, ts, seq), []
                same.extend(walk(data) if data is not None else ())
        yield from ((at[:2], at[2], *r) for r in sorted(same, key=lambda r: (r[0], r[4])))

    def units(batches) -> Iterator[tuple]:
        """(frame, unit, nal_type, starts, ends, list of bytes)."""
        now, before, ended = None, None, True
        for frame, seq, _, kind, starts, ends, data in parts(batches):
            # a part begins a unit if it says so, or if it does not follow a part of its type that is still open
            if now and now[0] == frame and not starts and not ended and now[2] == kind and None not in (seq, before) and before + 1 == seq:
                now[4] |= ends
                now[5].append(data)
            else:
                if now:
                    yield now
                now = [frame, now[1] + 1 if now and now[0] == frame else 1, kind, starts, ends, [data]]
            before, ended = seq, ends
        if now:
            yield now

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=schema.names)
        rows, held, size, key, at = [], [], 0, False, None
        for frame, unit, kind, starts, ends, some in units(batches):
            if frames and frame != at:
                rows.extend((*r, key) for r in held)
                held, key, at = [], False, frame
            row = (*frame, unit, kind, starts and ends, b"".join(some))
            key |= kind == 5
            size += len(row[5])
            (held if frames else rows).append(row)
            if len(rows) >= 8192 or (rows and size >= 1 << 24):
                yield emit(rows)
                rows, size = [], 0
        yield emit(rows + [(*r, key) for r in held])

    ordered = packets.select("ssrc", "rtp_ts", "ext_seq", "payload").repartition(n, "ssrc", "rtp_ts").sortWithinPartitions("ssrc", "rtp_ts", "ext_seq")
    return ordered.mapInArrow(run, schema)


def h264_frames(units: DataFrame) -> DataFrame:
    """(ssrc, rtp_ts, nal_types, key_frame): the kinds of units of each frame; a key frame holds a type 5."""
    got = units.groupBy("ssrc", "rtp_ts").agg(F.array_sort(F.collect_set("nal_type")).alias("nal_types"))
    return got.withColumn("key_frame", F.array_contains("nal_types", 5))


def redundant_packet(blocks: Column) -> Column:
    """RFC 2198 payload of array<struct<payload_type, ts_offset, block>>: the last is the primary block."""
    n = F.size(blocks)
    head = lambda x, i: F.when(i < n - 1, int_bytes((F.lit(128) + x["payload_type"]).cast("bigint") * (1 << 24) + x["ts_offset"].cast("bigint") * 1024 + F.octet_length(x["block"]), 4)).otherwise(int_bytes(x["payload_type"].bitwiseAND(F.lit(127)), 1))
    return F.concat(join_bytes(F.transform(blocks, head)), join_bytes(F.transform(blocks, lambda x: x["block"])))


def mpeg4_frames(packets: DataFrame, profile: int = 1) -> DataFrame:
    """(ssrc, rtp_ts, packets, data): RFC 6416 payloads of a time stamp in order.

    A frame that does not begin with a start code gets a visual object sequence header with the profile.
    """
    got = packets.groupBy("ssrc", "rtp_ts").agg(F.count("*").alias("packets"), F.array_sort(F.collect_list(F.struct("ext_seq", "payload"))).alias("parts"))
    data = join_bytes(F.transform("parts", lambda x: x["payload"]))
    coded = F.hex(F.substring(data, 1, 3)) == "000001"
    return got.select("ssrc", "rtp_ts", "packets", F.when(coded, data).otherwise(F.concat(F.lit(b"\x00\x00\x01\xb0" + bytes([profile])), data)).alias("data"))


def jpeg_header(payload: Column) -> Column:
    """struct of the RFC 2435 header: offset, type, quality, size in pixels, restart interval, tables, and the scan bytes behind."""
    kind, q, offset = u8(payload, 4), u8(payload, 5), uint(payload, 1, 3)
    restart = F.when(kind.between(64, 127), 4).otherwise(0)
    table_bytes = F.when((q >= 128) & (offset == 0), u16(payload, 8 + restart + 2))
    tables = F.when(table_bytes.isNotNull(), 4 + table_bytes).otherwise(0)
    return F.struct(
        offset.alias("offset"), kind.cast("int").alias("type"), q.cast("int").alias("quality"), (u8(payload, 6) * 8).cast("int").alias("width"), (u8(payload, 7) * 8).cast("int").alias("height"),
        F.when(restart > 0, u16(payload, 8)).cast("int").alias("restart"), F.when(table_bytes > 0, F.substring(payload, (13 + restart).cast("int"), table_bytes.cast("int"))).alias("tables"),
        F.substring(payload, (9 + restart + tables).cast("int"), F.octet_length(payload)).alias("scan"),
    )


def jpeg_scans(packets: DataFrame) -> DataFrame:
    """(ssrc, rtp_ts, width, height, type, quality, restart, tables, complete, scan): the fragments of each image by offset."""
    rows = packets.select("ssrc", "rtp_ts", "marker", jpeg_header(F.col("payload")).alias("h")).select("ssrc", "rtp_ts", "marker", "h.*")
    first = lambda c: F.min_by(c, "offset").alias(c)
    got = rows.groupBy("ssrc", "rtp_ts").agg(
        *(first(c) for c in ("width", "height", "type", "quality", "restart", "tables")), F.min("offset").alias("low"), F.max(F.col("offset") + F.octet_length("scan")).alias("high"), F.sum(F.octet_length("scan")).alias("bytes"), F.bool_or("marker").alias("ended"),
        F.array_sort(F.collect_list(F.struct("offset", "scan"))).alias("parts"),
    )
    whole = (F.col("low") == 0) & F.col("ended") & (F.col("high") == F.col("bytes"))
    return got.select("ssrc", "rtp_ts", "width", "height", "type", "quality", "restart", "tables", whole.alias("complete"), join_bytes(F.transform("parts", lambda x: x["scan"])).alias("scan"))


def rtmp_chunk(b: Column) -> Column:
    """struct of a chunk's basic and message header: format, stream, time stamp, length, type, message stream, header bytes."""
    form, low = F.shiftright(u8(b, 0), 6), u8(b, 0).bitwiseAND(F.lit(63))
    basic = F.when(low == 0, 2).when(low == 1, 3).otherwise(1)
    stream = F.when(low == 0, u8(b, 1) + 64).when(low == 1, uint(b, 1, 2, little=True) + 64).otherwise(low)
    size = F.element_at(F.array(*map(F.lit, (11, 7, 3, 0))), (form + 1).cast("int"))
    stamp = F.when(size >= 3, uint(b, basic, 3))
    extended = F.coalesce(stamp == 0xFFFFFF, F.lit(False))
    return F.struct(
        form.cast("int").alias("format"), stream.cast("int").alias("stream"), F.when(extended, uint(b, basic + size, 4)).otherwise(stamp).alias("timestamp"), F.when(size >= 7, uint(b, basic + 3, 3)).cast("int").alias("length"),
        F.when(size >= 7, u8(b, basic + 6)).cast("int").alias("type"), F.when(size == 11, uint(b, basic + 7, 4, little=True)).alias("message_stream"), (basic + size + F.when(extended, 4).otherwise(0)).cast("int").alias("header_bytes"),
    )


def midi_delta(value: Column) -> Column:
    """Variable-length bytes of a delta time below 2**28."""
    group = lambda k, more: int_bytes(F.shiftright(value, 7 * k).bitwiseAND(F.lit(127)) + (128 if more else 0), 1)
    out = group(0, False)
    for k in (1, 2, 3):
        out = F.when(value >= 1 << 7 * k, F.concat(*(group(j, j > 0) for j in range(k, -1, -1)))).otherwise(out)
    return out


def interleaved_stream(chunks: DataFrame, order: str = "arrival") -> DataFrame:
    """(conn_id, offset, channel, payload) of `$` frames over the chunks (conn_id, ``order``, chunk) of each connection.

    Frames may begin in one chunk and end in another. A connection's chunks are sorted and read as they
    pass; only the bytes of the frame that is not yet whole are held, 65,539 at most. Channel -1 holds
    bytes between frames, and at the end of a connection the bytes of a frame that was cut off.
    """
    from pyspark.sql.types import StructType

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([chunks.schema["conn_id"], *StructType.fromDDL("offset bigint, channel int, payload binary").fields])

    def frames(held: bytearray, base: int, ended: bool) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(held):
            start = held.find(b"$", at)
            if start != at:
                end = len(held) if start < 0 else start
                yield base + at, -1, bytes(held[at:end])
                at = end
                continue
            end = at + 4 + int.from_bytes(held[at + 2 : at + 4]) if at + 4 <= len(held) else len(held) + 1
            if end > len(held):
                if ended:
                    yield base + at, -1, bytes(held[at:])
                    at = len(held)
                break
            yield base + at, held[at + 1], bytes(held[at + 4 : end])
            at = end
        del held[:at]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        key, held, base = None, bytearray(), 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        for b in batches:
            rows = []
            for conn, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if conn != key:
                    rows.extend((key, *f) for f in frames(held, base, True))
                    key, held, base = conn, bytearray(), 0
                held += chunk or b""
                before = len(held)
                rows.extend((key, *f) for f in frames(held, base, False))
                base += before - len(held)
            yield emit(rows)
        yield emit([(key, *f) for f in frames(held, base, True)])

    rows = chunks.select("conn_id", order, "chunk").repartition(n, "conn_id").sortWithinPartitions("conn_id", order)
    return rows.select("conn_id", "chunk").mapInArrow(run, schema)
