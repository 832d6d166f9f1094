"""Packet dumps: a text line, a 16-byte head, then entries of an 8-byte head and a packet; and the text forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import int_bytes, join_bytes, u8, u16, u32

SCHEMA = "file_offset bigint, source string, start_us bigint, length int, plen int, offset_ms bigint, blob binary"


def entries_of(d: bytes) -> Iterator[tuple[int, str, int, int, int, int, bytes]]:
    """Entries in file order; the walk ends at the first that is cut off. plen 0 marks a control packet."""
    line = d.find(b"\n")
    if not d.startswith(b"#!rtpplay1.0 ") or line < 0 or line + 17 > len(d):
        return
    source, at = d[13:line].decode("latin-1"), line + 17
    start = int.from_bytes(d[line + 1 : line + 5]) * 1_000_000 + int.from_bytes(d[line + 5 : line + 9])
    while at + 8 <= len(d):
        length, plen, ms = int.from_bytes(d[at : at + 2]), int.from_bytes(d[at + 2 : at + 4]), int.from_bytes(d[at + 4 : at + 8])
        if length < 8 or at + length > len(d):
            return
        yield at, source, start, length, plen, ms, d[at + 8 : at + length]
        at += length


def entries(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Rows of the entries of each file of ``files`` (key, content); other files and nulls give none."""
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL(SCHEMA)
    schema = StructType([StructField(key, files.schema[key].dataType), *added.fields])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        for b in batches:
            got = [(i, *e) for i, data in enumerate(b.column(1)) if data.is_valid for e in entries_of(data.as_py())]
            cols = list(zip(*got, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names=schema.names)

    return files.select(key, content).mapInArrow(run, schema)


def seek(rows: DataFrame, ms: int, key: str = "path") -> DataFrame:
    """The first entry of each file at or behind a time: one aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col("offset_ms") >= ms).groupBy(key).agg(F.min_by(F.struct(*rest), "file_offset").alias("e")).select(key, "e.*")


def skip(rows: DataFrame, n: int, key: str = "path") -> DataFrame:
    """The entries of each file behind its first ``n``."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("file_offset")
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") > n).drop("__k")


def entry_bytes(packet: Column, offset_ms: Column, control: Column) -> Column:
    n = F.octet_length(packet)
    return F.concat(int_bytes(n + 8, 2), int_bytes(F.when(control, 0).otherwise(n), 2), int_bytes(offset_ms, 4), packet)


def file_bytes(address: Column, start_us: Column, entries_: Column) -> Column:
    """A dump of entries (array<binary>) from one address `a.b.c.d/port`."""
    sec, us = F.floor(start_us / 1_000_000).cast("bigint"), F.pmod(start_us, F.lit(1_000_000))
    head = F.concat(F.encode(F.concat(F.lit("#!rtpplay1.0 "), address, F.lit("\n")), "UTF-8"), int_bytes(sec, 4), int_bytes(us, 4), F.lit(bytes(8)))
    return F.concat(head, join_bytes(entries_))


def text_line(packet: Column, seconds: Column, source: Column, hexadecimal: bool = False) -> Column:
    """`time RTP len= from= v= p= x= cc= m= pt= ts= seq= ssrc=` and, if asked for, the bytes."""
    b0, b1 = u8(packet, 0), u8(packet, 1)
    named = [("len", F.octet_length(packet)), ("from", source), ("v", F.shiftright(b0, 6)), ("p", F.shiftright(b0, 5) % 2), ("x", F.shiftright(b0, 4) % 2), ("cc", b0 % 16), ("m", F.shiftright(b1, 7)), ("pt", b1 % 128), ("ts", u32(packet, 4)), ("seq", u16(packet, 2)), ("ssrc", F.concat(F.lit("0x"), F.lower(F.hex(u32(packet, 8)))))]
    out = F.concat_ws(" ", F.format_string("%.6f", seconds), F.lit("RTP"), *(F.concat(F.lit(k + "="), v.cast("string")) for k, v in named))
    return F.concat(out, F.lit(" data="), F.lower(F.hex(packet))) if hexadecimal else out


def parse_text_line(line: Column) -> Column:
    """map of the k=v tokens of a text line."""
    return F.str_to_map(F.regexp_replace(line, r"^\S+\s+\S+\s+", ""), F.lit(" "), F.lit("="))


def short_line(seconds: Column, seq: Column, port: Column, marker: Column) -> Column:
    """`seconds seq port`; a marker makes the sequence number negative."""
    return F.concat_ws(" ", F.format_string("%.6f", seconds), F.when(marker, -seq).otherwise(seq).cast("string"), port.cast("string"))


def text_packets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of the ascii, hex and short forms as columns, beside the other columns of ``lines``.

    form (`ascii`, `hex`, `short`, `control`), seconds, source, seq, marker, payload_type, rtp_ts, ssrc, port,
    packet (the bytes of the hex form). A line that fits no form has form null.
    """
    line = F.btrim(F.col(column))
    tokens = F.str_to_map(F.regexp_replace(line, r"^\S+\s+\S+\s*", ""), F.lit(" "), F.lit("="))
    get = lambda k: F.try_element_at(F.col("__t"), F.lit(k))
    short, rtp, control = r"^([0-9.]+) (-?[0-9]+) ([0-9]+)$", r"^[0-9.]+ RTP ", r"^[0-9.]+ RTCP"
    form = F.when(line.rlike(short), "short").when(line.rlike(rtp), F.when(F.contains(line, F.lit(" data=")), "hex").otherwise("ascii")).when(line.rlike(control), "control")
    rows = lines.withColumns({"form": form, "__t": F.when(line.rlike(rtp), tokens), "seconds": F.regexp_extract(line, r"^([0-9.]+)", 1).try_cast("double")})
    number = F.regexp_extract(line, short, 2).try_cast("int")
    hexadecimal = F.substring_index(get("ssrc"), "x", -1)
    return rows.withColumns({
        "source": get("from"), "seq": F.when(F.col("form") == "short", F.abs(number)).otherwise(get("seq").try_cast("int")),
        "marker": F.when(F.col("form") == "short", number < 0).otherwise(get("m") == "1"), "payload_type": get("pt").try_cast("int"), "rtp_ts": get("ts").try_cast("bigint"),
        "ssrc": F.conv(hexadecimal, 16, 10).try_cast("bigint"), "port": F.when(F.col("form") == "short", F.regexp_extract(line, short, 3).try_cast("int")), "packet": F.unhex(get("data")),
    }).drop("__t")


def control_text(text: Column) -> Column:
    """array<struct<kind, params>> of the innermost `(SR ...)`, `(RR ...)`, `(SDES ...)`, `(BYE ...)` and block groups of a control entry."""
    groups = F.regexp_extract_all(text, F.lit(r"\(([A-Z]*[^()]*)"), 1)

    def one(g: Column) -> Column:
        kind = F.regexp_extract(g, "^([A-Z]+) ", 1)
        return F.struct(F.when(kind == "", "block").otherwise(kind).alias("kind"), F.str_to_map(F.regexp_replace(F.btrim(F.regexp_replace(g, "^[A-Z]+ ", "")), r'"', ""), F.lit(" "), F.lit("=")).alias("params"))

    return F.transform(F.filter(groups, lambda g: F.contains(g, F.lit("="))), one)


def read_text(spark, path: str, together: bool = False) -> DataFrame:
    """The lines of text dumps below ``path`` with their file, as ``text_packets`` gives them.

    ``together``: of the files that ``write_text`` gives with it, with the stream (text, null without one) in front of each line.
    """
    rows = spark.read.text(path)
    if together:
        at = F.position(F.lit("\t"), F.col("value"))
        stream = F.when(at > 1, F.substring("value", F.lit(1), at - 1))
        return text_packets(rows.select(stream.alias("stream"), F.substring("value", at + 1, F.length("value")).alias("value")))
    return text_packets(rows.select(F.col("_metadata.file_path").alias("path"), "value"))


def write_text(rows: DataFrame, path: str, line: Column, key: str = "ssrc", order: str = "seconds", together: bool = False) -> None:
    """Text dumps, one folder a stream: rows are dealt by stream, sorted, and written as they pass.

    Each stream costs a file to open, move and list. ``together`` writes the streams of a task to one
    file, one behind the other, with the stream and a tab in front of each line.
    """
    dealt = rows.withColumn("value", line).repartition(key).sortWithinPartitions(key, order)
    if together:
        dealt.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\t"), "value").alias("value")).write.mode("overwrite").text(path)
    else:
        dealt.select(key, "value").write.partitionBy(key).mode("overwrite").text(path)


def write_files(rows: DataFrame, path: str, address: str, start_us: int, key: str = "ssrc", order: str = "offset_ms", entry: str = "entry") -> DataFrame:
    """Binary dumps, one file a stream below ``path``, and a table (key, file, entries, bytes) of what was written.

    ``entry`` holds the bytes of ``entry_bytes``. A stream's rows are sorted and written as they pass. A
    task that runs again writes the same files anew, under the names of their streams.
    """
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(key, rows.schema[key].dataType), *StructType.fromDDL("file string, entries bigint, bytes bigint").fields])
    head = f"#!rtpplay1.0 {address}\n".encode() + (start_us // 1_000_000).to_bytes(4) + (start_us % 1_000_000).to_bytes(4) + bytes(8)

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        now, out, done = None, None, []

        def close() -> None:
            if out is not None:
                done.append((now, f"{path}/{now}.rtp", count, out.tell()))
                out.close()

        for b in batches:
            for k, e in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None or k != now:
                    close()
                    now, count, out = k, 0, store.open_output_stream(f"{root}/{k}.rtp")
                    out.write(head)
                out.write(e.as_buffer())
                count += 1
        close()
        cols = list(zip(*done, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=schema.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(key, order, entry).repartition(n, key).sortWithinPartitions(key, order).select(key, entry).mapInArrow(run, schema)
