"""Control packets as a whole: dispatch by type, rules of compound packets, reports from counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import int_bytes, u8, u32
from ..functions.timecode import ntp_from_timestamp
from . import packets as pk

#: Names of control packet types (fixed values of the registry).
CONTROL_TYPES = {192: "FIR", 193: "NACK", 195: "IJ", 200: "SR", 201: "RR", 202: "SDES", 203: "BYE", 204: "APP", 205: "RTPFB", 206: "PSFB", 207: "XR"}


def control_type(b: Column) -> Column:
    """Name of a control packet's type; null for one that is not registered."""
    names = F.create_map(*(F.lit(x) for pair in CONTROL_TYPES.items() for x in pair))
    return F.try_element_at(names, u8(b, 1).cast("int"))


def dispatch(b: Column) -> Column:
    """struct of the packet's type and what its kind holds; the parts of other kinds are null."""
    kind = u8(b, 1)
    return F.struct(
        control_type(b).alias("kind"), u32(b, 4).alias("ssrc"), pk.sender_info(b).alias("sender"), pk.report_blocks(b).alias("blocks"), pk.bye_sources(b).alias("bye"), pk.feedback(b).alias("feedback"),
        F.when(kind == 204, F.struct(F.decode(F.substring(b, 9, 4), "ISO-8859-1").alias("name"), u8(b, 0).bitwiseAND(F.lit(31)).cast("int").alias("subtype"), F.substring(b, F.lit(13), F.octet_length(b)).alias("data"))).alias("app"),
    )


def ordered_compound(packets: Column) -> Column:
    """array<binary> in the order a compound packet asks for: reports, descriptions, others, goodbyes; else as given."""
    rank = lambda b: F.when(u8(b, 1).isin(200, 201), 0).when(u8(b, 1) == 202, 1).when(u8(b, 1) == 203, 3).otherwise(2)
    keyed = F.transform(packets, lambda b, i: F.struct(rank(b).alias("rank"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda x: x["b"])


def compound_rules(packets: Column) -> Column:
    """struct of the rules of RFC 3550 6.1: a report first, a description among them, padding at most on the last, whole words."""
    n = F.size(packets)
    padded = lambda b: u8(b, 0).bitwiseAND(F.lit(32)) != 0
    return F.struct(
        F.coalesce(u8(F.get(packets, F.lit(0)), 1).isin(200, 201), F.lit(False)).alias("report_first"), F.exists(packets, lambda b: u8(b, 1) == 202).alias("described"),
        (~F.exists(F.slice(packets, F.lit(1), F.greatest(n - 1, F.lit(0))), padded)).alias("padding_last"), F.forall(packets, lambda b: F.octet_length(b) % 4 == 0).alias("whole_words"),
        (F.size(F.filter(packets, lambda b: u8(b, 1) == 202)) <= 1).alias("one_description"),
    )


def block_bytes(ssrc: Column, fraction: Column, lost: Column, ext_seq: Column, jitter: Column, lsr: Column, dlsr: Column) -> Column:
    return F.concat(int_bytes(ssrc, 4), int_bytes(fraction, 1), int_bytes(lost, 3), *(int_bytes(x, 4) for x in (ext_seq, jitter, lsr, dlsr)))


def sender_report(ssrc: Column, sent: Column, rtp_ts: Column, packets: Column, octets: Column, block: Column | None = None) -> Column:
    """A sender report of the time ``sent`` (timestamp), with one report block or none."""
    ntp = ntp_from_timestamp(sent)
    high, low = F.floor(ntp / F.lit(1 << 32)).cast("bigint"), (ntp % F.lit(1 << 32)).cast("bigint")
    body = F.concat(int_bytes(ssrc, 4), int_bytes(high, 4), int_bytes(low, 4), int_bytes(rtp_ts, 4), int_bytes(packets, 4), int_bytes(octets, 4))
    return F.concat(F.lit(b"\x80\xc8\x00\x06"), body) if block is None else F.concat(F.lit(b"\x81\xc8\x00\x0c"), body, block)


def sender_reports(packets: DataFrame) -> DataFrame:
    """(ssrc, report): each stream's counters and newest time stamps as its sender would report them; one aggregation."""
    at = F.struct("arrival", "event_id", "copy")
    got = packets.groupBy("ssrc").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("octets"), F.max_by("rtp_ts", at).alias("rtp_ts"), F.max("arrival").alias("sent"))
    return got.select("ssrc", sender_report(F.col("ssrc"), F.col("sent"), F.col("rtp_ts"), F.col("n"), F.col("octets")).alias("report"))


def counters(packets: DataFrame, good: Column) -> DataFrame:
    """(ssrc, packets, octets, wire_octets, failed): valid packets, their payload and whole bytes, and the packets that failed."""
    raw, size = F.octet_length("raw"), F.octet_length("payload")
    ok = F.coalesce(good, F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    return packets.groupBy("ssrc").agg(F.count_if(ok).alias("packets"), total(size).alias("octets"), total(raw).alias("wire_octets"), F.count_if(~ok).alias("failed"))
