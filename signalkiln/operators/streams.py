"""Ordered statistics of packet streams: unwrapping, loss, jitter, reports, frames, look-ups.

Packets are rows of (ssrc, arrival, event_id, seq, payload_type, rtp_ts, marker, payload). A stream is
ordered by arrival. Unwrapping and jitter order the packets of one stream and hour at a time, and then
only one small row of each hour, so that a stream with a third of all packets is spread over tasks.
Aggregations are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import join_bytes

ORDER = ("arrival", "event_id", "copy")
#: Packets of a frame at most; a frame that has more is not complete.
MAX_FRAME = 1024


def _stream() -> W:
    return W.partitionBy("ssrc").orderBy(*ORDER)


def _bucketed(packets: DataFrame) -> tuple[DataFrame, W]:
    """The packets with their hour, and the order inside a stream and hour."""
    rows = packets.withColumn("__hour", F.date_trunc("hour", "arrival"))
    return rows, W.partitionBy("ssrc", "__hour").orderBy(*ORDER)


def _turn(step: Column) -> Column:
    return F.when(step < -32768, 65536).when(step > 32767, -65536).otherwise(0)


def unwrap(packets: DataFrame) -> DataFrame:
    """Adds ext_seq: the 16-bit sequence number plus 65536 for each wrap that its stream has seen.

    Wraps are counted inside each hour of a stream; the hours' first and last numbers and counts, one row
    an hour, give what came before each hour. Rows without an arrival time form an hour of their own, the first.
    """
    rows, w = _bucketed(packets)
    rows = rows.withColumn("__turn", _turn(F.col("seq") - F.lag("seq").over(w)))
    rows = rows.withColumn("__turns", F.coalesce(F.sum("__turn").over(w), F.lit(0)))
    at = F.struct(*ORDER)
    hours = rows.groupBy("ssrc", "__hour").agg(F.min_by("seq", at).alias("first"), F.max_by("seq", at).alias("last"), F.sum("__turn").alias("turns"))
    order = W.partitionBy("ssrc").orderBy("__hour")
    edge = _turn(F.col("first") - F.lag("last").over(order)) + F.coalesce(F.lag("turns").over(order), F.lit(0))
    before = hours.withColumn("edge", edge).select("ssrc", "__hour", F.sum("edge").over(order).alias("__before"))
    got = rows.alias("r").join(before.alias("b"), (F.col("r.ssrc") == F.col("b.ssrc")) & F.col("r.__hour").eqNullSafe(F.col("b.__hour")))
    return got.select(*(F.col(f"r.{c}") for c in packets.columns), (F.col("r.seq") + F.col("r.__turns") + F.col("b.__before")).cast("bigint").alias("ext_seq"))


def loss(unwrapped: DataFrame, *by: str) -> DataFrame:
    """received, expected, lost, fraction (of 256) for each stream, or stream and ``by``.

    Lost is clamped to 24 signed bits; the fraction is 0 where nothing is lost.
    """
    got = unwrapped.groupBy("ssrc", *by).agg(F.count("*").alias("received"), F.min("ext_seq").alias("base_seq"), F.max("ext_seq").alias("max_seq"))
    expected = F.col("max_seq") - F.col("base_seq") + 1
    lost = F.greatest(F.least(expected - F.col("received"), F.lit((1 << 23) - 1)), F.lit(-(1 << 23)))
    return got.select("ssrc", *by, "received", expected.alias("expected"), lost.alias("lost"), _fraction(lost, expected).alias("fraction"))


def _fraction(lost: Column, expected: Column) -> Column:
    return F.when((expected > 0) & (lost > 0), F.floor(lost * 256 / F.nullif(expected, F.lit(0)))).otherwise(0).cast("int")


def interval_report(unwrapped: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Loss since the prior report, one row for each stream and interval: a tumbling aggregate and one lag over its rows."""
    start = F.window(F.col("arrival").cast("timestamp"), interval)["start"]
    per = unwrapped.groupBy("ssrc", start.alias("start")).agg(F.count("*").alias("received"), F.max("ext_seq").alias("max_seq"), F.min("ext_seq").alias("min_seq"), F.sum(F.octet_length("payload")).alias("octets"))
    w = W.partitionBy("ssrc").orderBy("start")
    upto = F.max("max_seq").over(w.rowsBetween(W.unboundedPreceding, -1))
    high = F.greatest(F.col("max_seq"), F.coalesce(upto, F.col("max_seq")))
    expected = high - F.coalesce(upto, F.col("min_seq") - 1)
    lost = expected - F.col("received")
    return per.select("ssrc", "start", "received", "octets", expected.alias("expected"), lost.alias("lost"), _fraction(lost, expected).alias("fraction"))


def timestamp_delta(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts_delta", F.col("rtp_ts") - F.lag("rtp_ts").over(_stream()))


def jitter(packets: DataFrame, rate: int = 90000) -> DataFrame:
    """RFC 3550 interarrival jitter, in clock units: J += (|D| - J) / 16 over the packets of a stream in order.

    The recursion is a fold, J_n = (15/16) J_(n-1) + |D_n| / 16, so each packet's share of the result is
    |D_n| / 16 * (15/16)^(packets after it). The shares are summed inside each hour of a stream; the hours'
    sums, counts and first and last packets, one row an hour, are then joined up.
    """
    rows, w = _bucketed(packets)
    us = F.unix_micros(F.col("arrival").cast("timestamp"))
    apart = lambda a, b, c, d: F.abs((a - b) * (rate / 1e6) - (c - d))
    weight = lambda n: F.pow(F.lit(15 / 16), n)
    rows = rows.select("ssrc", "__hour", *ORDER, "rtp_ts", us.alias("us"), apart(us, F.lag(us).over(w), F.col("rtp_ts"), F.lag("rtp_ts").over(w)).alias("d"), F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy("ssrc", "__hour")).alias("n"))
    at, place = F.struct(*ORDER), F.struct("us", "rtp_ts")
    hours = rows.groupBy("ssrc", "__hour").agg(F.max("n").alias("n"), F.coalesce(F.sum(F.col("d") / 16 * weight(F.col("n") - F.col("k"))), F.lit(0.0)).alias("share"), F.min_by(place, at).alias("first"), F.max_by(place, at).alias("last"))
    order = W.partitionBy("ssrc").orderBy("__hour")
    before = F.lag("last").over(order)
    edge = F.coalesce(apart(F.col("first.us"), before["us"], F.col("first.rtp_ts"), before["rtp_ts"]) / 16 * weight(F.col("n") - 1), F.lit(0.0))
    after = F.coalesce(F.sum("n").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    joined = hours.select("ssrc", "n", ((F.col("share") + edge) * weight(after)).alias("share"))
    return joined.groupBy("ssrc").agg(F.sum("n").alias("packets"), F.sum("share").alias("jitter"))


def reject_duplicates(unwrapped: DataFrame) -> DataFrame:
    """The first arrival of each (ssrc, rtp_ts, ext_seq); min_by is combined before the shuffle."""
    rest = [c for c in unwrapped.columns if c not in ("ssrc", "rtp_ts", "ext_seq")]
    first = F.min_by(F.struct(*rest), F.struct(*ORDER))
    return unwrapped.groupBy("ssrc", "rtp_ts", "ext_seq").agg(first.alias("r")).select(*(F.col(f"r.{c}") if c in rest else F.col(c) for c in unwrapped.columns))


def frames(unique: DataFrame) -> DataFrame:
    """One row for each (ssrc, payload_type-free timestamp) group of packets without duplicates.

    complete: no gap, a marker, and no more than MAX_FRAME packets. payload: the first MAX_FRAME parts in order.
    """
    # of a longer group no more than MAX_FRAME parts are gathered; the rest is counted
    nth = F.row_number().over(W.partitionBy("ssrc", "rtp_ts").orderBy("ext_seq"))
    rows = unique.select("ssrc", "rtp_ts", "marker", "ext_seq", "arrival", F.when(nth <= MAX_FRAME, F.struct("ext_seq", "payload")).alias("part"))
    got = rows.groupBy("ssrc", "rtp_ts").agg(
        F.count("*").alias("packets"), F.sum(F.col("marker").cast("int")).alias("markers"), F.min("ext_seq").alias("first_seq"), F.max("ext_seq").alias("last_seq"), F.min("arrival").alias("first_arrival"), F.array_sort(F.collect_list("part")).alias("parts"),
    )
    whole = (F.col("last_seq") - F.col("first_seq") + 1 == F.col("packets")) & (F.col("markers") > 0) & (F.col("packets") <= MAX_FRAME)
    return got.withColumns({"complete": whole, "payload": join_bytes(F.transform("parts", lambda x: x["payload"]))}).drop("parts")


def late(unwrapped: DataFrame) -> DataFrame:
    """(ssrc, late): packets of each stream that came behind one with a higher number."""
    before = F.max("ext_seq").over(_stream().rowsBetween(W.unboundedPreceding, -1))
    return unwrapped.select("ssrc", (F.col("ext_seq") < before).alias("late")).groupBy("ssrc").agg(F.count_if("late").alias("late"))


def last_frames(frames_: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` newest frames of each stream."""
    w = W.partitionBy("ssrc").orderBy(F.desc("first_arrival"), F.desc("rtp_ts"))
    return frames_.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def derivative(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(y - previous y) / (t - previous t) along each key; null where the times are equal."""
    w = W.partitionBy(key).orderBy(at, value)
    return rows.withColumn("slope", (F.col(value) - F.lag(value).over(w)) / F.nullif(F.col(at) - F.lag(at).over(w), F.lit(0)))


def ring(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def lookup_context(packets: DataFrame, contexts: DataFrame, small: int = 100_000) -> DataFrame:
    """Each packet's context: by ssrc (local or remote), else by payload type; of several the last registered.

    ``contexts`` has ctx_id (registration order), local_ssrc, remote_ssrc, payload_types. Both look-up
    tables hold one row a key, so the joins multiply nothing; they are broadcast if the contexts count
    ``small`` at most and shuffled otherwise.
    """
    near = F.broadcast if contexts.limit(small + 1).count() <= small else lambda x: x
    by_ssrc = contexts.select("ctx_id", F.explode(F.array("local_ssrc", "remote_ssrc")).alias("ssrc")).where("ssrc is not null").groupBy("ssrc").agg(F.max("ctx_id").alias("ssrc_ctx"))
    by_type = contexts.select("ctx_id", F.explode("payload_types").alias("payload_type")).groupBy("payload_type").agg(F.max("ctx_id").alias("type_ctx"))
    found = packets.join(near(by_ssrc), "ssrc", "left").join(near(by_type), "payload_type", "left")
    return found.withColumn("ctx_id", F.coalesce("ssrc_ctx", "type_ctx")).drop("ssrc_ctx", "type_ctx")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it: one union, one window, no range join."""
    rest = [c for c in left.columns if c not in (key, at)]
    rows = left.select(key, at, F.struct(*rest).alias("l"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    rows = rows.unionByName(right.select(key, at, F.lit(None).cast(rows.schema["l"].dataType).alias("l"), value, F.lit(0).alias("side")))
    w = W.partitionBy(key).orderBy(at, "side").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").select(key, at, *(F.col(f"l.{c}").alias(c) for c in rest), value)
