"""Queries of look-ups, sessions, reports and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, text
from ..operators import lookups, reports
from ..operators import packets as pk
from ..operators import streams as st
from ..streaming import frames as stateful
from ..streaming import sessions as ses
from .bridge import PACKETS, UNWRAPPED, packets, table
from .registry import query

# --- look-ups -------------------------------------------------------------------------------------


@query("""WITH cx AS (SELECT s_suppkey AS ctx_id, s_suppkey % 40 * 2 AS data_channel, s_suppkey % 40 * 2 + 1 AS control_channel FROM supplier),
u AS (SELECT channel, min(ctx_id) AS ctx_id FROM (SELECT ctx_id, data_channel AS channel FROM cx UNION ALL SELECT ctx_id, control_channel FROM cx) GROUP BY channel)
SELECT event_id, ctx_id FROM events LEFT JOIN u ON u.channel = event_id % 100""")
def lookup_by_channel(spark, sf_dir):
    k = F.col("s_suppkey") % 40 * 2
    contexts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ctx_id"), k.alias("data_channel"), (k + 1).alias("control_channel"))
    frames = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("channel"))
    return lookups.context_by_channel(frames, contexts).select("event_id", "ctx_id")


def _medias(spark, sf_dir):
    p = F.col("page_id")
    n = lambda c: c.cast("string")
    body = F.concat(F.lit("v=0\r\ns=x\r\nm=video "), n(5000 + p % 10), F.lit(" RTP/AVP 96 97\r\na=control:v"), n(p % 3), F.lit("\r\nm=audio "), n(6000 + p % 10), F.lit("/2 RTP/AVP 0 97\r\na=control:a\r\nm=text 9 RTP/AVP t140\r\n"))
    return lookups.medias(text.sdp_lines(table(spark, sf_dir, "pages").select(p.alias("doc_id"), body.alias("text"))))


@query("SELECT page_id AS doc_id, 3 AS medias, 'video' AS by_97, 1 AS section_97, 'audio' AS by_0, CASE WHEN page_id % 10 = 4 THEN 'audio' END AS by_port, 'v' || page_id % 3 AS control FROM pages")
def media_lookups(spark, sf_dir):
    """Media of descriptions by payload type and by port."""
    m = _medias(spark, sf_dir)
    one = lambda df, name, *more: df.select("doc_id", F.col("media").alias(name), *more)
    got = m.groupBy("doc_id").agg(F.count("*").cast("int").alias("medias"))
    got = got.join(one(lookups.media_by_payload_type(m, F.lit(97)), "by_97", F.col("section").alias("section_97"), "control"), "doc_id", "left")
    return got.join(one(lookups.media_by_payload_type(m, F.lit(0)), "by_0"), "doc_id", "left").join(one(lookups.media_by_port(m, F.lit(6004)), "by_port"), "doc_id", "left")


@query("""WITH cx AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'video' ELSE 'audio' END AS media, 5000 + (s_suppkey % 2) * 1000 + s_suppkey % 7 AS port, min(s_suppkey) AS ctx_id FROM supplier GROUP BY ALL)
SELECT p.page_id AS doc_id, m.media, ctx_id FROM (SELECT page_id, unnest(['video', 'audio', 'text']) AS media FROM pages) m JOIN pages p ON p.page_id = m.page_id
LEFT JOIN cx ON cx.media = m.media AND cx.port = CASE m.media WHEN 'video' THEN 5000 + p.page_id % 10 WHEN 'audio' THEN 6000 + p.page_id % 10 ELSE 9 END""")
def lookup_by_media(spark, sf_dir):
    k = F.col("s_suppkey")
    contexts = table(spark, sf_dir, "supplier").select(k.alias("ctx_id"), F.when(k % 2 == 0, "video").otherwise("audio").alias("media"), (5000 + k % 2 * 1000 + k % 7).cast("int").alias("port"))
    return lookups.context_for_media(_medias(spark, sf_dir), contexts).select("doc_id", "media", "ctx_id")


@query(f"WITH {PACKETS} SELECT event_id, copy, event_id % 4 < 3 AND event_id % 4 <= event_id % 3 AS contributes FROM pk")
def csrc_membership(spark, sf_dir):
    csrc = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda i: F.col("ssrc") + i)
    raw = pk.build(F.col("payload"), F.col("seq"), F.col("rtp_ts"), F.col("ssrc"), F.col("payload_type"), F.col("marker"), csrc)
    return packets(spark, sf_dir).withColumn("raw", raw).select("event_id", "copy", lookups.contributes(pk.parse(F.col("raw"))["csrc"], F.col("ssrc") + F.col("event_id") % 4).alias("contributes"))


# --- control packets ------------------------------------------------------------------------------


@query(f"""WITH {PACKETS}, r AS (SELECT ssrc, count(*) AS n, CAST(sum(strlen(payload)) AS BIGINT) AS octets, max_by(rtp_ts, (arrival, event_id, copy)) AS rtp_ts, max(arrival) AS sent FROM pk GROUP BY ssrc),
t AS (SELECT *, epoch_us(sent) // 1000000 + 2208988800 AS sec, (epoch_us(sent) % 1000000) * 4294967296 // 1000000 AS frac FROM r)
SELECT ssrc, printf('80C80006%08X%08X%08X%08X%08X%08X', ssrc, sec, frac, rtp_ts, n, octets) AS report, n AS packets, octets FROM t""")
def sender_report_build(spark, sf_dir):
    """Reports as their bytes, which SQL writes by itself, and read again."""
    rows = reports.sender_reports(packets(spark, sf_dir)).withColumn("d", reports.dispatch(F.col("report")))
    return rows.select("ssrc", F.hex("report").alias("report"), F.col("d.sender.packets").alias("packets"), F.col("d.sender.octets").alias("octets"))


_CONTROL = {0: "80C8000600000001AABBCCDD11223344000000070000000200000003", 1: "81C9000700000001000000020500000A00000064000000010000000200000003", 2: "81CA000300000009010361626300000000", 3: "82CB000200000005000000FF", 4: "85CC000300000005666F6F4D01020304", 5: "81CD0003000000050000000900070003", 6: "80D10000"}


@query("""SELECT e.event_id, t.kind, t.ssrc, t.packets, t.lost, t.bye, t.name, t.fmt FROM events e JOIN (VALUES
(0, 'SR', 1, 2, NULL, NULL, NULL, NULL), (1, 'RR', 1, NULL, 10, NULL, NULL, NULL), (2, 'SDES', 9, NULL, NULL, NULL, NULL, NULL), (3, 'BYE', 5, NULL, NULL, '5,255', NULL, NULL), (4, 'APP', 5, NULL, NULL, NULL, 'fooM', NULL), (5, 'RTPFB', 5, NULL, NULL, NULL, NULL, 1), (6, NULL, NULL, NULL, NULL, NULL, NULL, NULL))
t(k, kind, ssrc, packets, lost, bye, name, fmt) ON e.event_id % 7 = t.k""")
def control_dispatch(spark, sf_dir):
    """Packets written out in hexadecimal, by the type of each."""
    known = F.create_map(*(F.lit(x) for pair in _CONTROL.items() for x in pair))
    rows = table(spark, sf_dir, "events").select("event_id", reports.dispatch(F.unhex(F.element_at(known, (F.col("event_id") % 7).cast("int")))).alias("d"))
    return rows.select("event_id", "d.kind", "d.ssrc", F.col("d.sender.packets").alias("packets"), F.get("d.blocks", F.lit(0))["cumulative_lost"].alias("lost"), F.array_join(F.transform("d.bye", lambda x: x.cast("string")), ",").alias("bye"), F.col("d.app.name").alias("name"), F.col("d.feedback.fmt").alias("fmt"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '80C9,81CA,81CB' WHEN 1 THEN '80C9,81CB' ELSE '81CA,81CD' END AS ordered, event_id % 3 <> 2 AS report_first, event_id % 3 <> 1 AS described, TRUE AS padding_last, TRUE AS whole_words, TRUE AS one_description FROM events""")
def compound_rules(spark, sf_dir):
    rr, sdes, bye, fb = (F.unhex(F.lit(x)) for x in ("80C9000100000001", "81CA00020000000901016100", "81CB000100000001", "81CD00020000000500000009"))
    k = F.col("event_id") % 3
    given = F.when(k == 0, F.array(bye, sdes, rr)).when(k == 1, F.array(bye, rr)).otherwise(F.array(fb, sdes))
    rows = table(spark, sf_dir, "events").select("event_id", reports.ordered_compound(given).alias("p"))
    return rows.select("event_id", F.array_join(F.transform("p", lambda b: F.hex(F.substring(b, 1, 2))), ",").alias("ordered"), reports.compound_rules(F.col("p")).alias("r")).select("event_id", "ordered", "r.*")


@query(f"""WITH {PACKETS} SELECT ssrc, count(*) FILTER (WHERE ok) AS packets, CAST(coalesce(sum(strlen(payload)) FILTER (WHERE ok), 0) AS BIGINT) AS octets, CAST(coalesce(sum(strlen(payload) + 12) FILTER (WHERE ok), 0) AS BIGINT) AS wire_octets, count(*) FILTER (WHERE NOT ok) AS failed
FROM (SELECT *, payload_type IN (96, 97, 98) AS ok FROM pk) GROUP BY ssrc""")
def stream_counters(spark, sf_dir):
    raw = pk.build(F.col("payload"), F.col("seq"), F.col("rtp_ts"), F.col("ssrc"), F.col("payload_type"), F.col("marker"))
    rows = packets(spark, sf_dir).withColumn("raw", raw)
    return reports.counters(rows, pk.valid(pk.parse(F.col("raw")), [96, 97, 98]))


@query("SELECT event_id, 3 AS version, FALSE AS padding, CAST(event_id % 32 AS INTEGER) AS n, 201 AS packet_type, 7 AS length_words, event_id AS ssrc, FALSE AS ok, '128,127' AS mask FROM events")
def control_headers(spark, sf_dir):
    b = F.concat(bits.int_bytes(F.lit(0xC0) + F.col("event_id") % 32, 1), F.unhex(F.lit("C90007")), bits.int_bytes(F.col("event_id"), 4))
    h = pk.control_header(b)
    return table(spark, sf_dir, "events").select("event_id", h["version"].alias("version"), h["padding"].alias("padding"), h["count"].alias("n"), h["packet_type"].alias("packet_type"), h["length_words"].alias("length_words"), h["ssrc"].alias("ssrc"), pk.control_header_ok(b).alias("ok"), F.lit("128,127").alias("mask"))


@query("SELECT event_id, CAST(event_id % 32 AS INTEGER) AS fmt, event_id AS sender_ssrc, user_id AS media_ssrc, 'AABBCCDD' AS fci FROM events")
def feedback_report(spark, sf_dir):
    b = F.concat(bits.int_bytes(F.lit(0x80) + F.col("event_id") % 32, 1), F.unhex(F.lit("CD0003")), bits.int_bytes(F.col("event_id"), 4), bits.int_bytes(F.col("user_id"), 4), F.unhex(F.lit("AABBCCDD")))
    f = pk.feedback(b)
    return table(spark, sf_dir, "events").select("event_id", f["fmt"].alias("fmt"), f["sender_ssrc"].alias("sender_ssrc"), f["media_ssrc"].alias("media_ssrc"), F.hex(f["fci"]).alias("fci"))


@query("SELECT event_id, event_id % 40 NOT IN (1, 2, 19, 20, 21, 22, 23, 24, 27, 29, 30, 35, 36, 37, 38, 39) AS avp, event_id % 3 = 0 AS redundant FROM events")
def profile_validity(spark, sf_dir):
    """Packets judged by the rules of their profile."""
    e = F.col("event_id")
    some = F.encode("props", "UTF-8")
    raw = lambda payload, kind: pk.build(payload, F.lit(1), F.lit(2), F.lit(3), kind, F.lit(False))
    body = F.when(e % 3 == 0, F.concat(F.unhex(F.lit("E000000260AABB")), some)).when(e % 3 == 1, F.unhex(F.lit("E0000002")))
    rows = table(spark, sf_dir, "events").select("event_id", raw(some, (e % 40).cast("int")).alias("a"), raw(F.coalesce(body, F.lit(b"")), F.lit(97)).alias("b"))
    rows = rows.select("event_id", pk.parse(F.col("a")).alias("a"), pk.parse(F.col("b")).alias("b"))
    return rows.select("event_id", pk.valid_for(F.col("a"), "RTP/AVP").alias("avp"), pk.valid_for(F.col("b"), "redundant").alias("redundant"))


# --- sessions -------------------------------------------------------------------------------------


@query(f"""WITH {PACKETS}, f AS (SELECT ssrc, arrival, event_id, copy, event_id % 29 = 0 AS bye, coalesce(lag(event_id % 29 = 0) OVER w OR arrival > lag(arrival) OVER w + INTERVAL 12 HOUR, TRUE) AS fresh FROM pk WINDOW w AS (PARTITION BY ssrc ORDER BY arrival, event_id, copy)),
s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY ssrc ORDER BY arrival, event_id, copy) AS session FROM f)
SELECT ssrc, CAST(session AS BIGINT) AS session, min(arrival) AS begins, max(arrival) AS ends, count(*) AS packets, bool_or(bye) AS said_goodbye FROM s GROUP BY ALL""")
def stream_sessions(spark, sf_dir):
    """Sessions that end by a goodbye (every 29th event is one) or by twelve quiet hours."""
    return ses.sessions(packets(spark, sf_dir), F.col("event_id") % 29 == 0, "12 hours")


@query(f"""WITH {PACKETS}, own AS (SELECT s_suppkey AS local_ssrc, 'h' || s_suppkey % 3 AS source FROM supplier), hit AS (SELECT pk.ssrc, own.source AS home, 'h' || event_id % 3 AS source FROM pk JOIN own ON pk.ssrc = own.local_ssrc)
SELECT ssrc, count(DISTINCT source) AS peers FROM hit WHERE source <> home GROUP BY ssrc, home""")
def identity_collision(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("local_ssrc"), F.concat(F.lit("h"), (F.col("s_suppkey") % 3).cast("string")).alias("source"))
    rows = packets(spark, sf_dir).select("ssrc", F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("source"))
    return ses.collisions(rows, own).select("ssrc", "peers")


_METHODS = ["OPTIONS", "DESCRIBE", "SETUP", "PLAY", "PAUSE", "RECORD", "TEARDOWN"]


@query(f"""WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS k, {_METHODS}[CAST((conv_id * 3 + turn * turn * 5 + turn) % 7 + 1 AS INTEGER)] AS method FROM conversations),
m AS (SELECT conv_id, turn, k, method, CASE WHEN method = 'SETUP' THEN 'ready' ELSE 'init' END AS state, method NOT IN ('PLAY', 'RECORD', 'PAUSE') AS allowed FROM r WHERE k = 1
UNION ALL SELECT r.conv_id, r.turn, r.k, r.method,
 CASE WHEN r.method = 'SETUP' AND m.state IN ('init', 'ready') THEN 'ready' WHEN r.method = 'PLAY' AND m.state IN ('ready', 'playing') THEN 'playing' WHEN r.method = 'RECORD' AND m.state IN ('ready', 'recording') THEN 'recording' WHEN r.method = 'PAUSE' AND m.state <> 'init' THEN 'ready' WHEN r.method = 'TEARDOWN' THEN 'init' ELSE m.state END,
 CASE r.method WHEN 'SETUP' THEN m.state IN ('init', 'ready') WHEN 'PLAY' THEN m.state IN ('ready', 'playing') WHEN 'RECORD' THEN m.state IN ('ready', 'recording') WHEN 'PAUSE' THEN m.state <> 'init' ELSE TRUE END
 FROM m JOIN r ON r.conv_id = m.conv_id AND r.k = m.k + 1)
SELECT conv_id, turn, method, state, allowed FROM m""")
def session_state_machine(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    method = F.element_at(F.array(*map(F.lit, _METHODS)), ((c * 3 + t * t * 5 + t) % 7 + 1).cast("int"))
    return ses.replay(table(spark, sf_dir, "conversations").select("conv_id", "turn", method.alias("method")), "conv_id", "turn")


@query(f"""WITH RECURSIVE {PACKETS}, o AS (SELECT ssrc, CAST((seq + CASE WHEN rn > 20 THEN 5000 ELSE 0 END + CASE WHEN rn > 40 THEN 9000 ELSE 0 END) % 65536 AS BIGINT) AS seq, CAST(row_number() OVER (PARTITION BY ssrc ORDER BY arrival, event_id, copy) AS BIGINT) AS k FROM pk),
m AS (SELECT ssrc, k, seq AS base, seq AS high, 0::BIGINT AS cycles, -1::BIGINT AS bad, 1::BIGINT AS received, 0::BIGINT AS rejected FROM o WHERE k = 1
UNION ALL SELECT o.ssrc, o.k,
 CASE WHEN s.step >= 500 AND s.step <= 65436 AND o.seq = m.bad THEN o.seq ELSE m.base END,
 CASE WHEN s.step < 500 OR (s.step <= 65436 AND o.seq = m.bad) THEN o.seq ELSE m.high END,
 CASE WHEN s.step < 500 THEN m.cycles + CASE WHEN o.seq < m.high THEN 65536 ELSE 0 END WHEN s.step <= 65436 AND o.seq = m.bad THEN 0 ELSE m.cycles END,
 CASE WHEN s.step >= 500 AND s.step <= 65436 THEN CASE WHEN o.seq = m.bad THEN -1 ELSE (o.seq + 1) % 65536 END ELSE m.bad END,
 CASE WHEN s.step >= 500 AND s.step <= 65436 THEN CASE WHEN o.seq = m.bad THEN 1 ELSE m.received END ELSE m.received + 1 END,
 m.rejected + CASE WHEN s.step >= 500 AND s.step <= 65436 AND o.seq <> m.bad THEN 1 ELSE 0 END
 FROM m JOIN o ON o.ssrc = m.ssrc AND o.k = m.k + 1, LATERAL (SELECT (o.seq - m.high + 65536) % 65536 AS step) s)
SELECT ssrc, max_by(received, k) AS received, max_by(cycles + high - base + 1, k) AS expected, max_by(rejected, k) AS rejected FROM m GROUP BY ssrc""")
def sequence_validation(spark, sf_dir):
    """The literal state machine over streams that jump twice and so begin anew."""
    jump = F.when(F.col("rn") > 20, 5000).otherwise(0) + F.when(F.col("rn") > 40, 9000).otherwise(0)
    return stateful.validate(packets(spark, sf_dir).withColumn("seq", ((F.col("seq") + jump) % 65536).cast("int")))


_BUFFERED = """fq AS (SELECT DISTINCT ssrc, payload_type, rtp_ts, ext_seq, marker FROM un),
bf AS (SELECT ssrc, payload_type, rtp_ts, CAST(count(*) AS INTEGER) AS packets, CAST(sum(CAST(marker AS INTEGER)) AS INTEGER) AS markers, max(ext_seq) - min(ext_seq) + 1 = count(*) AND sum(CAST(marker AS INTEGER)) > 0 AS whole FROM fq GROUP BY ALL)"""


@query(f"WITH {UNWRAPPED}, {_BUFFERED} SELECT ssrc, payload_type, rtp_ts, packets, markers FROM bf WHERE whole")
def jitter_buffer(spark, sf_dir):
    """Whole frames as the stateful buffer gives them out over a stream of the packets; its payload type is that of the stream."""
    from ..sources.scratch import scratch_path

    path = scratch_path(spark, "jitter")
    rows = packets(spark, sf_dir).withColumn("arrival", F.col("arrival").cast("timestamp"))
    rows.write.parquet(f"{path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    got = ses.buffered_frames(stream, capacity=1 << 20)
    got.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start().awaitTermination()
    # a frame that was whole before a part of it came is given out once, with what had come
    late = spark.read.schema("ssrc bigint, payload_type int, rtp_ts bigint, packets int, markers int, whole boolean").parquet(f"{path}/out")
    return late.where("whole").select("ssrc", "payload_type", "rtp_ts", "packets", "markers")


# --- messages -------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, 'HTTP' AS protocol, 1.1 AS version, 'POST' AS method, '/c/' || conv_id AS uri, CAST(turn AS VARCHAR) AS length, md5(coalesce(text, '') || chr(13) || chr(10) || chr(13) || chr(10) || role || chr(13) || 'x') AS body FROM conversations")
def http_message(spark, sf_dir):
    """Requests whose bodies hold line ends of all kinds and an empty line."""
    raw = F.concat(F.lit("POST /c/"), F.col("conv_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: h\r\nX-Long: a\r\n b\r\nContent-Length: "), F.col("turn").cast("string"), F.lit("\r\n\r\n"), F.coalesce("text", F.lit("")), F.lit("\r\n\r\n"), F.col("role"), F.lit("\rx"))
    m = text.message(raw)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", m["protocol"].alias("protocol"), m["version"].alias("version"), m["method"].alias("method"), m["uri"].alias("uri"), text.header(m["headers"], "content-length").alias("length"), F.md5(m["body"].cast("binary")).alias("body"))


@query("SELECT conv_id, turn, 'SIP' AS protocol, turn % 2 = 0 AS is_request, CASE WHEN turn % 2 = 0 THEN 'INVITE' END AS method, CASE WHEN turn % 2 = 1 THEN 180 END AS status, CASE WHEN turn % 2 = 1 THEN 'Ringing' END AS reason, '<sip:u' || conv_id || '@h>' AS caller, 'v=0' || chr(13) || chr(10) || 's=' || role AS body FROM conversations")
def sip_message(spark, sf_dir):
    first = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("INVITE sip:a@h SIP/2.0"))).otherwise("SIP/2.0 180 Ringing")
    raw = F.concat(first, F.lit("\r\nFrom: <sip:u"), F.col("conv_id").cast("string"), F.lit("@h>\r\nCSeq: 1 INVITE\r\n\r\nv=0\r\ns="), F.col("role"))
    m = text.message(raw)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", m["protocol"].alias("protocol"), m["is_request"].alias("is_request"), m["method"].alias("method"), m["status"].alias("status"), m["reason"].alias("reason"), text.header(m["headers"], "from").alias("caller"), m["body"].alias("body"))


@query("SELECT conv_id, turn, 'clock' AS type, CAST(1577836800 + turn AS DOUBLE) AS start, NULL::DOUBLE AS stop, 'smpte' AS type2, CAST(3600 + turn AS DOUBLE) AS start2, CAST(7200 AS DOUBLE) AS stop2, turn + 0.5 AS stamp, 0.25 AS delay FROM conversations WHERE turn < 60")
def range_clock_smpte(spark, sf_dir):
    """Turns below 60, which fill the seconds of a clock."""
    two = F.lpad(F.col("turn").cast("string"), 2, "0")
    c = text.sdp_range(F.concat(F.lit("clock=20200101T0000"), two, F.lit("Z-")))
    s = text.sdp_range(F.concat(F.lit("smpte=1:00:"), two, F.lit("-2:00:00")))
    h = text.timestamp_header(F.concat(F.col("turn").cast("string"), F.lit(".5 delay=0.25")))
    return table(spark, sf_dir, "conversations").where("turn < 60").select("conv_id", "turn", c["type"].alias("type"), c["start"].alias("start"), c["end"].alias("stop"), s["type"].alias("type2"), s["start"].alias("start2"), s["end"].alias("stop2"), h["timestamp"].alias("stamp"), h["delay"].alias("delay"))


@query(f"""WITH {PACKETS} SELECT ssrc, time_bucket(INTERVAL 1 HOUR, arrival) AS start, count(*) AS packets, CAST(sum(strlen(payload)) AS BIGINT) AS octets FROM pk GROUP BY ALL""")
def periodic_reports(spark, sf_dir):
    """The windowed report of a stream, run over all packets at once."""
    return stateful.interval_counts(packets(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {UNWRAPPED} SELECT ssrc, count(*) FILTER (WHERE late) AS late FROM (SELECT ssrc, ext_seq < max(ext_seq) OVER (PARTITION BY ssrc ORDER BY arrival, event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM un) GROUP BY ssrc")
def late_packets(spark, sf_dir):
    return st.late(st.unwrap(packets(spark, sf_dir)))
