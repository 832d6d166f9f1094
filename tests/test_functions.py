"""Golden values and round trips of functions and walkers that the SQL queries don't reach."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalkiln.functions import bits, kernels, signal, subband, text, timecode
from signalkiln.operators import packets as pk
from signalkiln.operators import payloads
from signalkiln.operators import streams as st
from signalkiln.plans import catalog, media
from signalkiln.sources import containers, dump, images, jpeg, tracks
from signalkiln.streaming import frames


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_bits(spark):
    b = F.lit(bytes.fromhex("8F01FE7A00FF80FF"))
    r = one(spark, a=bits.u16(b, 0), l=bits.u16(b, 0, True), s=bits.sint(b, 6, 2), w=bits.uint(b, 0, 8), e=bits.u32(b, 6), m=bits.bits_msb(b, 4, 8), q=bits.bits_lsb(b, 4, 8), o=bits.octets(b), f=bits.contains_bytes(b, F.lit(b"\x00\xff")))
    assert (r.a, r.l, r.s, int(r.w), r.e, r.m, r.q, r.f) == (0x8F01, 0x018F, -32513, 0x8F01FE7A00FF80FF, None, 0xF0, 0x18, 4)
    assert r.o == [0x8F, 1, 0xFE, 0x7A, 0, 0xFF, 0x80, 0xFF]


def test_rational(spark):
    half, third = bits.rational(F.lit(2), F.lit(4)), bits.rational(F.lit(-1), F.lit(-3))
    r = one(spark, s=bits.rational_add(half, third), p=bits.rational_multiply(half, third), z=bits.rational(F.lit(1), F.lit(0)))
    assert tuple(r.s) == (5, 6) and tuple(r.p) == (1, 6) and r.z is None


def test_ntp_eras(spark):
    r = one(spark, a=timecode.ntp_from_timestamp(F.lit("2036-02-07 06:28:16").cast("timestamp")), b=timecode.timestamp_from_ntp(F.lit("9487534653230284800").cast("decimal(20,0)")).cast("string"), c=timecode.timestamp_from_ntp(F.lit(0).cast("decimal(20,0)")).cast("string"), d=timecode.midi_delta(F.lit(b"\x81\x80\x00")))
    assert int(r.a) == 0 and r.b == "1970-01-01 00:00:00" and r.c == "2036-02-07 06:28:16" and r.d == 1 << 14


def test_text_edges(spark):
    r = one(
        spark, m=text.message(F.lit("HTTP/1.1 404 Not Found\r\nA: 1\r\n b\r\nbad\r\n\r\nx\r\n\r\ny")), q=text.message(F.lit("nonsense")), r=text.sdp_range(F.lit("clock=20200101T000000Z-")), t=text.transport(F.lit("RTP/AVP;multicast;ttl=127;ssrc=DEADBEEF;client_port=5000")),
        p=text.params(F.lit("a=1; b ;a=2")), e=text.endpoint(F.lit("[::1]:80")), i=text.ipv4(F.lit("1.2.3.256")), h=text.timestamp_header(F.lit("12.5 delay=0.25")), y=text.typed_time(F.lit("7d 1h -30m 5s")),
    )
    assert (r.m.status, r.m.reason, r.m.headers, r.m.body, r.m.valid) == (404, "Not Found", {"a": "1 b"}, "x\r\n\r\ny", True) and not r.q.valid
    assert r.r.type == "clock" and r.r.end is None and r.t.ssrc == 0xDEADBEEF and not r.t.unicast and r.t.client_port.high == 5000
    assert r.p == {"a": "2", "b": None} and tuple(r.e) == ("::1", 80) and r.i is None and tuple(r.h) == (12.5, 0.25) and r.y == 7 * 86400 + 3600 - 1800 + 5


def test_companding_round_trip(spark):
    rows = spark.range(-32768, 32768, 97).select(F.col("id").cast("int").alias("x"))
    got = rows.select("x", signal.mulaw_decode(signal.mulaw_encode(F.col("x"))).alias("u"), signal.alaw_decode(signal.alaw_encode(F.col("x"))).alias("a")).toPandas()
    assert (np.abs(got.x - got.u) <= np.maximum(np.abs(got.x) / 16, 16) + 200 * (np.abs(got.x) > 32000)).all() and (np.abs(got.x - got.a) <= np.maximum(np.abs(got.x) / 16, 16) + 600 * (np.abs(got.x) > 32000)).all()
    r = one(spark, z=signal.mulaw_encode(F.lit(0)), m=signal.mulaw_encode(F.lit(-1)), a=signal.alaw_encode(F.lit(0)))
    assert (r.z, r.m, r.a) == (0xFF, 0x7F, 0xD5)


def test_cosine_transform():
    x = np.random.default_rng(3).normal(size=(5, 64))
    assert np.allclose(kernels.idct(kernels.fdct(x)), x) and np.allclose(kernels.fdct(np.ones((1, 64)))[0], [8, *[0] * 63])
    assert signal.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(signal.ZIGZAG) == list(range(64))


def test_compat_modes(spark):
    r = one(spark, d=timecode.frame_duration(F.lit(1), F.lit(90001), 90000), c=timecode.frame_duration(F.lit(1), F.lit(90001), 90000, "compat"), l=signal.xyz_to_lab(F.lit(0.5), F.lit(0.5), F.lit(0.5))["l"], k=signal.xyz_to_lab(F.lit(0.5), F.lit(0.5), F.lit(0.5), "compat")["l"])
    assert (r.d, r.c) == (1.0, 1.0) and abs(r.l - 76.069) < 0.01 and abs(r.k - (116 * 0.5**0.75 - 16)) < 1e-9


def test_truncated_packets(spark):
    rows = spark.createDataFrame([(b"",), (None,), (b"\x80\x60\x00",), (b"\xb1" + b"\x60" * 11,), (b"\xa0\x60" + bytes(9) + b"\x01\xff",)], "raw binary")
    got = [r.h for r in rows.select(pk.parse(F.col("raw")).alias("h")).collect()]
    assert not any(h.complete for h in got) and got[2].payload_type == 96


def test_compound_stops_at_bad_packet(spark):
    good = b"\x80\xc9\x00\x01\x00\x00\x00\x07"
    r = one(spark, p=pk.split_compound(F.lit(good + good + b"\x40\xc9\x00\x00")), q=pk.split_compound(F.lit(good[:6])), f=pk.feedback(F.lit(b"\x81\xcd\x00\x03" + bytes(4) + b"\0\0\0\x09" + b"\x00\x05\x00\x03")), ok=pk.control_header_ok(F.lit(good)))
    assert [bytes(x) for x in r.p] == [good, good] and r.q == [] and r.f.media_ssrc == 9 and r.ok
    assert one(spark, n=pk.nack_sequences(F.lit(b"\x00\x05\x00\x03"))).n == [5, 6, 7]


def test_fragmented_unit(spark):
    parts = [list(pk._h264(x)) for x in (b"\x7c\x85ab", b"\x7c\x05cd", b"\x7c\x45ef", b"\x00xx", b"a")]
    assert parts[0] == [(0, 5, True, False, b"\x65ab")] and parts[2] == [(0, 5, False, True, b"ef")] and parts[3] == parts[4] == []


FILES = {
    "ebml": bytes.fromhex("1A45DFA3") + b"\x84" + b"\x42\x86\x81\x01" + bytes.fromhex("18538067") + b"\xff" + bytes.fromhex("1654AE6B") + b"\x85" + b"\xae\x83\xd7\x81\x05",
    "ogg": b"OggS\0\x02" + struct.pack("<qIII", 5, 9, 0, 0) + b"\x01\x03abc" + b"OggS\0\x04" + struct.pack("<qIII", 77, 9, 1, 0) + b"\x01\x02de",
    "asf": bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C") + struct.pack("<Q", 30 + 28) + bytes(6) + bytes(16) + struct.pack("<Q", 28) + b"body",
    "mxf": bytes.fromhex("060E2B34") + bytes(12) + b"\x82\x00\x03abc",
    "gxf": b"\0\0\0\0\1\xbc\0\0\0\x12" + bytes(4) + b"\xe1\xe2" + b"xy",
    "real": b".RMF\0\0\0\x0aab" + b"PROP\0\0\0\x09x",
    "flac": b"fLaC\x80\0\0\x02abframes",
    "png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x02IHDRab" + bytes(4),
    "jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02zz\xff\x00z\xff\xd9",
    "mpeg": b"\0\0\1\xe0\0\x03abc\0\0\1\xb9",
    "bmff": struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 16) + b"moov" + struct.pack(">I", 8) + b"trak",
}


def test_walkers(spark):
    rows = spark.createDataFrame([(k, v) for k, v in FILES.items()] + [("none", None), ("text", b"hello")], "path string, content binary")
    got: dict = {}
    for r in containers.nodes(rows).orderBy("path", "ord").collect():
        assert r.format == r.path
        got.setdefault(r.path, []).append((r.depth, r.parent, r.identifier, r.data_size, r.complete))
    assert set(got) == set(FILES)
    assert [x[:4] for x in got["ebml"]] == [(0, -1, "1a45dfa3", 4), (1, 0, "4286", 1), (0, -1, "18538067", 10), (1, 2, "1654ae6b", 5), (2, 3, "ae", 3), (3, 4, "d7", 1)]
    assert got["ogg"] == [(0, -1, "OggS:2:9:0:5", 3, True), (0, -1, "OggS:4:9:1:77", 2, True)] and [x[3] for x in got["asf"]] == [34, 4] and got["mxf"][0][3] == 3
    assert got["gxf"][0][2:4] == ("bc", 2) and [x[2] for x in got["real"]] == [".RMF", "PROP"] and [x[2] for x in got["flac"]] == ["0", "frames"] and got["png"][0][2:] == ("IHDR", 2, True)
    assert [(x[2], x[3]) for x in got["jpeg"]] == [("d8", 0), ("e0", 2), ("da", 5), ("d9", 0)] and [x[2] for x in got["mpeg"]] == ["e0", "b9"] and [x[2] for x in got["bmff"]] == ["ftyp", "moov", "trak"]
    tracks = containers.ogg_tracks(containers.nodes(rows)).first()
    assert (tracks.serial, tracks.pages, tracks.granules) == (9, 2, 77)


@pytest.mark.parametrize("name", sorted(media.FILES))
def test_walkers_survive_truncation_of_whole_files(name):
    data = bytes.fromhex(media.FILES[name][0])
    walk = containers.WALKERS.get(name.split()[0])
    for n in range(len(data) if walk else 0):
        for _, _, at, size, whole in walk(data[:n]):
            assert size >= 0 and (not whole or at <= n)


def test_tracks_survive_truncation():
    for reader, data in ((tracks.ebml_tracks, media.MATROSKA), (tracks.riff_tracks, media.AVI), (tracks.ogg_stream_tracks, media.OGG)):
        assert list(reader(data))


def test_png_filters():
    """Lines of each of the five filters, written here by hand."""
    import zlib

    rng = np.random.default_rng(8)
    px = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    flat = px.reshape(5, 12).astype(int)
    raw = b""
    for y in range(5):
        line = []
        for i in range(12):
            a, b, c = flat[y, i - 3] if i > 2 else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - 3] if y and i > 2 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[y]) % 256)
        raw += bytes([y]) + bytes(line)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + bytes(4)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.png_array(data) == px).all() and (images.png_array(images.png_file(px)) == px).all() and (images.bmp_array(images.bmp_file(px)) == px).all()


def test_jpeg_blocks_and_pixels():
    """The reader gets the writer's blocks; smooth pictures come back closely; restart markers, sub-sampling and cut files are read."""
    y, x = np.mgrid[0:21, 0:30]
    px = np.stack([x * 8, y * 12, (x + y) * 4], axis=2).astype(np.uint8)
    data = jpeg.file(px, 95)
    back = jpeg.array(data)
    assert back.shape == px.shape and np.abs(back.astype(int) - px).mean() < 3
    frame = jpeg.decode(data)
    for n in range(0, len(data), 37):
        jpeg.array(data[:n])
    # by hand: one grey block of 16 x 8 pixels in two units with a restart marker between; codes of 1 and 2 bits
    part = lambda c, b: b"\xff" + bytes([c]) + struct.pack(">H", len(b) + 2) + b
    tables = part(0xDB, b"\0" + bytes([1] * 64)) + part(0xC4, b"\0" + bytes([0, 2] + [0] * 14) + bytes([0, 5]) + b"\x10" + bytes([1] + [0] * 15) + b"\0")
    head = b"\xff\xd8" + tables + part(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0])) + part(0xDD, struct.pack(">H", 1)) + part(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    scan = bytes([0b01_10000_0]) + b"\xff\xd0" + bytes([0b01_01111_0])
    two = jpeg.decode(head + scan + b"\xff\xd9")
    assert two.blocks[0][0, :, 0].tolist() == [16, -16] and not two.blocks[0][:, :, 1:].any()
    assert (jpeg.to_pixels(two)[:, :8] == 130).all() and (jpeg.to_pixels(two)[:, 8:] == 126).all()
    assert len(frame.blocks) == 3 and frame.blocks[0].shape == (3, 4, 64)


def test_subband_codec():
    """Tones come back behind a delay of 22 samples; signals coded side by side are coded as by themselves; halves of a signal need the state between."""
    t = np.arange(1600)
    x = np.stack([8000 * np.sin(2 * np.pi * f * t / 16000) for f in (200, 440, 1000, 3000)]).round().astype(int)
    codes = subband.encode(x)
    y = subband.decode(codes)
    for a, b in zip(x, y, strict=True):
        assert np.sum((a[200:1400] - b[222:1422]) ** 2.0) < 1e-3 * np.sum(a[200:1400] ** 2.0)
    assert (subband.encode(x[2:3]) == codes[2:3]).all() and (subband.decode(codes[2:3]) == y[2:3]).all()
    assert (subband.encode(np.zeros((1, 20), int)) == 0xFA).all()
    loud = np.full((1, 400), 32767)
    loud[:, ::2] = -32768
    assert np.abs(subband.decode(subband.encode(loud)).astype(int)).max() <= 32768


def test_jpeg_codes_are_whole():
    """Each kind of code has every symbol once, leaves no code over but the last, and counts as many as it lists."""
    for kind, (counts, symbols) in jpeg.CODES:
        want = set(range(12)) if kind < 16 else {0x00, 0xF0} | {r << 4 | n for r in range(16) for n in range(1, 11)}
        assert sum(counts) == len(symbols) and set(symbols) == want and sum(c / 2**n for n, c in enumerate(counts, 1)) < 1


def test_jpeg_over_packets(spark):
    """A picture with halved chroma, built from grey blocks by the writer, cut into packets and joined to a file again."""
    y, x = np.mgrid[0:16, 0:32]
    grey = (x * 6 + y * 2).astype(np.uint8)
    whole = jpeg.file(np.repeat(grey[:, :, None], 3, axis=2), 90)
    frame = jpeg.decode(whole)
    tables = bytes(frame.quant[0].tolist()) + bytes(frame.quant[1].tolist())
    # one scan of units of 2 x 2 grey blocks and two blank chroma blocks, coded by the standard's words
    dc, ac, cdc, cac = (jpeg._words(c) for c in (jpeg.DC_LUMINANCE, jpeg.AC_LUMINANCE, jpeg.DC_CHROMINANCE, jpeg.AC_CHROMINANCE))
    signed = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    bits, before = "", 0
    for col in (0, 2):
        for by, bx in ((0, col), (0, col + 1), (1, col), (1, col + 1)):
            c = frame.blocks[0][by, bx].tolist()
            step, before = c[0] - before, c[0]
            bits += dc[abs(step).bit_length()] + signed(step)
            run = 0
            for v in c[1:]:
                if v:
                    bits += ac[0xF0] * (run // 16) + ac[run % 16 << 4 | abs(v).bit_length()] + signed(v)
                run = 0 if v else run + 1
            bits += ac[0] * (run > 0)
        bits += 2 * (cdc[0] + cac[0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    half = len(scan) // 2
    head = lambda at: b"\0" + at.to_bytes(3) + bytes([1, 255, 4, 2])
    packets = [(1, 0, True, head(half) + scan[half:]), (1, 0, False, head(0) + b"\0\0\0\x80" + tables + scan[:half])]
    got = jpeg.rtp_files(payloads.jpeg_scans(spark.createDataFrame(packets, "ssrc long, rtp_ts long, marker boolean, payload binary"))).first()
    assert got.complete and (got.width, got.height) == (32, 16)
    assert np.abs(jpeg.array(bytes(got.content)).astype(int)[:, :, 0] - grey).mean() < 3
    assert jpeg.from_scan(32, 16, 2, 50, None, None, b"") is None and jpeg.from_scan(32, 16, 0, 255, None, None, b"") is None


def test_rotate_compat(spark):
    rows = [(1, x, y, 10 * y + x, 0, 0) for x in range(4) for y in range(4)]
    got = {(r.x, r.y): r.c0 for r in signal.rotate(spark.createDataFrame(rows, "image_id int, x int, y int, c0 int, c1 int, c2 int"), (4, 4), 90.0, mode="compat").collect()}
    assert got[2, 2] == 22 and got[3, 2] == 12 and got[2, 3] == 23


@pytest.mark.parametrize("name", sorted(FILES))
def test_walkers_survive_truncation(name):
    for n in range(len(FILES[name])):
        list(containers.WALKERS[name](FILES[name][:n]))


def test_dump_seek_and_truncation(spark):
    head = b"#!rtpplay1.0 1.2.3.4/5\n" + bytes(16)
    body = b"".join(struct.pack(">HHI", 10, 2 * (i % 2), i * 10) + b"ab" for i in range(5))
    rows = dump.entries(spark.createDataFrame([("a", head + body), ("b", head + body[:25]), ("c", b"x"), ("d", None)], "path string, content binary"))
    assert {r.path: r.n for r in rows.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 2}
    assert {r.path: r.offset_ms for r in dump.seek(rows, 15).collect()} == {"a": 20}


def test_sequence_machine(spark, sf_dir):
    state, seen = None, []
    for s in (65534, 65535, 1, 0, 40000, 40001, 40002):
        state, ok = frames.advance(state, s)
        seen.append(ok)
    assert seen == [True, True, True, True, False, True, True] and state[4] == 2
    by_loss = {r.ssrc: (r.received, r.expected) for r in st.loss(st.unwrap(catalog.packets(spark, sf_dir))).collect()}
    got = {r.ssrc: (r.received, r.expected) for r in frames.validate(catalog.packets(spark, sf_dir)).collect()}
    assert got == by_loss


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
