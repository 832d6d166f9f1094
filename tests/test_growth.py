"""What must hold at sizes that the driver's smallest tables don't reach: plans without steps that grow, and values beyond their fields."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from signalkiln.functions import signal
from signalkiln.operators import packets as pk
from signalkiln.operators import payloads
from signalkiln.plans import catalog
from signalkiln.sources import dump, images
from signalkiln.streaming import sessions


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, kind: str) -> int:
    """How often an expression stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toJSON().count(f'catalyst.expressions.{kind}"')


def test_rotate_neither_joins_nor_shuffles(spark):
    """A grid of targets that is joined back gets broadcast, with all its rows on the driver."""
    rows = spark.range(2).select(F.when(F.col("id") == 1, F.col("id")).alias("image_id"), F.lit(0).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("y"), F.col("y").alias("c0"))
    got = signal.rotate(rows, (1, 5), 2.2)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    c, s = math.cos(2.2), math.sin(2.2)
    nw, nh = int(abs(c) + 5 * abs(s)), int(abs(s) + 5 * abs(c))
    places = {(x, y): ((x - nw / 2) * c + (y - nh / 2) * s + 0.5, (nw / 2 - x) * s + (y - nh / 2) * c + 2.5) for x in range(nw) for y in range(nh)}
    assert {tuple(r) for r in got.collect()} == {(1, x, y, math.floor(v)) for (x, y), (u, v) in places.items() if 0 <= u < 1 and 0 <= v < 5}


def test_clock_fields_beyond_a_round(spark, tmp_path):
    """From event 453,332 on the clock of ``pcr_decode`` is beyond 33 bits."""
    spark.createDataFrame([(i,) for i in (0, 453_331, 453_332, 600_000, 36_000_000)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    for r in catalog.QUERIES["pcr_decode"](spark, str(tmp_path)).collect():
        base = r.event_id * 7919 + 5_000_000_000
        assert (r.pcr, r.scr, r.pts) == (base * 300 + r.event_id % 300, base * 300 + r.event_id % 300, base)


def test_packets_are_built_once_before_they_are_parsed(spark, sf_dir):
    """A parsed expression, not a column, is computed again for each field."""
    for name in ("rtp_packet_full", "rtp_rewrite"):
        assert nodes(catalog.QUERIES[name](spark, sf_dir), "Concat") < 100, name


def test_nack_reads_its_word_once(spark):
    fci = F.unhex(F.col("f"))
    rows = spark.createDataFrame([("FFFE8001" "00010000",), ("0000FFFF" "00",), ("0000",), ("",), (None,)], "f string")
    assert [r.n for r in rows.select(pk.nack_sequences(fci).alias("n")).collect()] == [[65534, 65535, 14, 1], [*range(17)], None, None, None]
    assert nodes(rows.select(pk.nack_sequences(F.encode("f", "UTF-8"))), "Conv") <= 4


def test_text_dumps_of_many_streams_share_files(spark, tmp_path):
    rows = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("ssrc"), F.lit(1.0).alias("seconds"))
    line = dump.short_line(F.col("seconds"), F.coalesce("ssrc", F.lit(0)), F.lit(5004), F.col("ssrc") == 7)
    dump.write_text(rows, f"{tmp_path}/d", line, together=True)
    assert len(list((tmp_path / "d").rglob("part-*"))) <= 4
    got = {(r.stream, r.form, r.seq, r.marker) for r in dump.read_text(spark, f"{tmp_path}/d", together=True).collect()}
    assert got == {(str(i) if i else None, "short", i, i == 7) for i in range(300)}


def test_units_take_one_sort(spark):
    rows = spark.createDataFrame([(1, 2, 3, bytearray(b"\x7c\x45ab")), (1, 2, 2, bytearray(b"\x7c\x85cd")), (1, 2, 1, bytearray(b"\x67x")), (None, 2, 1, bytearray(b"\x7c\x81e")), (2, 2, 1, None)], "ssrc long, rtp_ts long, ext_seq long, payload binary")
    got = payloads.h264_units(rows, frames=True)
    text = plan(got)
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1 and "Join" not in text
    assert {(r.ssrc, r.unit, r.nal_type, r.complete, bytes(r.data), r.key_frame) for r in got.collect()} == {(1, 1, 7, True, b"gx", True), (1, 2, 5, True, b"ecdab", True), (None, 1, 1, False, b"ae", False)}


def test_images_are_made_in_one_pass_over_sorted_rows(spark):
    """A group of 10,000 rows and more spans several batches; a key may be null."""
    rows = spark.range(30_000).select(F.when(F.col("id") >= 3, F.lit(5)).alias("image_id"), (F.col("id") % 200).cast("int").alias("x"), F.expr("id div 200").cast("int").alias("y"), *((F.col("id") % 251).cast("int").alias(f"c{k}") for k in range(3)))
    files = images.image_files(rows, "bmp")
    assert "FlatMapGroups" not in plan(files)
    got = {r.image_id: images.bmp_array(bytes(r.content)) for r in files.collect()}
    assert set(got) == {None, 5} and got[None].shape == (1, 3, 3) and got[5].shape == (150, 200, 3)
    assert all(got[5][i // 200, i % 200, 0] == i % 251 for i in range(3, 30_000))


def test_jitter_buffer_calls_its_state_once_a_batch():
    class State:
        calls = 0

        def __getattr__(self, name):
            def call(*_):
                State.calls += 1
                return False if name in ("exists", "containsKey") else iter(())

            return call

    class Handle:
        def getListState(self, *_):
            return State()

        getMapState = getListState

    buffer = sessions.JitterBuffer(1000)
    buffer.init(Handle())
    rows = pd.DataFrame({"payload_type": 96, "rtp_ts": range(100), "seq": range(100), "marker": [k % 2 == 0 for k in range(100)], "arrival": pd.Timestamp("2024-01-01"), "event_id": range(100), "copy": 0})
    (got,) = buffer.handleInputRows((1,), iter([rows]), None)
    assert len(got) == 50 and got.whole.all()
    assert State.calls <= 4
