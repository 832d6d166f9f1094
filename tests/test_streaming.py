"""Stateful operators over several micro-batches, with late and repeated rows, and restarts from the checkpoint."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalkiln.streaming import frames, sessions

KIND = "ssrc long, arrival timestamp, event_id long, copy int, seq int, payload_type int, rtp_ts long, marker boolean, payload binary"
BEGIN = datetime(2024, 1, 1)


def packet(ssrc: int, n: int, seq: int, ts: int, marker: bool, minutes: float | None = None, kind: int = 96, copy: int = 0):
    return ssrc, BEGIN + timedelta(minutes=n if minutes is None else minutes), n, copy, seq, kind, ts, marker, b"ab"


@pytest.fixture
def run(spark, tmp_path):
    """Write batches one after another; each is one run of the query to its end, the next begins from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(operator, batches, mode):
        got = []
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = operator(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"))
            each: list = []
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
            query.foreachBatch(lambda df, _, each=each: each.extend(df.collect())).start().awaitTermination()
            got.append(sorted(tuple(r) for r in each))
        return got

    return go


def test_sequence_validator_keeps_its_state(run):
    one = [packet(1, 0, 65534, 0, False), packet(1, 1, 65535, 0, False)]
    two = [packet(1, 2, 0, 0, False), packet(1, 3, 30000, 0, False)]
    three = [packet(1, 4, 30001, 0, False), packet(1, 5, 30002, 0, False)]
    got = run(frames.validate_stream, [one, two, three], "append")
    assert [[(r[1], r[3], r[4]) for r in b] for b in got] == [[(0, 65534, True), (1, 65535, True)], [(2, 65536, True), (3, 95536, False)], [(4, 30001, True), (5, 30002, True)]]


def test_frames_over_batches_with_late_and_repeated_packets(run):
    one = [packet(1, 0, 10, 100, False), packet(1, 1, 12, 100, True)]
    two = [packet(1, 2, 11, 100, False), packet(1, 3, 11, 100, False), packet(1, 4, 13, 200, True)]
    three = [packet(1, 5, 14, 300, True), packet(1, 6, 15, 400, False)]
    got = run(frames.assemble_stream, [one, two, three], "update")
    assert got[0] == [(1, 100, 2, 1, False, False)]
    assert got[1] == [(1, 100, 3, 1, True, False), (1, 200, 1, 1, True, False)]
    assert [r for r in got[2] if r[5]] == [(1, 100, 3, 1, True, True), (1, 200, 1, 1, True, True)] and {r[1] for r in got[2] if not r[5]} == {300, 400}


def test_interval_counts_drop_rows_behind_the_watermark(run):
    operator = lambda df: frames.interval_counts(df, "1 hour", "10 minutes")
    one = [packet(1, 0, 1, 0, False, 5), packet(1, 1, 2, 0, False, 10)]
    two = [packet(1, 2, 3, 0, False, 200)]
    three = [packet(1, 3, 4, 0, False, 15), packet(1, 4, 5, 0, False, 210)]
    got = run(operator, [one, two, three], "update")
    assert [[(r[2], r[3]) for r in b] for b in got] == [[(2, 4)], [(1, 2)], [(2, 4)]]


def test_jitter_buffer_gives_frames_when_whole(run):
    one = [packet(1, 0, 65535, 100, False), packet(1, 1, 1, 100, True), packet(1, 2, 7, 100, True, kind=97)]
    two = [packet(1, 3, 0, 100, False), packet(1, 4, 0, 100, False, copy=1), packet(1, 5, 1, 100, True, copy=1)]
    three = [packet(1, 6 + k, 20 + 2 * k, 200 + k, False) for k in range(3)]
    got = run(lambda df: sessions.buffered_frames(df, capacity=2), [one, two, three], "append")
    assert got[0] == [(1, 97, 100, 1, 1, True)] and got[1] == [(1, 96, 100, 3, 1, True)] and got[2] == [(1, 96, 200, 1, 0, False)]


def test_sessions_close_after_inactivity(run):
    one = [packet(1, 0, 1, 0, False, 0), packet(1, 1, 2, 0, False, 20), packet(2, 2, 1, 0, False, 20)]
    two = [packet(1, 3, 3, 0, False, 300)]
    three = [packet(2, 4, 9, 0, False, 310)]
    got = run(lambda df: sessions.active_sessions(df, "1 hour", "10 minutes"), [one, two, three], "append")
    closed = sorted((r[0], r[3]) for b in got for r in b)
    assert closed == [(1, 2), (2, 1)] and not got[0]


def test_tee_hands_a_batch_to_every_sink(spark):
    seen = []
    sessions.tee(spark.range(3), lambda df: seen.append(df.count()), lambda df: seen.append(df.agg(F.sum("id")).first()[0]))
    assert seen == [3, 3]
