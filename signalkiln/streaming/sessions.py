"""Sessions of streams: goodbyes, inactivity, identity collisions, jitter buffers, and the request state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lookups import small_side

#: State that a request leads to from the states where it is allowed; other requests leave the state (RFC 2326 A.1).
TRANSITIONS = {"SETUP": ({"init", "ready"}, "ready"), "PLAY": ({"ready", "playing"}, "playing"), "RECORD": ({"ready", "recording"}, "recording"), "PAUSE": ({"ready", "playing", "recording"}, "ready"), "TEARDOWN": ({"init", "ready", "playing", "recording"}, "init")}


def sessions(packets: DataFrame, goodbye: Column, idle: str = "1 hour") -> DataFrame:
    """(ssrc, session, begins, ends, packets, said_goodbye): counters begin anew behind a goodbye or a pause longer than ``idle``.

    ``goodbye`` tells of a packet that it ends its session. One window in order of arrival, then one aggregation.
    """
    w = W.partitionBy("ssrc").orderBy("arrival", "event_id", "copy")
    bye = F.coalesce(goodbye, F.lit(False))
    fresh = F.coalesce(F.lag(bye).over(w) | (F.col("arrival") > F.lag("arrival").over(w) + F.expr(f"interval {idle}")), F.lit(True))
    rows = packets.select("ssrc", "arrival", "event_id", "copy", bye.alias("bye"), fresh.alias("fresh"))
    rows = rows.withColumn("session", F.sum(F.col("fresh").cast("int")).over(w))
    return rows.groupBy("ssrc", "session").agg(F.min("arrival").alias("begins"), F.max("arrival").alias("ends"), F.count("*").alias("packets"), F.bool_or("bye").alias("said_goodbye"))


def active_sessions(packets: DataFrame, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(ssrc, begins, ends, packets) on a stream: a session closes when nothing came for ``idle``; later rows than ``delay`` are dropped."""
    rows = packets.withColumn("arrival", F.col("arrival").cast("timestamp")).withWatermark("arrival", delay)
    return rows.groupBy("ssrc", F.session_window("arrival", idle)).agg(F.count("*").alias("packets")).select("ssrc", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "packets")


def collisions(packets: DataFrame, own: DataFrame) -> DataFrame:
    """(ssrc, peers, new_ssrc): own identities that packets from elsewhere carry, and the identity to change to.

    ``packets``: ssrc, source; ``own``: local_ssrc, source. The new identity is a hash of the old one and the
    source, so every node picks the same one.
    """
    mine = small_side(own.groupBy("local_ssrc").agg(F.min("source").alias("home")))
    hit = packets.join(mine, (F.col("ssrc") == F.col("local_ssrc")) & (F.col("source") != F.col("home")))
    got = hit.groupBy("ssrc", "home").agg(F.countDistinct("source").alias("peers"))
    return got.select("ssrc", "peers", F.crc32(F.concat_ws("/", F.col("ssrc").cast("string"), "home").cast("binary")).alias("new_ssrc"))


def replay(requests: DataFrame, session: str, *order: str) -> DataFrame:
    """Adds state and allowed to requests (method): the state machine of each session in order.

    The state depends on all requests before, so a session's rows are sorted and folded as they pass; none is gathered.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = requests.columns.index(session), requests.columns.index("method")
    schema = requests.withColumns({"state": F.lit(""), "allowed": F.lit(True)}).schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, "init"
        for b in batches:
            states, allowed = [], []
            for k, method in zip(b.iloc[:, place[0]], b.iloc[:, place[1]], strict=True):
                if k != key:
                    key, state = k, "init"
                origins, target = TRANSITIONS.get(method, ({"init", "ready", "playing", "recording"}, state))
                ok = state in origins
                state = target if ok else state
                states.append(state)
                allowed.append(ok)
            yield b.assign(state=states, allowed=allowed)

    return requests.repartition(n, session).sortWithinPartitions(session, *order).mapInPandas(fold, schema)


class JitterBuffer(StatefulProcessor):
    """Frames of a stream by payload type and time stamp, given out when they are whole.

    A frame is whole when it has a marker and no gap. The buffer holds ``capacity`` frames a stream; the
    oldest leaves as it is when another one begins (whole is false then). Duplicates are not counted;
    packets of a frame that was given out are dropped, told by the newest time stamps given out.
    """

    def __init__(self, capacity: int = 16):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        # lists, read and written once a batch: each call for a single frame is a round trip to the JVM
        self.frames = handle.getListState("live", "payload_type int, rtp_ts long, seqs array<int>, markers int, first long")
        self.gone = handle.getListState("left", "payload_type int, rtp_ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # of each frame its numbers, markers, first arrival, and the least and greatest place of its numbers about the first of them
        live = {}
        for kind, ts, seqs, markers, first in self.frames.get():
            places = [(q - seqs[0] + 32768) % 65536 for q in seqs]
            live[kind, ts] = [dict.fromkeys(seqs), markers, first, min(places), max(places)]
        gone = dict.fromkeys(tuple(k) for k in self.gone.get())
        held, known, out = bool(live), len(gone), []

        def leave(k, whole: bool) -> None:
            frame = live.pop(k)
            out.append((key[0], *k, len(frame[0]), frame[1], whole))
            gone[k] = None

        for part in rows:
            part = part.sort_values(["arrival", "event_id", "copy"])
            arrivals = part.arrival.astype("datetime64[ns]").astype("int64")
            for kind, ts, seq, marker, at in zip(*(c.astype("int64").tolist() for c in (part.payload_type, part.rtp_ts, part.seq, part.marker, arrivals)), strict=True):
                k = kind, ts
                if k in gone:
                    continue
                frame = live.get(k)
                if frame is None:
                    if len(live) >= self.capacity:
                        leave(min(live, key=lambda x: live[x][2]), False)
                    frame = live[k] = [{}, 0, at, 65536, -1]
                if seq not in frame[0]:
                    frame[0][seq] = None
                    frame[1] += marker
                    place = (seq - next(iter(frame[0])) + 32768) % 65536
                    frame[3], frame[4] = min(frame[3], place), max(frame[4], place)
                if frame[1] and frame[4] - frame[3] + 1 == len(frame[0]):
                    leave(k, True)
        if live:
            self.frames.put([(*k, list(v[0]), v[1], v[2]) for k, v in live.items()])
        elif held:
            self.frames.clear()
        if len(gone) > 4 * self.capacity:
            self.gone.put(list(gone)[-4 * self.capacity :])
        elif len(gone) > known:
            self.gone.appendList(list(gone)[known:])
        yield pd.DataFrame(out, columns=["ssrc", "payload_type", "rtp_ts", "packets", "markers", "whole"])

    def close(self) -> None:
        pass


def buffered_frames(packets: DataFrame, capacity: int = 16) -> DataFrame:
    """Frames of a stream of packets (ssrc, payload_type, rtp_ts, seq, marker, arrival, event_id, copy) as the jitter buffer gives them out."""
    return packets.groupBy("ssrc").transformWithStateInPandas(JitterBuffer(capacity), "ssrc long, payload_type int, rtp_ts long, packets int, markers int, whole boolean", "append", "none")


def tee(batch: DataFrame, *sinks) -> None:
    """For ``foreachBatch``: hand one micro-batch to several sinks (an archive and user callbacks), each a function of it.

    The batch is persisted, so that its sources are read once.
    """
    batch.persist()
    try:
        for sink in sinks:
            sink(batch)
    finally:
        batch.unpersist()
