"""Stateful operators on packet streams: sequence validation by stream and frames as packets arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_DROPOUT, MAX_MISORDER, MODULUS = 500, 100, 65536
STATE = "base long, high long, cycles long, bad long, received long"


def advance(state: tuple[int, int, int, int, int] | None, seq: int) -> tuple[tuple[int, int, int, int, int], bool]:
    """RFC 3550 A.1 after probation: the new state and whether the packet counts.

    state: first sequence number, highest one, cycles counted in 65536s, the next number of a possible
    restart (or -1), packets received.
    """
    if state is None:
        return (seq, seq, 0, -1, 1), True
    base, high, cycles, bad, received = state
    step = (seq - high) % MODULUS
    if step < MAX_DROPOUT:
        return (base, seq, cycles + MODULUS * (seq < high), bad, received + 1), True
    if step <= MODULUS - MAX_MISORDER:
        if seq == bad:
            return (seq, seq, 0, -1, 1), True
        return (base, high, cycles, (seq + 1) % MODULUS, received), False
    return (base, high, cycles, bad, received + 1), True


def validate(packets: DataFrame) -> DataFrame:
    """(ssrc, received, expected, rejected) by the state machine, in batch.

    The machine is a fold in order of arrival, so a stream is read by one task, in bounded memory:
    rows are sorted by stream and folded as they pass, never gathered.
    """
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, rejected = None, None, 0
        for b in batches:
            out = []
            for ssrc, seq in zip(b.ssrc.tolist(), b.seq.tolist(), strict=True):
                if ssrc != key:
                    if state:
                        out.append((key, state[4], state[2] + state[1] - state[0] + 1, rejected))
                    key, state, rejected = ssrc, None, 0
                state, ok = advance(state, seq)
                rejected += not ok
            yield pd.DataFrame(out, columns=["ssrc", "received", "expected", "rejected"])
        if state:
            yield pd.DataFrame([(key, state[4], state[2] + state[1] - state[0] + 1, rejected)], columns=["ssrc", "received", "expected", "rejected"])

    rows = packets.select("ssrc", "arrival", "event_id", "copy", "seq").repartition(n, "ssrc").sortWithinPartitions("ssrc", "arrival", "event_id", "copy")
    return rows.select("ssrc", "seq").mapInPandas(fold, "ssrc bigint, received bigint, expected bigint, rejected bigint")


class SequenceValidator(StatefulProcessor):
    """The same machine over a stream: one row for each packet with its extended number and whether it counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sequence", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrival", "event_id", "copy"])
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for event, copy, seq in zip(frame.event_id, frame["copy"], frame.seq, strict=True):
            state, ok = advance(state, int(seq))
            out.append((key[0], event, copy, state[2] + int(seq), ok))
        self.state.update(state)
        yield pd.DataFrame(out, columns=["ssrc", "event_id", "copy", "ext_seq", "valid"])

    def close(self) -> None:
        pass


class FrameAssembler(StatefulProcessor):
    """Frames by stream and timestamp. A frame is given out when its timestamp is left behind by two newer ones or
    at the end of the batch as it stands (``final`` false); duplicates are dropped, late packets join a live frame."""

    LIVE = 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "rtp_ts long", "seqs array<long>, markers int, first long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrival", "event_id", "copy"])
        live = {k[0]: (set(v[0]), v[1], v[2]) for k, v in self.frames.iterator()}
        out = []
        for ts, seq, marker, at in zip(frame.rtp_ts, frame.seq, frame.marker, frame.arrival, strict=True):
            if ts not in live:
                live[ts] = (set(), 0, int(pd.Timestamp(at).value))
                while len(live) > self.LIVE:
                    oldest = min(live, key=lambda t: live[t][2])
                    out.append(self._row(key[0], oldest, live.pop(oldest), True))
                    if self.frames.containsKey((oldest,)):
                        self.frames.removeKey((oldest,))
            seqs, markers, first = live[ts]
            if seq not in seqs:
                seqs.add(int(seq))
                live[ts] = (seqs, markers + int(marker), first)
        for ts, (seqs, markers, first) in live.items():
            self.frames.updateValue((int(ts),), (sorted(seqs), markers, first, False))
            out.append(self._row(key[0], ts, (seqs, markers, first), False))
        yield pd.DataFrame(out, columns=["ssrc", "rtp_ts", "packets", "markers", "complete", "final"])

    @staticmethod
    def _row(ssrc, ts, frame, final):
        seqs, markers, _ = frame
        some = next(iter(seqs))
        place = [(q - some + MODULUS // 2) % MODULUS for q in seqs]
        return ssrc, ts, len(seqs), markers, max(place) - min(place) + 1 == len(place) and markers > 0, final

    def close(self) -> None:
        pass


def validate_stream(packets: DataFrame) -> DataFrame:
    return packets.groupBy("ssrc").transformWithStateInPandas(SequenceValidator(), "ssrc long, event_id long, copy int, ext_seq long, valid boolean", "append", "none")


def assemble_stream(packets: DataFrame) -> DataFrame:
    return packets.groupBy("ssrc").transformWithStateInPandas(FrameAssembler(), "ssrc long, rtp_ts long, packets int, markers int, complete boolean, final boolean", "update", "none")


def interval_counts(packets: DataFrame, interval: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Packets and octets by stream and interval, late rows dropped behind the watermark."""
    from pyspark.sql import functions as F

    rows = packets.withColumn("arrival", F.col("arrival").cast("timestamp")).withWatermark("arrival", delay)
    return rows.groupBy("ssrc", F.window("arrival", interval)).agg(F.count("*").alias("packets"), F.sum(F.octet_length("payload")).alias("octets")).select("ssrc", F.col("window.start").alias("start"), "packets", "octets")
