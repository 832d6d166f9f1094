"""Packets from and to sockets: streaming sources of datagrams and of RTSP media, sinks for datagrams and interleaved frames, an archive sink.

Register a source with ``spark.dataSource.register(DatagramSource)`` and read it by
``spark.readStream.format("datagrams").option("port", 5004).option("spool", shared_folder).load()``.
"""

from __future__ import annotations

import re
import select
import socket
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from . import dump

MAX_DATAGRAM = 65_535


class SpooledReader(SimpleDataSourceStreamReader):
    """Reads what has come since the last batch, up to ``batch`` rows, by ``collect`` of a kind of socket.

    What is read is first written below ``spool`` where one is given, under the numbers of its first and
    last row, so that a batch can be read again after a failure; without it a lost batch stays lost.
    """

    columns: tuple[tuple[str, str], ...] = ()

    def __init__(self, options: dict):
        self.most, self.wait = int(options.get("batch", 10_000)), float(options.get("wait", 0.2))
        self.spool = options.get("spool")

    def collect(self, until: float) -> list[tuple]:
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.collect(time.monotonic() + self.wait)
        end = {"n": start["n"] + len(rows)}
        if rows and self.spool:
            self._keep(start["n"], end["n"], rows)
        return iter(rows), end

    def _file(self, start: int, end: int):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.spool if "://" in self.spool else f"file://{self.spool}")
        store.create_dir(root)
        return store, f"{root}/{start:020d}-{end:020d}.parquet"

    def _keep(self, start: int, end: int, rows: list[tuple]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = {"timestamp": pa.timestamp("us", "UTC"), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        store, path = self._file(start, end)
        cols = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), self.columns, strict=True)]
        pq.write_table(pa.table(cols, names=[n for n, _ in self.columns]), path, filesystem=store)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if not self.spool:
            raise ValueError("a lost batch can be read again with a spool only")
        store, path = self._file(start["n"], end["n"])
        return iter([tuple(r.values()) for r in pq.read_table(path, filesystem=store).to_pylist()])


class DatagramReader(SpooledReader):
    columns = (("received", "timestamp"), ("source", "string"), ("payload", "binary"))

    def __init__(self, options: dict):
        super().__init__(options)
        self.address = (options.get("host", "0.0.0.0"), int(options["port"]))
        self.socket: socket.socket | None = None

    def _open(self) -> socket.socket:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind(self.address)
            self.socket.setblocking(False)
        return self.socket

    def collect(self, until: float) -> list[tuple]:
        s, rows = self._open(), []
        while len(rows) < self.most and (left := until - time.monotonic()) > 0:
            if select.select([s], [], [], left)[0]:
                data, (host, port) = s.recvfrom(MAX_DATAGRAM)
                rows.append((datetime.now(UTC), f"{host}:{port}", data))
        return rows


class DatagramSource(DataSource):
    """Options: port, host, batch, wait (seconds), spool (a folder that all executors share)."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "received timestamp, source string, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return DatagramReader(self.options)


class Session:
    """The client's side of one RTSP session over one connection, media interleaved with the messages."""

    def __init__(self, url: str, timeout: float = 10.0):
        m = re.match(r"rtsp://([^/:]+)(?::(\d+))?", url)
        if not m:
            raise ValueError(f"no rtsp address: {url}")
        self.url, self.number, self.session = url, 0, None
        self.socket = socket.create_connection((m[1], int(m[2] or 554)), timeout)
        self.held = bytearray()
        self.frames: list[tuple[int, bytes]] = []

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            data = self.socket.recv(65_536)
            if not data:
                raise ConnectionError("the server has closed the connection")
            self.held += data
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def _line(self) -> str:
        while (end := self.held.find(b"\r\n")) < 0:
            data = self.socket.recv(65_536)
            if not data:
                raise ConnectionError("the server has closed the connection")
            self.held += data
        return self._take(end + 2)[:-2].decode("utf-8", "replace")

    def next_frame(self) -> tuple[int, bytes]:
        """The next `$` frame; messages of the server in between are read and left."""
        if self.frames:
            return self.frames.pop(0)
        while True:
            if self._take(1) == b"$":
                channel, size = self._take(1)[0], int.from_bytes(self._take(2))
                return channel, self._take(size)
            self._message()

    def _message(self) -> tuple[dict[str, str], bytes]:
        headers = {}
        while line := self._line():
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        return headers, self._take(int(headers.get("content-length", 0)))

    def ask(self, method: str, url: str | None = None, **headers: str) -> tuple[dict[str, str], bytes]:
        """A request and its answer; frames that come before the answer are kept."""
        self.number += 1
        lines = [f"{method} {url or self.url} RTSP/1.0", f"CSeq: {self.number}", *(f"{k}: {v}" for k, v in headers.items()), *([f"Session: {self.session}"] if self.session else [])]
        self.socket.sendall("\r\n".join([*lines, "", ""]).encode())
        while True:
            if (first := self._take(1)) == b"$":
                channel, size = self._take(1)[0], int.from_bytes(self._take(2))
                self.frames.append((channel, self._take(size)))
                continue
            status = (first.decode("latin-1") + self._line()).split(" ", 2)
            found, body = self._message()
            if found.get("cseq") != str(self.number):
                continue
            if status[1] != "200":
                raise ConnectionError(f"{method}: {' '.join(status[1:])}")
            return found, body

    def play(self) -> None:
        """Describe, set up every media over this connection, and play."""
        self.ask("OPTIONS")
        headers, body = self.ask("DESCRIBE", Accept="application/sdp")
        base = headers.get("content-base", self.url).rstrip("/")
        controls = [x.partition("a=control:")[2] for part in re.split(r"(?m)^m=", body.decode("utf-8", "replace"))[1:] for x in part.split("\r\n") if x.startswith("a=control:")]
        for k, control in enumerate(controls):
            where = control if "://" in control else f"{base}/{control.lstrip('/')}"
            got, _ = self.ask("SETUP", where, Transport=f"RTP/AVP/TCP;unicast;interleaved={2 * k}-{2 * k + 1}")
            self.session = got.get("session", "").split(";")[0] or self.session
        self.ask("PLAY", base, Range="npt=0-")

    def close(self) -> None:
        try:
            if self.session:
                self.ask("TEARDOWN")
        except OSError:
            pass
        self.socket.close()


class RtspReader(SpooledReader):
    """The interleaved frames of a server's media; a connection that ends is opened again with the next batch."""

    columns = (("received", "timestamp"), ("channel", "int"), ("payload", "binary"))

    def __init__(self, options: dict):
        super().__init__(options)
        self.url, self.session = options["url"], None

    def collect(self, until: float) -> list[tuple]:
        rows: list[tuple] = []
        try:
            if self.session is None:
                self.session = Session(self.url)
                self.session.play()
            while len(rows) < self.most and (left := until - time.monotonic()) > 0:
                s = self.session
                if s.frames or s.held or select.select([s.socket], [], [], left)[0]:
                    rows.append((datetime.now(UTC), *s.next_frame()))
        except OSError:
            self.session = None
        return rows


class RtspSource(DataSource):
    """Options: url (``rtsp://host:port/name``), batch, wait, spool."""

    @classmethod
    def name(cls) -> str:
        return "rtsp"

    def schema(self) -> str:
        return "received timestamp, channel int, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return RtspReader(self.options)


def send_datagrams(rows: DataFrame, host: str, port: int, column: str = "payload") -> None:
    """Every row's bytes as a datagram, from the tasks that hold them; for a stream call it in ``foreachBatch``."""

    def send(part) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for r in part:
                if r[0] is not None:
                    s.sendto(bytes(r[0]), (host, port))

    rows.select(column).foreachPartition(send)


def send_interleaved(rows: DataFrame, host: str, port: int, key: str = "ssrc", order: str = "arrival", channel: Column | None = None, column: str = "payload") -> None:
    """Rows as `$` frames over one connection a task; the rows of a key go over one connection in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.select(key, order, (F.lit(0) if channel is None else channel).cast("int").alias("__channel"), column)

    def send(part) -> None:
        s = None
        for r in part:
            data = bytes(r[3] or b"")
            s = s or socket.create_connection((host, port))
            s.sendall(b"$" + bytes([r[2] & 255]) + len(data).to_bytes(2) + data)
        if s:
            s.close()

    some.repartition(n, key).sortWithinPartitions(key, order).foreachPartition(send)


def archive(path: str, address: str = "0.0.0.0/0", key: str = "ssrc", packet: str = "raw", at: str = "arrival"):
    """A ``foreachBatch`` function: the rows of each micro-batch as Parquet and as dump files, below a folder of its number.

    A batch that runs again writes the same folder anew.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/packets/batch={number}")
        us = F.unix_micros(F.col(at).cast("timestamp"))
        first = batch.agg(F.min(us)).first()[0]
        if first is None:
            return
        ms = F.floor((us - first) / 1000).cast("bigint")
        rows = batch.select(key, ms.alias("offset_ms"), dump.entry_bytes(F.col(packet), ms, F.lit(False)).alias("entry"))
        uri = f"{path}/dumps/batch={number}"
        dump.write_files(rows, uri if "://" in uri else f"file://{uri}", address, first, key=key).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")

    return keep
