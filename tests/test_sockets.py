"""Socket sources and sinks against sockets of the test, and the archive of a stream."""

from __future__ import annotations

import socket
import threading
import time

from pyspark.sql import functions as F

from signalkiln.operators import payloads
from signalkiln.sources import containers, dump, sockets


def free_port(kind) -> int:
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_datagrams_in(spark, tmp_path):
    spark.dataSource.register(sockets.DatagramSource)
    port, seen = free_port(socket.SOCK_DGRAM), []
    stream = spark.readStream.format("datagrams").option("host", "127.0.0.1").option("port", port).option("spool", f"{tmp_path}/spool").load()
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for k in range(400):
                s.sendto(f"packet {k % 5}".encode(), ("127.0.0.1", port))
                time.sleep(0.1)
                if len({bytes(r.payload) for r in seen}) == 5:
                    break
    finally:
        query.stop()
    assert {bytes(r.payload) for r in seen} == {f"packet {k}".encode() for k in range(5)} and all(r.source.startswith("127.0.0.1:") for r in seen)


def test_a_spooled_batch_is_read_again(tmp_path):
    port = free_port(socket.SOCK_DGRAM)
    reader = sockets.DatagramReader({"host": "127.0.0.1", "port": str(port), "spool": str(tmp_path), "wait": "0.5"})
    reader._open()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for k in range(3):
            s.sendto(bytes([k]), ("127.0.0.1", port))
    rows, end = reader.read(reader.initialOffset())
    first = [r[2] for r in rows]
    assert end == {"n": 3} and first == [b"\0", b"\1", b"\2"]
    assert [r[2] for r in sockets.DatagramReader({"port": "1", "spool": str(tmp_path)}).readBetweenOffsets({"n": 0}, end)] == first
    reader.socket.close()


def serve_rtsp(server: socket.socket, asked: list) -> None:
    """One session: answers each request and sends frames of two channels in between and behind."""
    c, _ = server.accept()
    held = b""
    body = b"v=0\r\nm=video 0 RTP/AVP 96\r\na=control:v\r\nm=audio 0 RTP/AVP 0\r\na=control:rtsp://h/a\r\n"
    while data := c.recv(4096):
        held += data
        while b"\r\n\r\n" in held:
            one, held = held.split(b"\r\n\r\n", 1)
            lines = one.decode().split("\r\n")
            asked.append(lines[0])
            number = next(x for x in lines if x.startswith("CSeq"))
            if lines[0].startswith("PLAY"):
                c.sendall(b"$\0\0\3one")
            extra = "\r\nSession: 77;timeout=60" if lines[0].startswith("SETUP") else ""
            answer = f"RTSP/1.0 200 OK\r\n{number}{extra}\r\nContent-Length: {len(body) if lines[0].startswith('DESCRIBE') else 0}\r\n\r\n".encode()
            c.sendall(answer + (body if lines[0].startswith("DESCRIBE") else b""))
            if lines[0].startswith("PLAY"):
                c.sendall(b"$\2\0\3two$\0\0")
                time.sleep(0.1)
                c.sendall(b"\5three")


def test_rtsp_session_and_reader():
    asked: list[str] = []
    server = socket.create_server(("127.0.0.1", 0))
    threading.Thread(target=serve_rtsp, args=(server, asked), daemon=True).start()
    url = f"rtsp://127.0.0.1:{server.getsockname()[1]}/live"
    reader = sockets.RtspReader({"url": url, "wait": "1"})
    rows, end = reader.read(reader.initialOffset())
    assert [r[1:] for r in rows] == [(0, b"one"), (2, b"two"), (0, b"three")] and end == {"n": 3}
    assert [x.split(" ")[0] for x in asked] == ["OPTIONS", "DESCRIBE", "SETUP", "SETUP", "PLAY"] and asked[2] == f"SETUP {url}/v RTSP/1.0" and asked[3] == "SETUP rtsp://h/a RTSP/1.0"
    reader.session.close()
    assert asked[-1].startswith("TEARDOWN")
    server.close()


def test_datagrams_out(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        rows = spark.range(6).select(F.when(F.col("id") != 3, F.encode(F.col("id").cast("string"), "UTF-8")).alias("payload"))
        sockets.send_datagrams(rows, "127.0.0.1", s.getsockname()[1])
        assert sorted(s.recv(99) for _ in range(5)) == [b"0", b"1", b"2", b"4", b"5"]


def test_interleaved_out_and_in(spark):
    """Frames sent over a connection come back from the chunks that the other side read."""
    got: list[tuple[int, bytes]] = []
    server = socket.create_server(("127.0.0.1", 0))
    server.settimeout(1)
    done = threading.Event()

    def serve() -> None:
        n = 0
        while not done.is_set():
            try:
                c, _ = server.accept()
            except TimeoutError:
                continue
            while data := c.recv(5):
                got.append((n, data))
            n += 1

    thread = threading.Thread(target=serve)
    thread.start()
    rows = spark.range(20).select((F.col("id") % 3).alias("ssrc"), F.col("id").alias("arrival"), F.encode(F.concat(F.lit("data "), F.col("id").cast("string")), "UTF-8").alias("payload"))
    sockets.send_interleaved(rows, "127.0.0.1", server.getsockname()[1], channel=F.col("ssrc"))
    time.sleep(2)
    done.set()
    thread.join()
    server.close()
    chunks = spark.createDataFrame([(n, i, d) for i, (n, d) in enumerate(got)], "conn_id int, arrival long, chunk binary")
    back = sorted((r.channel, bytes(r.payload)) for r in payloads.interleaved_stream(chunks).collect())
    assert back == sorted((k % 3, f"data {k}".encode()) for k in range(20))


def test_archive_of_batches(spark, tmp_path):
    keep = sockets.archive(str(tmp_path))
    rows = spark.range(10).select((F.col("id") % 2).alias("ssrc"), F.timestamp_millis(F.col("id") * 20).alias("arrival"), F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("raw"))
    for _ in range(2):  # a batch that runs again leaves one copy
        keep(rows, 0)
    keep(rows.where("id < 0"), 1)
    entries = dump.entries(containers.read_files(spark, f"{tmp_path}/dumps", "*.rtp"))
    assert sorted((r.offset_ms, bytes(r.blob)) for r in entries.collect()) == [(20 * k, bytes([0, k])) for k in range(10)]
    assert spark.read.parquet(f"{tmp_path}/packets").count() == 10
