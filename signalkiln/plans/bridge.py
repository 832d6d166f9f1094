"""Domain tables derived from the driver's tables: packets, samples, pixels, messages. Deterministic, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ssrc, arrival, rn, seq, payload_type, rtp_ts, marker, payload, copy): one packet an event.

    The numbers of a stream begin at 65531, so that they wrap; every 17th event is lost, every 23rd sent twice.
    """
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    kind = F.coalesce(*(F.when(F.col("event_type") == k, i) for i, k in enumerate(KINDS)), F.lit(5))
    one = table(spark, sf_dir, "events").withColumn("rn", rn).where("event_id % 17 <> 0").select(
        "event_id", F.col("user_id").alias("ssrc"), F.col("ts").alias("arrival"), "rn", ((F.col("rn") + 65530) % 65536).cast("int").alias("seq"), (kind + 96).alias("payload_type"),
        (3000 * F.expr("(rn - 1) div 4")).alias("rtp_ts"), (F.col("rn") % 4 == 0).alias("marker"), F.encode("props", "UTF-8").alias("payload"),
    )
    copies = F.when(F.col("event_id") % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = one.withColumn("copy", F.explode(copies))
    return rows.withColumn("arrival", F.col("arrival") + F.col("copy") * F.expr("interval 1 millisecond"))


PACKETS = """ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events),
one AS (SELECT event_id, user_id AS ssrc, ts AS arrival, rn, CAST((rn + 65530) % 65536 AS INTEGER) AS seq,
  96 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS payload_type,
  3000 * ((rn - 1) // 4) AS rtp_ts, rn % 4 = 0 AS marker, props AS payload FROM ev WHERE event_id % 17 <> 0),
pk AS (SELECT *, 0 AS copy FROM one UNION ALL SELECT event_id, ssrc, arrival + INTERVAL 1 MILLISECOND, rn, seq, payload_type, rtp_ts, marker, payload, 1 FROM one WHERE event_id % 23 = 0)"""

UNWRAPPED = (
    PACKETS
    + """,
st AS (SELECT *, seq - lag(seq) OVER w AS step FROM pk WINDOW w AS (PARTITION BY ssrc ORDER BY arrival, event_id, copy)),
un AS (SELECT *, CAST(seq + sum(CASE WHEN step < -32768 THEN 65536 WHEN step > 32767 THEN -65536 ELSE 0 END) OVER (PARTITION BY ssrc ORDER BY arrival, event_id, copy) AS BIGINT) AS ext_seq FROM st)"""
)

UNIQUE = (
    UNWRAPPED
    + """,
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ssrc, rtp_ts, ext_seq ORDER BY arrival, event_id, copy) AS k FROM un) WHERE k = 1),
fr AS (SELECT ssrc, rtp_ts, count(*) AS packets, CAST(sum(CAST(marker AS INTEGER)) AS BIGINT) AS markers, min(ext_seq) AS first_seq, max(ext_seq) AS last_seq, min(arrival) AS first_arrival,
  max(ext_seq) - min(ext_seq) + 1 = count(*) AND sum(CAST(marker AS INTEGER)) > 0 AND count(*) <= 1024 AS complete, string_agg(payload, '' ORDER BY ext_seq) AS payload FROM uq GROUP BY ssrc, rtp_ts)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, s): 64 samples of 16 bits of each embedding."""
    one = lambda x: F.least(F.greatest(F.round(x.cast("double") * 32767), F.lit(-32768.0)), F.lit(32767.0)).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", one).alias("s"))


SAMPLES = "sm AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(round(CAST(x AS DOUBLE) * 32767), -32768), 32767) AS INTEGER)) AS s FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, c0, c1, c2): an 8x8 image of each embedding's samples."""
    at = lambda k: (F.abs(F.element_at("s", F.lit(k))) % 256).cast("int") if isinstance(k, int) else (F.abs(F.element_at("s", k)) % 256).cast("int")
    rows = samples(spark, sf_dir).select("vec_id", "s", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    nth = lambda k: at(((F.col("i") + k) % 64 + 1).cast("int"))
    return rows.select(F.col("vec_id").alias("image_id"), (F.col("i") % 8).cast("int").alias("x"), F.expr("i div 8").cast("int").alias("y"), nth(0).alias("c0"), nth(1).alias("c1"), nth(2).alias("c2"))


PIXELS = (
    SAMPLES
    + """,
px AS (SELECT vec_id AS image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, abs(s[i + 1]) % 256 AS c0, abs(s[(i + 1) % 64 + 1]) % 256 AS c1, abs(s[(i + 2) % 64 + 1]) % 256 AS c2
  FROM sm, range(64) t(i))"""
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, raw): each turn as a request, answers as responses."""
    head = F.when(F.col("role") == "user", F.concat(F.lit("DESCRIBE rtsp://h/c/"), F.col("conv_id").cast("string"), F.lit(" RTSP/1.0"))).otherwise(F.lit("RTSP/1.0 200 OK"))
    raw = F.concat(head, F.lit("\r\nCSeq: "), F.col("turn").cast("string"), F.lit("\r\nX-Role:  "), F.col("role"), F.lit("\r\nAccept: a\r\nACCEPT: b\r\n\r\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", raw.alias("raw"))


def text_of(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
