"""Queries of the small operators: positions, comparisons, sets, limits, bytes, times, samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits, registry, signal, text, timecode
from ..operators import lookups, payloads
from ..sources import containers
from .bridge import SAMPLES, samples, table, text_of
from .registry import query


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def limit_offset(spark, sf_dir):
    """The feature is a page of an order: 50 rows behind the first 10."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(50)


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer")
def order_within(spark, sf_dir):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).alias("place"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_orderpriority")
def group_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_materialise(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key")
def union_concat(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")))
    return both.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("SELECT CAST(-1 AS INTEGER) AS n_nationkey, 'HEAD' AS n_name UNION ALL SELECT n_nationkey, n_name FROM nation")
def prefix_rows(spark, sf_dir):
    return lookups.prefix_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), -1, "HEAD")


@query(f"WITH {SAMPLES} SELECT vec_id, array_to_string(list_prepend(7, flatten([s[1:4], s[61:64]])), ',') AS v, CAST(coalesce(list_position(s, s[9]), 0) - 1 AS INTEGER) AS at, -1 AS none FROM sm")
def array_positions(spark, sf_dir):
    s = F.col("s")
    flat = F.flatten(F.array(F.slice(s, 1, 4), F.slice(s, 61, 4)))
    return samples(spark, sf_dir).select("vec_id", text_of(lookups.prefix(flat, F.lit(7))).alias("v"), lookups.index_of(s, s[8]).alias("at"), lookups.index_of(s, F.lit(99999)).alias("none"))


@query("""WITH a AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS r FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'other' ELSE role END, ',' ORDER BY turn) AS r FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id)
SELECT a.conv_id, coalesce(a.r = b.r, FALSE) AS same FROM a LEFT JOIN b ON a.conv_id = b.conv_id""")
def sequence_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    other = rows.where("conv_id % 5 <> 0").withColumn("role", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), "other").otherwise(F.col("role")))
    return lookups.same_sequences(rows, other, "conv_id", ["turn"], ["role"])


@query("SELECT page_id, CAST(instr(html, '<article') - 1 AS INTEGER) AS at FROM pages WHERE html IS NOT NULL AND strlen(html) = length(html)")
def contains_subsequence(spark, sf_dir):
    """Pages of one byte a character, so that places in bytes and characters agree."""
    rows = table(spark, sf_dir, "pages").where(F.col("html").isNotNull() & (F.octet_length("html") == F.length("html")))
    return rows.select("page_id", bits.contains_bytes(F.encode("html", "UTF-8"), F.encode(F.lit("<article"), "UTF-8")).cast("int").alias("at"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000")
def multimap_values(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("k"))
    return lookups.values_of(keys, table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), "k").select("c_custkey", "s_suppkey")


@query("SELECT conv_id, turn, coalesce(split_part(text, ' ', 1), '') AS head, CASE WHEN position(' ' IN text) > 0 THEN substr(text, position(' ' IN text) + 1) END AS rest FROM conversations WHERE text IS NOT NULL")
def lazy_split(spark, sf_dir):
    p = F.split("text", " ", 2)
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.get(p, F.lit(0)).alias("head"), F.get(p, F.lit(1)).alias("rest"))


@query("SELECT conv_id, turn, 7 * 86400 + turn * 3600 + 25 * 3600 AS seconds FROM conversations")
def repeat_time_sum(spark, sf_dir):
    r = F.concat(F.lit("7d "), F.col("turn").cast("string"), F.lit("h 0 25h"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.typed_time(r).alias("seconds"))


@query("SELECT event_id, CAST(event_id % 5 * 8 + 16 + user_id % 3 AS INTEGER) AS bits FROM events")
def component_sizes(spark, sf_dir):
    part = lambda n, b: F.struct(F.lit(n).alias("name"), b.cast("int").alias("bits"))
    parts = F.array(part("y", F.col("event_id") % 5 * 8), part("u", F.lit(16)), part("v", F.col("user_id") % 3))
    return table(spark, sf_dir, "events").select("event_id", lookups.component_bits(parts).alias("bits"))


@query("SELECT a.event_id, b.event_id AS other, a.event_type = b.event_type AND strlen(a.props) = strlen(b.props) AND a.props = b.props AS same FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def node_equality(spark, sf_dir):
    node = F.struct(F.col("event_type").alias("identifier"), F.octet_length("props").alias("data_size"), F.encode("props", "UTF-8").alias("data"))
    rows = table(spark, sf_dir, "events").select("event_id", node.alias("n"))
    other = rows.select(F.col("event_id").alias("other"), F.col("n").alias("m"))
    return rows.join(other, F.col("other") == F.col("event_id") + 1).select("event_id", "other", lookups.same_node(F.col("n"), F.col("m")).alias("same"))


@query(f"WITH {SAMPLES} SELECT vec_id, array_to_string(flatten(list_transform(range(1, 33), lambda i: [s[i], s[i + 32]])), ',') AS both, array_to_string(list_filter(s, lambda x, i: i % 4 IN (2, 3)), ',') AS middle FROM sm")
def stereo_channels(spark, sf_dir):
    s = F.col("s")
    return samples(spark, sf_dir).select("vec_id", text_of(signal.stereo(F.slice(s, 1, 32), F.slice(s, 33, 32))).alias("both"), text_of(signal.channel(s, 4, 1, 2)).alias("middle"))


@query("SELECT event_id, upper(substr(md5(props), 1, 8)) AS hex, upper(substr(md5(props), 7, 2) || substr(md5(props), 5, 2) || substr(md5(props), 3, 2) || substr(md5(props), 1, 2)) AS swapped, CAST(('0b' || reverse(lpad(bin(event_id % 256), 8, '0'))) AS INTEGER) AS mirrored, substr(event_type || 'xxxx', 1, 4) AS code FROM events")
def byte_order(spark, sf_dir):
    b = F.substring(F.unhex(F.md5("props")), 1, 4)
    return table(spark, sf_dir, "events").select("event_id", F.hex(b).alias("hex"), F.hex(bits.reverse_bytes(b, 4)).alias("swapped"), bits.reverse_bits8(F.col("event_id") % 256).alias("mirrored"), bits.fourcc(F.encode(F.concat("event_type", F.lit("xxxx")), "UTF-8")).alias("code"))


@query("SELECT event_id, epoch_us(ts) + event_id AS us, epoch_us(ts) + (event_id * 1500) // 1000 AS ns, event_id * 8000 // 1000 * 4 AS bytes, event_id / 32000 * 1000 AS ms FROM events")
def time_arithmetic(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", timecode.micros(timecode.add_micros(F.col("ts"), e)).alias("us"), timecode.micros(timecode.add_nanos(F.col("ts"), e * 1500)).alias("ns"), timecode.pcm_bytes(e, 8000, 2, 16).alias("bytes"), timecode.pcm_ms(e, 8000, 2, 16).alias("ms"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 128 WHEN event_id % 4 = 1 THEN 128 + event_id % 16000 WHEN event_id % 4 = 2 THEN 16384 + event_id * 7 % 2000000 ELSE 2097152 + event_id * 131 % 200000000 END AS v FROM events)
SELECT event_id, v AS back, CASE WHEN v < 128 THEN printf('%02X', v) WHEN v < 16384 THEN printf('%02X%02X', 128 + v // 128, v % 128) WHEN v < 2097152 THEN printf('%02X%02X%02X', 128 + v // 16384, 128 + v // 128 % 128, v % 128) ELSE printf('%02X%02X%02X%02X', 128 + v // 2097152, 128 + v // 16384 % 128, 128 + v // 128 % 128, v % 128) END AS hex FROM v""")
def midi_delta(spark, sf_dir):
    e = F.col("event_id")
    v = F.when(e % 4 == 0, e % 128).when(e % 4 == 1, 128 + e % 16000).when(e % 4 == 2, 16384 + e * 7 % 2000000).otherwise(2097152 + e * 131 % 200000000)
    rows = table(spark, sf_dir, "events").select("event_id", payloads.midi_delta(v).alias("b"))
    return rows.select("event_id", timecode.midi_delta(F.col("b")).alias("back"), F.hex("b").alias("hex"))


_Q = "CAST(greatest(event_id % 99 + 1, 1) AS INTEGER)"
_SCALE = f"CASE WHEN {_Q} < 50 THEN 5000 // {_Q} ELSE 200 - 2 * {_Q} END"


@query(f"""WITH t AS (SELECT event_id, list_transform({list(signal.LUMINANCE)}, lambda x: least(greatest((x * ({_SCALE}) + 50) // 100, 1), 255)) AS q FROM events),
r AS (SELECT event_id, list_sum(list_transform(range(1, 65), lambda i: 100.0::DOUBLE * q[i] / {list(signal.LUMINANCE)}[i])) / 64 AS r FROM t)
SELECT event_id, round(CASE WHEN r <= 100 THEN (200 - r) / 2 ELSE 5000 / r END, 6) AS quality FROM r""")
def quality_estimate(spark, sf_dir):
    lum = F.array(*map(F.lit, signal.LUMINANCE))
    q = (F.col("event_id") % 99 + 1).cast("int")
    scaled = signal.scaled_table(lum, signal.quantiser_scale(q))
    return table(spark, sf_dir, "events").select("event_id", F.round(signal.quality_estimate(scaled, lum), 6).alias("quality"))


@query("""WITH v AS (SELECT event_id, event_id % 50 - 20 AS a, event_id % 7 + 1 AS b, event_id % 11 - 5 AS c, event_id % 5 + 1 AS d FROM events),
s AS (SELECT event_id, a * d - c * b AS n, b * d AS m, a * d AS p, b * c AS q FROM v)
SELECT event_id, n // gcd(n, m) AS sub_num, m // gcd(n, m) AS sub_den, CASE WHEN q <> 0 THEN sign(q) * p // gcd(p, q) END AS div_num, CASE WHEN q <> 0 THEN abs(q) // gcd(p, q) END AS div_den, CAST(sign(n) AS INTEGER) AS cmp FROM s""")
def rational_ops(spark, sf_dir):
    e = F.col("event_id")
    r = lambda n, d: F.struct(n.alias("num"), d.alias("den"))
    x, y = r(e % 50 - 20, e % 7 + 1), r(e % 11 - 5, e % 5 + 1)
    s, d = bits.rational_subtract(x, y), bits.rational_divide(x, y)
    return table(spark, sf_dir, "events").select("event_id", s["num"].alias("sub_num"), s["den"].alias("sub_den"), d["num"].alias("div_num"), d["den"].alias("div_den"), bits.rational_compare(x, y).alias("cmp"))


@query("SELECT event_id, round(event_id * 0.0254 / 0.01, 6) AS cm, round(event_id * 60.0 / 3600, 6) AS hours, round(event_id * 8192.0 / 8, 6) AS bytes FROM events")
def unit_conversion(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", *(F.round(registry.convert(e, a, b), 6).alias(n) for n, a, b in (("cm", "in", "cm"), ("hours", "min", "h"), ("bytes", "kib", "byte"))))


@query(f"WITH {SAMPLES} SELECT vec_id, array_to_string(list_transform(s, lambda x: x * 2), ',') AS twice, 'pcma,pcma_decode,pcmu,pcmu_decode' AS names, FALSE AS taken FROM sm")
def registry_transform(spark, sf_dir):
    """A user's transform of sample arrays, and a registry that keeps a name once."""
    codecs = registry.Registry(**{n: registry.CODECS.get(n) for n in registry.CODECS.names()})
    taken = codecs.register("PCMU", abs)
    rows = registry.transform_arrays(samples(spark, sf_dir), "s", lambda v: v * 2, "array<int>")
    return rows.select("vec_id", text_of(F.col("s")).alias("twice"), F.lit(",".join(codecs.names())).alias("names"), F.lit(taken).alias("taken"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'riff' WHEN page_id % 3 = 1 THEN 'bmff' END AS format FROM pages")
def extension_lookup(spark, sf_dir):
    k = F.col("page_id") % 3
    name = F.concat(F.lit("/a.b/"), F.col("page_id").cast("string"), F.when(k == 0, ".WAV").when(k == 1, ".mp4").otherwise(".unknown"))
    return registry.by_extension(table(spark, sf_dir, "pages").select("page_id", name.alias("path")), registry.EXTENSIONS).select("page_id", "format")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'said' ELSE 'left' END AS what FROM conversations")
def method_handlers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("method"))
    mark = lambda w: lambda df: df.select("conv_id", "turn", F.lit(w).alias("what"))
    return registry.handle(rows, {"USER": mark("asked"), "assistant": mark("said")}, otherwise=mark("left"))


@query("SELECT event_id, substr(props, 3, 5) AS read, 'AB' || substr(props, 3) AS written, props || 'Z' AS appended FROM events")
def read_write_at(spark, sf_dir):
    b = F.encode("props", "UTF-8")
    d = lambda c: F.decode(c, "UTF-8")
    return table(spark, sf_dir, "events").select("event_id", d(containers.read_at(b, F.lit(2), F.lit(5))).alias("read"), d(containers.write_at(b, F.lit(0), F.lit(b"AB"))).alias("written"), d(containers.write_at(b, F.octet_length(b), F.lit(b"Z"))).alias("appended"))
