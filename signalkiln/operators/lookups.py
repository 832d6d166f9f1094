"""Look-ups of contexts, media and contributors, positions in sequences, and comparison of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a look-up table that are broadcast at most; a larger one is joined by shuffle.
SMALL = 100_000


def small_side(table: DataFrame, rows: int = SMALL) -> DataFrame:
    """``table``, marked for broadcast if it counts ``rows`` at most."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def context_by_channel(frames: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ctx_id to rows with a channel: the first context that uses it for data or control, else null.

    ``contexts``: ctx_id (order of registration), data_channel, control_channel. The table joined has one
    row a channel, so nothing multiplies.
    """
    used = contexts.select("ctx_id", F.explode(F.array("data_channel", "control_channel")).alias("channel")).where("channel is not null")
    return frames.join(small_side(used.groupBy("channel").agg(F.min("ctx_id").alias("ctx_id"))), "channel", "left")


def medias(lines: DataFrame) -> DataFrame:
    """(doc_id, section, media, port, protocol, payload_types, control) of the m= lines that ``text.sdp_lines`` gives."""
    part = lambda i: F.get("parts", F.lit(i))
    of = lambda hit, c: F.max(F.when(hit, c))
    m = F.col("type") == "m"
    got = lines.where("section > 0").groupBy("doc_id", "section").agg(
        of(m, part(0)).alias("media"), of(m, F.regexp_extract(part(1), r"^\d+", 0).try_cast("int")).alias("port"), of(m, part(2)).alias("protocol"),
        of(m, F.filter(F.transform(F.slice("parts", 4, 1 << 16), lambda x: x.try_cast("int")), lambda x: x.isNotNull())).alias("payload_types"),
        of((F.col("type") == "a") & F.col("value").startswith("control:"), F.substring("value", 9, 1 << 16)).alias("control"),
    )
    return got.where("media is not null")


def _first(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("doc_id", "section")]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("section", *rest), "section").alias("m")).select("doc_id", "m.*")


def media_by_payload_type(medias_: DataFrame, payload_type: Column) -> DataFrame:
    """Of each description its first media with the payload type."""
    return _first(medias_.where(F.array_contains("payload_types", payload_type)))


def media_by_port(medias_: DataFrame, port: Column) -> DataFrame:
    """Of each description its first media at the port."""
    return _first(medias_.where(F.col("port") == port))


def context_for_media(medias_: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ctx_id: the first context of the same media name and port; ``contexts``: ctx_id, media, port."""
    one = contexts.groupBy("media", "port").agg(F.min("ctx_id").alias("ctx_id"))
    return medias_.join(small_side(one), ["media", "port"], "left")


def values_of(keys: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Every value of each key, one a row, in a map with several values a key; a key without values gives none.

    Values stay rows: a key with very many of them is never gathered.
    """
    return keys.join(pairs, key)


def contributes(csrc: Column, ssrc: Column) -> Column:
    """Whether a source is among the contributing ones of a packet."""
    return F.coalesce(F.array_contains(csrc, ssrc), F.lit(False))


def index_of(values: Column, value: Column) -> Column:
    """Place of the first equal element counted from 0, or -1."""
    return F.coalesce(F.array_position(values, value) - 1, F.lit(-1)).cast("int")


def prefix(values: Column, value: Column) -> Column:
    return F.array_prepend(values, value)


def prefix_row(rows: DataFrame, *values) -> DataFrame:
    """One more row in front of ``rows``, as a union."""
    return rows.sparkSession.createDataFrame([values], rows.schema).unionByName(rows)


def sequence_digests(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """(key, n, digest): equal for keys whose rows have equal values in equal order.

    Each row adds a hash of its place and values, so that rows are combined before the shuffle of the sum.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    part = F.xxhash64(place, *values).cast("decimal(38,0)")
    return rows.select(key, part.alias("p")).groupBy(key).agg(F.count("*").alias("n"), F.sum("p").alias("digest"))


def same_sequences(left: DataFrame, right: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """(key, same): whether both sides have the same rows of a key in the same order."""
    a, b = (sequence_digests(x, key, order, values) for x in (left, right))
    same = F.coalesce((F.col("a.n") == F.col("b.n")) & (F.col("a.digest") == F.col("b.digest")), F.lit(False))
    return a.alias("a").join(b.alias("b"), key, "full").select(key, same.alias("same"))


def same_node(a: Column, b: Column) -> Column:
    """Nodes with one identifier, size and content."""
    return (a["identifier"] == b["identifier"]) & (a["data_size"] == b["data_size"]) & (a["data"] == b["data"])


def component_bits(components: Column) -> Column:
    """Bits of a sample: the sum over array<struct<bits>>."""
    return F.aggregate(components, F.lit(0), lambda a, x: a + x["bits"].cast("int"))
