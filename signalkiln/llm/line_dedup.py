"""Repeated lines across documents, by DataFrame functions only.

Line keys become two 64-bit hashes. Hashes met often enough are partitioned by range and sorted by
document (the contract keeps the largest, so descending) and position; a scan of each sorted partition
streams the first occurrences and stops a hash at its fifth document. A hash with very many lines is
dealt to several ranges by a salt, each of which gives its first documents only. The lines that fall are
gathered per document into bit words: the result is a compressed bitmap of the kept lines (run lengths).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, let

MIN_CHARS, MIN_DOCS = 40, 5
_WORD = 62
#: Lines of one hash that stand in one range at most; a more frequent hash is salted.
RANGE_LINES = 256


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; lower() where all is ASCII, which gives the same and is faster."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashes(line: Column) -> Column:
    return let(key_of(line), lambda k: F.when(F.length(k) >= MIN_CHARS, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, words): bit words (index to 62 bits) of the lines that fall in each document that loses any."""
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.select(F.col(id_col).alias("doc"), lines_of(F.col(text_col)).alias("lines"))
    lines = scratch.write(
        base.where(F.exists("lines", lambda x: F.length(x) >= MIN_CHARS)).select("doc", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= MIN_CHARS)
        .select("doc", "pos", _hashes(F.col("line")).alias("h")).where("h is not null").select("doc", "pos", "h.h1", "h.h2"),
        "lines",
    )
    # Lines met often enough anywhere; a second look then counts documents.
    repeats = scratch.write(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "repeats")
    some = scratch.write(lines.join(repeats, ["h1", "h2"]), "some")
    scratch.drop(lines)
    salted = some.select("h1", "h2", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / RANGE_LINES)).alias("salt"), "doc", "pos")
    ranges = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("doc"), "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"))
    first = ranges.withColumn("nth", F.dense_rank().over(stream)).where(F.col("nth") <= min_docs).select("h1", "h2", "doc").distinct()
    shared = scratch.write(first.groupBy("h1", "h2").agg(F.count("doc").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs).select("h1", "h2", "last"), "shared")
    gone = some.join(shared, ["h1", "h2"]).where("doc <> last").select("doc", F.floor(F.col("pos") / _WORD).cast("int").alias("w"), F.expr(f"shiftleft(1L, pos % {_WORD})").alias("bit"))
    words = gone.groupBy("doc", "w").agg(F.bit_or("bit").alias("bits")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("words"))
    return scratch.write(words, "words")


def _dense(words: Column) -> Column:
    """The bit words as an array by index, so that each line's bit is one look-up; null if no line falls."""
    return F.when(words.isNotNull(), F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(words))), lambda w: F.coalesce(F.element_at(words, w), F.lit(0).cast("bigint"))))


def _falls(bits: Column, i: Column) -> Column:
    return F.coalesce(F.getbit(F.get(bits, F.floor(i / _WORD).cast("int")), (i % _WORD).cast("int")) == 1, F.lit(False))


def _kept_text(text: Column, words: Column) -> Column:
    some = let(_dense(words), lambda bits: F.array_join(F.filter(lines_of(text), lambda x, i: ~_falls(bits, i)), "\n"))
    return F.when(words.isNull(), text).otherwise(some)


def _runs(n: Column, words: Column) -> Column:
    """Lengths of the alternating runs of kept and dropped lines among ``n`` lines."""

    def lengths(bits: Column) -> Column:
        # where a run begins: at 0, and again at 0 if the first line falls; the end closes the last run
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (_falls(bits, i) != _falls(bits, i - 1)))
        edges = F.concat(F.when(_falls(bits, F.lit(0)), F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))), starts)
        return let(edges, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.get(e, k) - F.get(e, k - 1)))

    return F.when(words.isNull(), F.array(n)).otherwise(let(_dense(words), lengths))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, keep_runs, kept_sha256, kept_text.

    keep_runs are the lengths of alternating runs of kept and dropped lines, the first one of kept
    lines (0 if the first line falls). A key of at least 40 code points in at least ``min_docs``
    documents loses all its lines except those in the largest doc_id that holds it. Null and empty
    texts are one empty line; ties and repeated lines of the last document stay. Rows that share an
    id count as one document; rows without an id hold no line that counts. Very long texts are split
    whole. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    words = dropped_lines(docs, min_docs, id_col, text_col).withColumnRenamed("doc", "owner")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = base.join(words.hint("merge"), F.col("doc_id") == F.col("owner"), "left")  # the bitmaps have no size bound
    n = F.size(lines_of(F.col("text")))
    kept = _kept_text(F.coalesce("text", F.lit("")), F.col("words"))
    return got.select(
        "doc_id",
        n.cast("bigint").alias("n_lines"),
        F.coalesce(F.aggregate(F.map_values("words"), F.lit(0).cast("bigint"), lambda a, b: a + F.bit_count(b)), F.lit(0).cast("bigint")).alias("n_dropped"),
        _runs(n, F.col("words")).alias("keep_runs"),
        kept.alias("kept_text"),
    ).withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the texts the kept lines give; texts that lose nothing stay as they are, null included.

    Columns come back as they are, whatever their names; n_chars is counted anew where there is one.
    """
    words = dropped_lines(docs, min_docs)
    whole = docs.select(F.struct(*docs.columns).alias("whole"))
    got = whole.join(words.hint("merge"), F.col("whole.doc_id") == F.col("doc"), "left")
    got = got.withColumn("kept", _kept_text(F.col("whole.text"), F.col("words")))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return got.select(*(new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key),
b AS (SELECT doc_id, pos, gone, CASE WHEN gone IS DISTINCT FROM lag(gone) OVER w THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT doc_id, gone, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b),
s AS (SELECT doc_id, run, bool_or(gone) AS gone, count(*) AS n FROM n GROUP BY doc_id, run),
runs AS (SELECT doc_id, CASE WHEN bool_or(gone AND run = 1) THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_runs FROM s GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM m GROUP BY doc_id)
SELECT t.doc_id, n_lines, n_dropped, kept_sha256, keep_runs FROM t JOIN runs ON t.doc_id = runs.doc_id
"""
