"""Near-duplicate components: MinHash, banding, signature verification, large-star and small-star.

Rows with the same shingle set are one class, so a group of exact copies costs one row. Inside an
LSH bucket the members are first compared with one hub (the smallest id); what is still in different
components after that is compared across components only, in blocks, on the signatures. Every link
that counts is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, mix64, shingle_set, small_batches

BANDS, ROWS = 30, 5
#: Minima of so many standard deviations below the threshold still go on to the full sets.
SLACK = 0.15
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BLOCK = 1024


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the set; the largest 32-bit value for an empty set."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(low), _BLOCK):
        x = _A[:, None] * low[None, i : i + _BLOCK] + _B[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    x = m.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix64(key ^ x[:, j]) * np.uint64(0xD1342543DE82EF95)
    return mix64(key)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, digests, bands, sigs = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(t.as_py(), width)
                ids.append(i)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minima(s)
                bands.append(band_keys(m).view(np.int64) if len(s) else np.zeros(0, np.int64))
                sigs.append(mix64(m.astype(np.uint64)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "digest", "bands", "sig"],
            )
        give_back()

    return run


def _sig_matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), BANDS * ROWS)


def _similar_sigs(least: float):
    """Keep the pairs whose minima agree often enough (agreement of single bytes, so a little too often)."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                hits = (_sig_matrix(b.column("sig_a")) == _sig_matrix(b.column("sig_b"))).mean(axis=1)
                t = t.filter(pa.array(hits >= least))
            yield from t.select(["a", "b"]).to_batches()

    return run


def _confirm(percent: int, width: int):
    def run(batches):
        for b in batches:
            keep, last, last_id = [], None, None
            a_col, b_col = b.column("a").to_pylist(), b.column("b").to_pylist()
            for i in range(b.num_rows):
                if b_col[i] != last_id:
                    last_id, last = b_col[i], shingle_set(b.column("text_b")[i].as_py(), width)
                s = shingle_set(b.column("text_a")[i].as_py(), width)
                both = len(np.intersect1d(s, last, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(last) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a_col[i] for i in keep], pa.int64()), pa.array([b_col[i] for i in keep], pa.int64())], ["a", "b"])
        give_back()

    return run


def _flag(least: float):
    """Rows of one block that have a partner in another component there, judged by their signatures.

    A pair is looked at in the first band that it shares only, told by the full keys of the bands.
    """

    def run(_, table):
        minor = np.array(table.column("minor").to_pylist(), bool)
        sig = _sig_matrix(table.column("sig").combine_chunks())
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        comp = np.array(table.column("comp").to_pylist(), np.int64)
        band = table.column("band")[0].as_py()
        q, r = np.flatnonzero(minor), np.flatnonzero(~minor)
        flagged = np.zeros(len(minor), bool)
        for i in q:
            hit = (comp[r] != comp[i]) & ((sig[r] == sig[i]).mean(axis=1) >= least)
            hit[hit] = (keys[r[hit]] == keys[i]).argmax(axis=1) == band
            flagged[r[hit]] = True
            flagged[i] |= hit.any()
        return table.filter(pa.array(flagged)).select(["key", "i", "j", "id", "comp", "minor"])

    return run


def _links_in_block(percent: int, width: int):
    """Confirmed links of one block between components, as few as join them: counted by inverted lists."""

    def run(_, table):
        minor = np.array(table.column("minor").to_pylist(), bool)
        ids, comp = (np.array(table.column(c).to_pylist(), np.int64) for c in ("id", "comp"))
        sets = [shingle_set(t.as_py(), width) for t in table.column("text")]
        size = np.array([len(x) for x in sets])
        q, r = np.flatnonzero(minor), np.flatnonzero(~minor)
        parent = {c: c for c in comp.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        left, right = [], []
        if len(q) and len(r):
            owner = np.repeat(np.arange(len(r)), size[r])
            every = np.concatenate([sets[k] for k in r])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for i in q:
                lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
                both = np.bincount(owner[at], minlength=len(r))
                for k in r[(both > 0) & (100 * both >= percent * (size[r] + size[i] - both))]:
                    x, y = root(int(comp[i])), root(int(comp[k]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        left.append(int(ids[i]))
                        right.append(int(ids[k]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) with v the least node of u's component, for every node of ``edges`` (columns a, b) but the least ones.

    Alternating large-star and small-star; the minima of a node's neighbours are combined before the
    shuffle and joined back, so a node with very many neighbours is never gathered in one task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = scratch.write(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        if large:
            out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done = scratch.write(out.where("u <> v").distinct(), "edges")
        scratch.drop(least)
        return done

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(e)
    while before[0]:
        a = star(e, True)
        b = star(a, False)
        scratch.drop(a, e)
        e, after = b, mark(b)
        if after == before:
            break
        before = after
    return e


def components(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable by links), kept.

    A link joins two rows with 100 * |intersection| >= percent * |union| of their shingle sets.
    Null or wordless texts have no shingles and stand alone; a null id has no component. Where rows of one
    id differ in text, each gives a row of its own, and links of that id are confirmed on the text of the
    least hash. Very long texts are taken whole. An empty table gives an empty result. Other columns,
    whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.write(base.mapInArrow(_sketch(width), "id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary"), "sketch")
    some = sketch.where("n_shingles > 0")
    classes = scratch.write(some.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.write(sketch.join(classes, (sketch.digest == classes.digest) & (sketch.id == classes.rep), "left_semi").select("id", "n_shingles", "bands", "sig"), "reps")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    hubs = scratch.write(rows.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub", "n"), "hubs")
    bucket = scratch.write(rows.join(hubs, "key").select("key", "band", "id", "hub", "n"), "bucket")
    sig = reps.select("id", "n_shingles", "sig")
    least = percent / 100 - SLACK

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b): texts are fetched for these documents only."""
        need = scratch.write(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "need")
        texts = scratch.write(base.join(need, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "texts")
        both = (
            pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b")
        )
        links = scratch.write(both.mapInArrow(_confirm(percent, width), "a bigint, b bigint"), "links")
        scratch.drop(need, texts)
        return links

    star_pairs = scratch.write(bucket.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    with_sigs = (
        star_pairs.join(sig.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sig_b")), "b")
        .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
        .select("a", "b", "sig_a", "sig_b")
    )
    likely = scratch.write(with_sigs.mapInArrow(_similar_sigs(least), "a bigint, b bigint"), "likely")
    links = confirmed(likely)
    comp = connected_components(links, scratch)

    labelled = scratch.write(
        bucket.join(comp.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("key", "band", "id", "n", F.coalesce("comp", "id").alias("comp")), "labelled"
    )
    # Of each bucket with several components: the component of the most rows is compared with the others only.
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    major = scratch.write(per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("k"), F.max("c").alias("c"), F.first("n").alias("n")).where("k > 1").withColumn("minors", F.col("n") - F.col("c")), "major")
    block, chunk = 256, 1024
    h = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), n)
    mixed = labelled.drop("n").join(major, "key").join(reps.select("id", "sig", "bands"), "id")
    n_minor, n_all = F.ceil(F.col("minors") / block), F.ceil(F.col("n") / chunk)
    asks = mixed.where("comp <> major").select("key", "band", h(n_minor, 1).alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), "id", "comp", "sig", "bands", F.lit(True).alias("minor"))
    answers = mixed.select("key", "band", F.explode(F.sequence(F.lit(0), n_minor - 1)).alias("i"), h(n_all, 2).alias("j"), "id", "comp", "sig", "bands", F.lit(False).alias("minor"))
    flagged = scratch.write(asks.unionByName(answers).groupBy("key", "i", "j").applyInArrow(_flag(least), "key bigint, i bigint, j bigint, id bigint, comp bigint, minor boolean"), "flagged")
    need = scratch.write(flagged.select("id").distinct(), "need")
    texts = scratch.write(base.join(need, "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "texts")
    more_links = scratch.write(flagged.join(texts, "id").groupBy("key", "i", "j").applyInArrow(_links_in_block(percent, width), "a bigint, b bigint").distinct(), "more")
    scratch.drop(texts, need)
    comp = connected_components(comp.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more_links), scratch)
    scratch.drop(bucket, labelled, major, flagged, star_pairs, likely)

    members = sketch.select("id", "n_shingles", "digest").join(classes, "digest", "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"))
    out = members.join(comp.select(F.col("u").alias("rep"), "v"), "rep", "left")
    root = F.coalesce("v", "rep")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", root.alias("component_id"), (F.col("id") == root).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; columns are left as they are.

    Rows without an id stay, and so do repeated rows of an id that stays.
    """
    scratch = Scratch(docs.sparkSession, "neardup-kept")
    gone = scratch.write(components(docs, percent, width).groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where("not stays").select("doc_id"), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""
