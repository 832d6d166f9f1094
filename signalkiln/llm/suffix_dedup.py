"""Exact repeated passages: bucketed enhanced suffix arrays scanned as a common-prefix interval tree.

Every window of ``PASSAGE`` bytes has a least inner gram (``gram`` bytes, by hash); runs of windows with
the same least gram form one segment, keyed by that gram, whose text reaches ``length`` bytes beyond its
last window. Equal windows have equal keys, so repeats never cross a key. Keys seen once are dropped
after one counting shuffle of small rows. Segments that are equal are one class; classes that share a
key but differ are compared in an enhanced suffix array of that key, whose LCP intervals are found by a
stack scan and kept where their left extensions differ. One array serves both questions: which bytes lie
in a repeat of ``length`` bytes (they are removed), and which passages of more than ``WORDS`` words repeat.
A key with more than ``BUCKET`` different segments is dealt to several arrays. What repeats inside one of
them is found there; each then sends one row for every different window, and counting their hashes finds
what repeats between arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, mix64, prefix_hash, range_hash, small_batches, word_bounds

LENGTH, GRAM = 400, 128
#: Bytes of the shortest repeats that are looked for, and the words a repeated passage has at least.
PASSAGE, WORDS = 256, 51
#: A run of equal least grams (a periodic text) is cut after so many windows.
RUN = 256
#: Different segments of one key that are sorted in one suffix array, about; a larger key is dealt to several.
#: A segment has 256 suffixes at most, and each costs some 40 bytes before those that cannot start a repeat leave.
BUCKET = 32_768
#: Bytes of texts that are hashed at once.
CHUNK = 4 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values (van Herk: prefix and suffix minima of blocks)."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def segments(data: np.ndarray, length: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and window counts of the segments of one text, and whether it has the key's gram twice."""
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    i = np.arange(len(data) - gram + 1)
    grams = range_hash(prefix_hash(data), i, i + gram)
    least = sliding_min(grams, length - gram + 1)
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(cut, n))
    most = min(RUN, length)  # the windows of a segment overlap, so any of them cover one range
    if sizes.max() > most:
        parts = -(-sizes // most)
        first = np.repeat(cut, parts)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = first + step * most
        sizes = np.diff(np.append(cut, n))
    keys = least[cut]
    known, back = np.unique(keys, return_inverse=True)
    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    times = np.bincount(place[known[place] == grams], minlength=len(known))
    return keys, cut, sizes, times[back] > 1


def _occurrences(window: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "seg", "doc", "th", "start", "windows", "bytes", "twice"]
        kinds = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int16, np.int32, bool]
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for doc, text, th in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                key, start, size, twice = segments(np.frombuffer(raw, np.uint8), window, gram)
                if not len(key):
                    continue
                ends = np.minimum(start + size + (length - 1), len(raw))
                segs = np.fromiter((digest(raw[p:e]) for p, e in zip(start.tolist(), ends.tolist(), strict=True)), np.uint64, len(key))
                for x, v in zip(out, (key.view(np.int64), segs.view(np.int64), np.full(len(key), doc, np.int64), np.full(len(key), th, np.int64), start, size, ends - start, twice), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k) if x else np.zeros(0, k)) for x, k in zip(out, kinds, strict=True)], names)
        give_back()

    return run


def _chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of texts with about ``CHUNK`` bytes each."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True))


def _starts(sizes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first ``count`` suffixes of each of several texts joined to one: start, text, place in it."""
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(sizes) - sizes)[text] + place, text, place


def open_suffixes(texts: list[bytes], windows: list[int], groups: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the suffixes of several groups of texts from which a maximal repeat can start.

    Suffixes of a group that share their first ``least`` bytes form a class. Where all of a class have
    the same byte to their left, every interval inside it extends to the left and none is maximal, so
    the class is left out; a hash that is equal by chance only merges classes, which leaves out no more.
    """
    sizes, count = np.array([len(t) for t in texts]), np.array(windows)
    salt = mix64(np.array(groups, np.int64).view(np.uint64))
    parts = []
    for lo, hi in _chunks(sizes):
        at, text, place = _starts(sizes[lo:hi], count[lo:hi])
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        h = range_hash(prefix_hash(data), at, at + least)
        left = np.where(place > 0, data[np.maximum(at - 1, 0)].astype(np.int16), np.int16(256))
        parts.append((mix64(h ^ salt[lo:hi][text]), left, (text + lo).astype(np.int32), place.astype(np.int32)))
    h, left, text, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    size = np.diff(np.append(first, len(order)))
    low, high = np.minimum.reduceat(left[order], first), np.maximum.reduceat(left[order], first)
    chosen = order[np.repeat((size > 1) & ((low != high) | (high == 256)), size)]
    chosen.sort()
    return text[chosen], place[chosen]


def repeat_intervals(texts: list[bytes], chosen: list[tuple[int, int]], least: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[int, int, int]]]:
    """The sorted suffixes (bytes, text, place) that start at ``chosen``, and the intervals (length, from, to) of maximal repeats.

    Neighbours' common prefixes give the LCP array, and a stack scan walks its interval tree, inner
    intervals first; an interval is reported where the bytes to the left of its suffixes are not all the
    same (a start of a text is different from every byte), so that no longer repeat has the same occurrences.
    """
    if len(chosen) < 2:
        return [], []
    suffixes = [(texts[k][p:], k, p) for k, p in chosen]
    suffixes.sort()
    n = len(suffixes)
    lcp = [0] * (n + 1)
    for i in range(1, n):
        a, b = suffixes[i - 1][0], suffixes[i][0]
        m = min(len(a), len(b))
        if a[:least] != b[:least] or m < least:
            continue
        if a[:m] == b[:m]:
            lcp[i] = m
            continue
        lo, hi = least, m
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[least:mid] == b[least:mid]:
                lo = mid
            else:
                hi = mid - 1
        lcp[i] = lo
    left = [texts[k][p - 1] if p else -1 - i for i, (_, k, p) in enumerate(suffixes)]
    out = []
    # stack of [lcp, left bound, left byte shared by all its suffixes or None]
    stack: list[list] = []
    for i in range(1, n + 1):
        start, same = i - 1, left[i - 1]
        while stack and stack[-1][0] > lcp[i]:
            size, start, inner = stack.pop()
            same = inner if inner == same else None
            if same is None:
                out.append((size, start, i))
        if lcp[i] >= least:
            if stack and stack[-1][0] == lcp[i]:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == same else None
            else:
                stack.append([lcp[i], start, same])
    return suffixes, out


def maximal_repeats(texts: list[bytes], windows: list[int], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of ``least`` bytes or more that start at one of the first ``windows`` places of a text.

    Returns (length, [(text, start), ...]) with all occurrences of each repeat.
    """
    chosen = list(zip(*(x.tolist() for x in open_suffixes(texts, windows, [0] * len(texts), least)), strict=True)) if sum(windows) else []
    suffixes, intervals = repeat_intervals(texts, chosen, least)
    return [(size, [(k, p) for _, k, p in suffixes[a:b]]) for size, a, b in intervals]


def covered(texts: list[bytes], windows: list[int], groups: list[int], least: int, length: int, repeats: list | None = None) -> dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Byte ranges, joined, that the maximal repeats of its group cover in each text that has any: all, and those of ``length`` bytes.

    Of the nested intervals that hold a suffix the longest counts, so each suffix gives one range. ``repeats``
    gets (hash, bytes, text, start) of every occurrence of each maximal repeat.
    """
    text, place = open_suffixes(texts, windows, groups, least)
    if not len(text):
        return {}
    own = np.array(groups)[text]
    ranges: dict[int, list[tuple[int, int]]] = {}
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(own)], strict=True):
        suffixes, intervals = repeat_intervals(texts, list(zip(text[a:b].tolist(), place[a:b].tolist(), strict=True)), least)
        longest = np.zeros(len(suffixes), np.int64)
        for size, i, j in intervals:
            np.maximum(longest[i:j], size, out=longest[i:j])
            if repeats is not None:
                name = xxhash.xxh3_64_intdigest(suffixes[i][0][:size])
                repeats.extend((name, size, k, p) for _, k, p in suffixes[i:j])
        for (_, k, p), size in zip(suffixes, longest.tolist(), strict=True):
            if size:
                ranges.setdefault(k, []).append((p, p + size))
    return {k: (join_ranges(r), join_ranges([x for x in r if x[1] - x[0] >= length])) for k, r in ranges.items()}


def join_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_RANGE = "array<struct<a:bigint,b:bigint>>"


def _listed(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPANS)


def _cut(batches):
    """Texts of the wanted segments of each document."""
    for b in batches:
        out = []
        for text, wants in zip(b.column("text"), b.column("wants").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            out.extend((w["key"], w["seg"], w["windows"], raw[w["start"] : w["start"] + w["bytes"]]) for w in wants)
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "seg", "windows", "bytes"])
    give_back()


def window_rows(texts: list[bytes], windows: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each different window of ``size`` bytes of the segments: two hashes, a segment and place that has it, and if only that has it."""
    sizes = np.array([len(t) for t in texts])
    count = np.clip(np.minimum(np.array(windows), sizes - size + 1), 0, None)
    parts = []
    for lo, hi in _chunks(sizes):
        at, text, place = _starts(sizes[lo:hi], count[lo:hi])
        s = prefix_hash(np.frombuffer(b"".join(texts[lo:hi]), np.uint8))
        h = range_hash(s, at, at + size)
        parts.append((h, mix64(range_hash(s, at, at + size // 2) ^ h), text + lo, place))
    h, other, text, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, first, times = np.unique(h, return_index=True, return_counts=True)
    return h[first], other[first], text[first], place[first], times == 1


_ARRAY_ROWS = f"key bigint, seg bigint, spans {_RANGE}, long {_RANGE}, size bigint, h1 bigint, h2 bigint, at bigint, once boolean"


def _arrays(window: int, length: int, with_groups: bool = False):
    """Rows of up to three kinds: the covered ranges of segments; of dealt keys their different windows; and (once null) the
    occurrences of maximal repeats by a hash of their bytes. Rows come ordered by array; one is never split."""
    kinds = [pa.int64(), pa.int64(), _SPANS, _SPANS, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["key", "seg", "spans", "long", "size", "h1", "h2", "at", "once"]

    def batch(*cols) -> pa.RecordBatch:
        n = len(next(c for c in cols if c is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def answer(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, segs = t.column("key").to_numpy(), t.column("seg").to_numpy()
        texts, windows, groups, dealt = (t.column(c).to_pylist() for c in ("bytes", "windows", "array", "dealt"))
        repeats: list | None = [] if with_groups else None
        found = covered(texts, windows, groups, window, length, repeats)
        if repeats:
            name, size, text, place = (np.array(c) for c in zip(*repeats, strict=True))
            yield batch(keys[text], segs[text], None, None, size, name.astype(np.uint64).view(np.int64), np.zeros(len(name), np.int64), place, pa.nulls(len(name), pa.bool_()))
        at = np.array(list(found), np.int64)
        yield batch(keys[at], segs[at], _listed([s for s, _ in found.values()]), _listed([s for _, s in found.values()]), None, None, None, None, None)
        some = [i for i, d in enumerate(dealt) if d]
        first = [k for k, i in enumerate(some) if not k or groups[i] != groups[some[k - 1]]]
        for a, b in zip(first, [*first[1:], len(some)], strict=False):  # nothing where no key is dealt
            own = np.array(some[a:b])
            for size in (window, length):
                h1, h2, text, place, once = window_rows([texts[i] for i in own], [windows[i] for i in own], size)
                yield batch(keys[own[text]], segs[own[text]], None, None, np.full(len(h1), size), h1.view(np.int64), h2.view(np.int64), place, once)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("array").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from answer(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            elif held and held[-1].column("array")[0].as_py() != keys[0]:
                yield from answer(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(last))
        if held:
            yield from answer(pa.Table.from_batches(held))
        give_back()

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and what tells a row: its id (one value stands for null) and a hash of its text."""
    doc = F.col(id_col).cast("bigint")
    return docs.select(doc.alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(doc, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.col(text_col)).alias("th"))


class _Search:
    """The tables of one search for repeats: segments that occur again, their classes, and what the arrays found."""

    def __init__(self, docs: DataFrame, length: int, window: int, gram: int, id_col: str, text_col: str, with_groups: bool):
        spark = docs.sparkSession
        small_batches(spark)
        self.scratch = scratch = Scratch(spark, "suffix")
        self.length, self.window = length, window
        base = _rows(docs, id_col, text_col)
        occ = scratch.write(base.select("doc", "text", "th").mapInArrow(_occurrences(window, length, gram), "key bigint, seg bigint, doc bigint, th bigint, start int, windows smallint, bytes int, twice boolean"), "occ")
        keys = scratch.write(occ.groupBy("key").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.bool_or("twice").alias("twice")).where("n > 1 or twice").select("key", (F.col("twice") | (F.col("lo") != F.col("hi"))).alias("mixed")), "keys")
        self.again = scratch.write(occ.drop("twice").join(keys, "key"), "again")
        scratch.drop(occ)
        segs = self.again.where("mixed").groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "start", "windows", "bytes")).alias("rep"))
        self.segs = scratch.write(segs.select("key", "seg", "n", "rep.*"), "segs")
        sizes = scratch.write(self.segs.groupBy("key").agg(F.count("*").alias("members")), "sizes")
        wants = self.segs.join(sizes, "key").select("doc", "th", F.struct("key", "seg", "start", F.col("windows").cast("int").alias("windows"), "bytes").alias("w"))
        wants = scratch.write(wants.groupBy("doc", "th").agg(F.collect_list("w").alias("wants")), "wants")
        once = base.join(wants, ["doc", "th"]).dropDuplicates(["doc", "th"])
        texts = scratch.write(once.select("text", "wants").mapInArrow(_cut, "key bigint, seg bigint, windows int, bytes binary"), "texts")
        deal = F.ceil(F.col("members") / BUCKET)
        dealt = texts.join(sizes, "key").withColumn("dealt", deal > 1).withColumn("array", F.when(deal > 1, F.xxhash64("key", F.pmod("seg", deal))).otherwise(F.col("key")))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.solved = scratch.write(dealt.drop("members").repartition(parts, "array").sortWithinPartitions("array").mapInArrow(_arrays(window, length, with_groups), _ARRAY_ROWS), "solved")
        scratch.drop(texts, sizes, wants)

    def spans(self) -> DataFrame:
        """(doc, th, spans, long): byte ranges of a row whose union is what repeated strings of ``window`` and of ``length`` bytes cover."""
        again, segs, solved, window, length = self.again, self.segs, self.solved, self.window, self.length
        none = F.array().cast(_RANGE)
        size = F.col("bytes").cast("bigint")

        def all_of(start):
            """Spans of a segment whose every byte is repeated: at the size of windows, and at ``length`` where it is as long."""
            one = F.array(F.struct(start.cast("bigint").alias("a"), (start + size).alias("b")))
            return one.alias("spans"), F.when(size >= length, one).otherwise(none).alias("long")

        whole = again.where("not mixed").select("doc", "th", *all_of(F.col("start")))
        twice = solved.where("once is not null").groupBy("size", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("size", "h1", "h2")
        # of a segment's windows any two overlap, so those that repeat cover one range
        at = lambda n: F.when(F.col("size") == n, F.col("at"))
        reach = lambda n: F.when(F.min(at(n)).isNotNull(), F.array(F.struct(F.min(at(n)).alias("a"), (F.max(at(n)) + n).alias("b")))).otherwise(none)
        found = solved.where("once").select("size", "h1", "h2", "key", "seg", "at").join(twice, ["size", "h1", "h2"]).groupBy("key", "seg").agg(reach(window).alias("spans"), reach(length).alias("long"))
        spans = solved.where("size is null").select("key", "seg", "spans", "long")
        # a segment with several occurrences is covered as a whole
        cover = self.scratch.write(
            spans.unionByName(found).where(F.size("spans") > 0).select("key", "seg", "spans", "long")
            .unionByName(segs.where("n > 1").select("key", "seg", *all_of(F.lit(0)))),
            "cover",
        )
        self.scratch.drop(solved, segs)
        move = lambda s: F.struct((F.col("start") + s.a).alias("a"), (F.col("start") + s.b).alias("b"))
        part = again.where("mixed").join(cover, ["key", "seg"]).select("doc", "th", F.transform("spans", move).alias("spans"), F.transform("long", move).alias("long"))
        return whole.unionByName(part)

    def groups(self) -> DataFrame:
        """(repeat, bytes, doc, th, start): see ``repeat_groups``."""
        inside = self.solved.where("size is not null and once is null").select("key", "seg", F.col("h1").alias("repeat"), F.col("size").alias("bytes"), "at")
        part = self.again.drop("bytes", "windows").join(inside, ["key", "seg"]).select("repeat", "bytes", "doc", "th", (F.col("start") + F.col("at")).alias("start"))
        of_classes = self.again.join(self.segs.where("n > 1").select("key", "seg"), ["key", "seg"], "left_semi").unionByName(self.again.where("not mixed"))
        whole = of_classes.select(F.col("seg").alias("repeat"), F.col("bytes").cast("bigint").alias("bytes"), "doc", "th", F.col("start").cast("bigint").alias("start"))
        return part.unionByName(whole).distinct()


def repeat_groups(docs: DataFrame, length: int = LENGTH, window: int = PASSAGE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, bytes, doc_id, start): every occurrence of every maximal repeat of ``window`` bytes or more, one a row.

    repeat is a hash of the repeated bytes, so rows of one value form a group. Repeats are maximal inside
    the segments that are compared (``window`` to some 650 bytes): a longer one appears as the repeats of its
    segments, which overlap. Nested repeats are groups of their own. Nulls, equal rows and repeated ids are
    handled as in ``remove_repeats``; a key that is dealt to several arrays gives groups for each.
    """
    found = _Search(docs, length, window, gram, id_col, text_col, True).groups()
    return found.select("repeat", "bytes", F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), "start")


def passages(raw: bytes, runs: list[tuple[int, int]], words: int = WORDS) -> list[tuple[int, int, int]]:
    """(first byte, end, words) of the runs that hold ``words`` whole words or more."""
    if not runs:
        return []
    first, last = word_bounds(np.frombuffer(raw, np.uint8))
    out = []
    for a, b in runs:
        n = int(np.searchsorted(last, b, "right") - np.searchsorted(first, a, "left"))
        if n >= words:
            out.append((a, b, n))
    return out


_PASSAGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())]))


def _digest(batches):
    for b in batches:
        rows = []
        for text, every, long in zip(b.column("text"), b.column("spans").to_pylist(), b.column("long").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs = join_ranges([(s["a"], s["b"]) for s in long or ()])
            kept, at = [], 0
            for a, e in runs:
                kept.append(raw[at:a])
                at = e
            kept.append(raw[at:])
            found = passages(raw, join_ranges([(s["a"], s["b"]) for s in every or ()]))
            rows.append((
                len(raw), sum(e - a for a, e in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), len(found), sum(n for *_, n in found),
                [{"a": a, "b": e} for a, e in runs], [{"a": a, "b": e, "words": n} for a, e, n in found],
            ))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _SPANS, _PASSAGES]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "spans", "passages"])
    give_back()


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = PASSAGE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words, spans, passages.

    spans are the byte ranges removed: what strings of ``length`` bytes that also start elsewhere cover.
    passages are the runs covered by repeated strings of ``window`` bytes that hold more than 50 words;
    they are reported, not removed. Matches are judged on the input as UTF-8 bytes and never cross rows;
    a null text counts as empty. Texts shorter than ``window`` have no repeats; very long ones are taken
    whole. All copies of a repeated string are removed, the first included. Rows are told by id and text:
    rows of one id are documents of their own, and equal rows are repeats of each other. Null ids are
    kept. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    search = _Search(docs, length, window, gram, id_col, text_col, False)
    spans = search.spans()
    per = search.scratch.write(spans.groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("long")).alias("long")), "spans")
    got = _rows(docs, id_col, text_col).join(per, ["doc", "th"], "left").select("doc_id", "text", "spans", "long")
    return got.mapInArrow(_digest, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_words bigint, spans {_RANGE}, passages array<struct<a:bigint,b:bigint,words:bigint>>")


#: The same rows by counting every window, for small tables.
SQL = r"""
WITH h AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sizes(k) AS (VALUES (400), (256)),
w AS (SELECT k, r, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 2 * k)) AS m FROM (SELECT k, r, h, unnest(range(length(h) // 2 - k + 1)) AS p FROM h, sizes WHERE length(h) >= 2 * k)),
t AS (SELECT k, r, p FROM (SELECT *, count(*) OVER (PARTITION BY k, m) AS n FROM w) WHERE n > 1),
f AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY k, r ORDER BY p) <= k THEN 0 ELSE 1 END AS fresh FROM t),
g AS (SELECT k, r, p, sum(fresh) OVER (PARTITION BY k, r ORDER BY p) AS run FROM f),
s AS (SELECT k, r, min(p) AS a, max(p) + k AS b FROM g GROUP BY k, r, run),
removed AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s WHERE k = 400 GROUP BY r),
cuts AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM s WHERE k = 400 UNION ALL SELECT r, max(b), NULL FROM s WHERE k = 400 GROUP BY r),
kept AS (SELECT cuts.r, string_agg(CASE WHEN b IS NULL THEN substr(h, CAST(2 * a + 1 AS BIGINT)) ELSE substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)) END, '' ORDER BY a, b NULLS LAST) AS h FROM cuts JOIN h ON h.r = cuts.r GROUP BY cuts.r),
runs AS (SELECT s.r, len(list_filter(regexp_split_to_array(regexp_replace(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '(20|09|0A|0B|0C|0D)|..', '\1.', 'g'), '(20|09|0A|0B|0C|0D)\.'), lambda x: x <> ''))
  - CASE WHEN a > 0 AND substr(h, CAST(2 * a - 1 AS BIGINT), 2) NOT IN ('20', '09', '0A', '0B', '0C', '0D') AND substr(h, CAST(2 * a + 1 AS BIGINT), 2) NOT IN ('20', '09', '0A', '0B', '0C', '0D') THEN 1 ELSE 0 END
  - CASE WHEN 2 * b < length(h) AND substr(h, CAST(2 * b - 1 AS BIGINT), 2) NOT IN ('20', '09', '0A', '0B', '0C', '0D') AND substr(h, CAST(2 * b + 1 AS BIGINT), 2) NOT IN ('20', '09', '0A', '0B', '0C', '0D') THEN 1 ELSE 0 END AS words FROM s JOIN h ON h.r = s.r WHERE k = 256),
pass AS (SELECT r, count(*) AS n_passages, CAST(sum(words) AS BIGINT) AS passage_words FROM runs WHERE words >= 51 GROUP BY r)
SELECT h.doc_id, length(h.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, h.h))) AS kept_sha256, coalesce(n_passages, 0) AS n_passages, coalesce(passage_words, 0) AS passage_words
FROM h LEFT JOIN removed ON removed.r = h.r LEFT JOIN kept ON kept.r = h.r LEFT JOIN pass ON pass.r = h.r
"""
