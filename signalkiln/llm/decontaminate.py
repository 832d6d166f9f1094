"""Benchmark decontamination: rare word n-gram seeds, then Smith-Waterman alignment.

An alignment that scores enough holds at least ``least_grams`` pairs of neighbouring words of its item.
Of an item's pairs that the corpus holds, all but the ``least_grams - 1`` most frequent are its seeds, so
every such alignment has a seed. A document with a seed is looked at stretch by stretch, and where
enough words and pairs of the item stand close together it is aligned with the item word by word.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches

MIN_SCORE = 0.6
#: Items handled in one pass over the documents; more items take more passes.
BLOCK = 20_000
_WORD = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _WORD(text.lower()) if text else []


def least_grams(n: int, min_score: float) -> tuple[int, int]:
    """(width, count): any alignment of ``min_score`` with an item of n words holds so many of its grams of so many words.

    With m matches and e other steps 2 * m - e >= 2 * min_score * n. The matches lie in e + 1 runs at most,
    so m - e - 1 >= (2 * min_score - 1) * n - 1 neighbours match. Where that is not positive, single words count.
    """
    pairs = math.ceil((2 * min_score - 1) * n - 1 - 1e-9)
    return (2, pairs) if pairs > 0 else (1, max(1, math.ceil(min_score * n - 1e-9)))


class Items:
    """Word codes and grams of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], min_score: float = MIN_SCORE):
        self.min_score = min_score
        self.vocab: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for k, text in rows:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            if w:
                self.ids.append(k)
                self.words.append(np.array(w, np.int64))
        self.base = len(self.vocab) + 1
        self.least = [least_grams(len(w), min_score) for w in self.words]
        self.widths = sorted({n for n, _ in self.least})
        self.fewest = min((n for _, n in self.least), default=1)
        codes = [self.grams(w, n) for w, (n, _) in zip(self.words, self.least, strict=True)]
        self.all = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
        self.at = [np.searchsorted(self.all, c) for c in codes]
        self.first, self.owner = np.zeros(len(self.all) + 1, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(x, 0) for x in words_of(text)], np.int64)

    def grams(self, w: np.ndarray, width: int) -> np.ndarray:
        """Codes of the single words or pairs; 0 where a word is of no item."""
        return w if width == 1 else np.where((w[:-1] > 0) & (w[1:] > 0), w[:-1] * self.base + w[1:], 0)

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the items' grams among a document's words, and their numbers in ``all``."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.widths:
            g = self.grams(w, n)
            at = np.minimum(np.searchsorted(self.all, g), len(self.all) - 1)
            p = np.flatnonzero(self.all[at] == g)
            places.append(p)
            numbers.append(at[p])
        return np.concatenate(places), np.concatenate(numbers)

    def choose(self, counts: np.ndarray) -> None:
        """Seeds by the corpus counts of ``all``: for each gram the items of which it is one."""
        pairs = [np.zeros((0, 2), np.int64)]
        for k, (at, (_, least)) in enumerate(zip(self.at, self.least, strict=True)):
            held = at[counts[at] > 0]
            seeds = held[np.argsort(counts[held], kind="stable")][: max(len(held) - least + 1, 0)]
            pairs.append(np.stack([seeds, np.full(len(seeds), k)], axis=1))
        found = np.concatenate(pairs)
        found = found[np.argsort(found[:, 0], kind="stable")]
        self.first = np.searchsorted(found[:, 0], np.arange(len(self.all) + 1))
        self.owner = found[:, 1]


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, other: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local score of a against b, and the start (approximate) and end of its stretch of b."""
    cols = np.arange(1, len(b) + 1)
    row, best, end = np.zeros(len(b) + 1), 0, 0
    begin = np.zeros(len(b) + 1, np.int64) + np.arange(len(b) + 1)
    start = 0
    for x in a:
        step = np.where(b == x, match, other)
        diag, up = row[:-1] + step, row[1:] + gap
        c = np.maximum(np.maximum(diag, up), 0)
        origin = np.where(c == 0, cols, np.where(diag >= up, begin[:-1], begin[1:]))
        lifted = np.maximum.accumulate(c - gap * cols)
        new = lifted + gap * cols
        src = np.maximum.accumulate(np.where(c - gap * cols == lifted, np.arange(len(b)), 0))
        row = np.concatenate([[0], np.maximum(new, 0)])
        begin = np.concatenate([[0], np.where(new > 0, origin[src], cols)])
        j = int(row.argmax())
        if row[j] > best:
            best, end, start = int(row[j]), j, int(begin[j])
    return best, start, end


def _stretches(items: Items, k: int, w: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a document that hold every alignment of ``min_score`` with an item: (first, end) of its words."""
    item, (_, least) = items.words[k], items.least[k]
    own = np.isin(numbers, items.at[k])
    if own.sum() < least:
        return []
    # an alignment spans m + e words at most, and m <= n
    span = math.floor((3 - 2 * items.min_score) * len(item) + 1e-9)
    grams, known = np.zeros(len(w) + 1, np.int64), np.zeros(len(w) + 1, np.int64)
    grams[places[own] + 1] = 1
    known[1:] = np.isin(w, item)
    grams, known = grams.cumsum(), known.cumsum()
    end = np.minimum(np.arange(len(w)) + span, len(w))
    ok = np.flatnonzero((known[end] - known[:-1] >= items.min_score * len(item) - 1e-9) & (grams[end] - grams[:-1] >= least))
    if not len(ok):
        return []
    cut = np.flatnonzero(np.diff(ok) > span) + 1
    return [(int(x[0]), int(end[x[-1]])) for x in np.split(ok, cut)]


def align(items: Items, w: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(item_id, score, first word, end word, seeds) of the items that a document's words hold."""
    places, numbers = items.hits(w)
    n_seeds = items.first[numbers + 1] - items.first[numbers]
    some = np.repeat(items.first[numbers] - np.cumsum(n_seeds) + n_seeds, n_seeds) + np.arange(n_seeds.sum())
    out = []
    for k, seeds in zip(*(x.tolist() for x in np.unique(items.owner[some], return_counts=True)), strict=True):
        item = items.words[k]
        best = None
        for a, b in _stretches(items, k, w, places, numbers):
            score, i, j = smith_waterman(item, w[a:b])
            if score >= items.min_score * 2 * len(item) - 1e-9 and (best is None or score > best[0]):
                best = (score, a + i, a + j)
        if best:
            out.append((items.ids[k], best[0] / (2 * len(item)), best[1], best[2], seeds))
    return out


def _scan(shared):
    """Two kinds of rows: (gram, n), a task's counts of the items' grams, and (doc_id, words) of the documents that have enough of them."""

    def run(batches):
        items = shared.value
        total = np.zeros(len(items.all), np.int64)
        names, words = ["gram", "n", "doc_id", "words"], pa.list_(pa.int32())
        for b in batches:
            some, held = [], []
            for i, text in enumerate(b.column(1)):
                w = items.codes(text.as_py())
                _, numbers = items.hits(w)
                np.add.at(total, numbers, 1)
                if len(numbers) >= items.fewest:
                    some.append(i)
                    held.append(w.astype(np.int32))
            m = len(some)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, b.column(0).take(pa.array(some, pa.int64())), pa.array(held, words)], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), words)], names)
        give_back()

    return run


def _align(shared):
    def run(batches):
        items = shared.value
        for b in batches:
            rows = []
            for doc, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend((doc, *x) for x in align(items, w.values.to_numpy().astype(np.int64)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])
        give_back()

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, n_seeds): items that a document holds, whole or edited.

    score is the alignment score as a share of an unedited copy's. Null and empty texts and items hold
    nothing. The benchmark is read in blocks of ``BLOCK`` items, so what is broadcast is bounded;
    every document is searched for every item; the first pass counts the items' grams and sets aside, as word
    codes, the documents that hold enough of them. Repeated rows give repeated results, an empty table gives an
    empty one. Very long texts are searched whole; of an item's several places the best, of ties the first, is
    reported. Other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "items")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = benchmark.where("text is not null and item_id is not null")
    blocks = max(1, -(-rows.count() // BLOCK))
    kind = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint, n_seeds bigint"
    out = None
    for i in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        items = Items([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], min_score)
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)
        scanned = scratch.write(base.mapInArrow(_scan(shared), "gram bigint, n bigint, doc_id bigint, words array<int>"), "scanned")
        counts = np.zeros(len(items.all), np.int64)
        for r in scanned.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            counts[r.gram] = r.n
        items.choose(counts)
        shared = docs.sparkSession.sparkContext.broadcast(items)  # with its seeds
        found = scanned.where("words is not null").select("doc_id", "words").mapInArrow(_align(shared), kind)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], kind) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns as they are; rows without an id stay."""
    gone = Scratch(docs.sparkSession, "leaks").write(find_leaks(docs, benchmark, min_score).select("doc_id").distinct(), "leaks")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
