"""Language identification: script ranges narrow the languages, Viterbi labels spans of words.

A word's score for a language is the log probability of its letter pairs and triples there. The best
path over the words of a text pays a penalty at each change of language, so that a stray word does not
open a span and a quoted passage does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, small_batches

BUCKETS = 1 << 16
PENALTY = 8.0
STEP = 256
#: First code points of ranges and their scripts (0: other).
_RANGES = [(0, 0), (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0)]
_STARTS, _SCRIPTS = (np.array(x) for x in zip(*_RANGES, strict=True))
N_SCRIPTS = 14
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two features a letter, each letter's word, and each word's start, end and script."""
    none = np.zeros(0, np.int64)
    if not text:
        return np.zeros((0, 2), np.int64), none, none, none, none
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    alpha = _is_letter()
    ok = alpha[code]
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros((0, 2), np.int64), none, none, none, none
    c = np.zeros(len(code) + 2, np.uint64)
    c[1:-1] = np.where(ok, code, 0)
    a, b, d = c[at], c[at + 1], c[at + 2]
    three = mix64(a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77C2B2AE63) + d * np.uint64(0x27D4EB2F165667C5))
    two = mix64(a * np.uint64(0x165667B19E3779F9) + b * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))
    f = np.stack([three & np.uint64(BUCKETS - 1), two & np.uint64(BUCKETS - 1)], axis=1).astype(np.int64)
    new = np.concatenate([[True], np.diff(at) > 1])
    word = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    start, end = at[first], at[np.append(first[1:], len(at)) - 1] + 1
    script = _SCRIPTS[np.searchsorted(_STARTS, code[start], "right") - 1]
    return f, word, start, end, script


class Model:
    """Log probabilities of the letter features in each language, and the scripts it is written in."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        n = len(self.langs)
        counts, scripts = np.zeros((BUCKETS, max(n, 1))), np.zeros((N_SCRIPTS, max(n, 1)))
        place = {x: i for i, x in enumerate(self.langs)}
        for lang, f, k in rows:
            if f < BUCKETS:
                counts[f, place[lang]] += k
            else:
                scripts[f - BUCKETS, place[lang]] += k
        self.logp = (np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        allowed = share >= 0.01
        allowed[~allowed.any(axis=1)] = True
        self.script_cost = np.where(allowed, 0, -40.0).astype(np.float32)

    def word_scores(self, f: np.ndarray, word: np.ndarray, script: np.ndarray) -> np.ndarray:
        s = self.logp[f[:, 0]] + self.logp[f[:, 1]]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.add.reduceat(s, first, axis=0) + self.script_cost[script]


#: Cells of back pointers or of start-by-end tables that are held at once.
_CELLS = 4 << 20


def _steps(v: np.ndarray, x: np.ndarray, penalty: float, back: np.ndarray | None = None) -> np.ndarray:
    """Best scores by the last label, ``STEP`` words on; ``back`` gets each word's label before."""
    own = np.arange(v.shape[-1], dtype=np.uint16)
    for t in range(STEP):
        best = v.max(axis=-1, keepdims=True) - penalty
        if back is not None:
            back[t] = np.where(v >= best, own, v.argmax(axis=-1).astype(np.uint16)[..., None])
        v = np.maximum(v, best) + (x[:, t, None, :] if v.ndim == 3 else x[:, t])
    return v


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best label paths of several texts.

    Steps run over all pieces of ``STEP`` words at once. A first pass finds each piece's best score from
    every start label to every end label; joined over the pieces of a text they tell each piece's start,
    and a second pass from there keeps the labels. Both passes go by blocks of pieces.
    """
    langs = scores[0].shape[1]
    pieces = [-(-len(x) // STEP) for x in scores]
    x = np.zeros((sum(pieces), STEP, langs), np.float32)
    at = 0
    for s, k in zip(scores, pieces, strict=True):
        x[at : at + k].reshape(-1, langs)[: len(s)] = s
        at += k
    n = len(x)
    v = np.empty((n, langs, langs), np.float32)
    block = max(1, _CELLS // (langs * langs))
    for i in range(0, n, block):
        begin = np.full((min(block, n - i), langs, langs), -np.inf, np.float32)
        begin[:, np.arange(langs), np.arange(langs)] = 0
        v[i : i + block] = _steps(begin, x[i : i + block], penalty)
    ends, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for k in pieces:
        a, froms = np.zeros(langs), []
        for c in range(at, at + k):
            total = a[:, None] + v[c]
            froms.append(total.argmax(axis=0))
            a = total.max(axis=0)
        state = int(a.argmax())
        for c in range(at + k - 1, at - 1, -1):
            ends[c] = state
            starts[c] = state = int(froms[c - at][state])
        at += k
    path = np.zeros((n, STEP), np.uint16)
    block = max(1, _CELLS // (langs * STEP))
    for i in range(0, n, block):
        m = min(block, n - i)
        begin = np.full((m, langs), -np.inf, np.float32)
        begin[np.arange(m), starts[i : i + m]] = 0
        back = np.zeros((STEP, m, langs), np.uint16)
        _steps(begin, x[i : i + m], penalty, back)
        state = ends[i : i + m].copy()
        for t in range(STEP - 1, -1, -1):
            path[i : i + m, t] = state
            state = back[t, np.arange(m), state]
    out, at = [], 0
    for s, k in zip(scores, pieces, strict=True):
        out.append(path[at : at + k].ravel()[: len(s)])
        at += k
    return out


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            f, _, _, _, script = features(text.as_py())
            if len(f):
                t = total.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                np.add.at(t, f.ravel(), 1)
                np.add.at(t, BUCKETS + script, 1)
    rows = [(k, np.flatnonzero(t), t) for k, t in sorted(total.items())]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, at, _ in rows for _ in at], pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *[at for _, at, _ in rows]])), pa.array(np.concatenate([np.zeros(0, np.int64), *[t[at] for _, at, t in rows]]))],
        ["lang", "f", "n"],
    )


def train(docs: DataFrame) -> Model:
    """A model from the rows with text and lang; its size is bounded by the languages times BUCKETS."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    got = rows.mapInArrow(_count, "lang string, f bigint, n bigint").groupBy("lang", "f").agg(F.sum("n").alias("n")).collect()
    return Model([(r.lang, r.f, r.n) for r in got])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _predict(model: Model, penalty: float):
    def label(texts):
        got = [features(t) for t in texts]
        todo = [i for i, g in enumerate(got) if len(g[0]) and model.langs]
        out = [("und", 0.0, [])] * len(texts)
        if not todo:
            return out
        paths = viterbi([model.word_scores(got[i][0], got[i][1], got[i][4]) for i in todo], penalty)
        for i, p in zip(todo, paths, strict=True):
            _, _, start, end, _ = got[i]
            mass = np.bincount(p, weights=end - start, minlength=len(model.langs))
            cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            last = np.append(cut[1:], len(p)) - 1
            spans = [{"start": int(start[a]), "end": int(end[z]), "lang": model.langs[p[a]]} for a, z in zip(cut, last, strict=True)]
            out[i] = (model.langs[int(mass.argmax())], float(mass.max() / mass.sum()), spans)
        return out

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                got = label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], _SPANS)],
                    ["doc_id", "held_out", "lang_pred", "score", "spans"],
                )
        give_back()

    return run


def identify(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (share of letters in that language), spans.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out of training. A text without a letter, a
    null text, and every text where nothing could be learned, get `und` and 0. Ties go to the language
    that sorts first. Very long texts are labelled whole, repeated rows get repeated results, and an empty
    table gives an empty result; other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs.where(~held))
    return docs.select(F.col("doc_id").cast("bigint"), "text", held.alias("held_out")).mapInArrow(
        _predict(model, penalty), "doc_id bigint, held_out boolean, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    )
