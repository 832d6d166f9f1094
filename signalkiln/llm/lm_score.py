"""Class-based bigram language model: exchange clustering, class transitions and word emissions.

Every word has a class. A first clustering on the driver takes the most frequent words as symbols of their
own and all others as symbols by their ending, so its table of symbol bigrams is bounded whatever the
vocabulary. Rounds of exchange over the whole vocabulary follow: each word of the training texts, however
rare, moves by itself to the class that its own neighbours favour. Class bigrams and the words of a class
are then counted anew over all texts. Frequent words are placed by broadcast and the others by a join.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches

#: Words whose counts are broadcast, and of these the words that are symbols of their own.
FREQUENT, SYMBOLS = 50_000, 1000
#: The id of all other words in a coded text.
OTHER = 65_535
#: Symbols that stand at first for all words with an ending (by a hash of their last bytes); words that the
#: training texts lack have no neighbours there and stay in the class of their ending.
ENDINGS = 512
#: Fewest and most classes.
CLASSES = (32, 96)
#: Bytes up to which a word can be broadcast; longer ones are joined.
MAX_WORD = 64
#: Tokens whose bigrams are counted at once.
CHUNK = 2_000_000
#: Rounds over the whole vocabulary end with one that gains less than this share of what all gained.
LEAST = 0.1
#: Groups (by a hash of the word) in which the words of a round move one behind another, and their bounds: as
#: many words at once as moved before, so that words with equal prospects do not all leave for one empty class.
GROUPS, BOUNDS = 16, (0, 1, 2, 4, 8, 16)
#: Blocks (by number) of frequent words whose neighbours are summed together.
BLOCKS = 256
#: Occurrences of other words in a bucket, on average.
OCCURRENCES = 200_000


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def classes_for(vocabulary: int) -> int:
    """The number of classes: a sixteenth of the square root of the vocabulary, within bounds."""
    return int(min(max(vocabulary**0.5 / 16, CLASSES[0]), CLASSES[1]))


class Symbols(dict):
    """Symbols of words: the frequent ones by number, the others by ending behind them."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.own = len(words)
        #: all symbols, the end of a text last
        self.size = self.own + ENDINGS + 1

    def __missing__(self, word: bytes) -> int:
        return self.own + ending(word)


def tokens(text: str | None) -> list[bytes]:
    """Words between white space with A-Z lower-cased, as bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _text(w: bytes) -> str:
    return w.decode("utf-8", "replace")


def _count(batches):
    """(word, ending, n) of each batch."""
    for b in batches:
        c: Counter = Counter()
        for t in b.column(0):
            c.update(tokens(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([_text(w) for w in c], pa.string()), pa.array([ending(w) for w in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["word", "ending", "n"])
    give_back()


def _bigrams(words: list[bytes]):
    """Counts of symbol bigrams of a task."""

    def run(batches):
        symbols = Symbols(words)
        size, get = symbols.size, symbols.__getitem__
        total = np.zeros(size * size, np.int64)
        ids: list[int] = []

        def add() -> None:
            nonlocal total
            a = np.array(ids, np.int64)
            ids.clear()
            if len(a):
                total += np.bincount(np.concatenate([[size - 1], a[:-1]]) * size + a, minlength=size * size)

        for b in batches:
            for t in b.column(0):
                ids.extend(map(get, tokens(t.as_py())))
                ids.append(size - 1)
                if len(ids) >= CHUNK:
                    add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])
        del total
        give_back()

    return run


def exchange(m: np.ndarray, classes: int, fixed: int, least: float = 1e-4) -> np.ndarray:
    """Classes of the symbols of a bigram table, the last ``fixed`` in classes of their own.

    Each symbol moves to the class that raises the likelihood of the class bigrams most, until none moves
    or a round gains less than the share ``least`` of what all rounds have gained.
    """
    s = len(m)
    n = s - fixed
    k = min(classes, max(n, 1)) + fixed
    cls = np.concatenate([np.arange(n) % max(k - fixed, 1), np.arange(k - fixed, k)]).astype(np.int64)

    one = np.zeros((s, k))
    one[np.arange(s), cls] = 1
    g = one.T @ m @ one
    weight = m.sum(axis=0)
    size = weight @ one
    rows = [(at := np.flatnonzero(m[w]), m[w, at]) for w in range(n)]
    cols = [(at := np.flatnonzero(m[:, w]), m[at, w]) for w in range(n)]
    d, f, total = np.arange(k), xlogx(g), 0.0
    while True:
        moved, won = 0, 0.0
        for w in range(n):
            old, own = cls[w], m[w, w]
            r = np.bincount(cls[rows[w][0]], weights=rows[w][1], minlength=k)
            q = np.bincount(cls[cols[w][0]], weights=cols[w][1], minlength=k)
            r[old] -= own
            q[old] -= own
            g[old] -= r
            g[:, old] -= q
            g[old, old] -= own
            size[old] -= weight[w]
            f[old], f[:, old] = xlogx(g[old]), xlogx(g[:, old])
            to, by = np.flatnonzero(r), np.flatnonzero(q)  # only these cells change
            right = xlogx(g[:, to] + r[to]) - f[:, to]
            under = xlogx(g[by] + q[by, None]) - f[by]
            corner = xlogx(g[d, d] + r + q + own) - f[d, d]
            twice = np.zeros(k)
            twice[to] += right[to, np.arange(len(to))]
            twice[by] += under[np.arange(len(by)), by]
            gain = right.sum(axis=1) + under.sum(axis=0) - twice + corner - 2 * (xlogx(size + weight[w]) - xlogx(size))
            gain[k - fixed :] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else int(old)
            g[new] += r
            g[:, new] += q
            g[new, new] += own
            size[new] += weight[w]
            f[new], f[:, new] = xlogx(g[new]), xlogx(g[:, new])
            cls[w] = new
            moved += new != old
            won += gain[new] - gain[old]
        total += won
        if not moved or won <= least * total:
            return cls


class Scorer:
    """Words that are broadcast, and the model of the first clustering; other words lack their own counts here.

    The probability of a word is that of its class behind the class before, by counts smoothed with the
    classes' own shares, times (c + 1) / (class tokens + class words + 1).
    """

    def __init__(self, frequent: list[tuple[str, int]], m: np.ndarray, ending_tokens: np.ndarray, ending_words: np.ndarray, n: int, v: int, docs: int):
        words = [w.encode("utf-8", "surrogatepass") for w, _ in frequent]
        own = len(m) - ENDINGS - 1
        self.words = words
        self.index = {w: i for i, w in enumerate(words)}
        c = np.array([x for _, x in frequent], float)
        self.counts = c
        self.log_c1 = np.log10(c + 1) if len(c) else np.zeros(0)
        self.once = c <= 1
        self.end_log = np.log10(docs + 1)
        self.end_known = int(docs > 0)
        cls = exchange(m.astype(float), classes_for(v), 1)
        k = int(cls.max()) + 1
        one = np.zeros((len(m), k))
        one[np.arange(len(m)), cls] = 1
        self.g = one.T @ m @ one
        self.log_a = transitions(self.g)
        self.end = k - 1
        self.of_ending = cls[own : own + ENDINGS]
        self.word_class = np.array([cls[i] if i < own else self.of_ending[ending(w)] for i, w in enumerate(words)], np.int64)
        # tokens and words of each class: the symbols of their own, and the rest of each ending
        tokens_, words_ = ending_tokens.astype(float), ending_words.astype(float)
        for i, w in enumerate(words[:own]):
            tokens_[ending(w)] -= c[i]
            words_[ending(w)] -= 1
        mass = np.bincount(cls[:own], weights=c[:own] + 1, minlength=k) + np.bincount(self.of_ending, weights=tokens_ + words_, minlength=k) + 1
        self.log_mass = np.log10(mass)
        self.n, self.log_all = n, np.log10(n + 1 * (v + 1))

    def code(self, text: str | None) -> tuple:
        """n_tokens, known, once, base and emission of the frequent words, ids of all, and of the others: the
        number in ``words`` of each, the different words, how often each occurs, and the classes of their endings."""
        t = tokens(text)
        get = self.index.get
        at = [get(w, OTHER) for w in t]
        number: dict[bytes, int] = {}
        others = np.array([number.setdefault(w, len(number)) for w, i in zip(t, at, strict=True) if i == OTHER], np.int32)
        ids = np.array(at, np.uint16)
        known = ids[ids != OTHER]
        emission = float(self.log_c1[known].sum())
        own = self.of_ending[[ending(w) for w in number]] if number else np.zeros(0)
        return (
            len(t) + 1, len(known) + self.end_known, int(self.once[known].sum()), emission + self.end_log - self.log_all * (len(t) + 1), emission,
            ids.tobytes(), others.tobytes(), [_text(w) for w in number], np.bincount(others, minlength=len(number)), own.astype(np.uint8).tobytes(),
        )


def transitions(g: np.ndarray) -> np.ndarray:
    """log10 probabilities of a class behind a class."""
    uni = (g.sum(axis=0) + 1) / (g.sum() + len(g))
    return np.log10((g + 5 * uni[None, :]) / (g.sum(axis=1, keepdims=True) + 5))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def fit(g: np.ndarray) -> float:
    """What the likelihood of class bigrams owes to the classes."""
    return float(xlogx(g).sum() - 2 * xlogx(g.sum(axis=0)).sum())


_PARTS = [
    ("n_tokens", pa.int64()), ("known", pa.int64()), ("once", pa.int64()), ("base", pa.float64()), ("emission", pa.float64()),
    ("ids", pa.binary()), ("others", pa.binary()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("own", pa.binary()),
]
_PARTS_KIND = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, once bigint, base double, emission double, ids binary, others binary, words array<string>, n array<bigint>, own binary"


def _code(shared):
    """Coded texts."""

    def run(batches):
        scorer = shared.value
        for b in batches:
            got = [scorer.code(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([g[i] for g in got], k) for i, (_, k) in enumerate(_PARTS))], ["doc_id", "held_out", *(name for name, _ in _PARTS)])
        give_back()

    return run


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of binaries one behind another, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


class Placed:
    """A batch of coded texts with the classes of all tokens, each text behind an end and before one."""

    def __init__(self, ids, others, own, classes: np.ndarray, end: int):
        self.ids, n = _joined(ids, np.uint16)
        number, n_others = _joined(others, np.int32)
        own, n_own = _joined(own, np.uint8)
        #: the numbers of all other words of the batch, by token
        self.number = number + np.repeat(np.cumsum(n_own) - n_own, n_others)
        self.own, self.is_other = own, self.ids == OTHER
        cls = np.append(classes, np.zeros(OTHER + 1 - len(classes), np.uint8))[self.ids]
        cls[self.is_other] = own[self.number]
        self.at = np.arange(len(cls)) + np.repeat(np.arange(len(n)), n) + 1
        self.cls = np.full(len(cls) + len(n) + 1, end, np.uint8)
        self.cls[self.at] = cls
        #: where each text's tokens start, and the end behind them
        self.end_at = np.cumsum(n + 1)
        self.start = self.end_at - n


class Best:
    """The class of each word that raises the likelihood most, by class bigrams ``g``, where the others stay in theirs.

    Words stay that no move helps; none moves to the last class, the end of a text. Of classes that are
    equally good, as all empty ones are, the number ``pick`` of a word chooses one.
    """

    def __init__(self, g: np.ndarray):
        self.k = len(g)
        self.cells, self.size = np.vstack([g, g.T]), g.sum(axis=0)  # of a class of neighbours (rows) with a word's class
        self.base = xlogx(self.cells)
        self.few = np.concatenate([xlogx(self.cells + n) - self.base for n in range(9)])

    def gains(self, at: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What neighbours in each class (without moves away) add to the likelihood of class bigrams."""
        out = np.zeros((len(first) - 1, self.k))
        i = 0
        while i < len(out):
            z = max(int(np.searchsorted(first, first[i] + 20_000, "right")) - 1, i + 1)
            a, c = at[first[i] : first[z]], n[first[i] : first[z]]
            part = self.few[np.where(c < 9, c, 0) * (2 * self.k) + a]
            many = np.flatnonzero(c >= 9)
            part[many] = xlogx(self.cells[a[many]] + c[many, None]) - self.base[a[many]]
            some = np.flatnonzero(np.diff(first[i : z + 1]))
            if len(some):
                out[i + some] = np.add.reduceat(part, first[i + some] - first[i], axis=0)
            i = z
        return out

    def __call__(self, at: np.ndarray, n: np.ndarray, first: np.ndarray, row: np.ndarray, old: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """``at``, ``n``: different sets of neighbours (classes behind a word above those before it, and how often),
        set i from first[i] on; ``row``: the set of each word."""
        k, size = self.k, self.size
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.bincount(of, weights=n * (at < k), minlength=len(first) - 1)
        gain = self.gains(at, n, first)
        different, same = np.unique(weight, return_inverse=True)
        gain -= (2 * (xlogx(size + different[:, None]) - xlogx(size)))[same]
        gain[:, k - 1] = -np.inf
        top = gain.max(axis=1)
        equal = gain >= top[:, None] - 1e-9
        one = equal.sum(axis=1) == 1
        # words with the same neighbours in the same class are alike; there their own counts are among those of the class
        alike, which = np.unique(row * k + old, return_inverse=True)
        r, o = np.divmod(alike, k)
        many = np.diff(first)[r]
        e = np.arange(many.sum()) + np.repeat(first[r] - (np.cumsum(many) - many), many)
        owner = np.repeat(np.arange(len(r)), many)
        cell = self.cells[at[e], o[owner]]
        stay = np.bincount(owner, weights=xlogx(cell) - xlogx(np.maximum(cell - n[e], 0)), minlength=len(r)) - 2 * (xlogx(size[o]) - xlogx(np.maximum(size[o] - weight[r], 0)))
        out = np.where(top[r] > stay + 1e-9, equal.argmax(axis=1)[r], o)[which]
        rest = np.flatnonzero(~(one[r] & ~equal[r, o])[which])
        for i in range(0, len(rest), 5000):
            w = rest[i : i + 5000]
            all_, here = gain[row[w]], stay[which[w]]
            all_[np.arange(len(w)), old[w]] = here
            all_[:, k - 1] = -np.inf
            best = all_.max(axis=1)
            ties = all_ >= best[:, None] - 1e-9
            new = (np.cumsum(ties, axis=1) > (pick[w] % ties.sum(axis=1))[:, None]).argmax(axis=1)
            out[w] = np.where(best > here + 1e-9, new, old[w])
        return out


def best_classes(near: np.ndarray, old: np.ndarray, g: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """``Best`` for words with a row each of ``near``, the counts of the classes before and then behind them."""
    row, at = np.nonzero(near)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(near)))])
    return Best(g)(at, near[row, at], first, np.arange(len(near)), old, pick)


#: Entries of a block (a frequent word above a word or class beside it, and how often) and of a word's neighbours.
_BLOCK, _NEAR = np.dtype([("at", "<u4"), ("n", "<u4")]), np.dtype([("at", "<u2"), ("n", "<u4")])
#: A neighbour of a word (by the key of the word) in a class.
_MESSAGE = np.dtype([("key", "<i8"), ("at", "<u2")])
#: What a row of the words' table is: changes of class bigrams, frequent words, neighbours of a block of frequent
#: words, other words of a bucket (by their keys), neighbours that these have among each other, or their texts.
CHANGE, NUMBERED, BLOCK, WORDS, MESSAGES, TEXTS = range(6)
#: Arrays by word (keys, own class, hash, number of occurrences or neighbours, bytes of texts) and by occurrence.
_ARRAYS = {"keys": "<i8", "own": "u1", "hash": "<u4", "n": "<u4", "codes": "<u4", "left": "<i8", "right": "<i8"}
_TOLD = "kind int, key bigint, class int, " + ", ".join(f"{x} binary" for x in _ARRAYS) + ", size binary, texts binary, h bigint"
_FOUND = "step int, key bigint, " + ", ".join(f"{x} binary" for x in _ARRAYS) + ", near binary, many binary, h bigint"


def _rows(schema: str, count: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``count`` rows of ``schema``, null or repeated where no array is given."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, arrays = [], []
    for name, t in (x.split() for x in schema.split(", ")):
        v = columns.get(name)
        names.append(name)
        arrays.append(pa.nulls(count, types[t]) if v is None else v if isinstance(v, pa.Array) else pa.array(np.broadcast_to(np.asarray(v, {"int": np.int32, "bigint": np.int64}[t]), count)))
    return pa.RecordBatch.from_arrays(arrays, names)


def _spans(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where the values of a column of binaries start and end, and their bytes."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int32), pa.py_buffer(b"")
    return np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1], data if data is not None else pa.py_buffer(b"")


def _cut(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of binaries one behind another, and where each row's start and end."""
    offsets, data = _spans(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets.astype(np.int64) - offsets[0]) // size


def _one(x: np.ndarray) -> pa.Array:
    """A column of one binary."""
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


class Words:
    """Words of a bucket: keys, own classes, hashes, numbers of occurrences, and of each occurrence the frequent words
    (or ``OTHER``) before and behind it; ``left`` and ``right`` have the keys of the other words there."""

    def __init__(self, **arrays: np.ndarray):
        self.arrays = arrays
        self.__dict__.update(arrays)

    @classmethod
    def read(cls, row: dict) -> "Words":
        return cls(**{x: np.frombuffer(row[x], t) for x, t in _ARRAYS.items()})

    def columns(self) -> dict:
        return {x: _one(v.astype(_ARRAYS[x], copy=False)) for x, v in self.arrays.items()}

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """How many other words each word has before and behind it."""
        of = np.repeat(np.arange(len(self.keys)), self.n)
        return tuple(np.bincount(of[code == OTHER], minlength=len(self.keys)) for code in (self.codes & 0xFFFF, self.codes >> 16))

    def take(self, order: np.ndarray) -> "Words":
        """The words of these numbers."""
        out = {x: self.arrays[x][order] for x in ("keys", "own", "hash", "n")}
        for x, n in zip(("codes", "left", "right"), (self.n, *self.beside()), strict=True):
            out[x] = self.arrays[x][_ranges(n, order)]
        return Words(**out)


def _ranges(n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the values of some rows, where all rows have ``n`` values each."""
    n = n.astype(np.int64)
    first, many = (np.cumsum(n) - n)[order], n[order]
    return np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)


def _together(rows: list[dict]) -> Words:
    """The words of several rows in the order of their keys."""
    parts = [Words.read(r) for r in rows]
    w = Words(**{x: np.concatenate([p.arrays[x] for p in parts]) for x in _ARRAYS})
    return w.take(np.lexsort((w.hash, w.keys)))


def _buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by bucket, the buckets, and where each starts and ends."""
    of = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    some, first = np.unique(of[order], return_index=True)
    return order, some, np.append(first, len(keys))


def _blocks(at: np.ndarray, n: np.ndarray, side: int):
    """Rows of blocks from entries with a frequent word each."""
    if not len(at):
        return
    block = (at >> 16) % BLOCKS
    order = np.argsort(block, kind="stable")
    x = np.empty(len(at), _BLOCK)
    x["at"], x["n"] = at[order], n[order]
    stop = np.searchsorted(block[order], np.arange(BLOCKS + 1))
    some = np.flatnonzero(np.diff(stop))
    yield _rows(_TOLD, len(some), kind=BLOCK, key=some, **{"class": side}, codes=_cut(np.append(stop[some], stop[-1]) * _BLOCK.itemsize, x.tobytes()))


def _adjacent(end: int, buckets: int):
    """Neighbours of words in texts: of the frequent ones by blocks, of the others as pairs of frequent words
    (or ``OTHER``) before and behind them with the keys of other words there."""

    def run(batches):
        pairs: list[np.ndarray] = []
        held: list[tuple] = []
        waiting = occurrences = 0

        def frequent():
            nonlocal waiting
            p, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            pairs.clear()
            waiting = 0
            yield from _blocks(p, n, 1)
            yield from _blocks((p << 16) | (p >> 16), n, 0)

        def others():
            nonlocal occurrences
            if not held:
                return
            words = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
            index = words.indices.to_numpy()
            keys, own = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            base = np.cumsum([0, *(len(x[1]) for x in held)])
            of = index[np.concatenate([x[3] + b for x, b in zip(held, base, strict=False)])]
            order = np.argsort(of, kind="stable")
            near = np.concatenate([x[4] for x in held])[order]
            beside = np.concatenate([x[5] for x in held])[order]
            held.clear()
            occurrences = 0
            first = np.zeros(len(words.dictionary), np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            sides = [beside[near[:, side] == OTHER, side] for side in (0, 1)]
            h = np.array([crc32(w.encode()) for w in words.dictionary.to_pylist()], np.uint32)
            w = Words(keys=keys[first], own=own[first], hash=h, n=np.bincount(of, minlength=len(first)), codes=near.view("<u4")[:, 0], left=sides[0], right=sides[1])
            order, some, stop = _buckets(w.keys, buckets)
            w, texts = w.take(order), words.dictionary.take(pa.array(order))
            yield from _by_bucket(w, some, stop, lambda a, z: _texts(texts[a:z]))

        for b in batches:
            ids, n = _joined(b.column(0), np.uint16)
            number, n_others = _joined(b.column(1), np.int32)
            own, n_own = _joined(b.column(3), np.uint8)
            number = number + np.repeat(np.cumsum(n_own) - n_own, n_others)
            keys = b.column(4).flatten().to_numpy()
            at = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n) + 1
            code = np.full(len(ids) + len(n) + 1, end, np.uint16)
            code[at] = ids
            before, behind = code[:-1], code[1:]
            known = (before != OTHER) & (behind != OTHER)
            pairs.append((before[known].astype(np.uint32) << 16) | behind[known])
            waiting += len(pairs[-1])
            if len(number):
                rare = at[ids == OTHER]
                key = np.zeros(len(code), np.int64)
                key[rare] = keys[number]
                held.append((b.column(2).flatten(), keys, own, number, np.stack([code[rare - 1], code[rare + 1]], axis=1), np.stack([key[rare - 1], key[rare + 1]], axis=1)))
                occurrences += len(number)
            if waiting >= 2 * CHUNK:
                yield from frequent()
            if occurrences >= CHUNK // 4:
                yield from others()
        yield from frequent()
        yield from others()
        give_back()

    return run


def _sum_blocks(table: pa.Table) -> pa.Table:
    """The rows of a block as one of each side."""
    out = []
    side = table.column("class").to_numpy()
    for s in np.unique(side):
        x = np.concatenate([np.frombuffer(c, _BLOCK) for c in table.column("codes").filter(pa.array(side == s)).to_pylist()])
        at, where = np.unique(x["at"], return_inverse=True)
        n = np.bincount(where, weights=x["n"])
        most = 2**32 - 1  # of an entry; larger counts take several
        y = np.empty(int((parts := np.maximum(np.ceil(n / most), 1).astype(np.int64)).sum()), _BLOCK)
        y["at"], y["n"] = np.repeat(at, parts), most
        y["n"][np.cumsum(parts) - 1] = n - most * (parts - 1)
        out.append(_rows(_TOLD, 1, kind=BLOCK, key=table.column("key")[0].as_py(), **{"class": int(s)}, codes=pa.array([y.tobytes()], pa.binary())))
    return pa.Table.from_batches(out)


def _texts(words: pa.Array) -> dict:
    """Strings as one binary, and their lengths."""
    b = words.cast(pa.binary())
    offsets, data = _spans(b)
    return {"size": _one(np.diff(offsets).astype("<u4")), "texts": _one(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]])}


def _strings(row: dict) -> pa.Array:
    size = np.frombuffer(row["size"], "<u4")
    return _cut(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), row["texts"]).cast(pa.string())


def _by_bucket(w: Words, some: np.ndarray, stop: np.ndarray, more):
    """Rows of words that stand by bucket."""
    ends = {x: np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for x, n in zip(("codes", "left", "right"), (w.n, *w.beside()), strict=True)}
    for bucket, a, z in zip(some.tolist(), stop.tolist(), stop[1:].tolist(), strict=False):
        part = Words(**{x: v[ends[x][a] : ends[x][z]] if x in ends else v[a:z] for x, v in w.arrays.items()})
        yield _rows(_TOLD, 1, kind=WORDS, key=bucket, **part.columns(), **more(a, z))


class Told:
    """Rows of words in their classes, with what their neighbours are told of these."""

    def __init__(self, k: int, buckets: int):
        self.k, self.buckets, self.waiting, self.messages, self.size = k, buckets, [], [], 0

    def rows(self, bucket: int, w: Words, cls: np.ndarray):
        """Words of a bucket in their classes ``cls``."""
        yield _rows(_TOLD, 1, kind=WORDS, key=bucket, **Words(**{**w.arrays, "own": cls}).columns())
        for to, n, above in zip((w.left, w.right), w.beside(), (self.k, 0), strict=True):
            x = np.empty(len(to), _MESSAGE)
            x["key"], x["at"] = to, np.repeat(cls, n) + above
            self.messages.append(x)
            self.size += len(x)
        of = np.repeat(cls, w.n).astype(np.uint32)
        for code, above in ((w.codes & 0xFFFF, self.k), (w.codes >> 16, 0)):
            known = code != OTHER
            self.waiting.append((code[known] << 16) | (of[known] + above).astype(np.uint32))
            self.size += int(known.sum())
        if self.size >= CHUNK:
            yield from self.rest()

    def rest(self):
        if self.size:
            at, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            yield from _blocks(at, n, 2)
            x = np.concatenate(self.messages)
            order, some, stop = _buckets(np.ascontiguousarray(x["key"]), self.buckets)
            yield _rows(_TOLD, len(some), kind=MESSAGES, key=some, codes=_cut(stop * _MESSAGE.itemsize, x[order].tobytes()))
        self.waiting, self.messages, self.size = [], [], 0


def _gather(k: int, buckets: int):
    """The words of a bucket, one behind another by their keys, with their texts in a row of its own."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts = pa.concat_arrays([_strings(r) for r in rows]).dictionary_encode()
        index, m = texts.indices.to_numpy(), len(texts.dictionary)
        parts = [Words.read(r) for r in rows]
        w = Words(**{x: np.concatenate([p.arrays[x] for p in parts]) for x in _ARRAYS})
        first = np.zeros(m, np.int64)
        first[index[::-1]] = np.arange(len(index))[::-1]
        w = w.take(np.argsort(index, kind="stable"))  # rows of one word one behind another
        same = np.sort(index, kind="stable")
        start = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        whole = Words(keys=w.keys[start], own=w.own[start], hash=w.hash[start], n=np.add.reduceat(w.n, start).astype("<u4"), codes=w.codes, left=w.left, right=w.right)
        order = np.lexsort((whole.hash, whole.keys))
        whole = whole.take(order)
        told, key = Told(k, buckets), table.column("key")[0].as_py()
        out = [_rows(_TOLD, 1, kind=TEXTS, key=key, keys=_one(whole.keys), n=_one(whole.n.astype("<u4")), **_texts(texts.dictionary.take(pa.array(order))))]
        return pa.Table.from_batches([*out, *told.rows(key, whole, whole.own), *told.rest()])

    return run


def _found(near: np.ndarray, cls: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of words by class, as entries, and how many entries each word has; ``table`` gets their class bigrams."""
    k = len(table)
    flat = np.flatnonzero(near)
    row, at = np.divmod(flat, 2 * k)
    x = np.empty(len(flat), _NEAR)
    x["at"], x["n"] = at, near[flat]
    before = at < k
    table += np.bincount(at[before] * k + cls[row[before]], weights=near[flat[before]], minlength=k * k).reshape(k, k).astype(np.int64)
    return x, np.bincount(row, minlength=len(cls)).astype("<u4")


def _bigram_rows(table: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    return _rows(_FOUND, len(at), step=-1, key=at, h=table.reshape(-1)[at])


def _steps(h: np.ndarray) -> np.ndarray:
    """The group of words by their hash."""
    return np.searchsorted(BOUNDS, h % GROUPS, "right") - 1


def _near(classes: np.ndarray, k: int):
    """The words of a bucket, by group, with their neighbours by class, and the class bigrams in which they come second."""
    of = np.zeros(OTHER + 1, np.int64)
    of[: len(classes)] = classes

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["key"]
        w = _together([r for r in rows if r["kind"] == WORDS])
        x = np.concatenate([np.zeros(0, _MESSAGE), *(np.frombuffer(r["codes"], _MESSAGE) for r in rows if r["kind"] == MESSAGES)])
        to = np.searchsorted(w.keys, x["key"])
        at = x["at"][order := np.argsort(to, kind="stable")].astype(np.int64)
        to = to[order]
        bigrams, out = np.zeros((k, k), np.int64), []
        groups = _steps(w.hash.astype(np.int64))
        stop = np.concatenate([[0], np.cumsum(w.n, dtype=np.int64)])
        for a in range(0, len(w.keys), 10_000):
            z = min(a + 10_000, len(w.keys))
            codes = w.codes[stop[a] : stop[z]]
            row = np.repeat(np.arange(z - a), w.n[a:z]) * (2 * k)
            before, behind = codes & 0xFFFF, codes >> 16
            p, q = before != OTHER, behind != OTHER
            i, j = np.searchsorted(to, [a, z])
            near = np.bincount(np.concatenate([row[p] + of[before[p]], row[q] + k + of[behind[q]], (to[i:j] - a) * (2 * k) + at[i:j]]), minlength=(z - a) * 2 * k)
            found, many = _found(near, w.own[a:z].astype(np.int64), bigrams)
            for step in range(len(BOUNDS) - 1):
                some = np.flatnonzero(groups[a:z] == step)
                if len(some):
                    out.append(_rows(_FOUND, 1, step=step, key=bucket, **w.take(a + some).columns(), near=_one(found[_ranges(many, some)]), many=_one(many[some])))
        return pa.Table.from_batches([*out, _bigram_rows(bigrams)])

    return run


def _near_frequent(classes: np.ndarray, h: np.ndarray, k: int):
    """The frequent words of a block with their neighbours by class, and the class bigrams in which they come second."""

    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("key")[0].as_py()
        words = np.arange(block, len(classes), BLOCKS)
        near = np.zeros(len(words) * 2 * k, np.int64)
        for side, codes in zip(rows.column("class").to_pylist(), rows.column("codes").to_pylist(), strict=True):
            x = np.frombuffer(codes, _BLOCK)
            beside = (x["at"] & 0xFFFF).astype(np.int64)
            at = beside if side == 2 else classes[beside] + side * k
            near += np.bincount((x["at"] >> 16).astype(np.int64) // BLOCKS * (2 * k) + at, weights=x["n"], minlength=len(near)).astype(np.int64)
        table = np.zeros((k, k), np.int64)
        cls = classes[words]
        found, many = _found(near, cls, table)
        group = np.where(words < len(classes) - 1, _steps(h[words]), -2)  # the end of a text stays
        out = []
        for step in range(len(BOUNDS) - 1):
            some = np.flatnonzero(group == step)
            if len(some):
                w = {"keys": _one(words[some]), "own": _one(cls[some].astype("u1")), "hash": _one(h[words[some]].astype("<u4"))}
                out.append(_rows(_FOUND, 1, step=step, key=block, **w, near=_one(found[_ranges(many, some)]), many=_one(many[some])))
        return pa.Table.from_batches([*out, _bigram_rows(table)])

    return run


def _move(g: np.ndarray, buckets: int):
    """Words in their new classes, with what their neighbours are told, and by how much class bigrams change."""
    k = len(g)

    def run(batches):
        best, told = Best(g), Told(k, buckets)
        change = np.zeros(k * k, np.int64)
        for b in batches:
            for r in b.to_pylist():
                old, h = np.frombuffer(r["own"], "u1").astype(np.int64), np.frombuffer(r["hash"], "<u4").astype(np.int64)
                many = np.frombuffer(r["many"], "<u4").astype(np.int64)
                sets = _cut(np.concatenate([[0], np.cumsum(many)]) * _NEAR.itemsize, r["near"]).dictionary_encode()
                x, first = _values(sets.dictionary, _NEAR)
                at, n, row = x["at"].astype(np.int64), x["n"].astype(np.int64), sets.indices.to_numpy().astype(np.int64)
                new = best(at, n, first, row, old, h // GROUPS)
                moved = np.flatnonzero(new != old)
                e, many = _ranges(np.diff(first), row[moved]), many[moved]
                before = at[e] < k
                for c, sign in ((old, -1), (new, 1)):
                    c = np.repeat(c[moved], many)
                    change += np.bincount(np.where(before, at[e] * k + c, c * k + at[e] - k), weights=sign * n[e], minlength=k * k).astype(np.int64)
                if r["codes"] is None:
                    yield _rows(_TOLD, len(new), kind=NUMBERED, key=np.frombuffer(r["keys"], "<i8"), **{"class": new})
                else:
                    yield from told.rows(r["key"], Words.read(r), new)
        yield from told.rest()
        at = np.flatnonzero(change)
        yield _rows(_TOLD, len(at), kind=CHANGE, key=at, h=change[at])
        give_back()

    return run


def _last(rows: pa.Table) -> pa.Table:
    """The words of a bucket, how often they occur, and their classes."""
    rows = rows.to_pylist()
    w = _together([r for r in rows if r["kind"] == WORDS])
    t = next(r for r in rows if r["kind"] == TEXTS)
    return pa.table({"word": _strings(t), "c": pa.array(np.frombuffer(t["n"], "<u4").astype(np.int64)), "k": pa.array(w.own.astype(np.int32))})


_WHOLE = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, once bigint, base double, emission double, classes binary"


def _place(classes: np.ndarray, end: int):
    """Rows with the classes of other words (number * 256 + class) that texts to learn from have, as rows with the classes of all tokens."""

    def run(batches):
        for b in batches:
            own, n_own = _joined(b.column("own"), np.uint8)
            own, found = own.copy(), b.column("found")
            x = found.flatten().to_numpy()
            n = pc.fill_null(pc.list_value_length(found), 0).to_numpy()
            own[(x >> 8) + np.repeat(np.cumsum(n_own) - n_own, n)] = x & 255
            to = np.concatenate([[0], np.cumsum(n_own)])
            p = Placed(b.column("ids"), b.column("others"), _cut(to, own.tobytes()), classes, end)
            cls = [p.cls[a:z].tobytes() for a, z in zip(p.start.tolist(), p.end_at.tolist(), strict=True)]
            names = [x.split()[0] for x in _WHOLE.split(", ")][:-1]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(cls, pa.binary())], [*names, "classes"])
        give_back()

    return run


def _class_bigrams(k: int):
    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            end = bytes([k - 1])
            x = np.frombuffer(end + b"".join(t + end for t in b.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(x[:-1] * k + x[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return run


def _score(log_a: np.ndarray, log_mass: np.ndarray):
    """log10 probabilities of the texts from their classes and the emissions of their words."""
    end = len(log_a) - 1

    def run(batches):
        for b in batches:
            out = []
            for t, emission in zip(b.column("classes").to_pylist(), b.column("emission").to_pylist(), strict=True):
                x = np.frombuffer(t, np.uint8)
                # the end is the only member of its class; its emission is certain
                out.append(float(log_a[np.append(end, x), np.append(x, end)].sum() + emission - log_mass[x].sum()))
            names = ["doc_id", "held_out", "n_tokens", "known", "once", "base"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(out, pa.float64())], [*names, "score"])

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, n_lone.

    n_lone counts the tokens that the training texts have once or never: what no other text supports. Rows whose crc32(doc_id as text) mod 7 is 2 are not learned from. A null or empty text is one end
    token; very long texts are scored whole. With nothing to learn from, all words are unknown and scores
    stay finite. Rows of one id are scored each by itself, equally frequent words in the order of their
    bytes. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out().alias("held_out"))
    train = base.where("not held_out").select("text")
    counts = scratch.write(train.mapInArrow(_count, "word string, ending int, n bigint").groupBy("word", "ending").agg(F.sum("n").alias("c")), "counts")
    ending_tokens, ending_words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        ending_tokens[r.ending], ending_words[r.ending] = r.c, r.v
    total, words = int(ending_tokens.sum()), int(ending_words.sum())
    n_docs = train.count()
    top = counts.where(F.octet_length("word") <= MAX_WORD).orderBy(F.desc("c"), "word").limit(FREQUENT).select("word", "c").collect()
    frequent = [(r.word, r.c) for r in sorted(top, key=lambda r: (-r.c, r.word))]
    symbols = [w.encode("utf-8", "surrogatepass") for w, _ in frequent[:SYMBOLS]]
    size = Symbols(symbols).size
    m = np.zeros((size, size))
    pairs = train.mapInArrow(_bigrams(symbols), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    m.reshape(-1)[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    scorer = Scorer(frequent, m, ending_tokens, ending_words, total + n_docs, words + (n_docs > 0), n_docs)
    scratch.drop(counts)
    shared = spark.sparkContext.broadcast(scorer)
    parts = scratch.write(base.select("doc_id", "text", "held_out").mapInArrow(_code(shared), _PARTS_KIND).withColumn("row", F.monotonically_increasing_id()), "parts")
    whole, g, mass = cluster(scratch, parts, scorer)
    out = whole.mapInArrow(_score(transitions(g), np.log10(mass)), "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, once bigint, base double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total + n_docs).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        (F.col("once") + F.col("n_tokens") - F.col("known")).alias("n_lone"),
    )


def cluster(scratch: Scratch, parts: DataFrame, scorer: Scorer) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Exchange over all words of the training texts: texts by classes, class bigrams, and the mass of each class.

    In a round all words move, group behind group, each by the classes that its neighbours had before the
    round. The bigrams are then counted anew; a round that lowers the likelihood is not kept, and one that
    gains little is the last. Groups go by a hash of the word, so no result depends on the partitions.

    The texts are read once for the neighbours of all words and once to place the words in their last classes.
    In between, words that are not broadcast tell their class to the other such words beside them by a shuffle.
    """
    end, k = scorer.end, scorer.end + 1
    classes = np.append(scorer.word_class, end).astype(np.int64)
    h = np.array([*(crc32(w) for w in scorer.words), 0], np.int64)
    buckets = int(max(scorer.n - scorer.counts.sum(), 0)) // OCCURRENCES + 16
    train = parts.where("not held_out").select("ids", "others", "words", "own", F.transform("words", lambda w: F.xxhash64(w)).alias("keys"))
    adjacent = scratch.write(train.mapInArrow(_adjacent(len(classes) - 1, buckets), _TOLD), "adjacent")
    small_batches(scratch.spark, 10)  # rows are long from here on
    first = scratch.write(adjacent.where(F.col("kind") == WORDS).groupBy("key").applyInArrow(_gather(k, buckets), _TOLD), "words")
    tables = [first]
    blocks = scratch.write(adjacent.where(F.col("kind") == BLOCK).groupBy("key").applyInArrow(_sum_blocks, _TOLD), "blocks")
    scratch.drop(adjacent)

    g, won, before = None, 0.0, None
    while True:
        told = reduce(DataFrame.unionAll, tables)
        words = told.where(F.col("kind").isin(WORDS, MESSAGES)).drop("class", "size", "texts", "h")
        beside = blocks.unionAll(told.where(F.col("kind") == BLOCK)).select("key", "class", "codes")
        near = words.groupBy("key").applyInArrow(_near(classes, k), _FOUND).unionAll(beside.groupBy("key").applyInArrow(_near_frequent(classes, h, k), _FOUND))
        near = scratch.write(near, "near")
        table = np.zeros((k, k))
        for r in near.where("step = -1").groupBy("key").agg(F.sum("h").alias("n")).collect():
            table.reshape(-1)[r.key] = r.n
        gain = fit(table) - fit(g) if g is not None else 0.0
        won += gain
        if gain < 0:
            scratch.drop(*tables)
            tables, classes = before
        elif before and before[0] != [first]:  # that has the texts of the words
            scratch.drop(*before[0])
        if g is not None and gain <= LEAST * won:
            scratch.drop(near, blocks)
            break
        g, before, tables = table, (tables, classes.copy()), []
        table = g.copy()
        for step in range(len(BOUNDS) - 1):
            tables.append(scratch.write(near.where(F.col("step") == step).mapInArrow(_move(np.maximum(table, 0), buckets), _TOLD), "words"))
            rows = tables[-1].where(F.col("kind").isin(CHANGE, NUMBERED)).groupBy("kind", "key").agg(F.sum("h").alias("h"), F.max("class").alias("class")).toArrow()
            kind, key = rows["kind"].to_numpy(), rows["key"].to_numpy()
            for of, x in ((CHANGE, "h"), (NUMBERED, "class")):
                to, value = (table.reshape(-1), rows[x].to_numpy()) if of == CHANGE else (classes, rows[x].to_numpy())
                if of == CHANGE:
                    to[key[kind == of]] += value[kind == of]
                else:
                    to[key[kind == of]] = value[kind == of]
        scratch.drop(near)

    small_batches(scratch.spark)
    last = reduce(DataFrame.unionAll, tables).where(F.col("kind") == WORDS).unionAll(first.where(F.col("kind") == TEXTS))
    of = scratch.write(last.groupBy("key").applyInArrow(_last, "word string, c bigint, k int"), "last")
    others = parts.select("row", F.posexplode(F.arrays_zip("words", "n")).alias("i", "x")).select("row", "i", F.col("x.words").alias("word"), "x.n")
    rare = others.join(of, "word").groupBy("row").agg(
        F.collect_list(F.col("i") * 256 + F.col("k")).alias("found"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"),
        F.sum("n").alias("more_known"), F.sum(F.when(F.col("c") == 1, F.col("n"))).alias("more_once"),
    )
    more, none = F.coalesce("more", F.lit(0.0)), F.lit(0)
    filled = parts.drop("words", "n").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", none)).alias("known"), (F.col("once") + F.coalesce("more_once", none)).alias("once"),
        (F.col("base") + more).alias("base"), (F.col("emission") + more).alias("emission"), "ids", "others", "own", "found",
    )
    whole = scratch.write(filled.mapInArrow(_place(classes[:-1].astype(np.uint8), end), _WHOLE), "whole")
    pairs = whole.where("not held_out").select("classes").mapInArrow(_class_bigrams(k), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((k, k))
    table.reshape(-1)[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    mass = np.bincount(classes[:-1], weights=scorer.counts + 1, minlength=k) + 1
    for r in of.groupBy("k").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r.k] += r.m
    return whole, table, mass
