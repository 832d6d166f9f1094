"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs wait in an agenda (a heap) ordered by score, then place; the best pair is merged
until none is left. Texts are cut where no piece of the vocabulary can reach across, the parts are
encoded once per distinct part, and each new part of an Arrow batch is encoded and decoded by the
library as well. Where the two differ the row says so.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

SPACE_MARK = "▁"
#: Bytes of encoded parts that each Python worker remembers, in two generations of half that size.
REMEMBERED = 128 << 20
#: Bytes of text that are encoded at once; a longer text is encoded by itself.
SLICE = 1 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r'.,!?;:*#%&$|"'


class Memory(dict):
    """Decimal ids of parts. A new part is encoded by the agenda and waits to be checked by the library."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old, self.size = codec, {}, 0
        self.fresh: dict[str, list[int]] = {}

    def __missing__(self, part: str) -> str:
        said = self.old.get(part)
        if said is None:
            ids = self.fresh[part] = self.codec.ids_of(self.codec.merge(part))
            said = " ".join(map(str, ids))
        self[part] = said
        self.size += 200 + 2 * len(part) + len(said)
        return said

    def age(self) -> None:
        """Forget what was not met since the last time."""
        if self.size > REMEMBERED // 2:
            self.old, self.size = dict(self), 0
            self.clear()


class Codec:
    """One model file: own encoder and decoder, and the library beside them."""

    _loaded: dict[str, Codec] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.surface = [sp.id_to_piece(i) for i in range(n)]
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.surface) if not odd[i]}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_id) if i != sp.unk_id()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unk, self.eos = sp.unk_id(), sp.eos_id()
        # What may be cut: before a space mark after anything else, around a line end, and between a
        # Latin letter and one of these signs. Only if no piece reaches across.
        across = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}|\n|[{_LETTERS}][{_SIGNS}]")
        self.cuts = not any(across.search(p) for p in self.ids)
        self.identity = all(sp.normalize(x) == SPACE_MARK + x.replace(" ", SPACE_MARK) for x in ("a", " ﬁ  B　", "\tİéé\n", "Ａ "))
        self.parts = re.compile(f"\n|{SPACE_MARK}*[{_LETTERS}]+(?=[{_SIGNS}])|{SPACE_MARK}+[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+").findall if self.cuts else lambda x: [x] if x else []
        self.said = Memory(self)
        #: Parts that the library encodes or decodes otherwise, with its ids and its text.
        self.disputed: dict[str, tuple[list[int], str]] = {}

    def normalized(self, text: str) -> str:
        if not text:
            return ""
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if self.identity else self.library.normalize(text)

    def merge(self, part: str) -> list[str]:
        """The symbols of a normalized text when no pair is left to merge."""
        symbols: list[str | None] = list(part)
        n = len(symbols)
        cost = self.cost
        agenda = [(cost[p], i, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in cost]
        if not agenda:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in cost:
                    heapq.heappush(agenda, (cost[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + pair) in cost:
                heapq.heappush(agenda, (cost[p], h, p))
        return [s for s in symbols if s is not None]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id[0] != self.unk:
                out.extend(self.byte_id[b] for b in s.encode())
            else:
                out.append(self.unk)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text by the agenda alone, without an end id."""
        return [i for p in self.parts(self.normalized(text)) for i in self.ids_of(self.merge(p))]

    def surfaces(self, ids: list[int]) -> str:
        """Pieces of ids joined, byte pieces as UTF-8, space marks as they are."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.surface[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first space mark dropped, the others as spaces."""
        text = self.surfaces(ids)
        return (text[1:] if text.startswith(SPACE_MARK) else text).replace(SPACE_MARK, " ")

    def by_library(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of normalized parts; a part that does not begin with a mark stands after a line end."""
        plain = [p[1:] if p[0] == SPACE_MARK else "\n" + p for p in parts]
        return [x if p[0] == SPACE_MARK else x[2:] for p, x in zip(parts, self.library.encode(plain, num_threads=1), strict=True)]

    def check_fresh(self) -> bool:
        """Encode and decode the new parts by the library too; true if it disputes any."""
        fresh, self.said.fresh = self.said.fresh, {}
        before = len(self.disputed)
        # the library drops a leading mark, so a mark by itself is checked with what follows it only
        parts = [p for p in fresh if p != SPACE_MARK]
        if parts:
            theirs = self.by_library(parts)
            # behind the id of a line end the library drops no mark
            texts = self.library.decode([[self.byte_id[10], *fresh[p]] for p in parts], num_threads=1)
            for p, ids, text in zip(parts, theirs, texts, strict=True):
                mine = self.surfaces(fresh[p])
                if ids != fresh[p] or text[1:] != mine.replace(SPACE_MARK, " ") or mine != p:
                    self.disputed[p] = (ids, self.library.decode([[self.byte_id[10], *ids]], num_threads=1)[0][1:])
                    self.said[p] = " ".join(map(str, ids))
        return len(self.disputed) > before

    def encode_whole(self, text: str) -> tuple[str, str, int]:
        """As encode_batch for one text of a model whose texts cannot be cut."""
        mine, theirs = self.encode(text) + [self.eos], self.library.encode(text, num_threads=1) + [self.eos]
        back, right = self.decode(mine), self.library.decode(theirs)
        return " ".join(map(str, theirs)), right, int(mine != theirs or back != right)

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Of each text: ids with the end id as decimal numbers, the decoded text, and how many of its parts the library disputes."""
        if not (self.cuts and self.identity):
            return [self.encode_whole(t) for t in texts]
        self.said.age()
        cut = [self.parts(self.normalized(t)) for t in texts]
        said = self.said.__getitem__
        ids = [" ".join(map(said, parts)) for parts in cut]
        if self.check_fresh():
            ids = [" ".join(map(said, parts)) for parts in cut]
        end = str(self.eos)
        ids = [f"{x} {end}" if x else end for x in ids]
        if not self.disputed:  # each part's pieces join to the part itself
            return [(x, "".join(parts)[1:].replace(SPACE_MARK, " "), 0) for x, parts in zip(ids, cut, strict=True)]
        get = self.disputed.get
        back = ["".join(get(p, (None, None))[1] or p.replace(SPACE_MARK, " ") for p in parts)[1:] for parts in cut]
        return [(x, t, sum(p in self.disputed for p in parts)) for x, t, parts in zip(ids, back, cut, strict=True)]


def slices(column: pa.Array) -> list[tuple[int, int]]:
    """(first, count) of runs of rows with about ``SLICE`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    cuts = np.flatnonzero(np.diff(ends // SLICE)) + 1
    edges = [0, *cuts.tolist(), len(column)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _run(path: str, with_ids: bool):
    def run(batches):
        codec = Codec.load(path)
        for b in batches:
            for at, n in slices(b.column(1)):
                part = b.slice(at, n)
                got = codec.encode_batch([t or "" for t in part.column(1).to_pylist()])
                count = [x.count(" ") + 1 for x, _, _ in got]
                cols = [
                    part.column(0),
                    pa.array(count, pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _, _ in got], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t, _ in got], pa.string()),
                    pa.array([d for _, _, d in got], pa.int64()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_disputed"]
                if with_ids:
                    flat = np.fromstring(" ".join(x for x, _, _ in got), np.int32, sep=" ")
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([t for _, t, _ in got], pa.string())]
                    names += ["ids", "decoded"]
                del got
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return run


def encode(docs: DataFrame, model_path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens (end id included), ids_sha256, decoded_sha256, n_disputed[, ids, decoded].

    A null text counts as empty and gives the end id alone. Repeated rows give repeated results, an
    empty table an empty one. Very long texts are encoded whole; other columns, whatever their names,
    are ignored. ``model_path`` is read on the executors. n_disputed counts the parts of a row for
    which agenda and library differ (the library's ids and text are returned then).
    """
    small_batches(docs.sparkSession)
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_disputed bigint" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_run(model_path, with_ids), kind)
