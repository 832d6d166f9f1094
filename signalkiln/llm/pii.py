"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained here from a small labelled table of sentences and adds spans that the patterns
miss: secrets behind a name, phone numbers without a plus, spelled-out addresses, cards written with
other separators or two in a row. Only words that hold a digit or an at sign, spelled or not, and their
neighbours can belong to such a span; these windows are decoded by Viterbi, many at once in numpy.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Kinds of the fixed patterns, and the kind that only the field finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign, so that long words cost no more than their length."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > low and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Runs of digits joined by dots, taken four at a time; each chain of runs is read once."""
    out = []
    for m in _CHAIN.finditer(text) if text.count(".") >= 3 else ():
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15] if "+" in text else []


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {"email": emails(text) if "@" in text else [], "ip": ips(text), "card": cards(text), "phone": phones(text)}


def plausible(kind: str, s: str) -> bool:
    """What holds of any value of its kind, however it is written."""
    d = _digits(s)
    if kind == "ip":
        numbers = re.findall(r"[0-9]+", s)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "secret":
        return len(s) >= 12 and bool(d) and any(c.isalpha() for c in s)
    return sum(c.isalpha() for c in s) >= 4


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'*#%&$|<>"
_CUE = re.compile(r"\d|@|^[\(\[]?(?:at|dot)[\)\]]?$", re.I)
TAGS = ["O"] + [f"{p}-{k}" for k in ALL_KINDS for p in "BI"]


def shape(word: str) -> str:
    """Classes of characters, runs of three or more shortened; long words by their first classes."""
    s = re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[a-zß-ÿ]", "a", re.sub(r"[0-9]", "9", word)))
    return re.sub(r"(.)\1\1+", r"\1\1+", s)[:24]


def facts(w: str) -> list[str]:
    """What a word is as a whole."""
    d = sum("0" <= c <= "9" for c in w)
    out = ["n=" + str(min(len(w), 20)), "d=" + str(min(d, 20))]
    if d:
        signs = "".join(sorted({c for c in w if not c.isalnum()}))
        out.append(f"signs={signs} groups={min(len(re.findall('[0-9]+', w)), 5)}")
    if len(w) >= 12 and d and any(c.isalpha() for c in w):
        out.append("long mix")
        if re.fullmatch(r"[0-9a-fA-F]+", w):
            out.append("long hex")
    if 16 <= d <= 19:
        out.append("check digit " + ("holds" if luhn(_digits(w)) else "fails"))
    return out


def observe(words: list[str], i: int) -> list[str]:
    """Feature names of word i: its shape and facts, and those of its neighbours."""
    w = words[i].strip(_EDGE)
    out = ["s=" + shape(w), "bias", *facts(w)]
    if len(w) <= 6 and not any(c.isdigit() for c in w):
        out.append("w=" + w.lower())
    for k in (-2, -1, 1, 2):
        if 0 <= i + k < len(words):
            v = words[i + k].strip(_EDGE)
            out.append(f"{k}s=" + shape(v))
            if k in (-1, -2) and (v.isalpha() or v == "="):
                out.append(f"{k}w=" + v.lower())
        else:
            out.append(f"{k}=edge")
    return out


#: The labelled table. Sentences without personal data.
PLAIN = (
    "the meeting was held on monday at noon", "see page 17 of the report from 2019", "version 3.11.2 of the tool came in may", "it cost 1250 euros or 12.50 each",
    "order 9951723 was sent on 2021-04-05", "we look at it and dot the line", "room 204 at the end of the hall", "la maison est au numéro 12 de la rue", "das haus hat 3 zimmer und 90 meter",
    "chapters 1 2 3 4 and 5 are short", "on 12.05.2019 at 10:30 they met", "values 0.25 and 1.75 were used", "licensed under the apache license, version 2.0", "general public license, version 3",
    "licensed under cc by-nc 4.0", "the number 8007782375593431 is none", "part 2744757332971694 of it", "of 9870157079875996 the rest", "build 20240115-3 passed", "the total = 1250 and the rest", "la casa tiene 4 puertas y 12 ventanas",
    "row 3 = 15 and row 4 = 17", "the file a1b2.txt is here", "mp3 and h264 are formats", "on 03 11 2021 they came", "la 14 07 1998 de",
    "numbers 5 6 7 8 9 10 follow", "und 20 10 2015 war", "rows 10 20 30 40 of it", "the 22 08 2003 of",
)
#: Values of each kind, and words that stand before and behind them.
VALUES = {
    "phone": ("(017) 555-7713", "017-555-7713", "555.201.7788", "(415) 555 0199", "030 1234 5678", "01 44 55 66 77", "212-555-0147", "0171/5550123", "(040) 555-01-77", "0049 30 123456"),
    "email": ("john.smith at example dot com", "mary [at] mail [dot] org", "bob (at) post (dot) net", "info.desk at mail4 dot example dot com", "anna_b @ example.org", "joe.19 at mail5 dot example dot com"),
    "ip": ("10.0.3[.]14", "192[.]168[.]7[.]20", "172 . 16 . 5 . 9", "10[.]20[.]30[.]40", "1.1[.]1[.]1"),
    "card": ("4111.1111.1111.1111", "4012/8888/8888/1881", "5105_1051_0510_5100", "4222 . 2222 . 2222 . 2220", "4111111111111111", "5105105105105100", "4012888888881881"),
    "secret": ("8f14e45fceea167a5a36dedd4bea2543", "e03422dad6b454724135a384f69ba12c7de6c8f4", "aebccd4559894937c75946a5f6a3ed5b13ef9ee9", "sk_live_51HxQ2eKvTz0", "AKIA4QX7Z2M8LPW3", "Xk29vQpL77mZt4Rb", "ghp_1a2B3c4D5e6F7g8H", "11acdfb36bb72224148e6160f674b4be45601bff"),
}
FRAMES = (("call", "or write today"), ("phone :", "for details"), ("the and", "of the thing"), ("contact", ""), ("", "is mine"), ("send it to", "and wait"), ("de la", "en que"), ("und der", "mit dem"), ("la ue", "doado el"))
SECRET_FRAMES = (("token =", "and the"), ("api_key =", "de la"), ("the password :", ""), ("secret =", "und der"), ("key :", "is used"), ("of token =", "the and"), ("passwd =", "la casa"))


def labelled_sentences() -> list[tuple[list[str], list[str]]]:
    """Words and their tags: each plain sentence, and each value in some of the frames."""
    out = [(s.split(), ["O"] * len(s.split())) for s in PLAIN]
    for kind, values in VALUES.items():
        for i, value in enumerate(values):
            for j, (a, b) in enumerate(SECRET_FRAMES if kind == "secret" else FRAMES):
                if kind != "secret" and (i + j) % 2:
                    continue
                w = value.split()
                if kind == "secret":
                    w = [f'"{w[0]}"' if (i + j) % 2 else w[0]]
                tags = [f"B-{kind}"] + [f"I-{kind}"] * (len(w) - 1)
                more, extra = (values[(i + 1) % len(values)].split(), 1) if kind == "card" and len(w) == 1 and j % 3 == 0 else ([], 0)
                more_tags = [f"B-{kind}"] * extra + [f"I-{kind}"] * max(len(more) - 1, 0)
                out.append(([*a.split(), *w, *more, *b.split()], ["O"] * len(a.split()) + tags + more_tags + ["O"] * len(b.split())))
    for i, s in enumerate(PLAIN):
        t = PLAIN[(i * 5 + 3) % len(PLAIN)]
        out.append((s.split() + t.split(), ["O"] * (len(s.split()) + len(t.split()))))
    return out


class Field:
    """A linear-chain conditional random field; weights are learned by gradient ascent with a quadratic prior."""

    def __init__(self, sentences: list[tuple[list[str], list[str]]], rounds: int = 120, prior: float = 0.02):
        self.names: dict[str, int] = {}
        place = {t: i for i, t in enumerate(TAGS)}
        seqs = [[[self.names.setdefault(f, len(self.names)) for f in observe(w, i)] for i in range(len(w))] for w, _ in sentences]
        gold = [np.array([place[t] for t in tags]) for _, tags in sentences]
        k, n, longest = len(TAGS), len(seqs), max(map(len, seqs))
        x = np.zeros((n, longest, len(self.names)), np.float32)
        mask, y = np.zeros((n, longest), bool), np.zeros((n, longest), int)
        for a, (s, g) in enumerate(zip(seqs, gold, strict=True)):
            mask[a, : len(s)] = True
            y[a, : len(g)] = g
            for t, fs in enumerate(s):
                x[a, t, fs] = 1
        u, a_ = np.zeros((len(self.names), k)), np.zeros((k, k))
        su, sa = np.full_like(u, 1e-6), np.full_like(a_, 1e-6)
        one = np.eye(k)[y] * mask[..., None]
        pairs = (mask[:, 1:] & mask[:, :-1])[..., None, None] * one[:, :-1, :, None] * one[:, 1:, None, :]
        flat = x.reshape(-1, x.shape[2])
        for _ in range(rounds):
            e = (flat @ u).reshape(n, longest, k)
            f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            f[:, 0] = e[:, 0]
            for t in range(1, longest):
                nxt = np.logaddexp.reduce(f[:, t - 1, :, None] + a_, axis=1) + e[:, t]
                f[:, t] = np.where(mask[:, t, None], nxt, f[:, t - 1])
            for t in range(longest - 2, -1, -1):
                nxt = np.logaddexp.reduce(a_ + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
            z = np.logaddexp.reduce(f[:, -1], axis=1)
            p = np.exp(np.minimum(f + b - z[:, None, None], 0)) * mask[..., None]
            pp = np.exp(np.minimum(f[:, :-1, :, None] + a_ + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * (mask[:, 1:] & mask[:, :-1])[..., None, None]
            gu = flat.T @ (one - p).reshape(-1, k) - prior * u
            ga = (pairs - pp).sum(axis=(0, 1)) - prior * a_
            su += gu**2
            sa += ga**2
            u += 0.5 * gu / np.sqrt(su)
            a_ += 0.5 * ga / np.sqrt(sa)
        for i, t in enumerate(TAGS):  # I- only behind its own B- or I-
            if t[0] == "I":
                a_[[j for j, s in enumerate(TAGS) if s[2:] != t[2:]], i] = -1e3
        self.u, self.a = u, a_
        self.first = np.array([-1e3 if t[0] == "I" else 0.0 for t in TAGS])

    def scores(self, words: list[str]) -> np.ndarray:
        get = self.names.get
        return np.array([self.u[[j for f in observe(words, i) if (j := get(f)) is not None]].sum(axis=0) for i in range(len(words))]).reshape(-1, len(TAGS))

    def decode(self, windows: list[list[str]]) -> list[list[int]]:
        """Viterbi over many word windows at once."""
        if not windows:
            return []
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        out: list[list[int]] = [[] for _ in windows]
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            longest = len(windows[some[-1]])
            e = np.zeros((len(some), longest, len(TAGS)))
            size = np.array([len(windows[i]) for i in some])
            for r, i in enumerate(some):
                e[r, : size[r]] = self.scores(windows[i])
            v, back = e[:, 0] + self.first, np.zeros((longest, len(some), len(TAGS)), int)
            for t in range(1, longest):
                total = v[:, :, None] + self.a
                live = (t < size)[:, None]
                back[t] = np.where(live, total.argmax(axis=1), np.arange(len(TAGS)))
                v = np.where(live, total.max(axis=1) + e[:, t], v)
            state = v.argmax(axis=1)
            path = np.zeros((len(some), longest), int)
            for t in range(longest - 1, -1, -1):
                path[:, t] = state
                state = back[t, np.arange(len(some)), state]
            for r, i in enumerate(some):
                out[i] = path[r, : size[r]].tolist()
        return out


_REACH = 4
_fields: list[Field] = []


def field() -> Field:
    if not _fields:
        _fields.append(Field(labelled_sentences()))
    return _fields[0]


def windows_of(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of word spans around the words with cues that no fixed pattern has taken."""
    words = [m.span() for m in _TOKEN.finditer(text)]
    busy, k = set(), 0
    taken = sorted(taken)
    for i, (a, b) in enumerate(words):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            busy.add(i)
    cue = [i for i, (a, b) in enumerate(words) if i not in busy and _CUE.search(text[a:b].strip(_EDGE))]
    out: list[list[int]] = []
    for i in cue:
        a, b = max(0, i - _REACH), min(len(words), i + _REACH + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [words[a:b] for a, b in out]


def find_batch(texts: list[str], model: Field) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """Fixed spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    jobs = []
    for i, (t, found) in enumerate(zip(texts, base, strict=True)):
        if re.search(r"\d|@|\bdot\b|\[at\]|\(at\)", t):
            jobs.extend((i, w) for w in windows_of(t, [s for k in KINDS for s in found[k]]))
    jobs = [(i, w) for i, w in jobs if len(w) > 0]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    tags = model.decode([[texts[i][a:b] for a, b in w] for i, w in jobs])
    for (i, w), path in zip(jobs, tags, strict=True):
        t, at = texts[i], 0
        while at < len(path):
            tag = TAGS[path[at]]
            end = at + 1
            if tag[0] == "B":
                while end < len(path) and TAGS[path[end]] == "I" + tag[1:]:
                    end += 1
                a, b = w[at][0], w[end - 1][1]
                while a < b and t[a] in _EDGE:
                    a += 1
                while b > a and t[b - 1] in _EDGE:
                    b -= 1
                kind = tag[2:]
                if plausible(kind, t[a:b]) and not any(x < b and a < y for k in KINDS for x, y in base[i][k]):
                    added[i].append((kind, a, b))
            at = end
    return list(zip(base, added, strict=True))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))


def _run(model: Field):
    def run(batches):
        for b in batches:
            rows = []
            for found, more in find_batch([t or "" for t in b.column(1).to_pylist()], model):
                base = [(k, a, e) for k in KINDS for a, e in found[k]]
                rows.append((*(len(found[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more), len(base) + len(more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_found"])
        give_back()

    return run


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, code points), n_added, n_found.

    The counts and base_sha256 are of the fixed patterns; spans has these and the field's, ordered by
    kind (secret last), then place; n_added counts the field's, n_found all. Null and empty texts hold
    nothing; very long ones are searched whole. Repeated rows give repeated results, an empty table an
    empty one. Other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_run(field()), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_found bigint")
