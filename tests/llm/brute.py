"""Plain versions of the operators' contracts, without Spark, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def held(doc_id: int, mod: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def repeats(docs: list[tuple[int, str | None]], length: int = 400) -> dict[int, tuple[int, int, int, str]]:
    """Bytes removed because a string of ``length`` bytes over them starts somewhere else as well."""
    raw = {i: (t or "").encode() for i, t in docs}
    seen: Counter = Counter()
    for b in raw.values():
        seen.update(hash(b[p : p + length]) for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        cover = bytearray(len(b))
        end = 0
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                for k in range(max(p, end), p + length):
                    cover[k] = 1
                end = p + length
        spans = sum(cover[k] and not (k and cover[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(cover), spans, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return out


def lines(docs: list[tuple[int, str | None]], min_chars: int = 40, min_docs: int = 5) -> dict[int, tuple[int, int, str]]:
    key = lambda x: x.strip(SPACE).translate(ASCII_LOWER)
    where: dict[str, set[int]] = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where[key(x)].add(i)
    out = {}
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(where.get(key(x), ())) >= min_docs and max(where[key(x)]) != i)]
        out[i] = (len(own), len(own) - len(kept), sha("\n".join(kept)))
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    w = WORDS.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    worded = [x for x in t.split("\n") if WORDS.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(worded) - len(set(worded)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def lm_base(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    toks = {i: [*WORDS.findall((t or "").translate(ASCII_LOWER)), None] for i, t in docs}
    c: Counter = Counter()
    for i, t in toks.items():
        if not held(i, 7, 2):
            c.update(t)
    n, v = sum(c.values()), len(c)
    return {i: (held(i, 7, 2), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in t)) for i, t in toks.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text: str | None) -> tuple[int, int, int, int, str]:
    t = text or ""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(sum(divmod(x * 2, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0

    spans = {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15],
    }
    return (*(len(x) for x in spans.values()), sha(",".join(f"{k}:{a}:{b}" for k, x in spans.items() for a, b in x)))


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    w = WORDS.findall((text or "").translate(ASCII_LOWER))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    sets = {i: shingles(t) for i, t in docs}
    owner: dict[tuple, list[int]] = defaultdict(list)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        both: Counter = Counter()
        for s in sets[i]:
            both.update(owner[s])
            owner[s].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
