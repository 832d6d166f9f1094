"""Main text of web pages by wrappers inferred per host.

A page is a stream of block slots (the path of open elements and a text). Streams of a host are
aligned one after another into a union-free expression: a mismatch becomes an optional slot, a run of
one slot a repeated group. Each page is matched against its host's expression; slots whose texts recur
over the host's pages belong to the template, inside an article as well. Pages send their shape and slot
hashes only, combined before the shuffle, so a host with a third of all pages costs its distinct shapes.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, small_batches

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_CLASS = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is no text of the page; noscript counts as one outside an article only.
RAW = {"script", "style", "template", "textarea", "title", "iframe", "svg", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = set("html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address form fieldset nav header footer aside details summary center hgroup dialog menu hr".split())
JUNK = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset"}
JUNK_WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond reply replies disqus discussion complementary contentinfo search pagination pager toolbar widget".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_BREAKS_P = BLOCK - {"html", "head", "body"}
#: Pages that each text of a slot must be on, on average, for the slot to count as part of the template.
TEMPLATE_PAGES = 3


def _junk(name: str, attrs: str, inside_main: bool) -> bool:
    if name in JUNK or (name == "header" and not inside_main):
        return True
    if re.search(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attrs):
        return True
    if name in ("body", "html", "article", "main"):
        return False
    for m in _CLASS.finditer(attrs):
        value = m[1] or m[2] or m[3] or ""
        if JUNK_WORDS & set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())):
            return True
    return False


def slots(page: str | None) -> list[tuple[str, bool, bool, str]]:
    """(path, junk, main, text) of each block with text, in page order."""
    out: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, label, junk, main
    parts: list[str] = []
    page = page or ""

    def flush() -> None:
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            path = "/".join(s[1] for s in stack if s[0] in BLOCK)
            out.append((path, any(s[2] for s in stack), any(s[3] for s in stack), text))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m.group().startswith("<![CDATA["):
            continue
        if not m[2]:
            continue
        name, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            if name in BLOCK or any(s[0] == name and s[2] for s in stack):
                flush()
            if name == "br":
                parts.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break
            continue
        if name in RAW or (name == "noscript" and not any(x[3] for x in stack)):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attrs.rstrip().endswith("/"):
                at = end.end() if end else n
            if name != "title":
                parts.append(" " if name == "svg" else "")
            continue
        if name in VOID:
            if name in ("hr",):
                flush()
            elif name in ("br", "img", "input"):
                parts.append(" ")
            continue
        main = any(s[3] for s in stack)
        junk = _junk(name, attrs, main)
        if name in BLOCK or junk:
            flush()
        if name in _BREAKS_P or name in _CLOSES:
            shut = _CLOSES.get(name, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    if name not in ("td", "th", "tr", "li", "dt", "dd"):
                        break
                elif stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "div", "section", "article", "main", "blockquote", "body", "li"):
                    break
        is_main = name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", attrs))
        label = name
        if name in BLOCK and (c := _CLASS.search(attrs)):
            label += "." + re.sub(r"\d+", "0", (c[1] or c[2] or c[3] or "").lower())
        if not attrs.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, label, junk, is_main))
    flush()
    return out


def shape(blocks: list[tuple[str, bool, bool, str]]) -> list[tuple[str, bool]]:
    """The stream of slot paths with runs of one path as one repeated group."""
    out: list[list] = []
    for path, *_ in blocks:
        if out and out[-1][0] == path:
            out[-1][1] = True
        else:
            out.append([path, False])
    return [(p, r) for p, r in out]


def align(wrapper: list[tuple[str, bool, bool]], stream: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    """Generalise (path, repeated, optional) expressions to one that both match.

    Matching slots are found by the longest common subsequence; a slot of one side only is optional,
    and equal neighbours fold into a repeated group.
    """
    n, m = len(wrapper), len(stream)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if wrapper[i][0] == stream[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[str, bool, bool]] = []
    i = j = 0

    def put(path: str, rep: bool, opt: bool) -> None:
        if out and out[-1][0] == path:
            out[-1] = (path, True, out[-1][2] and opt)
        else:
            out.append((path, rep, opt))

    while i < n or j < m:
        if i < n and j < m and wrapper[i][0] == stream[j][0]:
            put(wrapper[i][0], wrapper[i][1] or stream[j][1], wrapper[i][2] or stream[j][2])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            put(wrapper[i][0], wrapper[i][1], True)
            i += 1
        else:
            put(stream[j][0], stream[j][1], True)
            j += 1
    return out


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def places(wrapper: list[str], stream: list[str]) -> list[int]:
    """Of each path of a stream its slot in a wrapper, -1 where it has none: the longest common subsequence."""
    n, m = len(wrapper), len(stream)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if wrapper[i] == stream[j] else max(best[i + 1][j], best[i][j + 1])
    out = [-1] * m
    i = j = 0
    while i < n and j < m:
        if wrapper[i] == stream[j]:
            out[j] = i
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Matcher:
    """Slots of blocks in the wrappers of their hosts; each pair of wrapper and shape is aligned once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, tuple[str, ...]], list[int]] = {}

    def __call__(self, wrapper: str, blocks: list[tuple[str, bool, bool, str]]) -> list[int]:
        stream = tuple(p for p, _ in shape(blocks))
        if (wrapper, stream) not in self.known:
            self.known[wrapper, stream] = places([x.split("\t")[0] for x in wrapper.split("\n")], list(stream))
        runs, out, at = self.known[wrapper, stream], [], -1
        for i, (path, *_) in enumerate(blocks):
            at += i == 0 or path != blocks[i - 1][0]
            out.append(runs[at])
        return out


def _observe(batches):
    """(host, shape) of each batch."""
    for b in batches:
        seen = {(host or "", "\n".join(f"{p}\t{int(r)}" for p, r in shape(slots(page.as_py())))) for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string())], ["host", "what"])


def _texts(batches):
    """(host, slot, hash of a text, pages that have it there) of each batch."""
    match = Matcher()
    for b in batches:
        seen: dict[tuple[str, int, int], int] = defaultdict(int)
        for host, page, wrapper in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            blocks = slots(page.as_py())
            for slot, h in {(i, xxhash.xxh3_64_intdigest(x[3]) >> 1) for i, x in zip(match(wrapper, blocks), blocks, strict=True) if not x[1]}:
                seen[host, slot, h] += 1
        cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "slot", "text", "n"])


def _fold(table):
    """One expression of the streams (or expressions) of a group."""
    wrapper: list[tuple[str, bool, bool]] | None = None
    for what in sorted(table.column("what").to_pylist(), key=lambda x: (len(x), x)):
        slots_ = [(x[0], x[1] == "1", len(x) > 2 and x[2] == "1") for x in (y.split("\t") for y in what.split("\n") if y)]
        wrapper = slots_ if wrapper is None else align(wrapper, slots_)
    text = "\n".join(f"{p}\t{int(r)}\t{int(o)}" for p, r, o in wrapper or [])
    return pa.table({"host": table.column("host").slice(0, 1), "what": pa.array([text])})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template): lines of path, repeated, optional; and the slots of it that belong to the template."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    shapes = rows.mapInArrow(_observe, "host string, what string").distinct().withColumn("salt", F.pmod(F.xxhash64("what"), F.lit(32)))
    part = shapes.groupBy("host", "salt").applyInArrow(_fold, "host string, what string")
    whole = scratch.write(part.groupBy("host").applyInArrow(_fold, "host string, what string").withColumnRenamed("what", "wrapper"), "wrapper")
    texts = with_wrapper(rows, whole).select("host", "html", "wrapper").mapInArrow(_texts, "host string, slot bigint, text bigint, n bigint")
    texts = texts.where("slot >= 0").groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))
    fixed = texts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where(F.col("n") >= TEMPLATE_PAGES * F.col("texts"))
    template = scratch.write(fixed.groupBy("host").agg(F.collect_list("slot").alias("template")), "template")
    return scratch.write(whole.join(template, "host", "left"), "both")


def main_text(page: str | None, wrapper: str = "", template: set[int] = frozenset(), match: Matcher | None = None) -> str:
    """The article's blocks if there is an article, else all blocks, without junk and template.

    A page of nothing but template (copies of one page make up its host) is judged by its elements alone.
    """
    blocks = slots(page)
    at = (match or Matcher())(wrapper, blocks) if template else [-1] * len(blocks)
    clean = [(main, t, i in template) for i, (_, junk, main, t) in zip(at, blocks, strict=True) if not junk]
    clean = [x for x in clean if x[0]] or clean
    return "\n\n".join([t for _, t, known in clean if not known] or [t for _, t, _ in clean])


def _extract(batches):
    match = Matcher()
    for b in batches:
        text = [main_text(h.as_py(), w or "", frozenset(f or ()), match) for h, w, f in zip(b.column("html"), b.column("wrapper").to_pylist(), b.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
    give_back()


#: Bytes of wrappers that are broadcast at most; more are joined by host.
BROADCAST_BYTES = 8 << 20


def with_wrapper(rows: DataFrame, found: DataFrame) -> DataFrame:
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 64), F.lit(0))).first()[0]
    return rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars. A null or empty page, or one without main text, gives ''.

    A null url has the host ''. Repeated rows give repeated results, an empty table an empty one. Very long
    pages are read whole. Other columns, whatever their names, are ignored.
    """
    small_batches(pages.sparkSession, 500)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    got = with_wrapper(rows, wrappers(pages))
    return got.select("page_id", "url", "html", "wrapper", "template").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


#: The same rows for pages whose text is one article of paragraphs, list items and headings, with ASCII white space and no references but these two.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|li|ul|h1|div)\b[^>]*>'), lambda x:
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
