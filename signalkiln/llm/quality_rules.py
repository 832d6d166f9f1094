"""Quality rules: a learned decision list over text statistics, applied as one Spark expression.

The statistics are column expressions. The list is learned by sequential covering from the labelled rows
that the base rules let pass: a conjunction of thresholds grows by information gain on two thirds of
them, is pruned on the rest, and the rows it covers leave before the next one grows. A rule that does
not hold on the rest bars its first test, and the next best is tried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Labelled rows that a list is learned from at most (those of the least hashes).
MAX_LABELS = 20_000
#: A rule is taken if this share of the rows it covers is of low quality, on the pruning rows and on all.
MIN_PRECISION = 0.9
#: Rows that a rule covers at least, and failed rules after which learning ends.
MIN_COVER, MAX_FAILED = 5, 12
_BLANK = r"[\x20\x09-\x0D]"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "long_line_share", "upper_share", "digit_share")


#: Different repeated windows of a text up to which each window is looked up in their list; beyond it windows are sorted with their places.
FEW = 24


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK + "+", -1))


def _covered(places: Column) -> Column:
    """Words inside the 3-word windows at ``places`` (ascending)."""
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("p"), (a.n + F.least(F.lit(3), p - a.p)).alias("n")), lambda a: a.n)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def by_list(g: Column, twice: Column) -> Column:
        return _covered(F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull()))

    def by_sort(g: Column) -> Column:
        some = let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x.g, F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x.g, F.lit(False))))
        return _covered(F.sort_array(F.transform(some, lambda x: x.i)))

    def count(g: Column) -> Column:
        twice = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, F.greatest(k - 1, F.lit(0)))))))
        found = let(twice, lambda t: F.when(F.size(t) <= FEW, by_list(g, t)).otherwise(by_sort(g)))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(found)

    def grams(w: Column) -> Column:
        n = F.size(w)
        trios = F.arrays_zip(F.slice(w, F.lit(1), n - 2), F.slice(w, F.lit(2), n - 2), F.slice(w, F.lit(3), n - 2))
        return F.when(n >= 3, let(F.transform(trios, lambda t: F.xxhash64(t)), count)).otherwise(F.lit(0).cast("bigint"))

    return F.coalesce(let(words, grams), F.lit(0).cast("bigint"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id and the statistics of each text; a null text has no words. No shuffle, no Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def line_stats(lines: Column) -> Column:
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("dup"), F.size(lines).cast("bigint").alias("n"), F.size(F.filter(lines, lambda x: F.length(x) > 200)).cast("bigint").alias("long"))

    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), line_stats)
    words = let(_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("rep")))
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]+", "")).cast("bigint")
    raw = docs.select(
        F.col(id_col).alias("doc_id"), *keep, words.alias("w"), lines.alias("l"),
        F.length(F.regexp_replace(text, _BLANK + "+", "")).cast("bigint").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), count("A-Z").alias("n_upper"), count("0-9").alias("n_digits"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return raw.select(
        "doc_id", *keep, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"),
        share("word_chars", "w.n").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"), share("l.dup", "l.n").alias("dup_line_share"),
        share("w.rep", "w.n").alias("repeat_share"), share("l.long", "l.n").alias("long_line_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_digits", "word_chars").alias("digit_share"),
    )


@dataclass
class DecisionList:
    """Ordered rules; the first that covers a row rejects it, the rest are kept."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def verdict(self) -> Column:
        out = None
        for rule in self.rules:
            c = None
            for name, op, value in rule:
                t = F.col(name) <= value if op == "<=" else F.col(name) > value
                c = t if c is None else c & t
            out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(" AND ".join(f"{n} {o} {v:.6g}" for n, o, v in r) + " -> reject" for r in self.rules) or "keep all"


def _cover(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for j, op, v in rule:
        m &= x[:, j] <= v if op == "<=" else x[:, j] > v
    return m


def _grow(x: np.ndarray, bad: np.ndarray, g: np.ndarray, barred: set, max_tests: int) -> list[tuple[int, str, float]]:
    """The conjunction of best information gain on the rows ``g``; its first test is none of ``barred``."""
    rule: list[tuple[int, str, float]] = []
    inside = g.copy()
    while len(rule) < max_tests:
        pos, n = (bad & inside).sum(), inside.sum()
        if not pos or pos == n:
            break
        base, best = np.log2(pos / n), (0.0, None)
        for j in range(x.shape[1]):
            v, lost = x[inside, j], bad[inside]
            cuts = np.unique(np.concatenate([np.quantile(v, np.linspace(0.01, 0.99, 60)), np.quantile(v[lost], np.linspace(0, 1, 20))]))
            for q in cuts:
                for op in ("<=", ">"):
                    if not rule and (j, op) in barred:
                        continue
                    m = v <= q if op == "<=" else v > q
                    k, b = m.sum(), (lost & m).sum()
                    if k >= 3 and b:
                        gain = b * (np.log2(b / k) - base)
                        if gain > best[0] + 1e-9:
                            above = v[v > q]
                            best = (gain, (j, op, float(q if not len(above) else (q + above.min()) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = g & _cover(x, rule)
    return rule


def _tightest(rule: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    """Of several bounds of one kind on a feature the one that covers least."""
    bound: dict[tuple[int, str], float] = {}
    for j, op, v in rule:
        bound[j, op] = v if (j, op) not in bound else min(bound[j, op], v) if op == "<=" else max(bound[j, op], v)
    return [(j, op, v) for (j, op), v in bound.items()]


def learn(x: np.ndarray, bad: np.ndarray, names: tuple = FEATURES, min_precision: float = MIN_PRECISION, max_rules: int = 12, max_tests: int = 3) -> DecisionList:
    """Sequential covering on rows ``x`` with ``bad`` true for low quality."""
    out = DecisionList()
    grow_set, left = np.arange(len(x)) % 3 != 0, np.ones(len(x), bool)
    barred: set[tuple[int, str]] = set()

    def share(rows: np.ndarray) -> float:
        return bad[rows].mean() if rows.any() else 0.0

    while len(out.rules) < max_rules and len(barred) < MAX_FAILED:
        g, p = left & grow_set, left & ~grow_set
        rule = _grow(x, bad, g, barred, max_tests)
        if not rule:
            break
        while len(rule) > 1 and share(p & _cover(x, rule[:-1])) >= share(p & _cover(x, rule)):
            rule = rule[:-1]
        m = left & _cover(x, rule)
        if m.sum() < MIN_COVER or min(share(m), share(m & ~grow_set)) < min_precision:
            barred.add(rule[0][:2])
            continue
        out.rules.append([(names[j], op, v) for j, op, v in _tightest(rule)])
        left &= ~m
        barred.clear()
    return out


def learn_from(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DecisionList:
    """A list from labels (doc_id, quality 0/1) of ``docs`` that the base rules keep; without usable labels it keeps all."""
    some = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(max_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled"))
    # the bounded sample is filtered and ordered here, so that its statistics are computed once
    table = statistics(rows, keep=("quality",)).select(F.xxhash64("doc_id").alias("hash"), "doc_id", "n_repeat_words", "quality", *FEATURES).toPandas()
    table = table[(table.n_words >= 50) & (100 * table.n_repeat_words <= 50 * table.n_words)].sort_values(["hash", "doc_id", *FEATURES, "quality"])
    if not len(table) or table.quality.nunique() < 2:
        return DecisionList()
    return learn(table[list(FEATURES)].to_numpy(float), (table.quality == 0).to_numpy())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, statistics, base_failed, kept.

    Null and wordless texts fail the base rules. Repeated rows give repeated results, an empty table an
    empty one; very long texts are judged whole. Labels of unknown or null ids are left out, and several
    labels of one id are several rows to learn from. Other columns, whatever their names, are ignored.
    """
    rules = learn_from(docs, labels)
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, columns as they are; see ``judge`` for nulls, ties and empty tables."""
    rules = learn_from(docs, labels)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))
    return statistics(whole, keep=("row",)).where(~base_failed() & rules.verdict()).select("row.*")
