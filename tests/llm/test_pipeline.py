"""The pipeline against the plain versions of its stages, and on awkward tables."""

from __future__ import annotations

import brute
import pytest

from signalkiln.llm import decontaminate, quality_rules
from signalkiln.llm.queries import tokenizer_model

pipeline = pytest.importorskip("corpus_pipeline")


def plain(docs: list[tuple[int, str | None]], rules, items) -> dict[int, tuple[int, str, str]]:
    """All stages without Spark; rules tells of the statistics of a text whether the learned list keeps it."""
    import sentencepiece

    docs = [(i, t) for i, t in docs if not brute.statistics(t)[5] and rules(t)]
    where: dict[str, set[int]] = {}
    key = lambda x: x.strip(brute.SPACE).translate(brute.ASCII_LOWER)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                where.setdefault(key(x), set()).add(i)
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if not (len(where.get(key(x), ())) >= 5 and max(where[key(x)]) != i))) for i, t in docs]
    kept = brute.near(docs, 80)
    docs = [(i, t) for i, t in docs if kept[i][2]]
    out = []
    for i, t in docs:
        w = items.codes(t)
        if all(decontaminate.smith_waterman(x, w)[0] / (2 * len(x)) < decontaminate.MIN_SCORE for x in items.words):
            out.append((i, t))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    ids = {i: sp.encode(t, add_eos=True) for i, t in out}
    return {i: (len(x), brute.sha(" ".join(map(str, x))), brute.sha(sp.decode(x))) for i, x in ids.items()}


def test_pipeline_against_plain_versions(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn_from(docs, labels)

    def keeps(text):
        n, chars, symbols, *_ = brute.statistics(text)
        value = {"symbol_share": symbols / max(chars, 1), "n_words": n, "mean_word": chars / max(n, 1)}
        return not any(all(value[f] <= v if op == "<=" else value[f] > v for f, op, v in rule) for rule in rules.rules)

    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], keeps, items)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_columns_and_take_awkward_tables(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, None, None, None, "k", 1), (1, text, None, None, None, "k", 1), (None, text + " tail", "en", "s", 5, None, None), (2, None, None, None, None, "k", 2), (3, "", "en", "s", 0, "k", 3), (4, "short", "en", "s", 5, "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, words int")
    for table in (docs, docs.where("doc_id < 0")):
        now = table
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == docs.columns, name
        out = pipeline.STAGES[-1][1](spark, now, sf_dir)
        ids = [r.doc_id for r in out.collect()]
        assert sorted(x for x in ids if x is not None) == ([1, 1] if table is docs else []) and ids.count(None) == (1 if table is docs else 0)
