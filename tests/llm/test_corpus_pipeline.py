import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from kohorta.llm import quality_rules, repeats  # noqa: E402

from .test_near_duplicates import brute as classes  # noqa: E402
from .test_other_operators import contained, plain_ids  # noqa: E402
from .test_quality_rules import brute as statistics  # noqa: E402
from .test_repeats import brute_words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fits(rule, text):
    n, chars, symbols, lines, repeated = statistics(text)
    upper, marks = sum(c.isupper() for c in text), sum(c in "!?" for c in text)
    part = {"word_length": (chars, n), "symbols": (symbols, n), "dup_lines": (lines, n), "repeat_words": (repeated, n), "upper": (upper, chars), "marks": (marks, n)}
    values = {k: a * 1000 // max(b, 1) for k, (a, b) in part.items()} | {"n_words": n, "n_dup_lines": lines}
    return all((values[c.feature] > c.cut) == c.above for c in rule.conditions)


def plain(rows, rules, items):
    """The stages one after the other, without Spark; rows are (doc_id, text) with ids of their own."""
    good = []
    for d, t in rows:
        n, *_, repeated = statistics(t)
        if n >= 50 and 100 * repeated <= 50 * n and not any(fits(r, t) for r in rules):
            good.append((d, t))
    found = classes(good)
    good = [(d, t) for d, t in good if found[d] == d]
    cut = brute_words([t for _, t in good], repeats.WORDS)
    good = [(d, t) for (d, _), (t, _) in zip(good, cut, strict=True) if t.strip(" ")]
    bad = {d for d, *_ in contained(good, items)}
    return {d: t for d, t in good if d not in bad}


def test_all_stages_equal_brute_force(spark, sf_dir):
    made = corpus_pipeline.run(spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rules = quality_rules.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = plain(docs, rules, items)
    assert 0 < len(want) < len(docs)
    pieces = {}
    for r in made:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want)
    for d, text in want.items():
        ids, at = plain_ids(text), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)


def write(spark, folder, docs, labels=(), items=(), schema=SCHEMA):
    spark.createDataFrame(list(docs), schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_planted_cases(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
    words = lambda n: [word() for _ in range(n)]
    clean = {i: " ".join(words(120)) for i in range(60)}
    passages = [words(51 + i % 3) for i in range(10)]
    planted = {}
    for i, p in enumerate(passages):  # each in two documents, 51 to 53 words long
        for k in (0, 1):
            planted[100 + 2 * i + k] = " ".join(words(70) + p + words(70))
    copies = {200: clean[0], 201: clean[1] + " tail", 202: " ".join(clean[2].split()[:-3] + words(3))}
    items = [(i, " ".join(words(12))) for i in range(5)]
    leaks = {300 + i: " ".join([*words(60), items[i][1], *words(60)]) for i in range(5)}
    docs = [(d, t, "en", "s", len(t)) for d, t in (clean | planted | copies | leaks).items()]
    folder = write(spark, tmp_path / "in", docs, items=items)
    source = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    apart = stages["near-duplicates"](spark, stages["quality rules"](spark, source, folder), folder)
    assert {x.doc_id for x in apart.collect()} == set(clean) | set(planted) | set(leaks)
    cut = {x.doc_id: x for x in stages["repeated passages"](spark, apart, folder).collect()}
    assert all(cut[d].text == clean[d] for d in clean)
    assert all(" ".join(p) not in x.text and cut[100 + 2 * i].n_chars == len(cut[100 + 2 * i].text) for i, p in enumerate(passages) for x in cut.values())
    assert all(len(cut[d].text.split()) == 140 for d in planted)
    left = {x.doc_id for x in corpus_pipeline.run(spark, folder).collect()}
    assert left == set(clean) | set(planted)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    text = lambda seed: " ".join(f"w{seed}x{i}" for i in range(60))
    rows = [(None, text(1), "a", 1), (1, text(2), "b", 2), (1, text(2), "b", 2), (1, text(3), None, None), (2, None, "c", 3), (3, "", "d", 4), (4, text(5) + " " + "long " * 20, "e", 5)]
    schema = "doc_id long, text string, head string, spans int"
    folder = write(spark, tmp_path / "odd", rows, schema=schema)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "head", "spans"]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted([rows[0], rows[1], rows[3], rows[6]], key=str)
    empty = write(spark, tmp_path / "empty", [], schema=schema)
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, folder).agg(F.countDistinct("sequence_id")).first()[0] >= 1
