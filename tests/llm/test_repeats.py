import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, sha256(kept).hexdigest()))
    return out


def check(spark, texts, length, gram):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_report(docs, length=length, gram=gram).collect()}
    assert got == dict(enumerate(brute(texts, length)))


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_with_shared_passages(spark, seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abé \n") for _ in range(n))
    shared = [make(r.randrange(30, 150)) for _ in range(4)]
    texts = [make(r.randrange(0, 90)) + r.choice(shared) + make(r.randrange(0, 60)) + (r.choice(shared) if r.random() < 0.4 else "") for _ in range(40)]
    texts += [texts[3], texts[3], None, "", "a", "ab" * 300, "ba" * 200, "x" * 500, "x" * 90]
    edited = texts[5][:40] + "Q" + texts[5][41:]
    check(spark, [*texts, edited], 40, 12)


def test_production_length_on_real_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts[:120], repeats.LENGTH, repeats.GRAM)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(texts, length):
    """The texts without the repeated words and the white space after them, and how many runs went."""
    data = [(t or "").encode() for t in texts]
    words = [[m.span() for m in WORD.finditer(d)] for d in data]
    string = lambda d, w, i: tuple(d[a:b] for a, b in w[i : i + length])
    seen = Counter(string(d, w, i) for d, w in zip(data, words) for i in range(len(w) - length + 1))
    out = []
    for d, w in zip(data, words):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[string(d, w, i)] > 1:
                gone[i : i + length] = [True] * length
        starts = [a for a, _ in w] + [len(d)]
        cut = [False] * len(d)
        for i, g in enumerate(gone):
            if g:
                cut[starts[i] : starts[i + 1]] = [True] * (starts[i + 1] - starts[i])
        out.append((bytes(b for b, g in zip(d, cut) if not g).decode(), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


def check_words(spark, texts, length, gram):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute_words(texts, length)
    options = {"length": length, "gram": gram, "unit": repeats.WORD_UNIT}
    assert {r.doc_id: r.text for r in repeats.without_repeats(docs, **options).collect()} == {i: t for i, (t, _) in enumerate(want)}
    got = {r.doc_id: (r.kept_sha256, r.n_spans) for r in repeats.removal_report(docs, **options).collect()}
    assert got == {i: (sha256(t.encode()).hexdigest(), n) for i, (t, n) in enumerate(want)}


@pytest.mark.parametrize("seed", range(3))
def test_words_with_shared_passages(spark, seed, monkeypatch):
    r = random.Random(seed)
    part = lambda: r.choice([" ", "\n", "  ", "\t", " \r\n"])
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 4)))
    make = lambda n: "".join(word() + part() for _ in range(n))
    shared = [make(r.randrange(8, 40)) for _ in range(4)]
    texts = [make(r.randrange(0, 30)) + r.choice(shared) + make(r.randrange(0, 20)) + (r.choice(shared) if r.random() < 0.4 else "") for _ in range(40)]
    texts += [texts[3], None, "", " ", "\n a", "a b " * 60, "b a " * 50, "x " * 9, "x" * 3000 + " y " * 12, "x" * 3000 + " y " * 11, "\x1cfoo bar " * 7]
    check_words(spark, [*texts, texts[5].replace(" ", "\n")], 8, 3)


def test_production_words_on_real_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    check_words(spark, texts, repeats.WORDS, repeats.WORD_GRAM)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(("ab cd  " + "q" * 3000 + " " + "é" * 300 + " z " * 400).encode(), np.uint8)
    first, end, bounds = repeats.word_places(data, np.array([0, 4, len(data)]))
    assert bounds.tolist() == [0, 2, len(first)] and data[first[1] : end[1]].tobytes() == b"c"
    whole = repeats.word_hashes(data, first, end)
    monkeypatch.setattr(repeats, "PIECE", 50)
    assert repeats.word_hashes(data, first, end).tolist() == whole.tolist()
    assert len(set(whole.tolist())) == 6
    for none in (b"", b" \n"):
        data = np.frombuffer(none, np.uint8)
        assert [len(x) for x in repeats.word_places(data, np.array([0, 0, len(data)]))] == [0, 0, 3]


def test_unknown_units_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="unknown unit"):
        repeats.removal_report(docs, unit="line")
    with pytest.raises(ValueError, match="don't fit"):
        repeats.removal_report(docs, length=3, gram=4)


def test_pieces_of_long_documents(spark, monkeypatch):
    r = random.Random(9)
    a = "".join(r.choice("abcdefgh ") for _ in range(5000))
    texts = [a, "zz" + a[1000:4200] + "yy", "q" * 10]
    data = [t.encode() for t in texts]
    whole = repeats.Hasher(8000)
    found = []
    for i, d in enumerate(data):
        x = np.frombuffer(d, np.uint8)
        for at in range(0, max(1, len(x) - 40 + 1), 700 - 40 + 1):
            doc, start, count, *_ = repeats.runs(whole, x[at : at + 700], np.array([0, len(x[at : at + 700])]), 40, 12)
            found += [(i, s + at + j) for s, c in zip(start, count) for j in range(c)]
    assert sorted(found) == [(i, s) for i, d in enumerate(data) for s in range(len(d) - 40 + 1)]


def test_nulls_repeated_rows_and_other_columns(spark):
    long = "word and " * 60
    rows = [(None, long, "x"), (1, long, "y"), (1, long, "y"), (2, None, None), (3, "short", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = repeats.without_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.text, r.spans or "") for r in out) == [(-1, "", "x"), (1, "", "y"), (1, "", "y"), (2, "", ""), (3, "short", "z")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removal_report(empty).count() == 0


def test_merged():
    first, end = repeats.merged(np.array([5, 0, 3, 20]), np.array([9, 4, 6, 22]))
    assert first.tolist() == [0, 20] and end.tolist() == [9, 22]


def test_many_equal_rows_take_linear_time(spark):
    import time

    text = " ".join(f"word{i}" for i in range(400))
    began = time.time()
    docs = spark.range(16_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(8, "other " + text[:100])], "doc_id long, text string"))
    rows = repeats.removal_report(docs).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in rows} == {(7, len(text), 1, 16_000), (8, 0, 0, 1)}
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(2))
def test_report_counts_repeated_words_beside_removed_bytes(spark, seed):
    r = random.Random(seed)
    make = lambda n: "".join("".join(r.choice("abé") for _ in range(r.randrange(1, 4))) + r.choice([" ", "\n", "  "]) for _ in range(n))
    shared = [make(r.randrange(8, 40)) for _ in range(4)]
    texts = [make(r.randrange(0, 30)) + r.choice(shared) + make(r.randrange(0, 20)) + (r.choice(shared) if r.random() < 0.4 else "") for _ in range(40)]
    texts += [texts[3], None, "", "a b " * 60, "x" * 90, "x" * 90, texts[5].replace(" ", "\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = lambda t: len(WORD.findall((t or "").encode()))
    want = {
        i: (*of_bytes, n(t) - n(left), passages)
        for i, (t, of_bytes, (left, passages)) in enumerate(zip(texts, brute(texts, 40), brute_words(texts, 8), strict=True))
    }
    assert {x.doc_id: tuple(x)[1:] for x in repeats.removal_report(docs, length=40, gram=12, words=8).collect()} == want


def test_query_reports_planted_passages_of_over_50_words(spark, tmp_path):
    """51 to 53 words that two documents share: fewer than 400 bytes, so that none is removed, and reported all the same."""
    from kohorta.llm.queries import op9_repeated_passages

    r = random.Random(11)
    words = lambda n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    clean = {i: " ".join(words(120)) for i in range(30)}
    passages = [words(51 + i % 3) for i in range(10)]
    planted = {100 + 2 * i + k: " ".join(words(70) + p + words(70)) for i, p in enumerate(passages) for k in (0, 1)}
    rows = list((clean | planted).items())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = op9_repeated_passages(spark, str(tmp_path))
    assert made.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeat_words", "n_passages"]
    got = {x.doc_id: tuple(x)[1:] for x in made.collect()}
    assert {d: x[:4] for d, x in got.items()} == dict(zip([d for d, _ in rows], brute([t for _, t in rows], repeats.LENGTH), strict=True))
    assert all(max(map(len, map(" ".join, passages))) < repeats.LENGTH and got[d][1] == 0 for d in got)
    assert {d: x[4:] for d, x in got.items()} == {d: (0, 0) for d in clean} | {100 + 2 * i + k: (len(p), 1) for i, p in enumerate(passages) for k in (0, 1)}


def test_report_leaves_busy_runs_and_settings_only(spark):
    """All runs go once those with a common anchor are stored, and the session's setting is as it was."""
    from pathlib import Path

    from kohorta.llm.common import shared_dir

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(name), set(Path(shared_dir(spark).removeprefix("file://"), "kohorta").glob("*"))
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    made = repeats.removal_report(docs, words=repeats.WORDS)
    new = set(Path(shared_dir(spark).removeprefix("file://"), "kohorta").glob("*")) - there
    assert sorted(x.name.rsplit("-", 1)[0] for x in new) == ["busy", "busy"] and spark.conf.get(name) == before
    assert {tuple(x)[2:4] + tuple(x)[5:] for x in made.collect()} == {(len(text), 1, 200, 1)}
