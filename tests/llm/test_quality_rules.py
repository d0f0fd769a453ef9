import re
from collections import Counter

import pytest

from kohorta.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [
    None, "", " \n\t ", "one", "a b c", "a b c a b c", "a a a a a", "a\x0bb\x0cc\rd e f", "x\nx\n \n\nx \nx", "é " * 70, "#*$%&|<> " * 60,
    "\n".join(["same line of words"] * 9), "the cat sat " * 400, " ".join(map(str, range(3000))) + " " + " ".join(map(str, range(500))),
]


def test_statistics_equal_brute_force(spark, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = ODD + real
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in Q.statistics(docs).collect():
        assert tuple(r._statistics[n] for n in names) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_base_rules(spark):
    texts = ["w " * 49, " ".join(map(str, range(50))), "a b c d " * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in Q.statistics(docs).select("doc_id", Q.base_failed().alias("f")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_learns_thresholds_and_leaves_clean_rows_alone():
    rows = [({"a": i % 50, "b": i % 7}, i % 50 > 40 and i % 7 < 3) for i in range(700)]
    rules = Q.learn_rows(rows)
    assert rules
    fits = lambda f: any(all((f[c.feature] > c.cut) == c.above for c in r.conditions) for r in rules)
    assert all(fits(f) == bad for f, bad in rows)


def test_one_class_or_nothing_gives_no_rules(spark):
    assert Q.learn_rows([]) == [] and Q.learn_rows([({"a": 1}, True)] * 9) == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.learn(docs, labels)
    assert rules == [] and Q.judge(docs, rules).count() == 0


def test_verdict_equals_rules_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.learn(docs, labels.where("doc_id % 2 = 0"))
    judged = Q.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where(~Q.base_failed())
    rows = judged.select("quality", "_kept").collect()
    right = sum((r.quality == 1) == r._kept for r in rows)
    assert right >= 0.97 * len(rows)


def test_clashing_columns_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 5, "x"), (1, text, 5, "x"), (2, None, None, None)], "doc_id long, text string, _kept int, _statistics string")
    assert [tuple(r) for r in Q.kept_documents(docs, []).collect()] == [(1, text, 5, "x")] * 2


@pytest.mark.parametrize("bound", [1, 50])
def test_sample_bound(spark, bound):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert isinstance(Q.learn(docs, labels, max_labelled=bound), list)
