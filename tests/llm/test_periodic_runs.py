import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from kohorta.llm import queries
from kohorta.llm.periodic_runs import find_runs, periodic_runs, synchronising, with_planted_runs


def plain_runs(w, least=6, exponent=4):
    """Every period by itself, over all words."""
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                if not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                    out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out)


def plain_row(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    stays = [True] * len(w)
    for start, length, p in found:
        stays[start + p : start + length] = [False] * (length - p)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *top, sha256(lines.encode()).hexdigest(), sha256(" ".join(x for x, s in zip(w, stays, strict=True) if s).encode()).hexdigest())


def made_texts(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [r.randrange(r.choice([1, 2, 2, 3, 5, 40])) for _ in range(r.choice([0, 1, 5, 6, 7, 8, 12, 30, 80, 200]))]
        for _ in range(r.randrange(3)):
            if len(w) > 8:
                a, p = r.randrange(len(w)), r.randrange(1, len(w) // 4)
                for i in range(a, min(len(w), a + r.randrange(1, 12) * p + r.randrange(p))):
                    w[i] = w[a + (i - a) % p]
        out.append(w)
    return out


def test_runs_equal_brute_force():
    texts = made_texts(1500, 1)
    bounds = np.r_[0, np.cumsum([len(x) for x in texts])]
    found = find_runs(np.array([y for x in texts for y in x], dtype=np.int64), bounds)
    want = [(i, *r) for i, x in enumerate(texts) for r in plain_runs(x)]
    assert [tuple(x) for x in found.tolist()] == want
    assert max(r[3] for r in want) > 16  # several scales


def test_runs_of_nested_and_long_periods():
    block = [*range(5)] * 5 + [99]  # a run within every period of a longer one
    texts = [block * 6, [*range(1000)] * 4, [*range(1000)] * 4 + [0], ([0] * 50 + [1]) * 9, [7] * 100_000]
    bounds = np.r_[0, np.cumsum([len(x) for x in texts])]
    found = [tuple(x) for x in find_runs(np.array([y for x in texts for y in x], dtype=np.int64), bounds).tolist()]
    assert [x for x in found if x[0] == 0] == sorted([(0, i * 26, 25, 5) for i in range(6)] + [(0, 0, 156, 26)])
    assert [x for x in found if x[0] in (1, 2)] == [(1, 0, 4000, 1000), (2, 0, 4001, 1000)]
    assert [x for x in found if x[0] == 3] == sorted([(3, i * 51, 50, 1) for i in range(9)] + [(3, 0, 459, 51)])
    assert [x for x in found if x[0] == 4] == [(4, 0, 100_000, 1)]


def test_synchronising_positions_are_dense_and_consistent():
    r = np.random.default_rng(0)
    for t in (1, 2, 8, 32):
        h = r.integers(0, 2**62, 5000, dtype=np.uint64)
        h[3000:4000] = h[1000:2000]
        at = synchronising(h, t)
        assert np.diff(np.r_[-1, at, len(h)]).max() <= t + 1
        own = lambda low: {x - low for x in at if low <= x < low + 1000 - t}  # noqa: E731, B023
        assert own(1000) == own(3000)
        assert t < 8 or len(at) < 5000 * 4 / t


def test_a_smaller_exponent_is_refused():
    with pytest.raises(ValueError, match="exponent"):
        find_runs(np.zeros(3, dtype=np.int64), np.array([0, 3]), exponent=3)


def test_query_equals_brute_force(spark, tmp_path):
    texts = [" ".join(map(str, x)) for x in made_texts(300, 2)]
    texts += [None, "", " \t\n", "a " * 3000, "one\x0btwo\x1cthree", "é é " * 12, "x\r\ny\f" * 9, "ab " * 7 + "end"]
    rows = [(7 * i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "no id " * 5, "c", 0), (0, "again " * 8, "c", 0), (0, "again " * 8, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)


def test_operator_gives_runs_and_text(spark):
    docs = spark.createDataFrame([("x", "so " + "la la ti " * 4 + "da"), (None, None)], "name string, body string")
    rows = {r.name: r for r in periodic_runs(docs, text="body", key="name").collect()}
    assert [tuple(r) for r in rows["x"].runs] == [(1, 12, 3)] and rows["x"].collapsed == "so la la ti da" and rows["x"].n_words == 14
    assert rows[None].runs == [] and rows[None].collapsed == "" and rows[None].n_words == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(with_planted_runs(none)).count() == 0
