import random
from collections import defaultdict

import numpy as np

from kohorta.llm import near_duplicates as N
from kohorta.llm.components import components


def shingle_set(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, similarity=0.8):
    """Least id of each document's class; classes link equal word sequences' texts and similar sets."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    shared = defaultdict(int)
    for v in at.values():
        for j, a in enumerate(v):
            for b in v[j + 1 :]:
                shared[a, b] += 1
    links = [p for p, n in shared.items() if n >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    same = defaultdict(list)
    for i, (_, t) in enumerate(docs):
        same[t or ""].append(i)
    links += [(v[0], x) for v in same.values() for x in v[1:]]
    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def got(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = N.near_duplicate_classes(df).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: r.class_id for r in rows}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnopqrst") + r.choice("uvwxyz")
    base = [[word() for _ in range(r.randrange(60, 160))] for _ in range(40)]
    out = [" ".join(w) for w in base]
    for w in base[:15]:
        for _ in range(r.randrange(1, 5)):
            v = list(w)
            for _ in range(r.randrange(0, 5)):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v))
    hub = [word() for _ in range(120)]
    for i in range(60):  # copies that are near the hub and not always near each other
        v = list(hub)
        for _ in range(2):
            v[r.randrange(len(v))] = word()
        out.append(" ".join(v))
    out += [" ".join(hub), "", None, "one", "one", "one two three four", "  one", "x " * 400, "x " * 380]
    return list(enumerate(out))


def test_classes_equal_brute_force(spark):
    docs = corpus()
    assert got(spark, docs) == brute(docs)


def test_unequal_repeats_of_lines(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    docs = []
    for i in range(120):  # near copies, one of which repeats a passage of them 50 or 200 times
        shared, line = [word() for _ in range(90)], [word() for _ in range(10)]
        docs.append(" ".join([word() for _ in range(6)] + shared + line * 2))
        docs.append(" ".join(shared + line * (50 if i % 2 else 200) + [word() for _ in range(6)]))
    docs = list(enumerate(docs))
    want = brute(docs)
    assert all(want[2 * i + 1] == 2 * i for i in range(120))
    assert got(spark, docs) == want


def test_real_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(spark, docs) == brute(docs)


def test_first_of_each_keeps_columns_and_one_row(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(4, text, "a"), (2, text, "b"), (2, text, "b"), (9, text + " tail", "c"), (7, None, "d"), (8, "", "e"), (None, "other words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert sorted(map(str, map(tuple, N.first_of_each(docs).collect()))) == sorted(map(str, [(2, text, "b"), (7, None, "d"), (None, "other words", "f")]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicate_classes(empty).count() == 0


def test_signatures_estimate_the_probability_similarity():
    r = np.random.default_rng(5)
    ids = N.mix(np.arange(300, dtype=np.uint64))
    wa, wb = r.integers(1, 6, 300).astype(float), r.integers(1, 6, 300).astype(float)
    wa[200:], wb[:60] = 0, 0
    exact = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(300)) for i in range(300) if wa[i] and wb[i])
    doc = np.r_[np.zeros(200, int), np.ones(240, int)]
    s = N.signatures(doc, np.r_[ids[:200], ids[60:]], np.r_[wa[:200], wb[60:]], 2, 4000)
    assert abs((s[0] == s[1]).mean() - exact) < 0.03


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 301), (301, 300)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(80)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_recall_by_similarity(spark):
    """Of planted pairs at 0.8 and above at least nine in ten are found in every band of similarity, and none below."""
    r = random.Random(11)
    rows, pairs = [], []
    for i in range(240):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for at in r.sample(range(2, 198, 6), 1 + i % 6):  # far apart, so that each changes five shingles of its own
            other[at] = f"x{r.randrange(10**6)}"
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
        pairs.append((2 * i, 2 * i + 1, len(a & b) / len(a | b)))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = {x.doc_id: x.class_id for x in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [found[a] == found[b] for a, b, s in pairs if low <= s < high]
        assert len(own) >= 40 and sum(own) >= 0.9 * len(own)
    below = [found[a] == found[b] for a, b, s in pairs if s < 0.8]
    assert below and not any(below)


def test_blocks_pair_all_nodes_of_a_bucket_once(spark):
    """Of any bucket, larger than a block or not, each pair of nodes is compared once, and no key holds many of them."""
    rows = [(b, f"{b}-{i}", f"{i}", 9, 0, 0, 0) for b, n in ((1, 60), (2, 7), (3, 1)) for i in range(n)]
    rest = spark.createDataFrame(rows, "bucket long, node string, part string, size int, own int, lacks int, extra int")
    left, right = N._blocks(rest, 7)
    met = left.join(right, ["bucket", "low", "high"]).where("low != high OR node < other_node").select("node", "other_node").collect()
    pairs = [tuple(sorted(p)) for p in met]
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2 + 7 * 6 // 2
    most = left.groupBy("bucket", "low", "high").count().agg({"count": "max"}).first()[0]
    assert most < 3 * 7


def test_chains_of_neighbours_in_small_blocks(spark):
    """Texts that slide over a word list are near their neighbours only, so that a bucket's nodes stay undecided to the end."""
    r = random.Random(3)
    docs = []
    for _ in range(6):
        words = [f"w{r.randrange(10**6)}" for _ in range(600)]
        docs += [" ".join(words[i : i + 120]) for i in range(0, 480, 8)]
    docs = list(enumerate(docs))
    r.shuffle(docs)
    want = brute(docs)
    assert len(set(want.values())) == 6
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (2, N.BLOCK):
        assert {x.doc_id: x.class_id for x in N.near_duplicate_classes(df, block=block).collect()} == want
