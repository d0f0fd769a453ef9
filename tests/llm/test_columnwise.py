import random
from collections import Counter

import pytest

from kohorta.llm import columnwise


def brute_starts(texts, length):
    data = [t or b"" for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    return [[i for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1] for d in data]


def collection(seed):
    r = random.Random(seed)
    make = lambda n: bytes(r.choice(b"ab\x00\xff\n") for _ in range(n))
    shared = make(30)
    return [make(r.randrange(60)) + r.choice([shared, b""]) + make(r.randrange(20)) for _ in range(12)] + [shared, shared, b"", None, b"a", b"ab" * 30, b"z" * 45]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(seed, tmp_path, monkeypatch):
    monkeypatch.setattr(columnwise, "BLOCK", 7)
    texts = collection(seed)
    assert columnwise.repeated_starts(texts, 9, str(tmp_path)) == brute_starts(texts, 9)


def test_order_transform_and_common_prefixes(tmp_path):
    texts = collection(5)
    made = columnwise.Construction(texts, str(tmp_path)).run()
    rows = [tuple(x) for rows in columnwise._rows(made.paths()) for x in rows.tolist()]
    # the end of document i is smaller than every symbol and than the end of document i + 1
    key = lambda d, p: [*(c + 1000 for c in (texts[d] or b"")[p:]), d]
    want = sorted(((d, p) for d, t in enumerate(texts) for p in range(len(t or b"") + 1)), key=lambda x: key(*x))
    assert [x[:2] for x in rows] == want
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(key(*a), key(*b), strict=False)) if x != y), 0)
    assert [x[2] for x in rows] == [0, *(common(a, b) for a, b in zip(want, want[1:], strict=False))]
    assert made.transform() == bytes(texts[d][p - 1] if p else 0 for d, p in want)


def test_an_empty_collection(tmp_path):
    assert columnwise.repeated_starts([], 4, str(tmp_path)) == []
