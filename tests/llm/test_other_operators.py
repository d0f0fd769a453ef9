import json
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kohorta.llm import archives, decontamination, near_duplicates, packing, token_files, token_rollup, url_rules, wrappers
from kohorta.llm.common import shared_path
from kohorta.llm.tokenizing import Encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "one", "a\x1cb", "don't stop, it's 'em", "ΑΣ ΒΣ!", "é ́x é", "foo<|endoftext|>bar", "a b c　d\x85e", "日本語 テキスト", "word " * 5000, "x" * 9000]


def plain_ids(text):
    from tokenizers import Tokenizer

    plain_ids.t = getattr(plain_ids, "t", None) or Tokenizer.from_file(TOKENIZER)
    return [*plain_ids.t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()][:80]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(3 * i, t, "src", "en", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, shard string")


def test_encoder_equals_whole_texts(texts):
    e = Encoder(TOKENIZER)
    for _ in range(2):
        for t, ids in zip(texts, e.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer_on_random_texts():
    from tokenizers import Tokenizer

    r = random.Random(1)
    parts = [*"abcXYZéÈßÿĀİıŉǅɏɐµªº .,!?-()&*'’_0123\t\n\x1c\x1f\x85\u00a0\u3000中文\u0301<|>", "<|endoftext|>", "'s", "'ll", " ", " ", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(5000)]
    plain = Tokenizer.from_file(TOKENIZER)
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    e = Encoder(TOKENIZER, None)
    assert [*e.ids(texts[:2500]), *e.ids(texts[2500:])] == want
    assert e.ids(texts) == want  # with all of it looked up


def test_token_files_round_trip(spark, docs, texts):
    folder = shared_path(spark, "test-tokens")
    files = token_files.write_store(docs, TOKENIZER, folder, partitions=3).cache()
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = plain_ids(t)
        want[3 * i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in token_files.read_store(files, folder).collect()} == want
    assert token_files.read_document(spark, files, folder, 9) == [plain_ids(texts[3])]
    assert token_files.read_document(spark, files, folder, 10) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(empty, TOKENIZER).count() == 0
    twice = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in token_files.round_trip(twice, TOKENIZER).collect()) == [(0, None), (1, 5), (4, 5)]


def test_a_part_of_another_dictionary_is_refused(spark, docs, tmp_path):
    folder = shared_path(spark, "test-tokens")
    uri = token_files.write_store(docs, TOKENIZER, folder).first().uri
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Part(uri, token_files.Codec(b""))


def test_packing_holds_every_id_once(docs, texts):
    rows = packing.packed(docs, TOKENIZER, shards=3).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = plain_ids(t), 0
        for r in sorted(by_doc[3 * i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW


def test_best_fit_equals_a_plain_search():
    r = random.Random(3)
    lengths = sorted((r.randint(1, 64) for _ in range(500)), reverse=True)
    rooms, used = [], {}
    for n in lengths:
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        i = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(64)
        rooms[i] -= n
    for (s, at), n in zip(packing.best_fit(lengths, 64), lengths, strict=True):
        assert used.get(s, 0) == at
        used[s] = at + n
    assert sorted(64 - u for u in used.values()) == sorted(rooms)
    assert packing.padded_length(512) == 512 and packing.padded_length(513) == 2048


PAGES = [
    (1, "http://a.com/x", "p" * 150), (2, "http://b.com/x", "p" * 150), (3, None, "p" * 150), (4, "http://a.com/x?q=1", "short"),
    (5, "http://a.com/y", "short"), (6, "no scheme", None), (7, "http://a.com/x", "é\r\n\r\n" * 60), (7, "http://a.com/x", "é\r\n\r\n" * 60),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    rows = sorted(tuple(r) for r in archives.round_trip(pages).collect())
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = min(j for j, _, g in PAGES if g == h)
        revisit = len(data) >= 100 and first != i
        want.append((i, len(data), sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert rows == sorted(want)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.round_trip(empty).count() == 0


def test_capture_index_finds_across_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example.com/{i % 7}", f"page {i}") for i in range(300)], "page_id long, url string, html string")
    parts = archives.write_archives(pages, shared_path(spark, "test-warc"), block_lines=4)
    index = archives.CaptureIndex([(r.first, r.uri) for r in parts.collect()])
    found = [index.read(p) for p in index.places("com,example,h3)/2")]
    assert sorted(f["page"] for f in found) == [i for i in range(300) if i % 5 == 3 and i % 7 == 2]
    assert all(f["payload"] == f"page {f['page']}".encode() for f in found)
    assert list(index.places("com,example,h3)/9")) == [] and list(index.places("")) == []


def test_archives_are_plain_warc(spark):
    data = archives.record(5, "http://a.com/ b", b"<p>", "0" * 64, None)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>\r\n\r\n")
    import gzip

    assert list(archives.records(gzip.compress(b"a") + gzip.compress(b"b"))) == [b"a", b"b"]


def grams(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def contained(docs, items):
    """The best containment of each document id and item id, over their rows."""
    out = {}
    for i, t in items:
        k = min(5, len((t or "").split()))
        s = grams(t, k) if k else set()
        for d, u in docs:
            n = len(s & grams(u, k)) if s else 0
            if s and n >= 0.8 * len(s) - 1e-9:
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (n / len(s), n, len(s)))
    return {(*k, n, m) for k, (_, n, m) in out.items()}


def test_containment_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda: r.choice("abcdefgh") + r.choice("ijklmnop") + r.choice("qrstuv")
    items = [(i, " ".join(word() for _ in range(r.randrange(3, 70)))) for i in range(30)] + [(30, None), (31, ""), (32, "The same words here are the same words here are")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.randrange(0, 300))]
        if d % 2:
            v = r.choice(items)[1] or ""
            v = v.split()
            for _ in range(r.randrange(0, 3)):
                if v:
                    v[r.randrange(len(v))] = word()
            w[len(w) // 2 : len(w) // 2] = v
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a b c d")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int")
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc int")
    got = {(x["doc"], x["item"], x.n_shared, x.n_item) for x in decontamination.contained_items(df, it).collect()}
    want = contained(docs, items)
    assert got == want and len(want) > 20 and any(n == 1 for *_, n in want)
    left = {x.doc_id for x in decontamination.clean_documents(df, it).collect()}
    assert left == {d for d, _ in docs} - {d for d, *_ in want}
    assert decontamination.contained_items(df, it.limit(0)).count() == 0 and decontamination.contained_items(df.limit(0), it).count() == 0


def test_the_bit_table_passes_all_sketch_values_and_few_others(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sketch = decontamination.sketches(decontamination.item_shingles(items)).cache()
    table = decontamination.bit_table(sketch, sketch.count())
    assert len(table) & (len(table) - 1) == 0 and 64 * len(table) >= 32 * sketch.count()
    values = sketch.select(F.collect_set("shingle").alias("s"))
    assert values.select(F.size(decontamination.passing(F.col("s"), table)) == F.size("s")).first()[0]
    other = spark.range(100_000).select(F.collect_list(F.xxhash64(F.col("id") + 7)).alias("s"))
    assert other.select(F.size(decontamination.passing(F.col("s"), table))).first()[0] < 100_000 / 25
    sketch.unpersist()
    assert decontamination.bit_table(sketch.limit(0), 0) == [0] * (decontamination.LEAST_BITS // 64)


def test_rows_that_share_an_id_are_not_pooled(spark):
    item = " ".join(f"w{i}" for i in range(9))
    docs = [(1, " ".join(f"w{i}" for i in range(7)) + " x"), (1, "y " + " ".join(f"w{i}" for i in range(2, 9))), (2, item), (2, "clean text of more than five words"), (2, item), (3, item + " " + "long " * 30_000)]
    items = [(7, item), (8, "other words than those of the item here"), (8, item), (9, "clean text"), (9, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc"], x["item"], x.n_shared, x.n_item) for x in decontamination.contained_items(df, it).collect()}
    assert got == contained(docs, items) == {(2, 7, 5, 5), (2, 8, 5, 5), (3, 7, 5, 5), (3, 8, 5, 5), (2, 9, 1, 1)}
    assert [tuple(x) for x in decontamination.clean_documents(df, it.where("item_id = 7")).orderBy("text").collect()] == sorted([docs[0], docs[1], docs[3]], key=lambda x: x[1])


def test_documents_without_ids_are_decontaminated(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, f"begin {item} end"), (None, "clean text of more than five words"), (None, f"again {item}"), (None, None), (1, item), (2, "other clean text of some more words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(map(tuple, decontamination.contained_items(df, it).collect()), key=str) == [(1, 7, 6, 6), (None, 7, 6, 6)]
    assert sorted(map(tuple, decontamination.clean_documents(df, it).collect()), key=str) == sorted([docs[1], docs[3], docs[5]], key=str)


def test_url_rules(spark):
    rows = [
        (1, "http://www.Example.com/en/1"), (2, "https://m.example.com/en/1?x"), (3, "http://a.net/es/#f"), (4, "http://a.net/de/"), (5, None), (6, "no-scheme/casino"),
        (7, "http://casino-win.org/a"), (8, "http://casinos.org/a"), (9, "http://x.org/free-bets"), (10, "http://x.org/free-free"), (11, "http://com/"), (12, "http://xcom/x"), (13, "http://a.com"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("m.example.com", "/en/1", "example.com/en/", "block")
    assert got[3] == ("a.net", "/es/", "net/es/", "block") and got[4] == ("a.net", "/de/", None, "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "block")
    assert got[7][3] == "block" and got[8][3] == "allow" and got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][2] == "com/" and got[12][2] is None and got[13] == ("a.com", "", None, "allow")


def test_url_vocabulary_has_points(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# points\nBad-Word 4\n\nsoft 3  # a comment\nweak 1\nweaker 1\n")
    terms = url_rules.read_terms(path)
    assert terms == {"bad-word": 4, "soft": 3, "weak": 1, "weaker": 1}
    urls = ["http://x.org/a-bad-word.b", "http://x.org/bad-words", "http://x.org/soft/soft", "http://x.org/soft/weak", "http://x.org/weak/weaker"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.strict_hits, r.soft_hits, r.soft_points) for r in url_rules.judge_urls(pages, terms=terms).collect()}
    assert got == {0: ("block", 1, 0, 0), 1: ("allow", 0, 0, 0), 2: ("allow", 0, 1, 3), 3: ("block", 0, 2, 4), 4: ("allow", 0, 2, 2)}
    assert {r.verdict for r in url_rules.judge_urls(pages, terms={}).collect()} == {"allow"}
    path.write_text("none 0")
    with pytest.raises(ValueError, match="no points"):
        url_rules.read_terms(path)


def test_empty_tables_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string, lang string, id int, shard string"
    empty = spark.createDataFrame([], schema)
    assert packing.packed(empty, TOKENIZER).count() == 0 and token_rollup.count_corpus(empty, TOKENIZER, "a", "b").count() == 0
    rows = [(1, "one two", "s", "en", 1, "x")] * 3 + [(None, None, None, None, None, None)] * 2 + [(2, "word " * 3000, "s", "en", 2, "y")]
    docs = spark.createDataFrame(rows, schema)
    pieces = packing.packed(docs, TOKENIZER).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == {(1, len(plain_ids("one two"))): 3, (None, 1): 2, (2, len(plain_ids("word " * 3000))): 1}
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    n, m = len(plain_ids("one two")) - 1, len(plain_ids("word " * 3000)) - 1
    got = {(r.source, r.version): (r.documents, r.tokens) for r in token_rollup.count_corpus(docs, TOKENIZER, "a", "b").collect()}
    assert got == {("s", "a/copies"): (2, 2 * n), ("s", "b"): (2, n + 1 + m + 1), (None, "a/copies"): (1, 0), (None, "b"): (1, 1)}


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 50021}" for i in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other")], "doc_id long, text string")
    from kohorta.llm import near_duplicates, quality_rules

    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    item = spark.createDataFrame([(9, " ".join(f"w{i}" for i in range(500, 540)))], "item_id long, text string")
    assert {(r.doc, r.item, r.n_shared) for r in decontamination.contained_items(docs, item).collect()} == {(1, 9, 36), (2, 9, 36)}
    found = {r.doc_id: r._statistics.n_repeat_words for r in quality_rules.statistics(docs).collect()}
    assert found == {1: 120_000, 2: 120_000, 3: 0}
    page = spark.createDataFrame([(1, "http://a.com/", "<p>" + text * 3)], "page_id long, url string, html string")
    assert archives.round_trip(page).first().payload_bytes == 3 + 3 * len(text)


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul>{nav}</ul></nav><div class='ad'>Buy</div><article><h1>{h}</h1>{body}</article><footer>&copy; x</footer>"


def page(i, paragraphs):
    nav = "".join(f"<li><a href='/{j}'>n{i}{j}</a></li>" for j in range(2 + i % 3))
    return PAGE.replace("{nav}", nav).replace("{h}", f"Head {i}").replace("{body}", "".join(f"<p>{p}</p>" for p in paragraphs))


def test_main_texts(spark):
    rows = [(i, f"http://h.com/{i}", page(i, [f"a&amp;b  {j}\n x" for j in range(i % 4)])) for i in range(20)]
    rows += [(50, "http://one.com/", "<p>alone<p>two<script>var t='</p>'</script>"), (51, None, None), (52, "http://h.com/z", ""), (53, "http://h.com/q", "plain text")]
    rows += [(54, "http://h.com/c", "<main><article>A<div class='x'>B<br>c</div><section id=comments><p>no</p></section></article></main><form>no</form>")]
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.main_texts(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, wrapper int")).collect()}
    for i in range(20):
        text = "\n".join([f"Head {i}", *(f"a&b {j} x" for j in range(i % 4))])
        assert got[i] == (text, len(text))
    assert got[50][0] == "alone\ntwo" and got[51] == ("", 0) and got[52] == ("", 0) and got[53][0] == "plain text" and got[54][0] == "A\nB c"


def test_every_layout_of_a_host_is_extracted(spark):
    a = "<body><nav>n</nav><main><p>main {i}</p></main>"
    b = "<body><nav>n</nav><div class=content><p>div {i}</p></div>"
    c = "<body><div class=widget><p>widget {i}</p></div>"
    html = [[a, b, c][i % 3].replace("{i}", str(i)) for i in range(30)] + ["<body><section><p>rare</p></section>"]
    pages = spark.createDataFrame([(i, f"http://mixed.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    want = {i: f"{['main', 'div', 'widget'][i % 3]} {i}" for i in range(30)} | {30: "rare"}
    assert {r.page_id: r.text for r in wrappers.main_texts(pages).collect()} == want
    wrapper = json.loads(wrappers.host_wrappers(pages).first().wrapper)
    assert {"body/main", "body/div content", "body/div widget", "body/section"} <= set(wrapper["places"])


def test_the_wrapper_decides_where_names_say_nothing(spark):
    def layout(i):
        menu = "".join(f"<li><a href=/{j}>topic {i} {j}</a></li>" for j in range(3 + i % 2))
        extra = f"<p>See <a href=/x>this</a> too {i}</p>" if i % 3 == 0 else ""
        return f"<body><div class=zone><p>Call us any day of the week, we are glad to help you with all of it</p></div><div class=rail><ul>{menu}</ul></div><div class=zq><p>story {i} begins</p>{extra}</div>"

    html = {i: layout(i) for i in range(12)}
    html[12] = "<body><div class=rail><ul><li><a href=/1>only topic</a></li></ul></div>"  # nothing at the main places: its own
    pages = spark.createDataFrame([(i, f"http://plain.com/{i}", h) for i, h in html.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    assert got == {i: f"story {i} begins" + (f"\nSee this too {i}" if i % 3 == 0 else "") for i in range(12)} | {12: "only topic"}
    assert wrappers.extract(html[1]) == "Call us any day of the week, we are glad to help you with all of it\nstory 1 begins"  # one page can't tell
    wrapper = json.loads(wrappers.host_wrappers(pages).first().wrapper)
    assert wrapper["main"] == ["body/div zq"] and wrapper["places"]["body/div rail/ul"][0] and wrapper["places"]["body/div zone"][1:3] == [12, 1]


def test_copies_of_a_page_are_no_template(spark):
    html = "<body><div><p>all of it</p></div><div class=other><p>more of it here</p></div>"
    pages = spark.createDataFrame([(i, "http://same.com/", html) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.main_texts(pages).collect()} == {"all of it\nmore of it here"}
    near = spark.createDataFrame([(i, "http://near.com/", html + "<!-- -->" * i) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.main_texts(near).collect()} == {"all of it\nmore of it here"}


def test_what_pages_share_inside_an_article_stays(spark):
    shared = "<article><h1>Steps</h1><p>How it is done</p><ul><li>one step here</li><li>two steps here</li></ul></article>"
    html = [f"<body><nav>menu</nav>{shared}<footer>page {i}</footer>" for i in range(3)]
    html += [f"<body><nav>menu</nav><article><p>story {i} of its own</p></article>" for i in range(5)]
    table = "<table><tr><td>price</td><td>ten</td></tr></table>"
    html += [f"<body><main><p>another story, number {i}</p>{table}</main>" for i in range(4)]
    bare = "<body><div class=zone><p>{}</p></div><div class=list><p>one step here</p></div>"
    html += [bare.format("the story that three pages share")] * 3 + [bare.format(f"story {i}").replace("one step", f"step {i}") for i in range(6)]
    hosts = ["a"] * 8 + ["b"] * 4 + ["c"] * 9
    rows = [(i, f"http://{h}.com/{i}", x) for i, (h, x) in enumerate(zip(hosts, html, strict=True))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    assert got == {i: wrappers.extract(x) for i, x in enumerate(html)}
    assert got[0] == "Steps\nHow it is done\none step here\ntwo steps here" and got[8].split("\n")[-2:] == ["price", "ten"]
    assert got[12] == "the story that three pages share\none step here"


def test_unclosed_tags_take_linear_time():
    import time

    for piece in ("<a ", "<a '", '<a "', "<!", "<?x ", "<script ", "<iframe ", "<iframe>", "<svg x", "<b <c", "<a \"<b '"):
        began = time.time()
        wrappers.extract("<article><p>text</p>" + piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece
    assert wrappers.extract("<p>a < b and <b class=x>c</b> d</p>") == "a < b and c d"


class _Article(HTMLParser):
    """The text of the pages of the test tables by another parser: blocks inside the article, without what is marked as aside."""

    def __init__(self):
        super().__init__()
        self.stack, self.lines = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in wrappers.BLOCKS:
            self.lines.append("")
        if tag not in wrappers.VOID:
            marks = set(re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()))
            self.stack.append((tag, tag in wrappers.DROPPED | wrappers.BOILERPLATE - {"header"} or bool(marks & wrappers.MARKS)))

    def handle_endtag(self, tag):
        if tag in wrappers.BLOCKS:
            self.lines.append("")
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(gone for _, gone in self.stack):
            self.lines[-1] += data


def test_texts_of_the_pages_equal_another_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    for key, page in html.items():
        p = _Article()
        p.feed(page or "")
        p.close()
        if "<article" in (page or ""):
            assert got[key].split() == " ".join(p.lines).split(), key


def test_empty_tables_long_pages_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.main_texts(empty).count() == 0 and url_rules.judge_urls(empty).count() == 0
    long = "<article>" + "<p>" + "word " * 400_000 + "</p>" + "<div>" * 3000 + "deep" + "</article>"
    rows = [(1, "http://l.com/", long, "a", "b"), (1, "http://l.com/", long, "a", "b"), (2, "http://l.com/", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main string, host string")
    got = sorted((r.page_id, r.n_chars) for r in wrappers.main_texts(pages).collect())
    assert got == [(1, 5 * 400_000 - 1 + 5)] * 2 + [(2, 0)]
    assert sorted(r.page_id for r in url_rules.judge_urls(pages).collect()) == [1, 1, 2]


def test_dropped_elements_end_with_their_container():
    rest = "<p>rest</p></article><p>after</p>"
    for cut in ['<svg class="i"/>', "<svg/>", "<svg width='1'><path d='x'/><g></svg>", "<math />", "<iframe src='x' />", "<svg><p>no</p></svg>", "<noscript></div>no</noscript>", "<script>'</p>'</script>"]:
        assert wrappers.extract(f"<article><p>a</p>{cut}{rest}") == "a\nrest", cut
    for name in ["button", "object", "select", "canvas", "iframe", "noscript", "template", "svg", "math"]:
        assert wrappers.extract(f"<article><p>a<{name} id=x><b>no</p>{rest}") == "a\nrest", name
        assert wrappers.extract(f"<article><div><p>a</p><{name}>no</div>{rest}<{name}>no</{name}>") == "a\nrest", name
    assert wrappers.extract("<article><p>a<button>no<button>no</button>no</button> b</p></svg>c<object-fit>d</object-fit></article>") == "a b\ncd"


def test_wrapper_has_repeats_and_optionals():
    made = wrappers.infer([page(0, ["a"]), page(1, ["a", "b", "c"]), page(2, []).replace("<footer>", "<aside>x</aside><footer>")])
    kinds = [x[0] for x in made]
    assert "repeat" in kinds and "optional" in kinds
    assert ("repeat", (("open", "li", ""), ("open", "a", ""), ("#",), ("close", "a", ""), ("close", "li", ""))) in made


def test_null_page_ids_have_their_records(spark):
    html = ["x" * 200, "x" * 200, "x" * 200, "y" * 150, "y" * 150, "short", None]
    rows = [(i, "http://a.com/", h, "clash") for i, h in zip((5, None, 9, None, None, None, 3), html, strict=True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archives.round_trip(pages).collect())
    want = [(5, 200, "response", None), (None, 200, "response", None), (9, 200, "revisit", 5), *[(None, 150, "response", None)] * 2, (None, 5, "response", None), (3, 0, "response", None)]
    assert got == Counter(want)


def test_ids_that_are_no_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text", "s", "en", "http://a/", "x")], "doc_id string, text string, source string, lang string, url string, html string")
    numbers = docs.withColumn("doc_id", F.lit("7"))
    made = {
        "token files": lambda d: token_files.round_trip(d, TOKENIZER), "archives": lambda d: archives.round_trip(d, key="doc_id"),
        "near-duplicates": near_duplicates.near_duplicate_classes, "counts": lambda d: token_rollup.token_counts(d, TOKENIZER),
    }
    for name, of in made.items():
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            of(docs).collect()
        assert of(numbers).first()[0] == 7, name


def test_a_commit_during_a_compaction_counts_once(spark, monkeypatch):
    rollup = token_rollup.Rollup(spark, shared_path(spark, "test-rollup"))
    one = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], token_rollup.SCHEMA)
    rollup.commit("a", one(2))
    real = rollup._compacted

    def between():
        monkeypatch.setattr(rollup, "_compacted", real)
        rollup.commit("b", one(9))
        return real()

    monkeypatch.setattr(rollup, "_compacted", between)
    rollup.compact()
    want = [("s", "en", "v", 2, 11)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == want
    assert rollup._publish("batches/c", "one") and not rollup._publish("batches/c", "two") and rollup._value("batches/c") == "one"


def test_rollup_is_idempotent_and_compacts(spark, docs, texts):
    rows = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in token_rollup.count_corpus(docs, TOKENIZER, "v1", "v2").collect()}
    distinct = {t or "" for t in texts}
    copies = Counter(t or "" for t in texts)
    copied = sum((n - 1) * (len(plain_ids(t)) - 1) for t, n in copies.items())
    assert rows == {("src", "en", "v2"): (len(distinct), sum(len(plain_ids(t)) for t in distinct)), ("src", "en", "v1/copies"): (len(texts) - len(distinct), copied)}
    rollup = token_rollup.Rollup(spark, shared_path(spark, "test-rollup"))
    assert rollup.totals().count() == 0
    change = spark.createDataFrame([("s", "en", "v", 2, 10), (None, "en", "v", 1, 4)], token_rollup.SCHEMA)
    assert rollup.commit("a", change) and not rollup.commit("a", change)
    assert rollup.commit("b", spark.createDataFrame([("s", "en", "v", -1, -3)], token_rollup.SCHEMA))
    want = {("s", "en", "v", 1, 7), (None, "en", "v", 1, 4)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == want and not rollup.commit("a", change)
    rollup.commit("c", spark.createDataFrame([("s", "en", "v", -1, -7)], token_rollup.SCHEMA))
    assert {tuple(r) for r in rollup.totals().collect()} == {(None, "en", "v", 1, 4)}
    with pytest.raises(ValueError, match="batch name"):
        rollup.commit("../x", change)
