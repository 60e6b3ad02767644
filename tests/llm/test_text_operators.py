"""Decontamination, tokens, chat, quality, search, pages and archives."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import bpe, chat_format, decontaminate, html_text, quality, topk, warc
from veilframe.llm.common import new_path

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (10, "one two"), (3, None), (4, "!!!"), (2, "again été")]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    words = "one two three four five six seven eight nine ten eleven short item été other".split()
    docs = [(i, ", ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, ITEMS[0][1].upper()), (63, "x " + ITEMS[0][1] + "; " + ITEMS[0][1]), (64, "again,ÉTÉ"), (65, "again,été"), (None, "one two"), (63, "short-item")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, label string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(df, items).collect())
    want = sorted((str(i), *decontaminate.brute_force(t, [(str(a), b) for a, b in ITEMS])[:3]) for i, t in docs)
    assert got == want
    cut = decontaminate.remove_spans(df, items, keep=("n_hit",))
    assert cut.columns == ["doc_id", "text", "n_hit"] and cut.count() == len(docs)
    assert decontaminate.find_contamination(cut, items).filter("n_hit > 0").count() == 0
    clean = {i: t for i, t in docs if i is not None and not decontaminate.brute_force(t, [(str(a), b) for a, b in ITEMS])[1]}
    left = {r.doc_id: r.text for r in cut.collect()}
    assert all(left[i] == t for i, t in clean.items() if i != 63)
    assert decontaminate.remove_documents(df, decontaminate.find_contamination(df, items)).filter("doc_id = 62").count() == 0


def test_large_benchmarks_are_scanned_for_in_sets(spark):
    rng = random.Random(4)
    words = "one two three four five six seven eight nine ten eleven short item été other".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(40, None), (41, " ".join(w for _, t in ITEMS if t for w in t.split()))]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, lang string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(decontaminate._benchmark(items, 20)) > 2
    whole, parts = (sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.hits, r.ends) for r in decontaminate.find_contamination(df, items, set_bytes=n).collect()) for n in (10**6, 20))
    assert whole == parts
    cut = decontaminate.remove_spans(df, items, keep=("lang",), set_bytes=20)
    assert cut.count() == len(docs) and decontaminate.find_contamination(cut, items).filter("n_hit > 0").count() == 0


def test_decontamination_of_empty_tables(spark, empty, frame):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(frame, items.filter("false")).filter("n_hit > 0").count() == 0


tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_tokenizer()
    return bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_tokens_equal_the_library(pair, text):
    mine, theirs = pair
    ids = mine.encode(text)
    assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abeinorst 'é<|endoftext|>\n", max_size=60))
def test_tokens_of_words_and_specials(pair, text):
    mine, theirs = pair
    assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_tokens_of_long_and_odd_texts(pair):
    mine, theirs = pair
    for text in ("a" * 20_000, "the" * 3000, " " * 500 + "x", "<|endoftext|>" * 3, "I'll don't", "퟿", "é" * 999):
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode([255, 254]) == theirs.decode([255, 254], skip_special_tokens=False)


def test_token_tables(spark, frame, documents, empty):
    path = bpe.default_tokenizer()
    rows = bpe.decode_documents(bpe.encode_documents(frame, path, keep=("cls",)), path, keep=("cls",)).collect()
    assert {(r.doc_id, r.text) for r in rows} == {(i, t or "") for i, t in documents}
    assert bpe.encode_documents(empty, path).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [1])], "doc_id long, ids array<int>")
    assert sorted(r.text for r in bpe.decode_documents(nulls, path).collect()) == ["", '"']


ROLES, CONTROL = ["user", "assistant", "system", None, "[ROLE]"], [None, "</s>", "[INST]", "<next>", "\\", "\\[", "[/ROLE]x", "<\\s>", "<<SYS>>"]


def turn(rng):
    text = "".join(rng.choice("ab\\<>/s[]INSTROLE|next\n") for _ in range(rng.randint(0, 20)))
    return rng.choice(ROLES), rng.choice([text, text, rng.choice(CONTROL)])


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, *turn(rng)) for c in range(60) for t in range(rng.randint(1, 8))] + [(70, t, *turn(rng)) for t in range(3000)] + [(None, 0, "user", "x"), (61, None, "user", "first"), (61, 0, "user", "second"), (62, 1, "a", "tie"), (62, 1, "a", "tie")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    read = {r.conv_id: r for r in chat_format.parse_formatted(chat_format.format_conversations(df)).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {c: [(x.role, x.text) for x in r.turns] for c, r in read.items()} == {c: [x[1:] for x in sorted(v)] for c, v in want.items()}
    assert read[61].formatted == "<s>[ROLE]user[/ROLE]first<next>second</s>"
    assert chat_format.format_conversations(df.filter("false")).count() == 0


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.parse_formatted(chat_format.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_ranks_and_keeps(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(5, 90))).capitalize() + "." for _ in range(200)]
    bad = [" ".join(f"{word()}***" for _ in range(rng.randint(5, 90))) for _ in range(40)] + [" ".join([word()] * 30) for _ in range(40)]
    rows = [(i, t, int(i < 200)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, None), (901, "", "x"), (None, "x", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = {r.doc_id for r in docs.filter(quality.held_out("doc_id")).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= quality.THRESHOLD) == bool(q) for i, _, q in rows if i in held]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    assert quality.score(docs.filter("false"), model).count() == 0


def test_quality_learns_from_words(spark):
    """Texts that differ in nothing but their words: only the hashed words and n-grams can tell."""
    rng = random.Random(5)
    shared, fine, poor = (["".join(rng.choice("aeinorstl") for _ in range(6)) for _ in range(40)] for _ in range(3))
    text = lambda own: " ".join(rng.choice(own if rng.random() < 0.3 else shared) for _ in range(60))
    rows = [(i, text(fine if i % 2 else poor), i % 2) for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    held = {r.doc_id for r in docs.filter(quality.held_out("doc_id")).collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect() if r.doc_id in held}
    good, bad = ([s for i, s in got.items() if i % 2 == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_quality_of_repeated_rows_and_labels(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 2 else "stuvwxyz") * 3 for _ in range(20)), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    # rows that repeat an id or a label add nothing; of labels that differ the lower holds; a very long text is scored
    more = docs.unionByName(docs).unionByName(spark.createDataFrame([(7, "zz " * 400_000), (500, "")], "doc_id long, text string"))
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(2, 1), (500, None), (None, 0)], "doc_id long, quality int"))
    one, two = quality.train(docs, labels), quality.train(more, again)
    assert np.allclose(one[0], two[0]) and abs(one[1] - two[1]) < 1e-9
    assert quality.score(more, two).count() == 242 and quality.score(docs.filter("false"), two).count() == 0


def test_quality_without_labels(spark, frame):
    model = quality.train(frame, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality.score(frame, model).collect()} == {0.5}


def test_search_equals_brute_force(spark):
    rng = random.Random(6)
    for spread in (1.0, 5.0):  # lengths alike, and lengths apart: both prunings
        rows = [(i, [rng.gauss(0, 0.3) * rng.uniform(1, spread) for _ in range(8)]) for i in range(700)]
        rows += [(700, None), (750, [None] * 8), (800, [float("nan")] * 8), (801, [float("inf")] * 8), (802, rows[0][1]), (803, rows[0][1])]
        vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        whole = {r.vec_id: r.v for r in vectors.collect()}
        assert not {700, 750, 800, 801} & set(whole)
        got = {}
        for r in topk.top_k(vectors.repartition(3), vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        want = {q: sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q)[:5] for q, v in whole.items() if q % 50 == 0}
        assert got == want


def test_pruned_pairs_are_not_multiplied():
    """Lengths apart, or vectors whose coordinates differ in what they carry: fewer products, and the same result."""
    rng = np.random.default_rng(4)
    for spread, tilt in ((6.0, 0.0), (1.0, 0.08), (3.0, 0.04)):
        x = rng.normal(0, 60, (3000, 32)) * rng.uniform(1, spread, (3000, 1)) * np.exp(-tilt * np.arange(32))
        x = np.floor(x).astype(np.int64)
        ids = np.arange(3000)
        found = topk.Buckets(ids, x).search(ids[::50], x[::50], np.full(60, -np.inf), 5)
        assert found.met <= 60 * 3000 and found.verified < 0.6 * 60 * 3000
        scores = x[::50] @ x.T
        want = [sorted((-int(scores[i, j]), j) for j in range(3000) if j != 50 * i)[:5] for i in range(60)]
        assert found.best == want


def test_products_beyond_doubles_are_exact(spark):
    rng = random.Random(8)
    for top in (2**20, 2**28, 2**29):
        rows = [(i, [rng.randrange(-top, top) for _ in range(64)]) for i in range(200)]
        rows += [(200 + i, [x + (k == i) for k, x in enumerate(rows[0][1])]) for i in range(20)]
        v = spark.createDataFrame(rows, "vec_id long, v array<long>")
        got = {}
        for r in topk.top_k(v, v.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        want = {q: sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5] for q, v in rows if q % 50 == 0}
        assert got == want


def test_repeated_rows_take_one_place(spark):
    rows = [(0, [10, 0])] + [(1, [9, 1])] * 20 + [(i, [i, 0]) for i in range(2, 9)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = [(r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 90), (8, 80), (7, 70), (6, 60), (5, 50)]


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0]), (2, [1.0]), (None, [9.0]), (50, [])]
    v = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 2, 65536), (0, 3, 50, 0)]
    assert topk.top_k(v, v.filter("false")).count() == 0 and topk.top_k(v.filter("vec_id = 0"), v.filter("vec_id = 0")).count() == 0


PAGES = [
    ("http://a.org/x/1", "<html><head><title>t</title><style>s</style></head><body><nav><a>Home</a></nav><article><h1>One</h1><p>a &amp; b<p>c&nbsp; d<br>e</article><div class='ad'>buy</div><footer>f</footer></body></html>", "One\na & b\nc d\ne"),
    ("http://a.org/x/2", "<body><div>Same line</div><p>Own text here</p><div>Footer line</div>", "Own text here"),
    ("http://a.org/x/3", "<body><div>Same line</div><p>Other text</p><div>Footer line</div>", "Other text"),
    ("http://b.org/", "<div id='comments'><p>nice</p></div><main><p>Main</p><aside>no</aside><form>name<input></form></main>", "Main"),
    ("http://c.org/", "<div class='notice'>left open<article>kept<script>no()</script></article>", "kept"),
    (None, "", ""), (None, None, ""), ("relative", "plain &lt;text&gt;", "plain <text>"), ("http://d.org/", "<p>" * 2000 + "deep", "deep"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)] + [(None, "http://e.org/", "x", "y"), (1, PAGES[1][0], PAGES[1][1], "z")], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(PAGES) + 2 and got[None] == "x"
    # the repeated page is its own nearest neighbour and loses all unprotected lines
    for i, (_, _, want) in enumerate(PAGES):
        if i != 1:
            assert got[i] == want, i
    assert html_text.extract_text(df.filter("false")).count() == 0


def test_equal_articles_keep_their_text(spark):
    df = spark.createDataFrame([(i, f"http://a.org/{i}", "<nav>n</nav><article><p>same</p></article>") for i in range(4)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract_text(df).collect()} == {"same"}


def site(spark, *pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract_text(df).collect()}


def test_differencing_decides_inside_articles(spark):
    article = "<main><p>Follow us</p><p>{0} text of its own, long enough</p><p>{0} ends</p></main>"
    got = site(spark, *((f"http://a.org/{i}", article.format(w)) for i, w in enumerate(("One", "Two", "Six"))), ("http://b.org/x", article.format("One")), ("http://b.org/x?ref=y", article.format("One")))
    assert got == {i: f"{w} text of its own, long enough\n{w} ends" for i, w in enumerate(("One", "Two", "Six"))} | {i: "Follow us\nOne text of its own, long enough\nOne ends" for i in (3, 4)}
    # a near copy's article is kept whole
    near = "<article><p>a long passage in both</p><p>{}</p></article>"
    assert site(spark, ("http://c.org/1", near.format("new")), ("http://c.org/2", near.format("old"))) == {0: "a long passage in both\nnew", 1: "a long passage in both\nold"}


def test_a_teaser_does_not_replace_the_body(spark):
    page = "<div>Menu line</div><div>{} is a body of some length that stands in a div</div><article>Teaser</article>"
    got = site(spark, ("http://a.org/1", page.format("One")), ("http://a.org/2", page.format("Two").replace("Teaser", "Other")))
    assert got == {0: "One is a body of some length that stands in a div\nTeaser", 1: "Two is a body of some length that stands in a div\nOther"}


def test_copies_of_a_page_keep_their_text(spark):
    body = "<div>Same line</div><p>{} text</p><div>Footer line</div>"
    got = site(spark, ("http://a.org/a", body.format("Own")), ("http://a.org/a?ref=x", body.format("Own")), ("http://a.org/a?ref=y", body.format("Own")), ("http://a.org/b", body.format("Other")))
    assert got == {0: "Own text", 1: "Own text", 2: "Own text", 3: "Other text"}
    repeated = site(spark, *((u, h) for u, h, _ in [*PAGES[:3], PAGES[1]]))
    assert repeated[1] == repeated[3] and "Own text here" in repeated[1] and repeated[2] == "Other text"


@pytest.mark.parametrize("wrapper", ["with-sidebar", "page has-header", "sidebar"])
def test_wrappers_that_look_like_chrome(spark, wrapper):
    page = "<div class='" + wrapper + "'><div>Menu line</div><p>{} text</p></div>"
    assert site(spark, ("http://a.org/1", page.format("One")), ("http://a.org/2", page.format("Two"))) == {0: "One text", 1: "Two text"}


def test_runs_of_copies_at_any_edge(spark):
    rng = random.Random(3)
    bodies = ["".join(f"<p>{w}</p>" for w in ["Menu", *rng.sample("abcdefgh", 4), "Foot"]) for _ in range(12)]
    pages, k = [], 0
    while len(pages) < 300:
        body = rng.choice(bodies)
        for _ in range(rng.choice((1, 1, 2, 5, 60))):
            pages.append((k, "http://a.org/%04d" % k if k < 250 else "http://b.org/%04d" % k, body))
            k += 1
    lines = [html_text.page_lines(h) for _, _, h in pages]
    hosts = [u[:12] for _, u, _ in pages]
    want = {}
    for i, (_, url, _) in enumerate(pages):
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(pages) and hosts[j] == hosts[i] and lines[j] == lines[i]:
                j += step
            if 0 <= j < len(pages) and hosts[j] == hosts[i]:
                near.append(j)
        near.sort(key=lambda j: -html_text._close(pages[j][1], url))
        want[i] = html_text.main_text(lines[i], [lines[j] for j in near])[0]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_text.extract_text(df.repartition(3)).collect()
    assert len(rows) == len(pages) and {r.page_id: r.text for r in rows} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    at = sorted(html_text.shared_lines(a, b))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    rest = iter(b)
    assert len(at) == table[-1][-1] and all(a[i] in rest for i in at)


def test_shared_lines_of_equal_rows_take_few_steps():
    import time

    begin = time.time()
    a, b = ["x", *["row"] * 20_000, "y"], ["z", *["row"] * 15_000, "other", *["row"] * 5_000]
    got = html_text.shared_lines(a, b)
    assert len(got) == 20_000 and time.time() - begin < 20
    rng = random.Random(1)
    a, b = ([rng.choice("abc") for _ in range(n)] for n in (700, 600))
    table = [[0] * 601 for _ in range(701)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    at, rest = sorted(html_text.shared_lines(a, b)), iter(b)
    assert len(at) == table[-1][-1] and all(a[i] in rest for i in at)


@pytest.mark.parametrize("name", ["notice-period", "share-price", "press-release", "commentary", "headline", "subscription-cost", "articlebody main", "no-sidebar", "shareholders", "adroit", "post-body", ""])
def test_names_with_other_words_keep_their_text(name):
    page = f"<article><h1>Title</h1><div class='{name}'><p>First text.</p></div><p id='{name}'>Second text.</p></article><nav>Menu</nav>"
    assert html_text.main_text(html_text.page_lines(page), [])[0] == "Title\nFirst text.\nSecond text."


@pytest.mark.parametrize("name", ["ad", "ad-banner", "topnav", "navlist", "user-remarks", "comment-list", "cookie_notice", "related-posts", "site-header", "content sidebar-left", "menu2"])
def test_names_that_say_no_text(name):
    page = f"<body><div class='{name}'>Not this</div><div><p>The text of the page is here.</p><section id='{name}'>Nor this</section></div></body>"
    assert html_text.main_text(html_text.page_lines(page), [])[0] == "The text of the page is here."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>t</title><body><p>hello</p></body></html>", ["hello"]),
        ("<head><meta charset=x><p>hello", ["hello"]),
        ("<head><title>t</title>plain text", ["plain text"]),
        ("<head><style>s</style><script>x</script><link rel=y><h1>a</h1><p>b", ["a", "b"]),
        ("<body><form><input name=q><button>go</button><p>after</p><article><p>text</p></article>", ["after", "text"]),
        ("<body><form>name <input></form><p>text</p></body>", ["text"]),
        ("<body><form id=all><div>menu</div><article>text</article><select><option>x</select></form></body>", ["text"]),
        ("<body><form><p>all in one form</p><textarea>no</textarea></form></body>", ["all in one form"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><dl><dt>f<dd>g</dl>", ["a", "b", "c", "d", "e", "f", "g"]),
    ],
)
def test_tags_that_are_left_open(html, want):
    assert [t for t, _, _ in html_text.page_lines(html)] == want


#: Four hosts: (url, page, expected main text). Menus, adverts, comments and footers are marked on some, unmarked on others;
#: articles of one host repeat a sentence of the house at places of their own.
HOUSE = "The house sends its regards."
SITES = [
    *((f"http://news.org/2024/{i}-{w}", f"<div>Home</div><div>World</div><div>Sport</div><article><h1>{w} opens</h1><p>{HOUSE * (i == 0)}</p><p>The {w} was opened &amp; shown to all who came.</p><p>{HOUSE * (i > 0)}</p><p>It is the {w} of {i} towns.</p></article><div class=ad>Buy {w} now</div><div>All rights reserved</div>", "\n".join([f"{w} opens", *[HOUSE] * (i == 0), f"The {w} was opened & shown to all who came.", *[HOUSE] * (i > 0), f"It is the {w} of {i} towns."])) for i, w in enumerate(("bridge", "harbour", "library"))),
    *((f"http://blog.org/post/{i}", f"<table><tr><td>Archive</td><td>Contact me</td></tr></table><div><h2>On {w}</h2>Some words on {w}<br>and a second line on {w}.</div><div>Written by the owner of this blog</div><ol class='comments'><li>I like {w}</li><li>me too</li></ol>", f"On {w}\nSome words on {w}\nand a second line on {w}.") for i, w in enumerate(("rain", "snow", "wind", "sun"))),
    *((f"https://shop.example/{w}.html", f"<body><nav>Cart</nav><main><p>Share this page</p><p>{w} made by hand from old oak, in four sizes.</p><ul><li>{w} size one<li>{w} size two</ul><p>Ask us about this article</p></main><aside>See also {w} oil</aside><footer>Shop {i}</footer>", f"{w} made by hand from old oak, in four sizes.\n{w} size one\n{w} size two") for i, w in enumerate(("Table", "Chair", "Stool"))),
    ("http://alone.org/", "<header>Alone</header><p>The only page of its host.</p><footer>2024</footer>", "The only page of its host."),
]


def test_precision_and_recall_of_the_main_text(spark):
    got = site(spark, *((u, h) for u, h, _ in SITES))
    kept = right = wanted = 0
    for i, (_, _, want) in enumerate(SITES):
        a, b = got[i].split("\n"), want.split("\n")
        kept, wanted, right = kept + len(a), wanted + len(b), right + len(set(a) & set(b))
    assert right / kept >= 0.98 and right / wanted >= 0.98, got
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(SITES)], "page_id long, url string, html string")
    taken = html_text.extract_text(df).agg(F.sum("shared"), F.sum("marked")).first()
    assert taken[0] > 35 and taken[1] > 8  # most by differencing, the rest by markup


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.1"), (6, "a"), (7, "z" * 300_000)]
    spark.createDataFrame([(i, f"http://x/\n{i}", h, 0) for i, h in pages] + [(None, "u", "lost", 0), (6, "http://x/\n6", "a", 0)], "page_id long, url string, html string, record_type int").write.parquet(str(tmp_path / "pages.parquet"))
    groups = {}
    for i, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    want = sorted(
        ((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("response", None) if i == max(v) else ("revisit", max(v)))) for h, v in groups.items() for i in v), key=lambda x: x[0]
    )
    assert sorted((tuple(r) for r in warc.op4_warc(spark, str(tmp_path)).collect()), key=lambda x: x[0]) == want


def test_archives_of_empty_tables_and_thresholds(spark, tmp_path):
    warc.register(spark)
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], "page_id long, url string, html string")
    assert warc.archive_records(df, least_bytes=3).filter("record_type = 'revisit'").count() == 0
    path = new_path(spark, "empty")
    warc.archive_records(df.filter("false")).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress, warc.gzip_member])
def test_foreign_archives(spark, tmp_path, pack):
    warc.register(spark)
    kinds = ["warcinfo", "response", "request"] * 3
    raw = b"".join(pack(warc.record_bytes([("WARC-Type", k), ("WARC-Target-URI", f"http://h/{i}"), ("X-Own", "a: b")], b"payload\r\n\r\n" * i * 500)) for i, k in enumerate(kinds))
    file = tmp_path / ("a.warc" if pack(b"x") == b"x" else "a.warc.gz")
    file.write_bytes(raw)
    rows = spark.read.format("warc").load(str(file))
    assert rows.count() == 9 and rows.select(F.sum(F.octet_length("payload"))).first()[0] == 11 * 500 * 36
    picked = spark.read.format("warc").option("payload", "false").load(str(tmp_path)).filter("record_type = 'response' and target_uri like 'http://h/4%'")
    assert [(r.content_length, r.payload, r.headers["x-own"]) for r in picked.collect()] == [(22000, None, "a: b")]


@pytest.mark.parametrize("pack", [gzip.compress, warc.gzip_member])
def test_large_compressed_archives_are_split(spark, tmp_path, pack):
    warc.register(spark)
    rng = random.Random(7)
    blocks = [rng.randbytes(rng.randint(0, 4000)) + b"\x1f\x8b\x08" * (i % 3) for i in range(120)]
    file = tmp_path / "big.warc.gz"
    file.write_bytes(b"".join(pack(warc.record_bytes([("WARC-Type", "resource"), ("WARC-Target-URI", f"http://h/{i}")], b)) for i, b in enumerate(blocks)))
    rows = spark.read.format("warc").option("split_bytes", 10_000).load(str(file))
    assert rows.rdd.getNumPartitions() > 5
    assert sorted((int(r.target_uri[9:]), bytes(r.payload)) for r in rows.collect()) == list(enumerate(blocks))


def test_header_predicates_are_pushed():
    from pyspark.sql.datasource import EqualTo, Not, StringContains

    reader = warc.WarcReader({"path": "x"})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("payload",), b""), Not(StringContains(("target_uri",), "h")), EqualTo(("headers", "x"), "y")]))
    assert [f.attribute for f in rest] == [("payload",), ("headers", "x")] and len(reader.filters) == 2
    row = {c: None for c in warc.FIELDS} | {"record_type": "response"}
    assert not warc._holds(reader.filters[1], row) and warc._holds(reader.filters[1], row | {"target_uri": "x"}) and warc._holds(reader.filters[0], row)
