"""N-gram join, components, suffix dedup and sharding against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import components, ngram_join, sharding, suffix_dedup

from .conftest import make_documents


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = make_documents(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df).collect()}
    assert got == ngram_join.brute_force(rows)


def test_join_edges(spark, frame, empty):
    assert ngram_join.similarity_components(empty).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A b\tc d e f"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.similarity_components(df).collect())
    assert got == [(3, 0, 3), (4, 0, 4), (7, 2, 7), (9, 2, 7)]


def test_drifting_documents_are_one_component(spark):
    """Each document is the one before moved on by five words, with ids in random order: a long chain of links."""
    ids = list(range(600))
    random.Random(2).shuffle(ids)
    rows = [(i, " ".join(f"w{j}" for j in range(5 * at, 5 * at + 60))) for at, i in enumerate(ids)]
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in ids}


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_long_structured_words_are_apart(spark):
    rows = [(1, thue_morse(4096, "ab")), (2, thue_morse(4096, "ba")), (3, "x " * 6 + thue_morse(4096, "ab")), (4, "x " * 6 + thue_morse(4096, "ba"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == ngram_join.brute_force(rows) and got[2] == (1, 2)


def test_links_do_not_rest_on_hashes(monkeypatch):
    """With a hash that tells few words apart, texts of other words still do not link."""
    monkeypatch.setattr(ngram_join, "word_hashes", lambda data, s, e: (e - s).astype(np.uint64))
    texts = ["ab cd ef gh ij kl", "zb cd ef gh ij kl", "ab cd ef gh ij kl", "ab cd ef gh ij kl ab cd ef gh ij kl"]
    t = [x for _, x in ngram_join.shingled(pa.array(texts))]
    assert not ngram_join.linked(t[0], t[1]) and ngram_join.linked(t[0], t[2]) and not ngram_join.linked(t[0], t[3])


def test_split_tiles_and_shuffled_lookups(spark, monkeypatch):
    """Tiles split into groups, components in many chunks and lookups beyond the broadcast bound give the same result."""
    from veilframe.llm import common

    monkeypatch.setattr(ngram_join, "HOT_TILE", 8)
    monkeypatch.setattr(ngram_join, "COUNTERS", 1 << 17)
    monkeypatch.setattr(ngram_join, "CHUNK_MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "CHUNK_MET", 4)
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 10)
    monkeypatch.setattr(ngram_join, "BANDS", 1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "HEAVY_ROWS", 4)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = make_documents(3) + [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(9)}" for _ in range(rng.randrange(25)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df).collect()}
    assert got == ngram_join.brute_force(rows)
    levels = np.array([0, 3, 9])
    assert ngram_join._groups_of(levels, 1.5).tolist() == [1, 4, 32]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("by_id")]


def test_split_tiles_hold_each_pair():
    key, cls = np.full(40, 77, np.uint64), np.arange(40)
    k, c, _, place = ngram_join._split_hot(key, cls, cls, np.zeros(40, np.int64), np.full(40, 4))
    pairs = set()
    for tile in set(k.tolist()):
        at = np.flatnonzero(k == tile)
        side = place[at] & ngram_join._SIDE
        for i, x in zip(at, side):
            pairs |= {(min(c[i], c[j]), max(c[i], c[j])) for j, y in zip(at, side) if c[i] != c[j] and (x != y or not tile & 1)}
    assert len(pairs) == 40 * 39 // 2


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(200)]
    # shingles of a run of n words: n - 4; a prefix of m words shares m - 4 of them
    rows = [(1, " ".join(words[:104])), (2, " ".join(words[:79])), (3, " ".join(words[:78]) + " q"), (4, " ".join(words[100:104]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_components(df).collect()}
    assert got == {i: c for i, (_, c) in ngram_join.brute_force(rows).items()} and got[2] == 1


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert both <= (len(a) + len(b) - ngram_join.differing_bits(ngram_join.bitmap(a), ngram_join.bitmap(b))) // 2


@given(st.lists(st.tuples(st.integers(1, 10**6), st.integers(1, 10**6), st.integers(0, 10**6))))
def test_least_overlap(cases):
    for a, b, o in cases:
        o = min(o, a, b)
        assert (o >= int(ngram_join.least_overlap(np.int64(a), np.int64(b)))) == (100 * o >= 75 * (a + b - o))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(df.filter("false")).count() == 0


def test_components_of_a_long_chain_in_random_order(spark):
    ids = list(range(5000))
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r.component for r in components.connected_components(df).collect()} == {0}


def test_components_of_hubs_are_salted(spark, monkeypatch):
    from veilframe.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    pairs = [(1000, i) for i in range(100)] + [(i, 2000 + i) for i in range(0, 100, 7)] + [(5000, 5001)] + [(7000, 6000 + i) for i in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(got) == 1 + 100 + 15 + 2 + 51 and set(got.values()) == {0, 5000, 6000} and got[2098] == 0 and got[7000] == 6000


def test_dedup_equals_brute_force(frame, documents, spark, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == suffix_dedup.brute_force(documents)


def test_dedup_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = "0123456789" * 5
    rows = [(2, text), (1, text), (1, text), (3, "é" + text + "é"), (4, None), (5, text[:49]), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: text, 2: "", 3: "éé", 4: "", 5: text[:49]}


def test_dedup_of_ids_at_the_limits(spark):
    text = "0123456789" * 5
    for ids in ([2**62 + 1, 2**62 + 2], [2**63 - 1, 2**63 - 2], [-(2**63), 2**63 - 1], [-5, 0]):
        df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
        assert {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()} == {min(ids): text, max(ids): ""}


def test_frequent_strings_do_not_gather_their_surroundings(spark, monkeypatch):
    """Half of all rows hold one phrase between texts of their own. Its minimisers are marked, so that no bucket gets much."""
    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = own(24)
    rows = [(i, own(60) + (phrase if i % 2 else own(24)) + own(60)) for i in range(400)] + [(400 + i, rows_text) for i, rows_text in enumerate([own(70) * 2, phrase * 5, phrase * 5])]
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    late = suffix_dedup._frequent(df, len(rows), suffix_dedup.GRAM)
    assert late is not None and late.any()
    off = np.cumsum([0, *(len(t) for _, t in rows)])
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    share = [Counter(suffix_dedup.fragments(data, off, late=x)[3].tolist()).most_common(1)[0][1] for x in (None, late)]
    assert share[1] * 4 < share[0]
    cut = {r.doc_id: len(r.text) for r in suffix_dedup.remove_repeats(df).collect()}
    assert cut == {i: x[0] - x[1] for i, x in suffix_dedup.brute_force(rows).items()}


def test_dedup_of_many_short_texts(spark):
    """A task packs what it has read once that is PACK_BYTES, also if no text is long enough for a fragment."""
    n = suffix_dedup.PACK_BYTES // 40 + 1000
    short = spark.range(0, n, 1, 1).selectExpr("id as doc_id", "rpad(concat('short text ', id), 45, 'x') as text")
    text = "0123456789" * 5
    df = short.unionByName(spark.createDataFrame([(n, text), (n + 1, "a" + text)], "doc_id long, text string").coalesce(1)).coalesce(1)
    rows = suffix_dedup.remove_repeats(df)
    got = {r.doc_id: r.text for r in rows.filter(f"doc_id >= {n - 1}").collect()}
    assert got == {n - 1: f"short text {n - 1}".ljust(45, "x"), n: text, n + 1: "a"} and rows.count() == n + 2


def local_repeats(docs, length, gram):
    raws = [(t or "").encode() for _, t in docs]
    off = np.cumsum([0, *map(len, raws)])
    raw = b"".join(raws)
    row, s, e, _ = suffix_dedup.fragments(np.frombuffer(raw, np.uint8), off, length, gram)
    index = {}
    which = np.array([index.setdefault(raw[x:y], len(index)) for x, y in zip(s.tolist(), e.tolist())], np.int64)
    ids = np.array([i for i, _ in docs], np.int64)
    spans = defaultdict(list)
    if len(index):
        for part in suffix_dedup.repeated_bytes(list(index), which, ids[row], s - off[row], length):
            for d, x, y in part.tolist():
                spans[d].append(x << 32 | y)
    return {i: (len(r), suffix_dedup._kept(r, sorted(spans[i]))[1]) for (i, _), r in zip(docs, raws)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é", max_size=60), max_size=6))
def test_interval_expansion_equals_brute_force_on_small_alphabets(texts):
    docs = list(enumerate(texts))
    # minimisers meet per hash, so all fragments in one call are a superset of what a task sees
    got = local_repeats(docs, 12, 4)
    assert got == {i: x[:2] for i, x in suffix_dedup.brute_force(docs, 12).items()}


def test_suffix_order():
    text = np.array([1, 2, 1, 2, 1, 0, 2, 1, 0], np.int64)
    order = suffix_dedup.suffix_order(text, 5).tolist()
    assert [tuple(text[i : i + 5]) for i in order] == sorted(tuple(text[i : i + 5]) for i in range(len(text)))


def test_fragments_hold_each_window_once():
    rng = random.Random(8)
    raws = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 200))) for _ in range(30)]
    off = np.cumsum([0, *map(len, raws)])
    row, s, e, _ = suffix_dedup.fragments(np.frombuffer(b"".join(raws), np.uint8), off)
    windows = Counter((r, p) for r, x, y in zip(row.tolist(), s.tolist(), e.tolist()) for p in range(x, y - 49))
    assert windows == Counter((r, p) for r in range(30) for p in range(off[r], off[r + 1] - 49))


def check_shards(rows, documents, shards):
    texts = dict(documents)
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(frame, documents, spark, empty):
    check_shards(sharding.shard_documents(frame).collect(), documents, 16)
    check_shards(sharding.shard_documents(frame, shards=3).collect(), documents, 3)
    assert sharding.shard_documents(empty).count() == 0
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got, [(1, None), (2, ""), (3, "a")], 16)


def test_sharding_keeps_groups_and_survives_a_hot_one(spark):
    docs = [(i, f"pair {i // 2}") for i in range(400)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=8).collect()
    check_shards(rows, docs, 8)
    at = defaultdict(set)
    for r in rows:
        at[r.doc_id // 2].add(r.shard)
    assert sum(len(x) == 1 for x in at.values()) >= 180
    hot = [(i, "same" if i % 2 else str(i)) for i in range(300)]
    check_shards(sharding.shard_documents(spark.createDataFrame(hot, "doc_id long, text string"), shards=8).collect(), hot, 8)


def test_sharding_cuts_fewer_links_than_hashing(spark):
    """Links within random groups: the share of them that shards cut, against the shards' hashed start."""
    rng = random.Random(9)
    group = [rng.randrange(120) for _ in range(1500)]
    links = [(i, j) for i in range(1500) for j in rng.sample(range(1500), 40) if group[i] == group[j] and i != j]
    df = spark.createDataFrame([(i, f"text {i}") for i in range(1500)], "doc_id long, text string")
    rows = sharding.shard_documents(df, spark.createDataFrame(links, "a long, b long"), 8).collect()
    check_shards(rows, [(i, f"text {i}") for i in range(1500)], 8)
    at = {r.doc_id: r.shard for r in rows}
    start = {r.doc_id: r.s for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 8) as s").collect()}
    cut, before = (sum(where[a] != where[b] for a, b in links) for where in (at, start))
    assert cut < 0.75 * before


def test_scratch_deletes_all_but_the_result(spark):
    from pathlib import Path

    from veilframe.llm import common

    with common.scratch(spark) as keep:
        made = common.materialize(spark.range(5), "made")
        with common.scratch(spark) as inner:
            part = inner(common.materialize(made, "deep").filter("id > 1"), "part")
        assert part.count() == 3 and made.count() == 5
        result = keep(part, "result")
    assert result.count() == 3
    folder = Path(keep.paths[0].removeprefix("file:")).parent
    names = {p.name.rsplit("-", 1)[0] for p in folder.iterdir()}
    assert Path(keep.paths[0].removeprefix("file:")).exists() and not names & {"made", "deep", "part"}
    with pytest.raises(ValueError), common.scratch(spark):
        lost = common.new_path(spark, "lost")
        spark.range(1).write.parquet(lost)
        raise ValueError
    assert not Path(lost.removeprefix("file:")).exists()


def test_shingles_of_rows_do_not_cross():
    got = dict(ngram_join.shingle_sets(pa.array(["a b c d e f", None, "a b c d e", ""])))
    assert [len(got[i]) for i in range(4)] == [2, 0, 1, 0] and got[2][0] in got[0]


def test_lookups_beyond_the_bound_are_shuffled(spark):
    from veilframe.llm.common import even_keys, join_on_id

    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 50, 5)], "doc_id long")
    for how, n in (("inner", 10), ("left_anti", 40), ("left", 50)):
        assert join_on_id(rows, ids, "doc_id", how, bound=3).count() == join_on_id(rows, ids, "doc_id", how).count() == n
    keys = even_keys(spark, 17)
    assert len(set(keys)) == 17
