"""Mixing, the prefix trie and the filter audit against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import filter_audit, mixing, prefix_trie
from veilframe.llm.running import running

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, place long, rank long, part string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, 3, 4, 5, "x") for i, t, s in rows], DOCS)


# --- running totals


def test_running_totals_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(9), i, rng.randrange(-5, 100), rng.getrandbits(62)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, v long, x long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r["g"], r["o"]): (r["rank"], r["run_v"], r["run_x"]) for r in running(df, "g", ["o"], ["v"], ["x"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {}, defaultdict(lambda: (0, 0, 0))
    for g, o, v, x in sorted(rows):
        n, s, z = held[g]
        held[g] = want[g, o] = (n + 1, s + v, z ^ x)
    assert got == want


# --- mixing


def _fill(sizes, weights, budget, epochs):
    """Targets by rounds: clamp whoever is above, share the rest."""
    fixed = {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed and w > 0}
        left = budget - sum(fixed.values())
        shares = {s: left * w / sum(free.values()) for s, w in free.items()}
        above = [s for s in shares if shares[s] > epochs * sizes[s]]
        if not above:
            return {s: fixed.get(s, shares.get(s, 0.0)) for s in sizes}
        fixed |= {s: epochs * sizes[s] for s in above}


def _check_mix(rows, got, weights, budget=1.5, epochs=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = _fill(sizes, weights, budget * sum(sizes.values()), epochs)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    taken, left = Counter(), defaultdict(list)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= math.ceil(epochs) * r["size"]
        taken[r["source"]] += r["taken"]
        if r["size"] and r["copies"] == int(targets[r["source"]] / sizes[r["source"]] + 1e-9):
            left[r["source"]].append(r["size"])
    for s in sizes:  # within the source's short documents
        assert -1e-6 <= targets[s] - taken[s] <= max([16, *([min(left[s]) * 16] if left[s] else [])]), (s, targets[s], taken[s])


def _sources(rng, n):
    text = lambda: rng.choice([None, "", " \t\n"]) if rng.random() < 0.1 else " ".join(["w"] * rng.choice([1, 2, 9, 40, 300, rng.randint(1, 5000)]))
    return [(rng.choice([None, rng.randrange(n)]) if rng.random() < 0.05 else i, text(), "src0" if rng.random() < 0.4 else rng.choice(["b", "a", "é", "", None, "Z"])) for i in range(n)]


def test_mix_meets_targets_and_caps(spark):
    rows = _sources(random.Random(1), 500)
    rows += [rows[7]] * 40  # rows that repeat
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    first = mixing.mix(_docs(spark, rows), keep=("lang",)).collect()
    _check_mix(rows, first, weights)
    again = mixing.mix(_docs(spark, rows[::-1]).repartition(7), keep=("lang",)).collect()
    assert Counter(first) == Counter(again)
    other = mixing.mix(_docs(spark, rows), seed=12).collect()
    assert Counter(first) != Counter(r for r in other)


def test_mix_with_given_weights_and_many_sources(spark, monkeypatch):
    rows = _sources(random.Random(2), 300)
    weights = {"src0": 0.5, "a": 3.0, None: 1.0}
    given = spark.createDataFrame([*weights.items(), ("absent", 9.0)], "source string, weight double")
    few = mixing.mix(_docs(spark, rows), given, budget=0.4, epochs=1.5).collect()
    _check_mix(rows, few, weights | {s: 0.0 for _, _, s in rows if s not in weights}, 0.4, 1.5)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert Counter(mixing.mix(_docs(spark, rows), given, budget=0.4, epochs=1.5).collect()) == Counter(few)


def test_mix_of_nothing(spark):
    assert mixing.mix(_docs(spark, [])).collect() == []
    blank = mixing.mix(_docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in blank} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_mixed_documents_repeat_texts(spark):
    rows = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(_docs(spark, rows)).collect()}
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(_docs(spark, rows)).collect())
    assert got == {(i, t): copies[i] for i, t, _ in rows if copies[i]}


# --- the trie


def _turns(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, key), role, text))
    return {c: [(role, text) for _, role, text in sorted(t)] for c, t in convs.items()}


def _rebuilt(rows):
    turns = _turns(rows)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: turns.get(c - c % 5, [])[: h[c]] + t[h[c] :] for c, t in turns.items()}


def _trie(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        own = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items()}


def _conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 9, 12, 40])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", None, "", f"text {rng.randrange(4)}"])))
    rows += [(None, 0, "user", "x")] * 3 + [(10**12 + 5, t, "user", "hi") for t in range(70)] + [(3, 1, "user", "same")] * 5
    return rows


CONV = "conv_id long, turn long, role string, text string, key string, depth long, total long"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_rebuilt_conversations(spark, seed):
    rows = _conversations(seed, 60)
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV).repartition(3)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(df)).collect()
    want = _trie(_rebuilt(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_conversations_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = _conversations(5, 30) + [(1000 + i, t, "user", f"turn {t}") for i in range(50) for t in range(2)]
    got = prefix_trie.prefix_trie(*prefix_trie.own_turns(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV))).collect()
    assert {tuple(r) for r in got} == _trie(_turns(rows))


def test_trie_with_hot_parents_and_nothing(spark, monkeypatch):
    from veilframe.llm import common

    monkeypatch.setattr(common, "HEAVY_ROWS", 4)
    monkeypatch.setattr(common, "HEAVY_KEYS", 20)
    rows = [(c, t, "user", "system" if t == 0 else f"{c if t == 2 else 0}") for c in range(0, 300, 1) for t in range(4)]
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONV))).collect()
    assert {tuple(r) for r in got} == _trie(_rebuilt(rows))
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(spark.createDataFrame([], CONV))).collect() == []


def test_trie_refuses_colliding_digests(spark):
    turns = spark.createDataFrame([(1, 1, b"a", 1, 1), (2, 1, b"b", 1, 1)], "conv_id long, position long, key binary, bytes long, total long")
    clash = turns.withColumn("key", F.lit(b"a")).withColumn("bytes", F.col("conv_id"))
    with pytest.raises(RuntimeError, match="one digest"):
        prefix_trie.prefix_nodes(clash, turns.select("conv_id", "total"))


# --- the audit


def _fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller,
    }


def _audit(rows, labels):
    texts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(_fails(t or "", i is not None and i > min(texts[t or ""])), i) for i, t, s in rows if (s or "") == part]
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                alive = [d for d in docs if not any(d[0][x] for x in order[: step - 1])]
                hit = [d for d in alive if d[0][f]]
                removed_by[f] += len(hit)
                out[part, order, step] = [
                    len(alive) - len(hit), len(hit), sum(d[0][f] for d in docs) - len(hit), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] in good for d in hit), sum(d[1] in toxic for d in hit),
                ]
        for order, step in itertools.product(map("".join, itertools.permutations("ABCDE")), range(1, 6)):
            out[part, order, step].append(removed_by[order[step - 1]])
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "DELTA", "x#", "y", "z|"] + [f"w{i}" for i in range(300)]
    text = lambda: rng.choice([None, "", " "]) if rng.random() < 0.1 else " ".join(rng.choice(words[rng.choice([0, 6]):rng.choice([8, 300])]) for _ in range(rng.choice([3, 199, 200, 260])))
    texts = [text() for _ in range(60)]
    rows = [(i if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["a", "a", None, "", "b"])) for i in range(250)]
    rows += [rows[3]] * 4 + [(rows[5][0], "another text", "b"), (-7, None, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 250, 2)] + [(4, 1, None), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.document_masks(_docs(spark, rows), frame)).collect()
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    want = _audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == want


def test_audit_of_nothing_and_of_too_much(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.document_masks(_docs(spark, []), labels)).collect() == []
    with pytest.raises(ValueError, match="too many"):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, n_good long, n_toxic long"), "ABCDEFG")
