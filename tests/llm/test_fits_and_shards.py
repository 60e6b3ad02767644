"""The quality fit against a dense Newton method, its named features against counting, and label propagation against plain
Python."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilframe.llm import quality, sharding


def _dense_newton(good, bad, pairs, ridge, rounds=60):
    """The same objective over differences that are laid out, with the whole Hessian."""
    rng = np.random.default_rng(11)
    both = np.concatenate([good, bad]).astype(np.float64)
    scale = np.maximum(both.std(0), 1e-4)
    i, j = rng.integers(0, len(good), pairs), rng.integers(0, len(bad), pairs)
    x = (good[i].astype(np.float64) - bad[j].astype(np.float64)) / scale
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, -x @ v).mean() + (ridge * v * v).sum() / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
        gradient = ridge * w - x.T @ p / pairs
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / pairs + np.diag(ridge), gradient)
        length = 1.0
        while length > 1e-6 and loss(w - length * step) > loss(w):
            length /= 2
        w = w - length * step
        if np.abs(gradient).max() < 1e-10:
            break
    return w / scale, loss(w)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairwise_fit_equals_a_dense_newton_method(seed):
    rng = np.random.default_rng(seed)
    good, bad = rng.random((80, 12)), rng.random((60, 12)) - np.linspace(0, 0.4, 12)
    ridge = np.repeat([1e-3, 3e-2], [5, 7])
    w = quality.fit_bradley_terry(good.copy(), bad.copy(), 4000, ridge)
    v, _ = _dense_newton(good, bad, 4000, ridge)
    every = np.concatenate([good, bad])
    s, t = every @ w, every @ v
    assert np.abs((s - s.mean()) - (t - t.mean())).max() < 0.02 * t.std()  # strengths differ by a constant at most
    assert (np.argsort(s[:80])[::-1][:10] == np.argsort(t[:80])[::-1][:10]).mean() > 0.8


def test_fit_takes_all_pairs_of_all_rows(spark):
    """Against a dense Newton method over every pair laid out."""
    rng = np.random.default_rng(4)
    x = rng.random((170, quality.WIDTH)) * (np.arange(quality.WIDTH) < 12)
    x[100:, :12] -= np.linspace(0, 0.4, 12)
    x, ridge = x.astype(np.float16), np.repeat([1e-3, 3e-2], [5, quality.WIDTH - 5])
    df = spark.createDataFrame([(int(i < 100), bytearray(r.tobytes())) for i, r in enumerate(x)], "quality int, x binary")
    w = quality.fit_all_pairs(df.repartition(3), ridge)
    good, bad = x[:100, :12].astype(np.float64), x[100:, :12].astype(np.float64)
    scale = np.maximum(np.concatenate([good, bad]).std(0), 1e-4)
    d = ((good[:, None] - bad[None]) / scale).reshape(-1, 12)
    v = np.zeros(12)
    for _ in range(40):
        p = 1 / (1 + np.exp(d @ v))
        v -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(ridge[:12]), ridge[:12] * v - d.T @ p / len(d))
    assert not w[12:].any() and np.abs(w[:12] - v / scale).max() < 0.01 * np.abs(v / scale).max()


def test_every_label_is_learnt_from(spark, monkeypatch):
    """A class of more ids than any bound that there was: the features of all of them are seen."""
    rows = [(i, i % 2) for i in range(27_000)]
    docs = spark.createDataFrame([(i, f"a{q}") for i, q in rows], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit_all_pairs", lambda df, ridge: seen.append(df.count()) or np.zeros(quality.WIDTH), raising=False)
    monkeypatch.setattr(quality, "fit_bradley_terry", lambda good, bad, **_: seen.append(len(good) + len(bad)) or np.zeros(quality.WIDTH))
    quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert seen == [docs.filter(~quality.held_out("doc_id")).count()] and seen[0] > 20_000


def test_threshold_is_an_order_statistic_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "ORDER_ROWS", 5)
    monkeypatch.setattr(quality, "ORDER_CELLS", 7)
    rng = random.Random(3)
    for rows in ([(i % 3 > 0, rng.gauss(i % 3, 1)) for i in range(200)], [(i % 2, float(i % 4)) for i in range(80)], [(0, 1.0), (1, 5.0)], [(0, 2.0), (0, 2.0), (1, 2.0)]):
        rows = [(int(q), z) for q, z in rows]
        n = Counter(q for q, _ in rows)
        z = sorted(z for _, z in rows)
        got = quality._threshold(spark.createDataFrame(rows, "quality int, z double"), dict(n))
        assert got == pytest.approx((z[n[0] - 1] + z[n[0]]) / 2, abs=1e-12)


def test_named_features_are_counts():
    texts = ["", None, "Hello, World! 42", "a a a b", "x" * 30 + " | y\nz #", "Straße été 😀"]
    got = quality.text_features(pa.array(texts, pa.string()))
    at = quality.NAMES.index
    for row, t in zip(got, texts):
        raw = (t or "").encode()
        found = (t or "").split()
        share = lambda n: n / max(len(raw), 1)
        want = {
            "empty": float(not found), "log_words": min(1, math.log1p(len(found)) / 12), "upper": share(sum(65 <= c < 91 for c in raw)), "digit": share(sum(48 <= c < 58 for c in raw)),
            "line": share(raw.count(b"\n")), "bar": share(raw.count(b"|")), "shout": share(raw.count(b"!")), "wide": share(sum(c > 127 for c in raw)),
            "word_length": min(1, sum(len(w.encode()) for w in found) / max(len(found), 1) / 16), "long_words": sum(len(w.encode()) > 20 for w in found) / max(len(found), 1),
            "repeat_1": sum(a == b for a, b in zip(found, found[1:])) / max(len(found), 1),
        }
        for name, value in want.items():
            assert row[at(name)] == pytest.approx(value, abs=1e-9), (t, name)


# --- sharding


def _hash(*values):
    """Spark's xxhash64 of longs and ints."""
    h = 42
    for fmt, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(fmt, v), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def _propagate(nodes, links, shards, rounds, slack):
    near = defaultdict(set)
    for a, b in links:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    start = {i: _hash(("<q", i)) % shards for i in nodes}
    label = {i: start[i] for i in near if i in start}
    free = Counter(start[i] for i in nodes if i not in label)
    capacity = len(nodes) / shards * (1 + slack) + 1
    for turn in range(rounds):
        wants = {}
        for i in label:
            votes = Counter(label[j] for j in near[i] if j in label)
            to = min(votes, key=lambda s: (-votes[s], s))
            gain = votes[to] - votes.get(label[i], 0)
            wants[i] = (to, gain > 0 and to != label[i] and _hash(("<q", i), ("<i", turn)) % 2 == 0)
        held = Counter(free) + Counter(label.values())
        flows = Counter((label[i], to) for i, (to, goes) in wants.items() if goes)
        if not flows:
            break
        share = {}
        for t in range(shards):
            into = {s: n for (s, u), n in flows.items() if u == t}
            swaps = {s: min(n, flows.get((t, s), 0)) for s, n in into.items()}
            room, rest = max(0.0, capacity - held[t]), sum(n - swaps[s] for s, n in into.items())
            for s, n in into.items():
                share[s, t] = (swaps[s] + ((n - swaps[s]) * min(1.0, room / rest) if rest else 0.0)) / n
        luck = lambda i: _hash(("<q", i), ("<i", turn + 1000)) % 1_000_003 / 1_000_003  # noqa: B023, E731
        label |= {i: to for i, (to, goes) in wants.items() if goes and luck(i) < share[label[i], to]}
    return start | label


def _slots(placed, linked, first, shards):
    """Rows of each shard up to its quota, linked ones first and by group; what is over fills the others in order."""
    rows = defaultdict(list)
    for i, s in placed.items():
        rows[s].append(i)
    sizes = [len(rows[s]) for s in range(shards)]
    order = sorted(range(shards), key=lambda s: (-sizes[s], s))
    quota = {s: len(placed) // shards + (k < len(placed) % shards) for k, s in enumerate(order)}
    out, over = {}, []
    for s in range(shards):
        ranked = sorted(rows[s], key=lambda i: (i not in linked, first[i], i))
        out |= {i: (s, k) for k, i in enumerate(ranked[: quota[s]])}
        over += ranked[quota[s] :]
    for s in range(shards):
        while min(sizes[s], quota[s]) < quota[s]:
            out[over.pop(0)] = (s, sizes[s])
            sizes[s] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_equal_plain_propagation(spark, seed):
    rng = random.Random(seed)
    texts = [f"text {rng.randrange(60)}" if rng.random() < 0.6 else f"own {i}" for i in range(200)] + [None, "", None]
    ids = rng.sample(range(-500, 5000), len(texts))
    got = {r.doc_id: r for r in sharding.shard_documents(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    first = {}
    for i, t in sorted(zip(ids, texts)):
        first.setdefault(t or "", i)
    groups = Counter(t or "" for t in texts)
    links = [(i, first[t or ""]) for i, t in zip(ids, texts) if groups[t or ""] > 1]
    placed = _propagate(ids, links, sharding.SHARDS, sharding.ROUNDS, sharding.SLACK)
    linked = {i for link in links for i in link}
    want = _slots(placed, linked, {i: first[t or ""] for i, t in zip(ids, texts)}, sharding.SHARDS)
    assert {i: (r.shard, r.slot) for i, r in got.items()} == want
    for i, t in zip(ids, texts):
        assert (got[i].size, got[i].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
