"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its text: densities of byte classes, word statistics, and hashed
words, word pairs and byte n-grams. Of each preference pair (a document with label 1, one
with label 0) the first should win; logistic loss on the difference of their features fits the weights, as in a
Bradley-Terry model, over all pairs of all training documents. The threshold is the quantile of the strengths that leaves below it the share of label 0 among all
training labels; scores are the logistic of the strength, shifted so that the threshold scores THRESHOLD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_on_id, materialize, one_row_per_id, released, scratch, small_batches, table
from .hashing import lower_table, mix, utf8_slices, word_hashes, word_table, words

#: Pairs that the fit in memory draws.
PAIRS = 120_000
THRESHOLD = 0.3

_IS_WORD = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Byte classes whose densities are features.
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "line": b"\n", "bar": b"|", "shout": b"!",
    "stop": b".,;:?", "quote": b"\"'()[]{}", "mark": b"#$%&*+/<=>@\\^_`~-", "wide": bytes(range(128, 256)), "control": bytes(range(9)) + bytes(range(14, 32)) + b"\x7f",
}
_TABLES = {k: ~word_table(v) for k, v in _CLASSES.items()}
NAMES = ("empty", "log_words", "word_length", "long_words", "repeat_1", "repeat_2", "marked_ends", "lone_marks", *_CLASSES)
#: Slots for hashed words, pairs of neighbouring words, and strings of NGRAM bytes, each; a text's shares of these count by
#: their square roots.
SLOTS, NGRAM = 128, 4
#: Named features and their square roots, then the slots.
NAMED = 2 * len(NAMES)
WIDTH = NAMED + 3 * SLOTS
#: Ridge on standardised weights: little on the named features, more on the many slots.
RIDGE, SLOT_RIDGE = 1e-3, 3e-2


def _shares(slots: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Square roots of each slot's share of a row's hits."""
    counts = np.bincount(row * SLOTS + slots, minlength=rows * SLOTS).reshape(rows, SLOTS).astype(np.float64)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def text_features(column: pa.Array) -> np.ndarray:
    """A row of WIDTH numbers in 0 to 1 for each text: the named features, their square roots, and the shares of the slots.
    Null counts as empty."""
    out, lexical = np.zeros((len(column), len(NAMES))), np.zeros((len(column), 3 * SLOTS))
    ends_marked = word_table(b"!#$%&*+/<=>@\\^_`~|")
    for first, data, off in utf8_slices(column):
        s, e, at = words(data, off, _IS_WORD)
        rows = slice(first, first + len(off) - 1)
        per = lambda x, cut: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[cut])
        size, n = np.diff(off).astype(np.float64), np.diff(at).astype(np.float64)
        by_size, by_words = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
        low = lower_table()[data]
        h = word_hashes(low, s, e)
        row = np.repeat(np.arange(len(n)), np.diff(at))
        cols = [(n == 0).astype(np.float64), np.log1p(n) / 12, per(e - s, at) * by_words / 16, per(e - s > 20, at) * by_words]
        for lag in (1, 2):
            same = np.zeros(len(h), bool)
            same[lag:] = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
            cols.append(per(same, at) * by_words)
        marked = ~ends_marked[data[e - 1]] if len(e) else np.zeros(0, bool)
        cols.append(per(marked, at) * by_words)
        cols.append(per(marked & (e - s == 1), at) * by_words)
        cols += [per(t[data], off) * by_size for t in _TABLES.values()]
        out[rows] = np.clip(np.stack(cols, 1), 0, 1)
        slot = lambda x: (x >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)
        pairs = np.flatnonzero(row[1:] == row[:-1])
        grams = np.zeros(max(0, len(low) - NGRAM + 1), np.uint32)
        for k in range(NGRAM):
            grams = grams << np.uint32(8) | low[k : k + len(grams)]
        owner = np.repeat(np.arange(len(n)), np.diff(off))
        whole = np.flatnonzero(owner[NGRAM - 1 :] == owner[: len(grams)])
        hashed = ((grams[whole] * np.uint32(0x9E3779B1)) >> np.uint32(33 - SLOTS.bit_length())).astype(np.int64)
        lexical[rows] = np.concatenate([_shares(slot(h), row, len(n)), _shares(slot(mix(h[pairs] * np.uint64(3) + h[pairs + 1])), row[pairs], len(n)), _shares(hashed, owner[whole], len(n))], 1)
    return np.concatenate([out, np.sqrt(out), lexical], 1)


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: np.ndarray | float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss of w . (good - bad) over drawn pairs of rows in memory, by Newton steps;
    fit_all_pairs is the form for tables. The differences are never laid out: each step's system is solved by conjugate
    gradients over the two sides, in their own precision. good and bad are scaled in place."""
    rng = np.random.default_rng(11)
    n = len(good) + len(bad)
    mean = (good.sum(0, dtype=np.float64) + bad.sum(0, dtype=np.float64)) / n
    square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (good, bad)) / n
    scale = np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-4)
    a, b = good, bad
    for x in (a, b):
        x /= scale.astype(x.dtype)
    same = lambda v: v.astype(a.dtype)  # noqa: E731  of another precision, it would be a's copy that is multiplied
    i, j = rng.integers(0, len(a), pairs), rng.integers(0, len(b), pairs)
    margins = lambda v: ((a @ same(v))[i] - (b @ same(v))[j]).astype(np.float64)
    back = lambda m: (same(np.bincount(i, m, len(a))) @ a - same(np.bincount(j, m, len(b))) @ b).astype(np.float64) / pairs
    loss = lambda v: np.logaddexp(0, -margins(v)).mean() + (ridge * v * v).sum() / 2
    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(margins(w), -40, 40)))
        gradient, curve = ridge * w - back(p), p * (1 - p)
        step, r = np.zeros_like(w), gradient.copy()
        d, size = r.copy(), r @ r
        for _ in range(40):
            if size < 1e-6 * (gradient @ gradient) or not size:
                break
            hd = back(curve * margins(d)) + ridge * d
            x = size / (d @ hd)
            step, r = step + x * d, r - x * hd
            d, size = r + (r @ r) / size * d, r @ r
        length = 1.0
        while length > 1e-4 and loss(w - length * step) > now:
            length /= 2
        w, before = w - length * step, now
        now = loss(w)
        if before - now < 1e-7:
            break
    return w / scale


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


#: Cells a unit of strength in which strengths are told apart, for the loss and its slope, and for its curvature alone.
FINE, COARSE = 32, 2
#: Newton steps at most; lengths that a step is tried at; what a step must promise or bring to go on; pieces of a sum.
ROUNDS, LENGTHS, LEAST_GAIN, PIECES = 30, (1.0, 0.5, 0.2, 0.05), 1e-7, 16
#: Rows of features at a time; cells of a round and rows at the end of the search for the threshold.
FEATURE_ROWS, ORDER_CELLS, ORDER_ROWS = 2048, 1000, 5000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(labels, features in double precision) of stored rows, FEATURE_ROWS at a time."""
    for b in batches:
        for at in range(0, len(b), FEATURE_ROWS):
            part = b.slice(at, FEATURE_ROWS)
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float16).reshape(len(part), WIDTH)
            yield part.column("quality").to_numpy(), x.astype(np.float64)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all rows of part(labels, features), an array of width numbers for a block of rows. A task adds up its own
    blocks, and a piece of the array is added up over tasks in one place and in their order, so the driver gets one array."""
    size = -(-width // PIECES)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * PIECES)
        for y, x in _blocks(batches):
            total[:width] += part(y, x)
        data = [total[k * size : (k + 1) * size].tobytes() for k in range(PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([TaskContext.get().partitionId()] * PIECES, pa.int32()), pa.array(data, pa.binary())], names=["k", "task", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v")):
                sums[k] = sums.get(k, 0) + np.frombuffer(v.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["k", "v"])

    parts = rows.mapInArrow(released(own), "k int, task int, v binary").repartition(PIECES, "k").sortWithinPartitions("k", "task")
    found = {r[0]: r[1] for r in parts.mapInArrow(together, "k int, v binary").collect()}
    return np.concatenate([np.frombuffer(found[k], np.float64) for k in range(PIECES)])[:width]


def _cells(rows: DataFrame, ways: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> list[dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]]:
    """For each column of ways the strengths of both labels, as {(label, fine): (cells, documents in them)}. A document's strength
    is shared between the two fine cells next to it, so that sums over cells change with it without jumps; it has one coarse
    cell. There are as many rows as cells, which the range of strengths bounds, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, x in _blocks(batches):
            s = (x - mean) / scale @ ways
            for way in range(s.shape[1]):
                for q in (0, 1):
                    v = s[y == q, way]
                    if not len(v):
                        continue
                    at = v * FINE
                    low = np.floor(at)
                    for fine, cell, n in ((True, np.concatenate([low, low + 1]), np.concatenate([1 - (at - low), at - low])), (False, np.floor(v * COARSE + 0.5), np.ones(len(v)))):
                        cells, which = np.unique(cell.astype(np.int64), return_inverse=True)
                        k = len(cells)
                        yield pa.RecordBatch.from_arrays([pa.array([way] * k, pa.int32()), pa.array([q] * k, pa.int32()), pa.array([fine] * k), pa.array(cells), pa.array(np.bincount(which, n, k))], names=["way", "quality", "fine", "cell", "n"])

    found = rows.mapInArrow(released(run), "way int, quality int, fine boolean, cell long, n double").groupBy("way", "quality", "fine", "cell").agg(F.sum("n").alias("n")).collect()
    out: list[dict] = [{} for _ in range(ways.shape[1])]
    for r in sorted(found):
        out[r[0]].setdefault((r[1], r[2]), []).append((r[3], r[4]))
    return [{k: (np.array([c for c, _ in v], np.int64), np.array([n for _, n in v])) for k, v in x.items()} for x in out]


def _over(points: np.ndarray, cells: np.ndarray, n: np.ndarray, unit: int, function) -> np.ndarray:
    """For each point the sum of n x function(point - cell), both in units."""
    return np.concatenate([function((points[i : i + 256, None] - cells) / unit) @ n for i in range(0, len(points), 256)])


def _losing(u: np.ndarray) -> np.ndarray:
    """The chance that the stronger by u loses."""
    return 1 / (1 + np.exp(np.clip(u, -700, 700)))


def _every(cells: np.ndarray) -> np.ndarray:
    return np.arange(cells.min(), cells.max() + 1)


def fit_all_pairs(rows: DataFrame, ridge: np.ndarray) -> np.ndarray:
    """Weights that minimise the mean logistic loss over all pairs of a document with label 1 and one with label 0, and the ridge
    on standardised weights, from rows (quality, x: WIDTH half-precision numbers), by Newton steps.

    What a document adds to the loss depends on its own strength and on how the other label's strengths are spread, so a
    step takes two passes over the rows, not one over their pairs: one counts strengths by cells, for several lengths of the
    step before, and one sums the slope and the curvature that follow from these counts.
    """
    moments = lambda y, x: np.concatenate([np.concatenate([[(y == q).sum()], x[y == q].sum(0), np.square(x[y == q]).sum(0)]) for q in (0, 1)])
    sums = _summed(rows, moments, 2 * (1 + 2 * WIDTH)).reshape(2, -1)
    n = sums[:, 0]
    if not n.all():
        return np.zeros(WIDTH)
    mean, square = (sums[:, i : i + WIDTH].sum(0) / n.sum() for i in (1, 1 + WIDTH))
    scale = np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-4)  # features are centred too, so that constant ones cancel
    pairs = n[0] * n[1]

    def loss(w: np.ndarray, counts: dict) -> float:
        (good, a), (bad, b) = counts[1, True], counts[0, True]
        return float(a @ _over(good, bad, b, FINE, lambda u: np.logaddexp(0, -u))) / pairs + float((ridge * w * w).sum() / 2)

    w = np.zeros(WIDTH)
    counts = _cells(rows, w[:, None], mean, scale)[0]
    now = loss(w, counts)
    for _ in range(ROUNDS):
        lowest = min(counts[q, False][0].min() for q in (0, 1))
        wide = int(max(counts[q, False][0].max() for q in (0, 1)) - lowest + 1)
        slopes, curves = {}, {}
        for q, sign in ((1, 1), (0, -1)):  # how a document of label q would be moved, and how stiffly, by its strength
            at = _every(counts[q, True][0])
            slopes[q] = at / FINE, sign * _over(sign * at, sign * counts[1 - q, True][0], counts[1 - q, True][1], FINE, _losing) / pairs
            curves[q] = _over(np.arange(wide) + lowest, *counts[1 - q, False], COARSE, lambda u: _losing(u) * _losing(-u)) / pairs

        def part(y: np.ndarray, x: np.ndarray, w=w, lowest=lowest, wide=wide, slopes=slopes, curves=curves) -> np.ndarray:
            x = (x - mean) / scale
            s = x @ w
            cell = np.clip(np.floor(s * COARSE + 0.5).astype(np.int64) - lowest, 0, wide - 1)
            slope = np.where(y == 1, np.interp(s, *slopes[1]), np.interp(s, *slopes[0]))
            curve = np.where(y == 1, curves[1][cell], curves[0][cell])
            held = np.zeros((2 * wide, len(y)))
            held[y * wide + cell, np.arange(len(y))] = 1
            return np.concatenate([slope @ x, ((x * curve[:, None]).T @ x).ravel(), (held @ x).ravel()])

        sums = _summed(rows, part, WIDTH + WIDTH * WIDTH + 2 * wide * WIDTH)
        gradient = ridge * w - sums[:WIDTH]
        bad, good = sums[WIDTH + WIDTH * WIDTH :].reshape(2, wide, WIDTH)
        u = (np.arange(wide)[:, None] - np.arange(wide)) / COARSE
        crossed = good.T @ (_losing(u) * _losing(-u) / pairs) @ bad
        hessian = sums[WIDTH : WIDTH + WIDTH * WIDTH].reshape(WIDTH, WIDTH) - crossed - crossed.T + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        tried = w[:, None] - step[:, None] * np.array(LENGTHS)
        found = _cells(rows, tried, mean, scale)
        losses = [loss(tried[:, i], c) for i, c in enumerate(found)]
        best = int(np.argmin(losses))
        gain = now - losses[best]
        if gain > 0:
            w, counts, now = tried[:, best].copy(), found[best], losses[best]
        if gain < LEAST_GAIN or gradient @ step / 2 < LEAST_GAIN:
            break
    return w / scale


def _threshold(strengths: DataFrame, shares: dict[int, int]) -> float:
    """The strength halfway between the document at which the weight of those below reaches label 0's share and the next one.
    strengths: (quality, z). The range that holds it is narrowed down by counts until few rows are left in it."""
    n = {r[0]: r[1] for r in strengths.groupBy("quality").count().collect()}
    weight = {q: shares[q] / n[q] for q in n}
    want, inside = shares[0] * (1 - 1e-9), strengths
    while True:
        low, high, rows = inside.agg(F.min("z"), F.max("z"), F.count(F.lit(1))).first()
        if low == high or rows <= ORDER_ROWS:
            break
        cell = F.least(F.floor((F.col("z") - low) / (high - low) * ORDER_CELLS), F.lit(ORDER_CELLS - 1))
        sizes: dict[int, float] = {}
        for k, q, count in inside.groupBy(cell.alias("k"), "quality").count().collect():
            sizes[k] = sizes.get(k, 0.0) + count * weight[q]
        last = max(sizes)
        for k in sorted(sizes):
            if sizes[k] >= want or k == last:
                break
            want -= sizes[k]
        inside = inside.filter(cell == k)
    found = sorted((z, q, count) for z, q, count in inside.groupBy("z", "quality").count().collect())
    for i, (z, q, count) in enumerate(found):  # noqa: B007
        if count * weight[q] >= want or i == len(found) - 1:
            break
        want -= count * weight[q]
    if count * weight[q] - want >= weight[q] or any(other[0] == z for other in found[i + 1 :]):
        return float(z)  # the next one is as strong
    after = strengths.filter(F.col("z") > z).agg(F.min("z")).first()[0]
    if after is None:  # the strongest is the last that can be above
        after = z if count > 1 else strengths.filter(F.col("z") < z).agg(F.max("z")).first()[0]
    return float((z + (z if after is None else after)) / 2)


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, threshold on the strength) from all labelled documents that are not held out, and all pairs of them.

    Their features are written once, WIDTH half-precision numbers a document, and every pass runs over these in tasks; the
    driver gets sums and counts by cells, whose size does not depend on the number of documents. An id that labels repeat
    counts once, with the least of its labels; one that documents repeat counts once, with the least of its texts (null first).
    Without labels of both classes there is nothing to learn: weights and threshold are 0.
    """
    spark = documents.sparkSession
    small_batches(spark)
    with scratch(spark):  # nothing but numbers leaves it
        known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
        known = materialize(known, "known")
        shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
        if len(shares) < 2:
            return np.zeros(WIDTH), 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = pa.array([x.tobytes() for x in text_features(b.column("text")).astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("quality"), packed], names=["quality", "x"])

        labelled = join_on_id(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), known, "doc_id")
        texts = one_row_per_id(labelled, "doc_id", "text", ("quality",)).select("quality", "text")
        rows = materialize(texts.mapInArrow(released(run), "quality int, x binary"), "features").coalesce(2 * spark.sparkContext.defaultParallelism)
        if rows.select("quality").distinct().count() < 2:
            return np.zeros(WIDTH), 0.0
        w = fit_all_pairs(rows, np.repeat([RIDGE, SLOT_RIDGE], [NAMED, WIDTH - NAMED]))

        def strength(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for y, x in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x @ w)], names=["quality", "z"])

        return w, _threshold(materialize(rows.mapInArrow(released(strength), "quality int, z double"), "strengths"), shares)


def score(documents: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, *keep and score, one row for each input row, repeated or not. Null and empty texts get the score of their
    features. Other columns are ignored."""
    spark = documents.sparkSession
    small_batches(spark)
    w, threshold = model
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) if np.any(w) else 0.0
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column("text")).astype(np.float16).astype(np.float64)  # as train stores them: its threshold is one of these
            z = np.clip(x @ w - threshold + shift, -700, 700)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(1 / (1 + np.exp(-z)))], names=[*kept, "score"])

    fields = ", ".join(f"`{c}` {dict(documents.dtypes)[c]}" for c in kept)
    return documents.select(*dict.fromkeys([*kept, "text"])).mapInArrow(released(run), f"{fields}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
