"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Documents are sets of word shingles (as 64-bit hashes). Documents with the same words in the same order (by a cryptographic
digest of them) are one class. Two classes that reach the threshold t
have sizes within a factor t and share a shingle among the first n - ceil(t n) + 1 of any common order, so a tile holds
the classes of one such shingle, sorted by size, and only neighbours within the size band of a class are paired. The
order puts frequent shingles last (their counts come from all documents), which keeps a passage that many documents share
out of the tiles. Each pair's bitmaps then bound the overlap from above: the parity bitmaps of two sets differ in at most
as many bits as the sets differ in elements, so overlap <= (|A| + |B| - differing bits) / 2. Pairs whose bound reaches
the threshold are verified by intersecting the sorted arrays; of what reaches it the shingles of equal hashes are compared
as text, so that no link rests on a hash.

Large groups of near copies would still give pairs by the square. They are joined first: classes with equal min-hash
bands are compared with one pivot, verified exactly, and united; the tiles then pair only classes of different components.
No link between components can be missed, as the tiles cover every pair above the threshold.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import by_id, heavy_keys, join_heavy, join_on_id, materialize, one_row_per_id, partitions, released, scratch, small_batches, table
from .components import connected_components
from .hashing import joined_words, lower_table, mix, utf8_slices, window_hashes, word_hashes, word_table, words

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Min-hash bands for the first pass and rows of each; they decide speed only, as the tiles cover what the bands miss.
BANDS, BAND_ROWS = 6, 3
#: Counters of the frequency table (broadcast as one byte each, 16 MB at any size); its precision decides speed only.
COUNTERS, CHUNK = 1 << 24, 1 << 16
#: Members of a band's bucket that a class is compared with: the first, and those so many places before it.
BACK = (1, 4)
#: Members of a component whose bitmaps travel together, and classes that meet them in one task.
CHUNK_MEMBERS, CHUNK_MET = 256, 4096
#: Copies of a pivot's text, over which its partners are dealt.
SALTS = 16
#: Rows of one tile that are paired in one step, and pairs that are held at most before they are put out: with these a tile
#: holds no more than the rows within one size band.
BLOCK, HELD_PAIRS = 2048, 1 << 20
#: A tile whose shingle is in so many documents is split: its rows fall into groups, and each two groups are a tile.
HOT_TILE, MOST_GROUPS = 4096, 32

_IS_WORD = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")


class Shingled(NamedTuple):
    """A text's shingles: sorted distinct hashes, the hashes in order, and where each lies in the bytes of the joined words."""

    distinct: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    joined: np.ndarray


def shingled(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, Shingled]]:
    """(row, its shingles) of every row; a text with fewer than k words but some is one shingle."""
    for first, data, off in utf8_slices(column):
        data = lower_table()[data]
        s, e, at = words(data, off, _IS_WORD)
        w = word_hashes(data, s, e)
        h = window_hashes(w, k)
        joined, begin = joined_words(data, s, e)
        for r in range(len(off) - 1):
            a, b = int(at[r]), int(at[r + 1])
            size = min(k, b - a)
            x = h[a : b - k + 1] if b - a >= k else window_hashes(w[a:b], size) if size else h[:0]
            begins = begin[a : a + len(x)] - begin[a]
            distinct = np.sort(x)
            if len(x):
                distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
            yield first + r, Shingled(distinct, x, begins, begin[a + size : a + size + len(x)] - begin[a], joined[begin[a] : begin[b]])


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row; a text with fewer than k words but some is one shingle."""
    for first, data, off in utf8_slices(column):
        data = lower_table()[data]
        s, e, at = words(data, off, _IS_WORD)
        w = word_hashes(data, s, e)
        h = window_hashes(w, k)
        for r in range(len(off) - 1):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= k:
                x = np.sort(h[a : b - k + 1])
                yield first + r, x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:
                yield first + r, window_hashes(w[a:b], b - a)
            else:
                yield first + r, np.zeros(0, np.uint64)


def equal_as_text(a: Shingled, b: Shingled, step: int = 1 << 14) -> bool:
    """Whether all shingles of two texts that have one hash are one string."""
    hashes, sizes = np.concatenate([a.hashes, b.hashes]), np.concatenate([a.ends - a.begins, b.ends - b.begins])
    begins, text = np.concatenate([a.begins, b.begins + len(a.joined)]), np.concatenate([a.joined, b.joined])
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    left, right = order[same], order[same + 1]
    if (sizes[left] != sizes[right]).any():
        return False
    for i in range(0, len(left), step):
        x, y, n = begins[left[i : i + step]], begins[right[i : i + step]], sizes[left[i : i + step]]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (text[at + np.repeat(x, n)] != text[at + np.repeat(y, n)]).any():
            return False
    return True


def linked(a: Shingled, b: Shingled, num: int = NUMERATOR, den: int = DENOMINATOR) -> bool:
    """Whether den * intersection >= num * union: by the sorted arrays of hashes, and as text if they say so."""
    both = len(np.intersect1d(a.distinct, b.distinct, assume_unique=True))
    if not both or den * both < num * (len(a.distinct) + len(b.distinct) - both):
        return False
    if equal_as_text(a, b):
        return True
    x, y = ({t.joined[i:j].tobytes() for i, j in zip(t.begins.tolist(), t.ends.tolist())} for t in (a, b))
    return den * len(x & y) >= num * len(x | y)


def least_overlap(na: np.ndarray, nb: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    """The least intersection with den * overlap >= num * union, union = na + nb - overlap."""
    return -(-num * (na + nb) // (num + den))


def bitmap(x: np.ndarray) -> bytes:
    """Parity bitmap: bit h mod width flips for each element; the width is a power of two of at least 2 n, so bitmaps of
    neighbouring size bands fold onto each other."""
    width = max(64, 1 << (2 * len(x) - 1).bit_length())
    ones = np.bincount((mix(x) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bands(x: np.ndarray) -> list[int]:
    """Keys of BANDS bands of BAND_ROWS min-hashes, each the least element of one of BANDS * BAND_ROWS bins."""
    bins = BANDS * BAND_ROWS
    b = (mix(x) % np.uint64(bins)).astype(np.int64)
    first = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(first, b, x)
    out = []
    for i in range(BANDS):
        rows = first[i * BAND_ROWS : (i + 1) * BAND_ROWS]
        out.append(int(window_hashes(np.concatenate([rows, [np.uint64(i)]]), BAND_ROWS + 1)[0].astype(np.int64)))
    return list(dict.fromkeys(out))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, n, h1, h2: a 128-bit digest of its words, bands, bits) and, with a null doc_id, chunks
    of the shingles' frequency table (chunk, counts)."""
    ddl = "doc_id long, n long, h1 long, h2 long, bands array<long>, bits binary, chunk int, counts binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint16)  # of this task; beyond 16 bits a shingle is frequent by any measure
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for r, t in shingled(b.column("text")):
                x = t.distinct
                at = (x & np.uint64(COUNTERS - 1)).astype(np.int64)
                counts[at] += counts[at] < 65535
                h1, h2 = np.frombuffer(hashlib.blake2b(t.joined.tobytes(), digest_size=16).digest(), np.int64).tolist()
                rows.append((ids[r], len(x), h1, h2, _bands(x) if len(x) else [], bitmap(x) if len(x) else b"", None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)
        pack = zstandard.ZstdCompressor(level=1)
        parts = ((i, counts[i * CHUNK : (i + 1) * CHUNK]) for i in range(COUNTERS // CHUNK))
        # low and high bytes apart, which packs better
        rows = [(None,) * 6 + (i, pack.compress(x.view(np.uint8).reshape(-1, 2).T.tobytes())) for i, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return docs.mapInArrow(released(run), ddl)


def frequency_levels(feats: DataFrame) -> tuple[float, np.ndarray]:
    """A base, and for each counter its shingles' number over it, as a power of two. Summed on the executors; the driver
    gets one byte for each counter at every size of the corpus."""
    total = feats.filter("doc_id is not null").agg(F.sum("n")).first()[0] or 0
    base = 1.5 * max(1.0, total / COUNTERS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(unpack.decompress(x), np.uint8).reshape(2, -1).T.copy().view(np.uint16)[:, 0].astype(np.uint64)
                sums[c] = sums[c] + x if c in sums else x
        if sums:
            level = (np.clip(np.log2(np.maximum(x / base, 1)), 0, 63).astype(np.uint8) for x in sums.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in level], pa.binary())], names=["chunk", "levels"])

    chunks = feats.filter("chunk is not null").select("chunk", "counts")
    levels = np.zeros(COUNTERS, np.uint8)
    for c, x in chunks.repartition(min(COUNTERS // CHUNK, partitions(feats.sparkSession)), "chunk").mapInArrow(released(add), "chunk int, levels binary").collect():
        levels[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(x, np.uint8)
    return base, levels


def verify(docs: DataFrame, pairs: DataFrame, k: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """Those of pairs (a, b: doc_ids) whose sets link: exact intersection of the sorted arrays. A pivot's partners are
    dealt over SALTS tasks, each with a copy of its text, and stream past it."""
    spark = docs.sparkSession
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialize(join_on_id(docs, ids, "doc_id"), "texts")
    pivots = pairs.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "salt", "b", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivot = None, None
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            left, right = [], []
            for r, x in shingled(batch.column("text"), k):
                if b[r] is None:
                    # a copy, as the slice that holds this text goes
                    held, pivot = (a[r], salt[r]), Shingled(*(v.copy() for v in x))
                    continue
                assert held == (a[r], salt[r])
                if linked(pivot, x, num, den):
                    left.append(a[r])
                    right.append(b[r])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = pivots.unionByName(others).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(released(compare), "a long, b long")


def _pivot_pairs(classes: DataFrame) -> DataFrame:
    """Candidates of the first pass: each class with a few others of its band's bucket. Rows of a key stream by, so each
    class gives at most 1 + len(BACK) pairs, whatever the bucket's size."""
    spark = classes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot, size = None, None, 0
        recent: deque = deque(maxlen=max(BACK))
        for b in batches:
            k, c, n = (b.column(x).to_pylist() for x in ("key", "cls", "n"))
            pairs = set()
            for i in range(len(k)):
                if key is None or k[i] != key:
                    recent.clear()
                    key, pivot, size = k[i], c[i], n[i]
                elif DENOMINATOR * size < NUMERATOR * n[i]:
                    pivot, size = c[i], n[i]
                for other, m in ((pivot, size), *(recent[-d] for d in BACK if d <= len(recent))):
                    if other != c[i] and DENOMINATOR * m >= NUMERATOR * n[i]:
                        pairs.add((min(other, c[i]), max(other, c[i])))
                recent.append((c[i], n[i]))
            left, right = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = classes.select(F.explode("bands").alias("key"), "n", "cls").repartition(partitions(spark), "key").sortWithinPartitions("key", "n", "cls")
    return rows.mapInArrow(released(run), "a long, b long").distinct()


def _groups_of(level: np.ndarray, base: float) -> np.ndarray:
    """Into how many groups a tile is split whose shingle has this level: 1, or a power of two."""
    size = base * np.exp2(level.astype(np.float64) + 1)
    return np.where(level > 0, np.clip(np.exp2(np.ceil(np.log2(np.maximum(size / HOT_TILE, 0.5)))), 1, MOST_GROUPS), 1).astype(np.int64)


def _split_hot(key: np.ndarray, cls: np.ndarray, comp: np.ndarray, place: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    """The rows with those of split tiles in a copy for each group that theirs meets. Keys of a tile of two groups are odd, and
    the rows of the second have _SIDE set; all other keys are even."""
    key = key & ~np.uint64(1)
    hot = np.flatnonzero(groups > 1)
    if not len(hot):
        return [key, cls, comp, place]
    n = groups[hot]
    row = np.repeat(hot, n)
    own = (mix(cls[row].view(np.uint64)) % groups[row].astype(np.uint64)).astype(np.int64)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.minimum(own, other), np.maximum(own, other)
    mixed = mix(key[row] + (low * MOST_GROUPS + high + 1).astype(np.uint64) * np.uint64(2))
    mixed = np.where(low == high, mixed & ~np.uint64(1), mixed | np.uint64(1))
    side = np.where((low < high) & (own == high), _SIDE, 0)
    plain = np.flatnonzero(groups == 1)
    return [np.concatenate(x) for x in ((key[plain], mixed), (cls[plain], cls[row]), (comp[plain], comp[row]), (place[plain], place[row] | side))]


#: In a place, marks rows of a split tile's second group; sizes are above it, ranks below.
_SIDE = np.int64(1 << 31)


def _prefixes(docs: DataFrame, levels: np.ndarray, base: float) -> DataFrame:
    """(key, cls, comp, place) for the prefix shingles of docs (doc_id, text, comp). place holds the set's size and, below
    it, how many shingles come before this one in the common order. Tiles of frequent shingles are split."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for b in batches:
            ids, comps = b.column("doc_id").to_numpy(), b.column("comp").to_numpy()
            keys, marks, at = [], [], []
            for r, x in shingle_sets(b.column("text")):
                n = len(x)
                if n:
                    p = n - -(-NUMERATOR * n // DENOMINATOR) + 1
                    v = level[(x & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    if v.any():
                        order = np.argsort(v, kind="stable")[:p]
                        x, v = x[order], v[order]
                    keys.append(x[:p])
                    marks.append(v[:p])
                    at.append((r, len(keys[-1]), n))
            if not keys:
                continue
            rows, sizes, n = (np.array(v, np.int64) for v in zip(*at))
            every = np.repeat(rows, sizes)
            before = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key, cls, comp, place = _split_hot(np.concatenate(keys), ids[every], comps[every], np.repeat(n, sizes) << 32 | before, _groups_of(np.concatenate(marks), base))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(cls), pa.array(comp), pa.array(place)], names=["key", "cls", "comp", "place"])

    return docs.mapInArrow(released(run), "key long, cls long, comp long, place long")


def _tile_pairs(prefixes: DataFrame) -> DataFrame:
    """(comp_a, b, comp_b): classes b that a class of another component comp_a meets in a tile, both within each other's size
    band and able to reach the threshold if the tile's key is the first they share. Rows come sorted by key and size; a
    tile is compared in blocks, and what is behind the size band is forgotten. Of the pairs with the members of one
    component only one row is put out."""
    spark = prefixes.sparkSession

    def fits(n1, p1, n2, p2):  # n1 <= n2
        return (DENOMINATOR * n1 >= NUMERATOR * n2) & (np.minimum(n1 - p1, n2 - p2) >= least_overlap(n1, n2))

    def pair(comp, n, p, side, begin):  # rows from begin on against all rows before them; side: of a tile of two groups
        for i in range(begin, len(comp), BLOCK):
            j = min(len(comp), i + BLOCK)
            low = int(np.searchsorted(n, -(-NUMERATOR * n[i] // DENOMINATOR)))
            for o in range(low, j, BLOCK):
                u = min(j, o + BLOCK)
                apart = (comp[i:j, None] != comp[None, o:u]) & (np.arange(o, u)[None, :] < np.arange(i, j)[:, None])
                if side is not None:
                    apart &= side[i:j, None] != side[None, o:u]
                y, x = np.nonzero(apart)
                y, x = i + y, o + x
                ok = fits(n[x], p[x], n[y], p[y])
                yield x[ok], y[ok]

    def met(cls, comp, left, right) -> pa.RecordBatch:
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        x, y = np.where(comp[x] < comp[y], x, y), np.where(comp[x] < comp[y], y, x)
        rows = np.unique(np.stack([comp[x], cls[y], comp[y]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["comp_a", "b", "comp_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "cls", "comp", "place")]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, cls, comp, place = cols
            if not len(key):
                continue
            n, p = place >> 32, place & (int(_SIDE) - 1)
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            # most tiles have two rows
            two = starts[(ends - starts == 2) & (ends > fresh)]
            two = two[comp[two] != comp[two + 1]]
            two = two[fits(n[two], p[two], n[two + 1], p[two + 1])]
            left, right, size = [two], [two + 1], len(two)
            many = np.flatnonzero((ends - starts > 2) & (ends > fresh))
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                if (comp[s:e] != comp[s]).any():
                    side = place[s:e] & _SIDE if key[s] & 1 else None
                    for x, y in pair(comp[s:e], n[s:e], p[s:e], side, max(0, fresh - s)):
                        left.append(s + x)
                        right.append(s + y)
                        size += len(x)
                        if size > HELD_PAIRS:
                            yield met(cls, comp, left, right)
                            left, right, size = [], [], 0
            s = int(starts[-1])
            s += int(np.searchsorted(n[s:], -(-NUMERATOR * n[-1] // DENOMINATOR)))
            held = [v[s:] for v in cols]
            yield met(cls, comp, left, right)

    dealt = prefixes.repartition(partitions(spark), "key").sortWithinPartitions("key", "place", "cls")
    return dealt.mapInArrow(released(run), "comp_a long, b long, comp_b long").distinct()


def _band(n: F.Column) -> F.Column:
    """Sizes within the threshold's factor of each other are in the same or neighbouring bands."""
    return F.floor(F.log(n) / float(np.log(DENOMINATOR / NUMERATOR * 1.005))).cast("int")


def _bounded(met: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(a, comp_a, b, comp_b, spare): pairs of met classes b with the members a of component comp_a whose bitmaps leave room
    for enough overlap, and how much.

    Members of a component fall by size into bands, and a band into chunks of about CHUNK_MEMBERS. A chunk's members are one
    row; met classes of the band and its neighbours stream past it. A chunk that many classes meet is copied into several
    tasks, over which these are dealt, and components with a large share of rows are salted where numbers are looked up.
    """
    spark = met.sparkSession
    times = materialize(met.groupBy(F.col("comp_a").alias("comp")).agg(F.count(F.lit(1)).alias("times")), "times")
    often = heavy_keys(times, "comp", "times")
    sized = comps.join(classes.select("cls", "n", "bits"), "cls").withColumn("band", _band(F.col("n")))
    members = join_heavy(sized, times, "comp", "cls", heavy_keys(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")), "comp", "rows"))
    tiles = members.groupBy("comp", "band").agg(F.ceil(F.count(F.lit(1)) / CHUNK_MEMBERS).cast("int").alias("chunks"), F.least(F.ceil(F.max("times") / CHUNK_MET), F.lit(256)).cast("int").alias("salts"))
    tiles = materialize(tiles, "tiles")
    large = tiles.filter("chunks > 1").select("comp", "band", "chunks")
    chunk = F.coalesce(F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"), F.lit(0))
    of_large = members.join(F.broadcast(large) if large.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS else large, ["comp", "band"], "left")
    packed = of_large.groupBy("comp", "band", chunk.alias("chunk")).agg(F.collect_list(F.struct("cls", "n", "bits")).alias("members"))
    copies = packed.join(tiles.select("comp", "band", "salts"), ["comp", "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    side = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bitsb"))
    near = met.join(side, "b").withColumn("band", F.explode(F.array(*[_band(F.col("nb")) + i for i in (-1, 0, 1)]))).withColumnRenamed("comp_a", "comp")
    every = tiles.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("chunks", "salts")))).alias("bands"))
    looked = join_heavy(near, every, "comp", "b", often).withColumn("tile", F.try_element_at("bands", F.col("band"))).filter("tile is not null")
    dealt = looked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("tile.chunks") - 1))).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("tile.salts")).cast("int"))
    key, names = ["comp", "band", "chunk", "salt"], ["a", "comp_a", "b", "comp_b", "spare"]
    rows = copies.select(*key, "members").unionByName(dealt.select(*key, "b", "comp_b", "nb", "bitsb"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, cls, maps = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            at = list(zip(*(batch.column(c).to_pylist() for c in key)))
            b, comp_b, nb = (batch.column(c).to_pylist() for c in ("b", "comp_b", "nb"))
            bits, members = batch.column("bitsb"), batch.column("members")
            for r in range(len(b)):
                if b[r] is None:
                    flat = members[r].values
                    held, sizes, cls, maps = at[r], flat.field("n").to_numpy().copy(), flat.field("cls").to_numpy().copy(), flat.field("bits").to_pylist()
                    continue
                assert held == at[r]
                own = bits[r].as_py()
                for i in np.flatnonzero(DENOMINATOR * np.minimum(sizes, nb[r]) >= NUMERATOR * np.maximum(sizes, nb[r])).tolist():
                    na = int(sizes[i])
                    spare = (na + nb[r] - differing_bits(maps[i], own)) // 2 - int(least_overlap(na, nb[r]))
                    if spare >= 0:
                        out.append((int(cls[i]), at[r][0], b[r], comp_b[r], spare))
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    spread = rows.repartition(partitions(spark), *key).sortWithinPartitions(*key, F.col("b").asc_nulls_first())
    return spread.mapInArrow(released(run), "a long, comp_a long, b long, comp_b long, spare long")


def _relabel(pairs: DataFrame, united: DataFrame) -> DataFrame:
    """pairs with the components of united (node, component), without pairs that are in one by now."""
    out = pairs
    for c in ("comp_a", "comp_b"):
        out = out.join(united.select(F.col("node").alias(c), F.col("component").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.filter("comp_a <> comp_b")


def _comp_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) of classes as links of their components."""
    return links.join(pairs.select("a", "b", "comp_a", "comp_b"), ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()


def similarity_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document.

    Null and wordless texts have no shingles and are their own component. Rows without a doc_id are left out; rows that
    repeat a doc_id count as one document (see one_row_per_id). Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    with scratch(spark) as keep, by_id(one_row_per_id(documents, "doc_id", "text")) as docs:
        return keep(_components(docs), "components")


def _components(docs: DataFrame) -> DataFrame:
    feats = materialize(features(docs), "features")
    rows = feats.filter("doc_id is not null")
    classes = materialize(rows.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("cls"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")

    links = materialize(verify(docs, _pivot_pairs(classes)), "links")
    united = connected_components(links)
    comps = materialize(classes.select("cls").join(united.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp")), "comps")

    # documents that are not their class's first, and classes in a component of another, are the exceptions to look up
    copies = materialize(rows.filter("n > 0").join(classes.select("n", "h1", "h2", "cls"), ["n", "h1", "h2"]).select("doc_id", "cls"), "members")
    odd = materialize(copies.filter("doc_id <> cls").select("doc_id", F.lit(None).cast("long").alias("comp")).union(comps.filter("cls <> comp").select(F.col("cls").alias("doc_id"), "comp")).withColumn("odd", F.lit(True)), "odd")
    firsts = join_on_id(docs, odd, "doc_id", "left").filter("odd is null or comp is not null").select("doc_id", "text", F.coalesce("comp", "doc_id").alias("comp"))
    base, levels = frequency_levels(feats)
    met = materialize(_tile_pairs(_prefixes(firsts, levels, base)), "met")
    pairs = materialize(_bounded(met, classes, comps), "pairs")

    # of two components first the likeliest pair, then all pairs of those that are still apart
    likely = pairs.groupBy("comp_a", "comp_b").agg(F.max(F.struct("spare", "a", "b")).alias("p")).select("comp_a", "comp_b", "p.a", "p.b")
    likely = materialize(likely, "likely")
    united = connected_components(materialize(_comp_links(verify(docs, likely.select("a", "b")), likely), "links"))
    left = materialize(_relabel(pairs.join(likely.select("a", "b"), ["a", "b"], "left_anti"), united), "left")
    more = _comp_links(verify(docs, left.select("a", "b")), left)
    final = connected_components(more.union(united.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    whole = copies.join(comps, "cls").join(final.select(F.col("node").alias("comp"), F.col("component").alias("last")), "comp", "left").select("doc_id", F.coalesce("last", "comp").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted, then what is reachable by links. For small tables.
OP1_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where doc_id is not null),
x as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from x group by doc_id),
same as (select doc_id, n, list(x order by x) as xs from x join n using (doc_id) group by all),
class as (select min(doc_id) as cls, n, list(doc_id) as members, xs from same group by n, xs),
c as (select cls, n, unnest(xs) as x from class),
common as (select a.cls as a, b.cls as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from c a join c b on a.x = b.x and a.cls < b.cls and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by a.cls, b.cls),
link as (select a, b from common where 100 * shared >= 75 * (na + nb - shared)), ways as (select a, b from link union all select b, a from link),
reach as (select cls as node, cls as least from class union select ways.b, reach.least from reach join ways on ways.a = reach.node where reach.least < ways.b),
part as (select node, min(least) as component_id from reach group by node),
member as (select unnest(members) as doc_id, cls from class)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(part.component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join member using (doc_id) left join part on part.node = member.cls
"""


def brute_force(docs: list[tuple[int, str | None]], k: int = WORDS) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) from all pairs, for tests."""
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}
