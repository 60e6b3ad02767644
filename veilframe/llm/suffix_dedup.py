"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

Distribution. Each LENGTH-byte window has a minimiser, the least hash of the GRAM-byte strings in it, so equal windows
have equal minimisers. Runs of neighbouring windows with one minimiser become one fragment, and fragments are dealt by
minimiser: every two equal windows meet in one task, and a fragment overlaps the next by LENGTH - 1 bytes only. Equal
fragments are merged on both sides of the shuffle: one text with its first document, and where else it occurs. Strings that
a share of all documents has come last in the order of minimisers, so that a frequent phrase gathers its own copies, which
are merged, and not all that stands around it. There are as many buckets as the table's bytes need.

In a task, windows whose hash occurs once stand aside, which leaves the transform only what may repeat; hashes decide
nothing else. The other fragments are concatenated, their suffixes sorted as
deep as LENGTH needs, and the transform is searched backward breadth first: intervals of common strings of length l give
those of length l + 1. A border between two suffixes that closes at level l has a common prefix of l, so prefixes come
out by increasing value; the search stops at LENGTH. Borders that never closed lie inside groups of suffixes that share
at least LENGTH bytes. The least document of each group then decides which occurrences are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import even_keys, materialize, one_row_per_id, partitions, released, small_batches, table
from .hashing import BLOCK_BYTES, byte_values, mix, powers, utf8_slices

LENGTH, GRAM = 50, 10
#: Bytes of text whose fragments are packed at once, and bytes of fragments that are searched at once.
PACK_BYTES, SEARCH_BYTES = 6 << 20, 1 << 20
#: Bytes of text for which there is a bucket. A worker unpacks one bucket, about twice as much.
BUCKET_BYTES = 48 << 20
#: Documents that are sampled for frequent strings, about; the share of them that makes one frequent; and its
#: least number. The sample decides how work is dealt, and nothing else.
SAMPLE, FREQUENT, LEAST = 800, 0.02, 16
#: Bits of a hash by which frequent strings are marked.
MARK_BITS = 20
#: Values of a block of the sliding minimum.
CACHED = 1 << 14
#: Intervals that are expanded at once, by all letters.
INTERVALS = 1 << 12
#: A fragment's share of its partition is one of so many.
SHARES = 256
_NO_DOC = np.iinfo(np.int64).max
_MULT = np.uint64(0xD1342543DE82EF95)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of data."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    out, values = np.empty(len(data) - k + 1, np.uint64), byte_values(3)
    for at in range(0, len(out), BLOCK_BYTES):  # a hash does not depend on where its block begins
        part = data[at : at + BLOCK_BYTES + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers(_MULT, len(part)), out=sums[1:])
        out[at : at + BLOCK_BYTES] = mix((sums[k:] - sums[:-k]) * powers(_INV, len(part) - k + 1))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by doubling, in blocks that stay in a core's cache."""
    if len(x) < w:
        return x[:0]
    out = np.empty(len(x) - w + 1, x.dtype)
    for at in range(0, len(out), CACHED):
        part, size = x[at : at + CACHED + w - 1], 1
        while size * 2 <= w:
            part = np.minimum(part[:-size], part[size:])
            size *= 2
        out[at : at + CACHED] = np.minimum(part[: len(part) - (w - size)], part[w - size :]) if w > size else part
    return out


def repeated_values(h: np.ndarray) -> np.ndarray:
    """Which of h occur twice, or else agree in the bits that a place leaves free in 64: hash and place are sorted as one number,
    which takes a fraction of the time that sorting places by hash does."""
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    ordered = np.sort(h & ~mask | np.arange(len(h), dtype=np.uint64))
    equal = (ordered[1:] ^ ordered[:-1]) <= mask
    places = (ordered & mask).astype(np.int64)
    twice = np.zeros(len(h), bool)
    twice[places[1:][equal]] = True
    twice[places[:-1][equal]] = True
    return twice


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, minimiser) of the fragments of all rows; start and end count in data. late: a table over the first
    MARK_BITS of a hash; strings marked there come after all others."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = string_hashes(data, gram)
    if late is not None:
        marked = np.flatnonzero(late[(h >> np.uint64(64 - MARK_BITS)).astype(np.int32)])
        h >>= np.uint64(1)
        h[marked] |= np.uint64(1 << 63)
    least = sliding_min(h, length - gram + 1)[:n]
    valid = np.zeros(n + 1, bool)  # windows inside one row
    begins, ends = offsets[:-1], offsets[1:] - length + 1
    ok = ends > begins
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, begins[ok], 1)
    np.add.at(change, ends[ok], -1)
    valid[:n] = np.cumsum(change[:n]) > 0
    first = valid[:n].copy()
    first[1:] &= ~valid[: n - 1] | (least[1:] != least[:-1])
    row_start = np.zeros(n + 1, bool)
    row_start[begins[ok]] = True
    first |= row_start[:n] & valid[:n]
    starts = np.flatnonzero(first)
    closed = ~valid[1 : n + 1]
    closed[:-1] |= first[1:]
    stops = np.flatnonzero(valid[:n] & closed)
    return np.searchsorted(offsets, starts, "right") - 1, starts, stops + length, least[starts]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text, sorted by their first depth bytes at least (beyond the end: least)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(9) | (padded[i : n + i] + (np.arange(i, n + i) < n).astype(np.uint64))
    order = np.argsort(key)
    known = 7
    while True:
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - known)] = rank[known:] + 1
        key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(key)
        known *= 2


def long_groups(text: np.ndarray, order: np.ndarray, length: int, separator: int = 0) -> np.ndarray:
    """For each place in the suffix order whether it opens a new group: suffixes of one group share length bytes.

    Backward search on the transform, breadth first. Level l holds the intervals of strings of length l; a string may end
    with the separator but never continues beyond it.
    """
    n = len(text)
    before = np.where(order > 0, text[order - 1], separator)
    # rank among equal letters: the transform's last-to-first mapping, from one stable sort
    by_letter = np.argsort(before, kind="stable")
    counts = np.bincount(before, minlength=257)
    base = np.concatenate([[0], np.cumsum(counts)])[:257]
    # suffixes that start with a letter: their block in the order. The first suffix has no letter before it and was
    # given the separator, so blocks are taken from the text itself.
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=257))])[:257]
    opens = np.zeros(n + 1, bool)
    opens[[0, n]] = True
    letters = np.flatnonzero(np.bincount(text, minlength=257))
    low = starts[letters].astype(np.int64)
    high = starts[letters + 1].astype(np.int64) if letters[-1] < 256 else np.concatenate([starts[letters[1:]], [n]]).astype(np.int64)
    opens[high] = True
    live = high - low > 0
    low, high = low[live], high[live]
    usable = letters[letters != separator].astype(np.int64)
    # letter and place as one number, ascending: a step backward looks up all letters at once
    keys = before[by_letter].astype(np.int64) * (n + 1) + by_letter
    shift = (starts[usable] - base[usable])[:, None]
    for _ in range(1, length):
        if not len(low):
            break
        next_low, next_high = [], []
        for at in range(0, len(low), INTERVALS):
            a, b = (np.searchsorted(keys, usable[:, None] * (n + 1) + x[None, at : at + INTERVALS]) for x in (low, high))
            some = b > a
            a, b = (a + shift)[some], (b + shift)[some]
            fresh = ~opens[b]
            # an interval whose right border is known brings nothing new further on, as every border is closed once
            opens[b] = True
            next_low.append(a[fresh])
            next_high.append(b[fresh])
        low, high = np.concatenate(next_low), np.concatenate(next_high)
    return opens[:n]


def repeated_bytes(texts: list[bytes], which: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """[doc, begin, end] of the bytes to remove. texts: distinct fragments that hold all windows of their minimisers;
    occurrence j of text which[j] is at places[j] in document docs[j]."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.full(len(texts), _NO_DOC)
    np.minimum.at(first, which, docs)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # in the text joined by separators
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    counts = sizes - length + 1
    at_text = np.concatenate([[0], np.cumsum(counts)])[:-1]  # windows that lie in one fragment
    windows = np.arange(int(counts.sum())) + np.repeat(begin - at_text, counts)
    least = np.repeat(first, counts)  # the first document that has the window
    twice = repeated_values(string_hashes(data, length)[windows])
    if twice.any():
        w = windows[twice]
        # the transform's text: letters shifted by one, so that 0 is the separator alone, and only stretches of windows
        # that may repeat
        keep = np.zeros(len(data) + 1, np.int32)
        np.add.at(keep, w, 1)
        np.add.at(keep, w + length, -1)
        at = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        jump = np.concatenate([[True], np.diff(at) > 1])
        where = np.arange(len(at)) + np.cumsum(jump)
        text = np.zeros(len(at) + int(jump.sum()) + 1, np.int64)
        text[where] = data[at].astype(np.int64) + 1
        index = np.full(len(data), -1, np.int64)
        index[w] = np.flatnonzero(twice)
        origin = np.full(len(text), -1, np.int64)  # the window that a suffix starts with, if it is one of these
        origin[where] = index[at]
        sa = suffix_order(text, length + 1)
        opens = np.flatnonzero(long_groups(text, sa, length))
        source = origin[sa]
        good = source >= 0
        doc = np.full(len(sa), _NO_DOC)
        doc[good] = least[source[good]]
        value = np.repeat(np.minimum.reduceat(doc, opens), np.diff(np.concatenate([opens, [len(sa)]])))
        least[source[good]] = value[good]
    low, high = np.minimum.reduceat(least, at_text), np.maximum.reduceat(least, at_text)
    full = docs > high[which]
    out = [np.stack([docs[full], places[full], places[full] + sizes[which[full]]], 1)]
    for j in np.flatnonzero((docs > low[which]) & ~full).tolist():
        i = which[j]
        hit = np.flatnonzero(least[at_text[i] : at_text[i] + counts[i]] < docs[j])
        cut = np.flatnonzero(np.diff(hit) > length) + 1
        out.append(np.array([(docs[j], places[j] + x[0], places[j] + x[-1] + length) for x in np.split(hit, cut)], np.int64))
    return out


_COLUMNS = (np.int32, np.int32, np.uint8, np.int64, np.int32)  # sizes, times, shares; documents, places


def _frequent(docs: DataFrame, rows: int, gram: int) -> np.ndarray | None:
    """The table of marks for fragments: strings of gram bytes that more than a share of the sampled documents has; None if
    there are none."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << MARK_BITS, np.int64), 0
        for b in batches:
            for text in b.column("text"):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                counts[np.unique((string_hashes(data, gram) >> np.uint64(64 - MARK_BITS)).astype(np.int64))] += 1
                seen += 1
        marks = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(marks, -1)), pa.array(np.append(counts[marks], seen))], names=["mark", "n"])

    counts = materialize(sample.mapInArrow(released(run), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")), "marks")
    seen, every = counts.agg(F.sum(F.when(F.col("mark") < 0, F.col("n"))), F.sum(F.when(F.col("mark") >= 0, F.col("n")))).first()
    least = max(LEAST, FREQUENT * (seen or 0), 4 * (every or 0) / (1 << MARK_BITS))  # far above what chance puts into a slot
    marks = [r[0] for r in counts.filter((F.col("mark") >= 0) & (F.col("n") > least)).select("mark").collect()]
    if not marks:
        return None
    late = np.zeros(1 << MARK_BITS, bool)
    late[marks] = True
    return late


def _emit(docs: DataFrame, length: int, gram: int, buckets: list[int], late: np.ndarray | None = None) -> DataFrame:
    """Rows (bucket, blob): fragments of one bucket, equal ones merged, as compressed columns. A task packs more text at once
    where there are more buckets, as small blobs pack badly."""
    names = np.array(buckets, np.int64)
    most = min(4, max(1, len(buckets) // 60)) * PACK_BYTES
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=5)
        texts = [t for p in parts for t in p[0]]
        doc, place, key = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        bucket = names[((key >> np.uint64(20)) % np.uint64(len(names))).astype(np.int64)]
        share = ((key >> np.uint64(8)) & np.uint64(SHARES - 1)).astype(np.uint8)
        order = np.lexsort((share, bucket))
        out_b, out_x = [], []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(texts[i], len(index)) for i in part.tolist()], np.int64)
            by_text = np.argsort(which, kind="stable")
            flat = part[by_text]
            starts = np.flatnonzero(np.diff(which[by_text], prepend=-1))
            body = (np.array([len(t) for t in index]), np.diff(np.append(starts, len(flat))), share[flat[starts]], doc[flat], place[flat])
            raw = np.array([len(index), len(flat)], np.int64).tobytes() + b"".join(x.astype(k).tobytes() for x, k in zip(body, _COLUMNS)) + b"".join(index)
            out_b.append(int(bucket[part[0]]))
            out_x.append(pack.compress(raw))
        return pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_x, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for first, data, off in utf8_slices(b.column("text")):
                r, s, e, k = fragments(data, off, length, gram, sent.value)
                raw = data.tobytes()
                parts.append(([raw[x:y] for x, y in zip(s.tolist(), e.tolist())], ids[first + r], s - off[r], k))
                held += len(raw)
                if held >= most:
                    if any(len(p[1]) for p in parts):
                        yield packed(parts)
                    parts, held = [], 0
        if any(len(p[1]) for p in parts):
            yield packed(parts)

    return docs.mapInArrow(released(run), "bucket int, blob binary")


def _unpack(blob: bytes) -> tuple:
    """(sizes, times, shares, documents, places, bytes, where in them the texts begin)"""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, cols = 16, []
    for kind, count in zip(_COLUMNS, (n, n, n, m, m)):
        cols.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return (*cols, raw, at)


def _search(blobs: list[bytes], length: int) -> Iterator[np.ndarray]:
    """A bucket's removals, share by share."""
    heads = np.zeros(SHARES, np.int64)
    parts = []
    while blobs:
        parts.append(_unpack(blobs.pop()))
        heads += np.bincount(parts[-1][2], parts[-1][0], SHARES).astype(np.int64)
    groups = (np.cumsum(heads) - heads) // SEARCH_BYTES
    for g in np.unique(groups[heads > 0]).tolist():
        low, high = (int(x) for x in np.flatnonzero(groups == g)[[0, -1]])
        index: dict[bytes, int] = {}
        which, docs, places = [], [], []
        for sizes, times, shares, doc, place, raw, text in parts:  # sorted by share
            a, b = np.searchsorted(shares, low), np.searchsorted(shares, high, "right")
            if b > a:
                ends = text + np.cumsum(sizes.astype(np.int64))
                begins = ends - sizes
                ids = [index.setdefault(raw[i:j], len(index)) for i, j in zip(begins[a:b].tolist(), ends[a:b].tolist())]
                which.append(np.repeat(np.array(ids, np.int64), times[a:b]))
                at = np.concatenate([[0], np.cumsum(times.astype(np.int64))])
                docs.append(doc[at[a] : at[b]])
                places.append(place[at[a] : at[b]].astype(np.int64))
        yield from repeated_bytes(list(index), *(np.concatenate(x) for x in (which, docs, places)), length)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, span): bytes to remove, in pieces that may overlap, each begin << 32 | end. docs: unique doc_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, size = docs.agg(F.count("text"), F.sum(F.octet_length("text"))).first()
    shuffled = max(partitions(spark), -(-(size or 0) // BUCKET_BYTES))
    late = _frequent(docs, rows, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            out, rows = [], 0
            for x in _search(blobs, length):
                out.append(x)
                rows += len(x)
                if rows >= 100_000:
                    yield batch(out)
                    out, rows = [], 0
            if rows:
                yield batch(out)

        def batch(found: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1] << 32 | x[:, 2])], names=["doc_id", "span"])

        blobs, at = [], None
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob")):
                if bucket != at and blobs:
                    yield from close(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield from close(blobs)

    dealt = _emit(docs, length, gram, even_keys(spark, shuffled), late).repartition(shuffled, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(released(run), "doc_id long, span long")


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, packed: the text's UTF-8 bytes under zstd, *keep, pieces: sorted byte ranges to remove, each
    begin << 32 | end; null if none) per document. Texts are packed as they meet the ranges in a shuffle.

    Null texts count as empty. Texts shorter than length bytes lose nothing. Rows without a doc_id are left out; rows
    that repeat one count as one document. Other columns are ignored.
    """
    docs = one_row_per_id(documents, "doc_id", "text", keep)
    ranges = repeated_spans(docs.select("doc_id", "text"), length, gram).groupBy("doc_id").agg(F.sort_array(F.collect_list("span")).alias("pieces"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [pack.compress((t.as_py() or "").encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary()), *(b.column(c) for c in keep)], names=["doc_id", "packed", *keep])

    rest = "".join(f", `{c}` {dict(documents.dtypes)[c]}" for c in keep)
    return docs.mapInArrow(released(shrink), f"doc_id long, packed binary{rest}").join(ranges, "doc_id", "left").select("doc_id", "packed", *keep, "pieces")


def _kept(raw: bytes, pieces) -> tuple[bytes, int, list[tuple[int, int]]]:
    spans: list[tuple[int, int]] = []
    for p in pieces or ():
        x, y = p >> 32, p & 0xFFFFFFFF
        if spans and x <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
        else:
            spans.append((x, y))
    out, at = [], 0
    for x, y in spans:
        out.append(raw[at:x])
        at = y
    out.append(raw[at:])
    return b"".join(out), sum(y - x for x, y in spans), spans


def remove_repeats(documents: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *keep) without the repeated bytes. A cut inside a character drops that character's other bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = map(zstandard.ZstdDecompressor().decompress, b.column("packed").to_pylist())
            texts = [_kept(t, p)[0].decode("utf-8", errors="ignore") for t, p in zip(raws, b.column("pieces").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *(b.column(c) for c in keep)], names=["doc_id", "text", *keep])

    rest = "".join(f", `{c}` {dict(documents.dtypes)[c]}" for c in keep)
    return removals(documents, length, keep=keep).mapInArrow(released(run), f"doc_id long, text string{rest}")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, p in zip(b.column("packed").to_pylist(), b.column("pieces").to_pylist()):
                raw = zstandard.ZstdDecompressor().decompress(t)
                kept, removed, spans = _kept(raw, p)
                rows.append((len(raw), removed, len(spans), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removals(table(spark, sf_dir, "documents")).mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: All windows as hexadecimal strings with the first document of each, for small tables.
OP9_SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents where doc_id is not null),
blocks as (select doc_id, p, least(500, n - p) as n, substr(h, (2 * p + 1)::int, 1098) as h from (select doc_id, h, length(h) // 2 - 49 as n, unnest(range(0, length(h) // 2 - 49, 500)) as p from t where length(h) >= 100)),
w as (select doc_id, p + i as p, substr(h, (2 * i + 1)::int, 100) as x from (select doc_id, p, h, unnest(range(0, n)) as i from blocks)),
f as (select x, min(doc_id) as first from w group by x having count(distinct doc_id) > 1),
c as (select doc_id, p, p + 50 as e from w join f using (x) where first < doc_id),
g as (select *, case when p <= max(e) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from c),
r as (select doc_id, p, e, sum(fresh) over (partition by doc_id order by p) as run from g),
s as (select doc_id, run, min(p) as s, max(e) as e from r group by doc_id, run),
k as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before, lead(s) over (partition by doc_id order by s) as after from s),
cut as (select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, (2 * before + 1)::int, (2 * (s - before))::int) || case when after is null then substr(h, (2 * e + 1)::int) else '' end, '' order by s) as kept from k join t using (doc_id) group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from t left join cut using (doc_id)
"""


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), for tests."""
    first: dict[bytes, int] = {}
    raws = {i: (t or "").encode() for i, t in docs}
    for i in sorted(raws):
        for p in range(len(raws[i]) - length + 1):
            first.setdefault(raws[i][p : p + length], i)
    out = {}
    for i, raw in raws.items():
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
