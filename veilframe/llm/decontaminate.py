"""Benchmark decontamination: a broadcast set of hashed, normalised n-grams of the benchmark, a scan over each
document's word windows, exact verification of every hit, and removal of the hit spans or documents.

Words: A-Z in lower case, then runs of bytes that are ASCII letters, digits or not ASCII. A window is WINDOW consecutive
words of an item; an item with fewer words, but at least one, is one window. Null, empty and wordless texts have no
words. Repeated item_ids count as one item with the windows of all its rows; a null item_id has windows but no name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, released, small_batches, table
from .hashing import lower_table, utf8_slices, window_hashes, word_hashes, word_table, words

WINDOW = 10
#: Bytes of benchmark text in a broadcast set; a larger benchmark is scanned for in several sets, one after another.
SET_BYTES = 16 << 20

_IS_WORD = word_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
_LONGS = pa.list_(pa.int64())
_FIELDS = [("n_words", pa.int64()), ("hits", _LONGS), ("ends", _LONGS), ("items", pa.list_(pa.string())), ("n_hit", pa.int64()), ("hit_words", _LONGS)]
_DDL = "n_words long, hits array<long>, ends array<long>, items array<string>, n_hit long, hit_words array<long>"


class WindowSet:
    """Hashes of all windows, by length and sorted, each with its item and place: 16 bytes a window besides the texts."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.words: list[list[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            own: list[bytes] = []
            for _, data, off in utf8_slices(pa.array([text], pa.large_string())):
                data = lower_table()[data]
                s, e, _ = words(data, off, _IS_WORD)
                raw = data.tobytes()
                own = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
                k = min(window, len(own))
                if k:
                    found[k].append((window_hashes(word_hashes(data, s, e), k), i))
            self.words.append(own)
        self.by_length = {}
        for k, parts in found.items():
            h = np.concatenate([x for x, _ in parts])
            item = np.concatenate([np.full(len(x), i, np.int32) for x, i in parts])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in parts])
            order = np.argsort(h, kind="stable")
            self.by_length[k] = h[order], item[order], place[order]

    def owners(self, k: int, h: np.uint64, text: list[bytes]) -> set[str | None] | None:
        """Names of the items that have exactly this window; None if none has."""
        known, item, place = self.by_length[k]
        a, b = np.searchsorted(known, h), np.searchsorted(known, h, "right")
        hits = [i for i, p in zip(item[a:b].tolist(), place[a:b].tolist()) if self.words[i][p : p + k] == text]
        return {self.names[i] for i in hits} if hits else None


#: The set that this worker built last, as (broadcast id, window, set).
_LAST: list[tuple] = []


def _window_set(sent, window: int) -> WindowSet:
    """The broadcast items' set, built once for all tasks of a worker that use it one after another."""
    name, items = sent.value
    if not _LAST or _LAST[0][:2] != (name, window):
        _LAST[:] = [(name, window, WindowSet(items, window))]
    return _LAST[0][2]


def _scan(texts: pa.Array, sets: WindowSet, known_words: list | None = None, known_items: list | None = None) -> list[pa.Array]:
    """The columns of _FIELDS for texts; known_words and known_items are what earlier sets of a large benchmark found."""
    n = len(texts)
    n_words, hits, ends, items, n_hit, hit_words = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)], [0] * n, [[] for _ in range(n)]
    for first, data, off in utf8_slices(texts):
        data = lower_table()[data]
        s, e, at = words(data, off, _IS_WORD)
        w = word_hashes(data, s, e)
        found: list[tuple[int, int]] = []
        for k, (known, _, _) in sets.by_length.items():
            h = window_hashes(w, k)
            if len(h):
                p = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found += [(int(i), k) for i in np.flatnonzero(known[p] == h)]
        counts = np.diff(at)
        for r in range(len(off) - 1):
            n_words[first + r] = int(counts[r])
        if not found and not known_words:
            continue
        by_row: dict[int, list[tuple[int, int]]] = defaultdict(list)
        rows = np.searchsorted(at, [i for i, _ in found], "right") - 1
        for (i, k), r in zip(found, rows.tolist()):
            if i + k <= at[r + 1]:
                by_row[r].append((i, k))
        for r in range(len(off) - 1) if known_words else by_row:
            spans = by_row.get(r, [])
            hit = set(known_words[first + r] or ()) if known_words else set()
            names = set(known_items[first + r] or ()) if known_items else set()
            for i, k in spans:
                text = [data[a:b].tobytes() for a, b in zip(s[i : i + k], e[i : i + k])]
                owners = sets.owners(k, window_hashes(w[i : i + k], k)[0], text)
                if owners is not None:
                    names |= owners
                    hit.update(range(i - at[r], i - at[r] + k))
            if not hit:
                continue
            order = np.array(sorted(hit))
            runs = np.split(order, np.flatnonzero(np.diff(order) > 1) + 1)
            hits[first + r] = [int(s[at[r] + x[0]] - off[r]) for x in runs]
            ends[first + r] = [int(e[at[r] + x[-1]] - off[r]) for x in runs]
            items[first + r] = sorted(x for x in names if x is not None)
            n_hit[first + r] = len(hit)
            hit_words[first + r] = sorted(hit)
    return [pa.array(v, t) for v, (_, t) in zip((n_words, hits, ends, items, n_hit, hit_words), _FIELDS)]


def _cut(raw: bytes, hits: list[int], ends: list[int]) -> bytes:
    kept, at = [], 0
    for x, y in zip(hits, ends):
        kept.append(raw[at:x].rstrip(b" "))
        at = y
    kept.append(raw[at:].lstrip(b" "))
    return b" ".join(x for x in kept if x)


def _benchmark(benchmark: DataFrame, set_bytes: int = SET_BYTES) -> list:
    """The benchmark's distinct rows as broadcast sets, each of about set_bytes of text at most: one for a small benchmark, as
    many as it takes for a large one. The size is measured first, and one set at a time reaches the driver."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    parts = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // set_bytes) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    send = benchmark.sparkSession.sparkContext.broadcast
    return [send((uuid.uuid4().hex, [tuple(r) for r in rows.filter(part == i).collect()])) for i in range(parts)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, *keep, n_words, hit spans as byte ranges of the text (hits, ends), items (ids as sorted strings), n_hit (words
    hit) and hit_words (their places). One output row for each input row, whatever its nulls or repeats. Other columns are
    ignored. A benchmark of several sets is scanned for one after another, each adding to what was found."""
    small_batches(docs.sparkSession)
    sets, kinds = _benchmark(benchmark, set_bytes), dict(docs.dtypes)
    kept = ["doc_id", *keep]
    carried = list(dict.fromkeys([*kept, *(["text"] if len(sets) > 1 else [])]))
    fields = ", ".join(f"`{c}` {'string' if c == 'text' else kinds[c]}" for c in carried)
    rows = docs.select(*dict.fromkeys([*kept, "text"])).withColumn("text", F.col("text").cast("string"))
    for number, sent in enumerate(sets):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            ready = _window_set(sent, window)
            for b in batches:
                known = [b.column(c).to_pylist() for c in ("hit_words", "items")] if number else []
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *_scan(b.column("text"), ready, *known)], names=[*carried, *(k for k, _ in _FIELDS)])

        rows = rows.mapInArrow(released(scan), f"{fields}, {_DDL}")
        rows = materialize(rows, "hits") if number < len(sets) - 1 else rows
    return rows.select(*kept, *(k for k, _ in _FIELDS))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, text, *keep without the hit spans; what is left on both sides of a span is joined by one space. Texts that
    were cut are scanned again, set by set, until nothing is hit. A null text stays null."""
    small_batches(docs.sparkSession)
    sets, kinds = _benchmark(benchmark, set_bytes), dict(docs.dtypes)
    names = ["doc_id", "text", *keep]
    rest = "".join(f", `{c}` {kinds[c]}" for c in keep)
    ddl = f"doc_id {kinds['doc_id']}, text string{rest}"

    def cut(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = _window_set(sent, window)
            for b in batches:
                texts = b.column("text")
                _, hits, ends, *_ = (x.to_pylist() for x in _scan(texts, ready))
                if any(hits):
                    texts = texts.to_pylist()
                    for i, x in enumerate(hits):
                        y = ends[i]
                        while x:
                            texts[i] = _cut(texts[i].encode(), x, y).decode()
                            _, again, last, *_ = (v.to_pylist() for v in _scan(pa.array([texts[i]], pa.string()), ready))
                            x, y = again[0], last[0]
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, *(b.column(c) for c in keep)], names=names)

        return released(run)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    if len(sets) == 1:
        return rows.mapInArrow(cut(sets[0]), ddl)
    # a cut for one set may join words to a window of another, so all sets' spans are found before any is cut
    while True:
        found = materialize(find_contamination(rows, benchmark, window, keep=("text", *keep), set_bytes=set_bytes), "hits")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t if not x else _cut(t.encode(), x, y).decode() for t, x, y in zip(*(b.column(c).to_pylist() for c in ("text", "hits", "ends")))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *(b.column(c) for c in keep)], names=names)

        if not found.filter("n_hit > 0").limit(1).count():
            return found.select(*names)
        rows = materialize(found.mapInArrow(released(apply), ddl), "cut")


def remove_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those that find_contamination hit. Rows without a doc_id stay."""
    return docs.join(found.filter("n_hit > 0").select("doc_id").distinct(), "doc_id", "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Windows of documents joined with windows of items as text, for small tables.
OP5_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id::varchar as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as x from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
hit as (select doc_id, dw.k, i, item from dw join bw using (k, x)),
word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
item as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hit where item is not null) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join item using (doc_id)
"""


def brute_force(doc: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str], str]:
    """The contract word for word, for tests: n_words, n_hit, item ids, sha256 of the ids."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, names = split(doc), set(), set()
    for name, text in items:
        x = split(text)
        k = min(window, len(x))
        for j in range(len(x) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[j : j + k]:
                    hit.update(range(i, i + k))
                    names.add(name)
    ids = sorted(names)
    return len(w), len(hit), ids, hashlib.sha256(",".join(ids).encode()).hexdigest()
