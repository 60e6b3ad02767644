"""BPE encoding by a backtracking search, and decoding through an offset table.

A byte string's BPE merge result is its only tokenisation in which each pair of neighbours is compatible: merging the
two tokens' own bytes from scratch gives these two tokens again. An Aho-Corasick automaton over the vocabulary gives the
longest token at each position; the encoder takes it where it is compatible with the token before, else tries the next
shorter token that is its prefix, and steps back where none is left. Each position is found dead at most once, so work
is linear in the text. Compatibility of a pair is decided by undoing merges along the touching sides and is memoised.

Texts are cut into pieces by the vocabulary's own pattern first. Results of pieces are memoised per worker under a fixed
bound. Special tokens of the file are found in the text before that, as its library does by default.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, table

#: Pieces that a worker remembers at once, and the longest that is remembered.
MEMO, MEMO_CHARS = 400_000, 40
#: Pairs of tokens whose compatibility a worker remembers at once.
MEMO_PAIRS = 400_000
#: The byte-level pattern of the vocabulary files, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts whose characters all lie below this are cut by the standard library's faster engine, with the same classes spelled out.
NARROW = 0x180


def byte_letters() -> dict[str, int]:
    """Printable Latin-1 letters stand for themselves in byte-level files; the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def narrow_pattern() -> re.Pattern:
    """PATTERN with its classes spelled out for characters below NARROW."""
    import regex

    def spelled(kind: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(NARROW) if regex.match(kind, chr(i)))

    space, letter, number = map(spelled, (r"\s", r"\p{L}", r"\p{N}"))
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\S", f"[^{space}]")
    return re.compile(pattern.replace(r"\s", f"[{space}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]"))


class Bpe:
    """An encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = file["model"]
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in model["vocab"].items():
            if s not in self.special:
                self.bytes_of[i] = raw(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        ids = {s: i for s, i in model["vocab"].items()}
        self.rank_of: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank_of[x, y] = (r, z)
            if z not in self.split:
                self.split[z], self.rank[z] = (x, y), r
        by_bytes = {b: i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()}
        # tokens that merging can really make
        self.whole = {b: i for b, i in by_bytes.items() if len(b) == 1 or i in self.split}
        # for each token the longest shorter one that is its prefix
        self.prefix: dict[int, int] = {}
        for b, i in self.whole.items():
            for n in range(len(b) - 1, 0, -1):
                j = self.whole.get(b[:n])
                if j is not None:
                    self.prefix[i] = j
                    break
        self.automaton = ahocorasick.Automaton()
        for b, i in self.whole.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.compatible_memo: dict[int, bool] = {}
        # pieces seen lately, and those of the generation before: both bounded
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces, self.narrow, self.wide = regex.compile(PATTERN), narrow_pattern(), re.compile(f"[^\x00-{chr(NARROW - 1)}]")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # the offset table: token i's bytes are blob[offsets[i]:offsets[i + 1]]
        self.size = [len(b) for b in self.bytes_of]
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        # the same for the ids' decimal forms, each with a comma
        decimal = [b"%d," % i for i in range(size)]
        self.decimal = np.frombuffer(b"".join(decimal), np.uint8)
        self.decimal_offsets = np.concatenate([[0], np.cumsum([len(b) for b in decimal])]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b from scratch leaves exactly (a, b)."""
        pair = a << 32 | b
        known = self.compatible_memo.get(pair)
        if known is None:
            if len(self.compatible_memo) >= MEMO_PAIRS:
                self.compatible_memo.clear()
            known = self.compatible_memo[pair] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges from the last one on; a merge across the border may never come before one that is undone later.
        limit = 1 << 60
        while True:
            across = self.rank_of.get((a, b))
            if across is not None and across[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # of equal ranks the left one was merged first, so the right one is undone first
            if ra > rb:
                limit, a = ra, self.split[a][1]
            else:
                limit, b = rb + 1, self.split[b][0]

    def encode_piece(self, text: str) -> bytes:
        """The piece's ids as int32 bytes, remembered if it is short."""
        known = self.older.get(text)
        if known is None:
            known = array("i", self._search(text.encode("utf-8"))).tobytes()
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO // 2:
                self.older, self.memo = self.memo, {}
            self.memo[text] = known
        return known

    def _search(self, data: bytes) -> tuple[int, ...]:
        whole = self.whole.get(data)
        n = len(data)
        if n == 1:
            return (whole,)
        longest: list[int] = [-1] * n
        best = [0] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            at = end - size + 1
            if size > best[at]:
                best[at], longest[at] = size, i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        sizes, shorter, known, compatible = self.size, self.prefix.get, self.compatible_memo.get, self.compatible
        last = -1
        while True:
            end = at + sizes[token]
            if not dead[end] and (last < 0 or (fits if (fits := known(last << 32 | token)) is not None else compatible(last, token))):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, last, token = end, token, longest[end]
                continue
            token = shorter(token, -1)
            while token < 0:
                # nothing fits here: this position is dead after the token before it, so shorten that one
                dead[at] = 1
                if not out:
                    raise ValueError("no tokenisation")
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = shorter(token, -1)

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for k, part in enumerate(self.specials.split(text) if self.specials is not None and any(s in text for s in self.special) else (text,)):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            pieces = (self.pieces if self.wide.search(part) else self.narrow).findall(part)
            got = list(map(self.memo.get, pieces))
            if None in got:
                for i, x in enumerate(got):
                    if x is None:
                        got[i] = self.memo.get(pieces[i]) or self.encode_piece(pieces[i])
            out += got
        return np.frombuffer(b"".join(out), np.int32)

    @staticmethod
    def _gather(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        begin = offsets[ids]
        size = offsets[ids + 1] - begin
        ends = np.cumsum(size)
        return blob[np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Gather the tokens' bytes through the offset table; invalid UTF-8 becomes U+FFFD."""
        return self._gather(self.blob, self.offsets, np.asarray(ids, np.int64)).decode("utf-8", errors="replace")

    def comma_joined(self, ids: np.ndarray) -> bytes:
        return self._gather(self.decimal, self.decimal_offsets, np.asarray(ids, np.int64))[:-1]


@lru_cache(maxsize=1)
def _ready(path: str, changed: float) -> Bpe:
    """The file's encoder, built once for all tasks of a worker; what it remembers is bounded."""
    return Bpe(path)


def ready(name: str) -> Bpe:
    path = SparkFiles.get(name)
    return _ready(path, os.path.getmtime(path))


def _shipped(spark: SparkSession, path: str) -> str:
    """The vocabulary file's name among the files sent to all executors; its size is that of one tokenizer file."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


_RESULTS = {
    "ids": [("ids", pa.list_(pa.int32()), "array<int>")],
    "round_trip": [("ids", pa.list_(pa.int32()), "array<int>"), ("text", pa.string(), "string")],
    "digests": [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")],
}


def encode_documents(docs: DataFrame, tokenizer_file: str, result: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, *keep and by result ids (array<int>); round_trip: ids and the text decoded from them; digests: n_tokens,
    ids_sha256 and decoded_sha256. Null texts count as empty; an empty text has no ids. One output row for each input row,
    repeated or not. Other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    name, kinds = _shipped(spark, tokenizer_file), _RESULTS[result]
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(name)
        for b in batches:
            rows = []
            for text in b.column("text"):
                ids = bpe.encode(text.as_py() or "")
                if result == "digests":
                    rows.append((len(ids), hashlib.sha256(bpe.comma_joined(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
                else:
                    rows.append((ids, bpe.decode(ids)) if result == "round_trip" else (ids,))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(list(c), t) for c, (_, t, _) in zip(cols, kinds))], names=[*kept, *(k for k, _, _ in kinds)])

    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in kept)
    rows = docs.select(*kept, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"{fields}, {', '.join(f'{k} {t}' for k, _, t in kinds)}")


def decode_documents(encoded: DataFrame, tokenizer_file: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, *keep and text from ids; null ids count as none. Other columns are ignored."""
    name = _shipped(encoded.sparkSession, tokenizer_file)
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(name)
        for b in batches:
            texts = [bpe.decode(x.values.to_numpy() if x.is_valid and len(x.values) else []) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    fields = ", ".join(f"`{c}` {dict(encoded.dtypes)[c]}" for c in kept)
    return encoded.select(*dict.fromkeys([*kept, "ids"])).mapInArrow(released(run), f"{fields}, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file or default_tokenizer(), "digests")
