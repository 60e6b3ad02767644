"""The entity registry: which value has which token, per task.

Three forms. entities: a table from detected spans, the first label of a value fixing its token (a plain aggregate).
mask_with_registry: the step-by-step form, in which step t masks what steps before t registered: a task's steps stream by in
order, and what is held is its registry, however many steps it has. global_mask: a join form that applies all entities of a
task to all its steps, which masks more.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DETECTORS, FUZZY_THRESHOLD, HASH_ALPHABET
from ..functions.spans import detect, with_values
from ..functions.text import fuzzy_key, similarity, token
from . import ocr
from .mask import registered_first, token_mask

#: Values that are looked for one by one before the automaton over all values is built anew.
LOOSE = 16


def py_token(label: str, value: str) -> str:
    label = label or "VALUE"
    n = int.from_bytes(hashlib.sha256(f"{label}:{value}".encode()).digest(), "big")
    out = ""
    for _ in range(5):
        n, r = divmod(n, 36)
        out = HASH_ALPHABET[r] + out
    return f"{label}#{out}"


def spans_of(df: DataFrame, task: str, step: str, text: str = "text") -> DataFrame:
    """(task, step, s, ord, e, label, value) of all detected spans."""
    known = lambda xs, value: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["ord"].alias("ord"), x["e"].alias("e"), x["label"].alias("label"), value(x).alias("value")))
    found = with_values(F.coalesce(text, F.lit("")), detect(F.col(text)), known)
    return df.select(F.col(task).alias("task"), F.col(step).alias("step"), F.explode(found).alias("x")).select("task", "step", "x.*")


def entities(spans: DataFrame) -> DataFrame:
    """(task, value, label, token, first_step): the first detection of a value in its task decides label and token."""
    first = spans.groupBy("task", "value").agg(F.min(F.struct("step", "s", "ord", "label")).alias("m"))
    return first.select("task", "value", "m.label", token(F.col("m.label"), F.col("value")).alias("token"), F.col("m.step").alias("first_step"))


def with_manual(registry: DataFrame, manual: DataFrame) -> DataFrame:
    """registry (task, value, label, token, ...) with manual rows (task, value, label, token) in place of those that have one of
    their values or tokens."""
    for c in ("value", "token"):
        registry = registry.join(manual.select("task", c).distinct(), ["task", c], "left_anti")
    return registry.unionByName(manual.select("task", "value", "label", "token"), allowMissingColumns=True)


def cleared(registry: DataFrame, tasks: DataFrame) -> DataFrame:
    """registry without what was registered for tasks (task)."""
    return registry.join(tasks.select("task").distinct(), "task", "left_anti")


def collisions(registry: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value of a task."""
    return registry.groupBy("task", "token").agg(F.countDistinct("value").alias("values")).filter("values > 1")


def lookup(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (task, token) with value (null if unknown) and missing."""
    known = registry.groupBy("task", "token").agg(F.min("value").alias("value"))
    return wanted.join(known, ["task", "token"], "left").withColumn("missing", F.col("value").isNull())


class Registry:
    """One task's values, tokens and whitelist, in plain Python."""

    def __init__(self):
        self.token_of: dict[str, str] = {}
        self.label_of: dict[str, str] = {}
        self.whitelist: set[str] = set()
        self._automaton, self._built = None, 0

    def get(self, value: str, label: str, override: bool = False) -> tuple[str, bool]:
        known = self.token_of.get(value)
        if known is not None:
            if override:
                self.label_of[value] = label
            return known, False
        self.token_of[value] = made = py_token(label, value)
        self.label_of[value] = label
        return made, True

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Every occurrence of every value, by start and then by the order of registration: one pass of an automaton, and a
        search for each of the few values that came since it was built."""
        if len(self.token_of) - self._built > max(LOOSE, self._built // 4):
            self._build()
        out = []
        if self._automaton is not None:
            out = [(end - len(value) + 1, number, value) for end, (number, value) in self._automaton.iter(text)]
        for number, value in enumerate(islice(self.token_of, self._built, None), self._built):
            at = text.find(value) if value else -1
            while at >= 0:
                out.append((at, number, value))
                at = text.find(value, at + 1)
        return [(s, s + len(value), value) for s, _, value in sorted(out)]

    def _build(self) -> None:
        import ahocorasick

        self._automaton, self._built = ahocorasick.Automaton(), len(self.token_of)
        for number, value in enumerate(self.token_of):
            if value:
                self._automaton.add_word(value, (number, value))
        self._automaton.make_automaton()

    def detect(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), label) for label, p in DETECTORS for m in re.finditer(p, text)]
        return sorted(found, key=lambda x: x[0])

    def mask(self, text: str, prompt: bool = False, wrap: bool = False, found: list[tuple[int, int, str]] | None = None) -> tuple[str, list[str], int]:
        """(masked text, tokens used, characters masked). A prompt fills the whitelist instead of heeding it. Detections
        (found, or the text's own) that an earlier replacement covers still enter the registry."""
        found = self.detect(text) if found is None else found
        if prompt:
            at, rest = 0, []
            for s, e, _ in found:
                if s > at:
                    rest.append(text[at:s])
                at = max(at, e)
            rest.append(text[at:])
            self.whitelist.update(w for part in rest for w in re.split("[^a-zA-Z0-9]+", part.lower()) if len(w) >= 2)
        known = self.find(text)
        todo = [(s, e, self.token_of[v]) for s, e, v in known]
        starts, reach = [s for s, _, _ in known], list(accumulate((e for _, e, _ in known), max))  # known are in order of starts
        for s, e, label in found:
            before = bisect_left(starts, e)
            if before and reach[before - 1] > s:
                continue
            value = text[s:e]
            if not prompt and any(w in value.lower() for w in self.whitelist):
                continue
            todo.append((s, e, self.get(value, label, override=prompt)[0]))
        out, used, at, chars = [], [], 0, 0
        for s, e, t in sorted(todo, key=lambda x: x[0]):
            if s >= at:
                out += [text[at:s], f"[{t}]" if wrap else t]
                used.append(t)
                at, chars = e, chars + e - s
        return "".join(out) + text[at:], used, chars


def mask_with_registry(df: DataFrame, task: str, step: str, text: str = "text", prompt_first: bool = False) -> DataFrame:
    """(task, step, masked, tokens, masked_chars), each task folded in the order of its steps (of equal steps by text). Null
    texts count as empty; a null task is a task."""
    kinds = dict(df.dtypes)
    names = ["task", "step", "masked", "tokens", "masked_chars"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, registry = None, None
        for b in batches:
            masked = []
            for task_id, value in zip(b.column("task").to_pylist(), b.column("text").to_pylist()):
                first = registry is None or task_id != at
                if first:
                    at, registry = task_id, Registry()
                masked.append(registry.mask(value or "", prompt=prompt_first and first))
            cols = [list(c) for c in zip(*masked)] if masked else [[], [], []]
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.list_(pa.string()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("task"), b.column("step"), *arrays], names=names)

    rows = df.select(F.col(task).alias("task"), F.col(step).alias("step"), F.col(text).alias("text"))
    dealt = rows.repartition("task").sortWithinPartitions("task", "step", "text")
    return dealt.mapInArrow(fold, f"task {kinds[task]}, step {kinds[step]}, masked string, tokens array<string>, masked_chars long")


def mask_screens(df: DataFrame, task: str, step: str, texts: str, points: str) -> DataFrame:
    """(task, step, item, masked, masked_chars, x1, y1, x2, y2): the recognised items of each screen (texts: array<string>,
    points: array<array<array<double>>>) that change when registered values and then new detections become [token]s, and
    the box around each. Items are packed into segments for detection; screens of a task stream by in order."""
    packed = ocr.pack(F.col(texts))
    segments = F.transform(
        F.sequence(F.lit(0), F.greatest(F.coalesce(F.array_max(F.transform(packed, lambda p: p["segment"])), F.lit(0)), F.lit(0))),
        lambda s: F.array_join(F.transform(F.filter(packed, lambda p: p["segment"] == s), lambda p: F.get(F.col(texts), p["item"])), ocr.SEPARATOR),
    )
    found = F.flatten(F.transform(segments, lambda t, i: F.transform(detect(t), lambda x: F.struct(i.alias("segment"), x["s"].alias("s"), x["e"].alias("e"), x["label"].alias("label")))))
    kinds = dict(df.dtypes)
    rows = df.select(F.col(task).alias("task"), F.col(step).alias("step"), F.col(texts).alias("texts"), F.col(points).alias("points"), ocr.remap(found, packed, F.col(texts)).alias("found"))
    ddl = f"task {kinds[task]}, step {kinds[step]}, item int, masked string, masked_chars long, x1 int, y1 int, x2 int, y2 int"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, registry = None, None
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if registry is None or row["task"] != at:
                    at, registry = row["task"], Registry()
                for i, text in enumerate(row["texts"] or []):
                    own = [(x["s"], x["e"], x["label"]) for x in row["found"] or [] if x["item"] == i]
                    masked, _, chars = registry.mask(text or "", wrap=True, found=sorted(own))
                    if masked != (text or ""):
                        xs, ys = zip(*(row["points"] or [])[i])
                        out.append((row["task"], row["step"], i, masked, chars, int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))))
            kinds = [b.schema.field("task").type, b.schema.field("step").type, pa.int32(), pa.string(), pa.int64(), *[pa.int32()] * 4]
            cols = list(zip(*out)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["task", "step", "item", "masked", "masked_chars", "x1", "y1", "x2", "y2"])

    return rows.repartition("task").sortWithinPartitions("task", "step").mapInArrow(fold, ddl)


def global_mask(df: DataFrame, task: str, step: str, text: str = "text") -> DataFrame:
    """(task, step, masked, masked_chars): every entity of a task is masked in all its steps."""
    registry = entities(spans_of(df, task, step, text)).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("value", "label"))).alias("known"))
    rows = df.select(F.col(task).alias("task"), F.col(step).alias("step"), F.coalesce(text, F.lit("")).alias("_t")).join(registry, "task", "left")
    spans = registered_first(F.col("_t"), detect(F.col("_t")), F.col("known"))
    masked = F.when(F.col("known").isNotNull(), token_mask(F.col("_t"), spans))
    done = rows.withColumn("_m", masked)
    return done.select("task", "step", F.coalesce("_m.text", "_t").alias("masked"), F.coalesce("_m.chars", F.lit(0)).cast("long").alias("masked_chars"))


def fuzzy_entity(value: Column, known: Column, threshold: float = FUZZY_THRESHOLD) -> Column:
    """The known value that a value means: one with an equal key, else the most similar at or above the threshold; of equals
    the first. Null if there is none."""
    key = fuzzy_key(value)
    scored = F.transform(known, lambda k, i: F.struct((fuzzy_key(k) == key).cast("int").alias("same"), similarity(key, fuzzy_key(k)).alias("sim"), (-i).alias("i"), k.alias("k")))
    best = F.array_max(F.filter(scored, lambda x: (x["same"] == 1) | (x["sim"] >= threshold)))
    return best["k"]
