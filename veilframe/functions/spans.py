"""Spans: half-open code-point ranges of texts, as arrays of structs (s, ord, e, label), found without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CHUNK_CHARS, DETECTORS

SPAN = "struct<s:int,ord:int,e:int,label:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


#: Items that a fold grows an array by before it starts another, and code points of a text's blocks. Growing one array, or
#: cutting one long text, item by item would cost the square of their number.
FOLD_BLOCK, TEXT_BLOCK = 256, 512


def once(value: Column, use) -> Column:
    """use(value), where value is worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def running_fold(items: Column, start: Column, step, out: str) -> Column:
    """struct(state, out): step(state, item) gives struct(state, out), out an item of the DDL type out or null for none; states
    run through the items in order, and what they give is listed."""
    none = F.expr(f"cast(array() as array<{out}>)")

    def inner(a, x):
        got = step(a["state"], x)
        return once(got, lambda g: F.struct(g["state"].alias("state"), F.when(g["out"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(g["out"]))).alias("out")))

    def of_block(a, block):
        done = F.aggregate(block, F.struct(a["state"].alias("state"), none.alias("out")), inner)
        return once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    blocks = once(items, lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / FOLD_BLOCK).cast("int")), lambda k: F.slice(xs, k * FOLD_BLOCK + 1, FOLD_BLOCK)))
    first = F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{out}>>)").alias("out"))
    return F.aggregate(blocks, first, of_block, lambda a: F.struct(a["state"].alias("state"), F.flatten(a["out"]).alias("out")))


def text_blocks(text: Column) -> Column:
    """text in blocks of TEXT_BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, s: Column, e: Column) -> Column:
    """Code points s to e of the text that text_blocks parted, at the cost of the blocks that hold them."""
    first = F.floor(s / TEXT_BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((e - 1) / TEXT_BLOCK).cast("int") - first + 1, F.lit(0))), "")
    return F.when(e > s, F.substring(held, s - first * TEXT_BLOCK + 1, e - s)).otherwise("")


def pattern_spans(text: Column, pattern: str, label: str, order: int = 0) -> Column:
    """All matches: matches give the lengths, the gaps between them the offsets. Classes are Unicode's."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)), F.split(text, f"(?U){pattern}", -1)

    def step(at, pair):
        s = at + F.length(pair["gap"])
        return once(F.struct(s.alias("s"), (s + F.length(pair["hit"])).alias("e")), lambda p: F.struct(p["e"].alias("state"), F.struct(p["s"].alias("s"), F.lit(order).alias("ord"), p["e"].alias("e"), F.lit(label).alias("label")).alias("out")))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())
    return running_fold(pairs, F.lit(0), step, SPAN)["out"]


def detect(text: Column, detectors=DETECTORS) -> Column:
    """Spans of all detectors, sorted by start and then by the detectors' order; overlaps stay. A text without any digit
    or @ is not searched. Null gives none."""
    text = F.coalesce(text, F.lit(""))
    every = F.concat(*(pattern_spans(text, p, label, i) for i, (label, p) in enumerate(detectors)))
    return F.when(text.rlike(r"(?U)[\d@]"), F.array_sort(every)).otherwise(F.expr(NO_SPANS))


def cascade(model: Column, fallback: Column) -> Column:
    """A model's spans, or the fallback's where it found none: never both."""
    return F.when(F.size(model) > 0, F.array_sort(model)).otherwise(fallback)


def detect_chunked(text: Column, size: int = CHUNK_CHARS, detectors=DETECTORS) -> Column:
    """Spans of fixed slices without overlap, shifted to the whole text: what a cut parts is missed or split."""
    text = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / size).cast("int"), F.lit(0)))

    def of_slice(i):
        at = i * size
        return F.transform(
            detect(F.substring(text, at + 1, F.lit(size)), detectors),
            lambda x: F.struct((x["s"] + at).alias("s"), x["ord"].alias("ord"), (x["e"] + at).alias("e"), x["label"].alias("label")),
        )

    return F.array_sort(F.flatten(F.transform(starts, of_slice)))


def detect_text(text: Column, is_markup: Column, size: int = CHUNK_CHARS) -> Column:
    """Spans of a text as a whole, or in slices where it is markup longer than one slice."""
    return F.when(is_markup & (F.length(text) > size), detect_chunked(text, size)).otherwise(detect(text))


def with_values(text: Column, spans: Column, use) -> Column:
    """use(spans, value), where value(span) is a span's text, cut from the blocks that hold it."""
    return once(text_blocks(text), lambda blocks: once(spans, lambda xs: use(xs, lambda x: cut(blocks, x["s"], x["e"]))))


def without_overlaps(spans: Column, taken: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(taken, lambda r: (x["e"] > r["s"]) & (x["s"] < r["e"])))


def merged_ranges(spans: Column) -> Column:
    """Disjoint (s, e) in order; ranges that touch become one."""
    kind = "struct<s:int,e:int>"

    def step(now, x):
        joins = now["e"].isNotNull() & (x["s"] <= now["e"])
        grown = F.struct(F.when(joins, now["s"]).otherwise(x["s"]).alias("s"), F.when(joins, F.greatest(now["e"], x["e"])).otherwise(x["e"]).alias("e"))
        return F.struct(grown.alias("state"), F.when(~joins & now["e"].isNotNull(), now).alias("out"))

    done = running_fold(F.array_sort(spans), F.expr(f"cast(named_struct('s', null, 'e', null) as {kind})"), step, kind)
    return once(done, lambda d: F.when(d["state"]["e"].isNull(), d["out"]).otherwise(F.concat(d["out"], F.array(d["state"]))))


def gaps(text: Column, spans: Column) -> Column:
    """The pieces of text outside all spans."""

    def between(blocks, ranges):
        ends = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["e"]))
        starts = F.concat(F.transform(ranges, lambda r: r["s"]), F.array(F.length(text)))
        return F.zip_with(ends, starts, lambda e, s: cut(blocks, e, s))

    return once(text_blocks(text), lambda blocks: once(merged_ranges(spans), lambda ranges: between(blocks, ranges)))


def replace_spans(text: Column, spans: Column, surface) -> Column:
    """struct(text, chars, used): spans, sorted, are replaced from left to right by surface(span, its text); a span that starts
    before the last one's end, or is empty, is passed over. chars counts the characters replaced, used the kept spans."""

    def step(at, x):
        keep = (x["s"] >= at) & (x["e"] > x["s"])
        return F.struct(F.when(keep, x["e"]).otherwise(at).alias("state"), F.when(keep, x).alias("out"))

    def put(blocks, used):
        new = lambda x: once(cut(blocks, x["s"], x["e"]), lambda value: surface(x, value))
        before = F.transform(used, lambda x, i: F.concat(cut(blocks, F.when(i == 0, 0).otherwise(F.get(used, i - 1)["e"]), x["s"]), new(x)))
        rest = cut(blocks, F.coalesce(F.try_element_at(used, F.lit(-1))["e"], F.lit(0)), F.length(text))
        chars = F.aggregate(used, F.lit(0), lambda a, x: a + x["e"] - x["s"])
        return F.struct(F.concat(F.array_join(before, ""), rest).alias("text"), chars.alias("chars"), used.alias("used"))

    used = running_fold(spans, F.lit(0), step, SPAN)["out"]
    return once(text_blocks(text), lambda blocks: once(used, lambda u: put(blocks, u)))


def occurrences(text: Column, value: Column) -> Column:
    """Starts of all, also overlapping, occurrences of value in text: the text is split before each, in one pass, and the
    pieces' lengths are run up. Texts without the value are not split."""
    literal = F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pieces = F.split(text, F.concat(F.lit("(?s)(?=\\Q"), literal, F.lit("\\E)")), F.lit(-1))
    none = F.expr("cast(array() as array<int>)")

    def step(a, piece):
        hit = a["hit"] | F.startswith(text, value)  # the first piece is an occurrence only at the text's start
        state = F.struct((a["at"] + F.length(piece)).cast("int").alias("at"), F.lit(True).alias("hit"))
        return F.struct(state.alias("state"), F.when(hit, a["at"]).alias("out"))

    found = running_fold(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit")), step, "int")["out"]
    # an occurrence at the end leaves no empty piece behind it, and no other piece is empty
    return F.when(F.contains(text, value) & (F.length(value) > 0), found).otherwise(none)
