"""Recognised text of screenshots: packing for a detector, mapping spans back, masked regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_CHARS

SEPARATOR = "[sep]"  # a fixed value


def pack(texts: Column, limit: int = CHUNK_CHARS, separator: str = SEPARATOR) -> Column:
    """array<struct(item, segment, at)>: non-empty texts in order go into a segment while its length with separators stays
    within limit; a text is never split, so a longer one has a segment of its own. at: its offset in the segment."""
    gap = len(separator)
    items = F.filter(F.transform(texts, lambda x, i: F.struct(i.alias("item"), F.length(x).alias("n"))), lambda x: x["n"] > 0)
    start = F.struct(F.lit(-1).alias("segment"), F.lit(limit + 1).alias("used"), F.expr("cast(array() as array<struct<item:int,segment:int,at:int>>)").alias("out"))

    def step(a, x):
        fits = (a["segment"] >= 0) & (a["used"] + gap + x["n"] <= limit)
        segment, at = F.when(fits, a["segment"]).otherwise(a["segment"] + 1), F.when(fits, a["used"] + gap).otherwise(F.lit(0))
        one = F.struct(x["item"].alias("item"), segment.alias("segment"), at.alias("at"))
        return F.struct(segment.alias("segment"), (at + x["n"]).alias("used"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def remap(spans: Column, packed: Column, texts: Column) -> Column:
    """array<struct(item, s, e, label)>: spans (segment, s, e, label) in segment offsets cut to each item that they overlap;
    a span over two items becomes two."""

    def of(span):
        hit = F.filter(packed, lambda p: (p["segment"] == span["segment"]) & (span["e"] > p["at"]) & (span["s"] < p["at"] + F.length(F.get(texts, p["item"]))))
        return F.transform(
            hit,
            lambda p: F.struct(
                p["item"].alias("item"),
                F.greatest(span["s"] - p["at"], F.lit(0)).alias("s"),
                F.least(span["e"] - p["at"], F.length(F.get(texts, p["item"]))).alias("e"),
                span["label"].alias("label"),
            ),
        )

    return F.flatten(F.transform(spans, of))


def region(points: Column) -> Column:
    """The box around an item's corner points."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))
