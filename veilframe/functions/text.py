"""String functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ACTION_PREFIXES, ACTION_SUFFIXES


def normalize_label(label: Column) -> Column:
    return F.replace(F.upper(label), F.lit(" "), F.lit("_"))


def hash5(value: Column) -> Column:
    """The five lowest base-36 digits of SHA-256: the digest is folded by 16 bits modulo 36^5."""
    digest = F.sha2(value.cast("binary"), 256)
    folded = F.aggregate(
        F.sequence(F.lit(0), F.lit(15)),
        F.lit(0).cast("long"),
        lambda a, i: (a * 65536 + F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("long")) % 60466176,
    )
    return F.lpad(F.lower(F.conv(folded.cast("string"), 10, 36)), 5, "0")


def token(category: Column, value: Column) -> Column:
    category = F.when(F.coalesce(category, F.lit("")) == "", F.lit("VALUE")).otherwise(category)
    return F.concat(category, F.lit("#"), hash5(F.concat(category, F.lit(":"), value)))


def fuzzy_key(text: Column) -> Column:
    """Lower case without white space or anything that is not a word character in Unicode's sense."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def answer_key(text: Column) -> Column:
    """Lower case, straight quotes, ASCII punctuation to spaces, spaces squeezed."""
    plain = F.translate(F.lower(text), "“”’", "\"\"'")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[!-/:-@\[-`{-~]", " "), r"(?U)\s+", " "))


def strip_action(text: Column) -> Column:
    """Without a leading verb (of one word or two) and a trailing noun; text is an answer_key."""
    two = [p for p in ACTION_PREFIXES if " " in p]
    one = [p for p in ACTION_PREFIXES if " " not in p]
    rest = F.regexp_replace(text, f"^(?:(?:{'|'.join(two)})(?: |$)|(?!(?:{'|'.join(two)})(?: |$))(?:{'|'.join(one)})(?: |$))", "")
    return F.regexp_replace(rest, f"(?:^| )(?:{'|'.join(ACTION_SUFFIXES)})$", "")


def first_words(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, n), " ")


def strip_leading_zeros(code: Column) -> Column:
    """Decimal literals in code without their leading zeros."""
    return F.regexp_replace(code, r"\b0+(\d)", "$1")


def unfence(reply: Column) -> Column:
    """What a code fence holds, or else the reply."""
    inner = F.regexp_extract(reply, r"(?s)```(?:\w+\n)?(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(reply))


def salvage_json(reply: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def duration_seconds(text: Column) -> Column:
    """m:ss or h:mm:ss in seconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))


def within_seconds(a: Column, b: Column, limit: int = 10) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) <= limit


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def ordered_distinct(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def tail(items: Column, n: int) -> Column:
    """The last n (one at least) of the distinct items in order."""
    distinct = F.array_distinct(items)
    size = F.size(distinct)
    return F.slice(distinct, F.greatest(size - max(1, n) + 1, F.lit(1)), F.lit(max(1, n)))
