"""Searches in one page's nodes, as expressions over an array column: what judges of screens test.

nodes is an array of struct<pre, last, parent, key> in page order: pre is a node's place, last that of the last node below it
(or its own), parent the parent's place (null at the top). A node is below another if its place lies in that interval, so no
search walks a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import once
from . import records as N

# How keys mark pages, records and their fields.
TEXT, TEXT_NODE, PLAIN = ";; ;;", "TextView", "TextView ;; ;;"
SELECTED, SELECTED_TAB, TAB_BAR_ALARM = "selected, ;", "focusable ; selected ; selected", "click ; ;;Alarm"
CURRENCY, INPUT, SIGN_BUTTON, SIGNS = "click ; ;;CNY", "EditText", "TextView ;click", ("+", "-")
THIN_SPACE = " "

NO_KEYS = "cast(array() as array<string>)"
ENDLESS = 2**31 - 1


def pages(nodes: DataFrame, page: list[str], key: str = "key") -> DataFrame:
    """(page, nodes) from nodes (page, node_id, last_id, parent_id, key). A page is one document, so its nodes were one row."""
    one = F.struct(F.col("node_id").alias("pre"), F.col("last_id").alias("last"), F.col("parent_id").alias("parent"), F.col(key).alias("key"))
    return nodes.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("nodes"))


def matches(nodes: Column, text: Column) -> Column:
    return F.filter(nodes, lambda n: F.contains(n["key"], text))


def topmost(nodes: Column, text: Column) -> Column:
    """The nodes whose key contains text and that lie below no other such node."""
    start = F.struct(F.lit(-1).alias("until"), F.slice(nodes, 1, 0).alias("out"))
    take = lambda a, n: F.when(n["pre"] <= a["until"], a).otherwise(F.struct(n["last"].cast("int").alias("until"), F.concat(a["out"], F.array(n)).alias("out")))
    return F.aggregate(matches(nodes, text), start, take, lambda a: a["out"])


def parents(nodes: Column, text: Column) -> Column:
    """Places of the parents whose child contains text, in page order. The search leaves a parent at its first such child, and so
    does not see what is below or after that child; a match at the top ends it."""
    start = F.struct(F.lit(-1).alias("until"), F.expr("cast(array() as array<int>)").alias("out"))
    end = lambda n: F.coalesce(F.get(F.filter(nodes, lambda m: m["pre"] == n["parent"]), 0)["last"], F.lit(ENDLESS)).cast("int")
    out = lambda a, n: F.when(n["parent"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(n["parent"].cast("int"))))
    take = lambda a, n: F.when(n["pre"] <= a["until"], a).otherwise(F.struct(end(n).alias("until"), out(a, n).alias("out")))
    return F.aggregate(matches(nodes, text), start, take, lambda a: a["out"])


def children(nodes: Column, place: Column) -> Column:
    return F.filter(nodes, lambda n: n["parent"] == place)


def keys(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["key"])


def family_keys(nodes: Column, text: Column) -> Column:
    """Keys of all children of parents(text), in order."""
    return F.flatten(F.transform(parents(nodes, text), lambda p: keys(children(nodes, p))))


def has(nodes: Column, text: Column) -> Column:
    return F.size(parents(nodes, text)) > 0


def within(nodes: Column, mark: Column, text: Column) -> Column:
    """Whether a node that contains mark, or one below it, contains text."""
    return once(matches(nodes, text), lambda found: F.exists(matches(nodes, mark), lambda m: F.exists(found, lambda n: n["pre"].between(m["pre"], m["last"]))))


def texts(nodes: Column, mark: str = TEXT_NODE) -> Column:
    """What topmost text nodes say."""
    return F.transform(topmost(nodes, F.lit(mark)), lambda n: N.text_part(n["key"]))


def tail(key: Column) -> Column:
    return F.substring_index(key, ";", -1)


def checked(key: Column) -> Column:
    return F.contains(key, F.lit("checked")) & ~F.contains(key, F.lit("unchecked"))


def bill(nodes: Column) -> Column:
    beside = F.coalesce(F.get(F.transform(F.slice(parents(nodes, F.lit(CURRENCY)), 1, 1), lambda p: keys(children(nodes, p))), 0), F.expr(NO_KEYS))
    return N.bill(keys(topmost(nodes, F.lit(PLAIN))), beside, keys(topmost(nodes, F.lit(INPUT))))


def sign(nodes: Column) -> Column:
    """The first sign among buttons, or null."""
    return F.get(F.filter(F.transform(topmost(nodes, F.lit(SIGN_BUTTON)), lambda n: F.trim(F.substring_index(n["key"], "; ;;", -1))), lambda s: s.isin(*SIGNS)), 0)


def before_word(key: Column, word: Column) -> Column:
    """What a key says before a word: of the part that has it."""
    part = F.get(F.filter(F.split(key, ";"), lambda p: F.contains(p, word)), 0)
    return F.rtrim(F.split_part(part, word, F.lit(1)))


def minutes_after_noon(time: Column) -> Column:
    """Hour times 60 and minutes of a time of an afternoon, as they are written."""
    part = F.get(F.filter(F.split(time, ";"), lambda p: F.contains(p, F.lit("PM"))), 0)
    clock = F.split(F.split(part, THIN_SPACE)[0], ":")
    number = lambda i: F.try_element_at(clock, F.lit(i)).try_cast("int")
    return number(1) * 60 + number(2)


def alarm_fits(alarm: Column, asked: Column) -> Column:
    """Whether an alarm is as asked (a map): time (all of its parts, split by &), after (later in the afternoon), days
    (comma-separated, in order), label, ringtone, vibrate, status. Without a time it fits only where none is asked for."""
    want = lambda k: F.try_element_at(asked, F.lit(k))
    test = lambda k, hit: want(k).isNull() | F.coalesce(hit, F.lit(False))
    timed = F.forall(F.split(want("time"), "&"), lambda t: F.contains(alarm["time"], t))
    later = F.contains(alarm["time"], F.lit("PM")) & (minutes_after_noon(alarm["time"]) > want("after").cast("int"))
    return (
        test("time", timed) & test("after", later) & test("days", F.array_join(alarm["days"], ",") == want("days"))
        & test("label", before_word(alarm["label"], F.lit("Label")) == want("label")) & test("ringtone", before_word(alarm["ringtone"], F.lit("Ringtone")) == want("ringtone"))
        & test("vibrate", alarm["vibrate"] == want("vibrate")) & test("status", alarm["status"] == want("status"))
    )


def any_alarm(nodes: Column, places: Column, asked: Column) -> Column:
    """Whether an alarm that is listed among the children of one of places is as asked."""
    return F.exists(places, lambda p: F.exists(N.alarms(keys(children(nodes, p))), lambda a: alarm_fits(a, asked)))


def alarm_list(nodes: Column) -> Column:
    """Whether the page lists alarms, and does not merely offer the tab that does."""
    return once(topmost(nodes, F.lit("Alarm")), lambda t: (F.size(t) > 1) | ((F.size(t) == 1) & ~F.contains(F.get(t, 0)["key"], F.lit(TAB_BAR_ALARM))))


def spoken_number(key: Column, unit: Column) -> Column:
    """The last word before a unit."""
    return F.try_element_at(F.split(F.rtrim(F.split_part(key, unit, F.lit(1))), " "), F.lit(-1))


def durations_run(nodes: Column, falling: bool) -> Column:
    """Whether the durations of the page's songs never rise (or never fall); no song, no break."""
    # Fixed value: a duration is minutes and seconds, or hours before them
    seconds = lambda d: once(F.split(d, ":"), lambda p: F.aggregate(p, F.lit(0), lambda a, x: a * 60 + x.cast("int")))
    found = F.transform(N.songs(texts(nodes, PLAIN)), lambda s: seconds(s["duration"]))
    return once(found, lambda d: F.array_sort(d) == (F.reverse(d) if falling else d))


def section_has(nodes: Column, begins: Column, ends: Column, text: Column) -> Column:
    """Whether below a node that stands after one with begins and not after one with ends, among the children of parents(begins),
    a child contains text."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("hit"))

    def step(a, n):
        hit = a["hit"] | (a["inside"] & F.exists(children(nodes, n["pre"]), lambda c: F.contains(c["key"], text)))
        return F.struct(((a["inside"] | F.contains(n["key"], begins)) & ~F.contains(n["key"], ends)).alias("inside"), hit.alias("hit"))

    rows = F.flatten(F.transform(parents(nodes, begins), lambda p: children(nodes, p)))
    return F.aggregate(rows, start, step, lambda a: a["hit"])


def next_checked(nodes: Column, text: Column) -> Column:
    """Whether the key after the first one with text, among the children of parents(text), is a switch that is on."""
    row = family_keys(nodes, text)
    return once(row, lambda ks: F.coalesce(checked(F.get(ks, F.array_position(F.transform(ks, lambda k: F.contains(k, text)), F.lit(True)).cast("int"))), F.lit(False)))


def first_family_has(nodes: Column, scope: Column, text: Column) -> Column:
    """Whether a node below the first of parents(scope) contains text; not where that parent itself does."""
    top = lambda place: F.get(F.filter(nodes, lambda n: n["pre"] == place), 0)
    below = lambda t: ~F.contains(t["key"], text) & F.exists(nodes, lambda n: (n["pre"] > t["pre"]) & (n["pre"] <= t["last"]) & F.contains(n["key"], text))
    return F.coalesce(once(F.get(parents(nodes, scope), 0), lambda place: once(top(place), below)), F.lit(False))


def last_family_tail(nodes: Column, scope: Column, mark: Column) -> Column:
    """Of the last of parents(scope), the tail of the first child with mark; null if none has it."""
    share = lambda last: F.rtrim(tail(F.get(F.filter(keys(children(nodes, last)), lambda k: F.contains(k, mark)), 0)))
    return once(F.try_element_at(parents(nodes, scope), F.lit(-1)), share)


def time_beside(nodes: Column, scope: Column, word: Column) -> Column:
    """The two words after word in the last child that has it, of parents(scope): a time and its half of the day."""
    found = F.try_element_at(F.filter(family_keys(nodes, scope), lambda k: F.contains(k, word)), F.lit(-1))
    return F.array_join(F.slice(F.filter(F.split(F.split_part(found, word, F.lit(-1)), r"\s+"), lambda w: w != ""), 1, 2), " ")
