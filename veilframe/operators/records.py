"""Records read from a page's node keys: alarms, songs, bills and sets of texts, and whether a tab is selected.

Nodes come as rows (page columns, ord, key), key in the form ``class ;action; status ;extended;text``. A page's keys are taken
in order into one array, as pages are small, and folded there without leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of records in keys.
PLAIN_TEXT = "TextView ;; ;;"
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "Not scheduled", "Today", "Tomorrow", "Every day")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DURATION = r"^(\d+:)?[0-5]?\d:[0-5]?\d$"
NOTE_HINTS = ("Notes", "Payee or item purchased", "Name of income")

ALARM = "struct<days:array<string>,expanded:boolean,time:string,label:string,ringtone:string,vibrate:string,status:string>"


def keys_of(nodes: DataFrame, page: list[str]) -> DataFrame:
    """(page, keys): each page's keys in order."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"])
    return nodes.groupBy(*page).agg(keys.alias("keys"))


def alarms(keys: Column) -> Column:
    """array of alarms. An alarm ends at its switch; one that is unfolded ends at its delete button or at the list's add button
    instead. What belongs to the key that ends it counts for the next alarm."""
    empty = F.expr(f"cast(named_struct('days', array(), 'expanded', null, 'time', null, 'label', null, 'ringtone', null, 'vibrate', null, 'status', null) as {ALARM})")
    start = F.struct(F.lit(False).alias("open"), empty.alias("now"), F.expr(f"cast(array() as array<{ALARM}>)").alias("out"))
    has = lambda key, text: F.contains(key, F.lit(text))
    state = lambda key: F.when(has(key, "unchecked"), "unchecked").otherwise("checked")

    def with_(now, **fields):
        return F.struct(*[(fields[c] if c in fields else now[c]).alias(c) for c in ("days", "expanded", "time", "label", "ringtone", "vibrate", "status")])

    def step(a, key):
        unfolded = a["open"] | has(key, "Collapse")
        now = with_(a["now"], expanded=F.when(has(key, "Collapse"), F.lit(True)).otherwise(a["now"]["expanded"]))
        ends = F.when(unfolded, has(key, "Delete") | has(key, "Add alarm")).otherwise(has(key, "Switch") & has(key, "checked"))
        out = F.when(ends, F.concat(a["out"], F.array(with_(now, status=state(key))))).otherwise(a["out"])
        rest = F.when(ends, empty).otherwise(now)
        days = F.filter(F.array(*map(F.lit, DAYS)), lambda d: F.contains(key, d) & has(key, "TextView"))
        rest = with_(
            rest,
            days=F.concat(rest["days"], days),
            time=F.when(has(key, "AM") | has(key, "PM"), key).otherwise(rest["time"]),
            label=F.when(has(key, "Label"), key).otherwise(rest["label"]),
            ringtone=F.when(has(key, "Ringtone"), key).otherwise(rest["ringtone"]),
            vibrate=F.when(has(key, "Vibrate"), state(key)).otherwise(rest["vibrate"]),
        )
        return F.struct((unfolded & ~ends).alias("open"), rest.alias("now"), out.alias("out"))

    return F.aggregate(keys, start, step, lambda a: a["out"])


def text_part(key: Column, mark: str = ";; ;;") -> Column:
    """What stands after the last mark."""
    return F.trim(F.substring_index(key, mark, -1))


def songs(texts: Column) -> Column:
    """array<struct<song, artist, duration>> of texts in threes. They begin at the first of four places with a duration two
    places on (or the first place), and end where a third text is none."""
    n = F.size(texts)
    timed = lambda i: F.coalesce(F.get(texts, i + 2).rlike(DURATION), F.lit(False))
    first = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: (i + 2 < n) & timed(i)), 0), F.lit(0))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - first, F.lit(1)) / 3).cast("int")), lambda k: first + 3 * k), lambda i: i + 2 < n)
    start = F.struct(F.lit(False).alias("done"), F.expr("cast(array() as array<struct<song:string,artist:string,duration:string>>)").alias("out"))

    def step(a, i):
        one = F.struct(F.get(texts, i).alias("song"), F.get(texts, i + 1).alias("artist"), F.get(texts, i + 2).alias("duration"))
        done = a["done"] | ~timed(i)
        return F.struct(done.alias("done"), F.when(done, a["out"]).otherwise(F.concat(a["out"], F.array(one))).alias("out"))

    return F.aggregate(places, start, step, lambda a: a["out"])


def bill(texts: Column, beside_amount: Column, inputs: Column) -> Column:
    """struct<type, date, cash, note>, each empty where it is not found. texts: the plain texts' keys; beside_amount: the keys of
    the children of the first parent of an amount's currency; inputs: the input fields' keys."""
    last = lambda keys: F.try_element_at(keys, F.lit(-1))
    dated = F.get(F.filter(texts, lambda k: k.rlike(MONTHS)), 0)
    amount = last(F.filter(beside_amount, lambda k: F.contains(k, F.lit("EditText")) & F.contains(k, F.lit("long-click"))))
    note = text_part(last(inputs), ";;")
    return F.struct(
        F.coalesce(F.substring_index(text_part(F.get(texts, 0)), " ", -1), F.lit("")).alias("type"),
        F.coalesce(text_part(dated), F.lit("")).alias("date"),
        F.coalesce(text_part(amount, ";;"), F.lit("")).alias("cash"),
        F.coalesce(F.when(note.isin(*NOTE_HINTS), "None").otherwise(note), F.lit("")).alias("note"),
    )


def bill_matches(found: Column, wanted: Column) -> Column:
    """Per field whether it is as wanted (null: not asked for): notes without regard to case, amounts with or without cents."""
    cash = (found["cash"] == wanted["cash"]) | (found["cash"] == F.concat(wanted["cash"], F.lit(".00")))
    return F.struct((found["type"] == wanted["type"]).alias("type"), (found["date"] == wanted["date"]).alias("date"), cash.alias("cash"), (F.lower(found["note"]) == F.lower(wanted["note"])).alias("note"))


def text_set(keys: Column) -> Column:
    """The distinct texts of the text nodes, sorted: titles, playlists, collections."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(keys, lambda k: F.contains(k, F.lit("TextView"))), lambda k: text_part(k))))


def selected(nodes: DataFrame, page: str, name: str, mark: str = "selected, ;") -> DataFrame:
    """(page, selected): whether a node whose key has mark, or one below it, has name in its key. nodes: path, key."""
    marked = nodes.filter(F.contains("key", F.lit(mark))).select(page, F.col("path").alias("_up"))
    named = nodes.filter(F.contains("key", F.lit(name))).select(page, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), 1, i), "."))).alias("_up"))
    hits = named.join(marked, [page, "_up"], "left_semi").select(page).distinct().withColumn("selected", F.lit(True))
    return nodes.select(page).distinct().join(hits, page, "left").select(page, F.coalesce("selected", F.lit(False)).alias("selected"))


def descending(durations: Column, seconds) -> Column:
    """Whether durations (array<string>, read by seconds) never rise; an empty list does not."""
    n = F.size(durations)
    return F.forall(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: seconds(F.get(durations, i)) >= seconds(F.get(durations, i + 1)))
