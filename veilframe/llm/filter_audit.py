"""Filter interaction audit: what each of several document filters removes at each place of each order of applying them.

A document's failures are a bit mask, so a part (a source) is known by its counts per mask. Masks are unpivoted against the
orders and steps once: a long table of (order, step, mask), whose size depends on the number of filters alone, in which a
window runs the bits of the steps before together. Joined with the counts, conditional sums give a row per part, order and
step, and a window over part and filter the total that the filter removes in all orders.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, materialize, table

#: Fixed values of the audit's query: white space between words; limits of words, distinct words and capitals; marks.
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions A to D, by letter, of a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each source that fail just the filters of mask, bit i for FILTERS[i].

    Null source: the part of the empty string. Null text: empty. E holds for a document if a smaller doc_id has its text, by
    SHA-256; a null doc_id is not smaller than any, nor is any smaller than it, and rows that repeat a doc_id are documents of
    their own. An id that labels repeat is good or toxic if one of its rows says so; nulls say nothing. What is shuffled is one
    narrow row a document: texts stay where they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    failures = text_failures(F.col("_text"))
    bits = sum((F.when(failures[f], 1 << i).otherwise(0) for i, f in enumerate("ABCD")), F.lit(0))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"))
    narrow = narrow.select("doc_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("same"), bits.cast("int").alias("bits"))
    narrow = materialize(narrow, "masks")
    known = narrow.filter("doc_id is not null")
    first = known.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    times = known.groupBy("doc_id").count().filter("count > 1")
    heavy = heavy_keys(times, "doc_id", "count") if times.limit(1).count() else None
    marked = join_heavy(known, marks, "doc_id", "same", heavy, "left").join(first, ["doc_id", "same"], "left")
    rows = marked.select("part", (F.col("bits") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask"), "good", "toxic")
    rows = rows.unionByName(narrow.filter("doc_id is null").select("part", F.col("bits").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("good").alias("n_good"), one("toxic").alias("n_toxic"))


def order_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, filter, bit, mask, earlier): every order of the filters, step by step, against every mask; earlier
    are the bits of mask that steps before this one remove. Its rows depend on the number of filters alone."""
    orders = spark.createDataFrame([("".join(p),) for p in itertools.permutations(filters)], "filter_order string")
    steps = orders.select("filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    steps = steps.select("filter_order", (F.col("at") + 1).alias("step"), "filter", F.create_map(*(F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)))[F.col("filter")].alias("bit"))
    cells = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    before = Window.partitionBy("filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("earlier", F.coalesce(F.bit_or(F.col("bit").bitwiseAND(F.col("mask"))).over(before), F.lit(0)))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    (part, mask, n, n_good, n_toxic), a row for each part, order and step, zeros included. An empty table gives no row.

    Only the counts per part and mask meet the long table, whose size is fixed and which is broadcast."""
    if len(filters) > 6:
        raise ValueError(f"{math.factorial(len(filters))} orders are too many to audit")
    cells = masks.join(F.broadcast(order_steps(masks.sparkSession, filters)), "mask")
    fails, alive = F.col("bit").bitwiseAND(F.col("mask")) != 0, F.col("earlier") == 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    rows = cells.groupBy("part", "filter_order", "step", "filter").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(alive & fails, "n_good").alias("good_lost"), total(alive & fails, "n_toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = materialize(document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "cells")
    return audit(masks).drop("filter").withColumn("step", F.col("step").cast("int"))


OP13_SQL = r"""
with recursive docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
firsts as (select body, min(doc_id) as least from docs group by body),
marks as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels group by doc_id),
fails as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, map {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(d.body, '[^A-Z]', '', 'g')) > 2 * length(d.body),
    'D': regexp_matches(d.body, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)} as f
  from docs d join firsts using (body) left join marks using (doc_id)),
cells as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, f),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
orders as (
  select letter as o from letters union all select o || letter from orders, letters where length(o) < 5 and not contains(o, letter)),
steps as (select o, s as step, substr(o, s, 1) as letter, substr(o, 1, s - 1) as before from orders, range(1, 6) t(s) where length(o) = 5),
judged as (
  select part, o, step, letter, n, good, toxic, coalesce(f[letter], false) as failing,
    len(list_filter(string_split(before, ''), lambda x: x <> '' and coalesce(f[x], false))) > 0 as gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: coalesce(f[x], false))) = 1 as single
  from cells, steps),
tallied as (
  select part, o, step, letter, sum(n) filter (not gone and not failing) as kept, sum(n) filter (not gone and failing) as removed,
    sum(n) filter (gone and failing) as redundant, sum(n) filter (failing and single) as unique_fails,
    sum(good) filter (not gone and failing) as good_lost, sum(toxic) filter (not gone and failing) as toxic_lost
  from judged group by all)
select part, o as filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley
from tallied
"""
