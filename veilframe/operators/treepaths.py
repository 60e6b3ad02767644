"""Paths and merges up the parent links of node tables, by pointer doubling: in each round a node takes over what the node it points
at has found and points where that one points, so a tree of depth d takes about log d rounds of one join, however many pages
there are. Both sides of these joins grow with the nodes and are small as files, so that Spark would broadcast them by their files'
size: each join is hinted to shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

#: Attributes that may tell a node apart, in the order they are tried, and what paths call them.
NAMED = (("tag", "label"), ("resource_id", "resource-id"), ("text", "text"), ("content_desc", "content-desc"))


def double_up(pointers: DataFrame, page: str, value: str, joined) -> DataFrame:
    """pointers (page, node_id, up, value), where up is a node of the page to go on from or null: value of each node once all
    pointers are followed. joined(above, own) puts two values together. A pointer to a node that the page lacks ends there.
    Rounds are written to the shared folder; they end when no pointer is left, which for a cycle would be never, so a number
    of rounds beyond 32, more than any tree has, raises."""
    held = pointers.select(page, "node_id", "up", value)
    for _ in range(32):
        held = stored(held, "pointers")
        ended, open_ = held.filter("up is null"), held.filter("up is not null")
        if not open_.limit(1).count():
            return held.drop("up")
        above = held.select(page, F.col("node_id").alias("up"), F.col("up").alias("_next"), F.col(value).alias("_above"), F.lit(True).alias("_known"))
        both = F.when(F.col("_known"), joined(F.col("_above"), F.col(value))).otherwise(F.col(value))
        followed = open_.join(above.hint("merge"), [page, "up"], "left").select(page, "node_id", F.col("_next").alias("up"), both.alias(value))
        held = ended.unionByName(followed)
    raise ValueError("parent links go round in circles")


def short_xpaths(nodes: DataFrame, page: str) -> DataFrame:
    """(page, node_id, xpath): the shortest path from a node that one of its attributes tells apart on the page. nodes: (page, node_id,
    parent_id, ord, tag, class, resource_id, text, content_desc).

    A step that no attribute tells apart is its class (without one its tag) and its place among the siblings of that class; at the top
    it is the tag. Empty values count as values: the only node without a text is told apart by that. Nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = nodes.select(page, "node_id", "parent_id", "ord", *(text(c).alias(c) for c, _ in NAMED), F.coalesce(F.nullif(F.col("class"), F.lit("")), text("tag")).alias("class"))
    rows = rows.repartition(page)  # all windows below are by page and more, and so shuffle nothing
    single = lambda c: F.count(F.lit(1)).over(Window.partitionBy(page, c)) == 1
    rows = rows.withColumns({f"_{c}": single(c) for c in ("tag", "resource_id", "text", "content_desc", "class")})
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(page, "parent_id", "class").orderBy("ord", "node_id")))
    named = F.lit(None).cast("string")
    for c, name in reversed([*NAMED, ("class", None)]):
        named = F.when(F.col(f"_{c}"), F.col("class") if name is None else F.concat(F.lit(f'*[@{name}="'), F.col(c), F.lit('"]'))).otherwise(named)
    step = F.coalesce(named, F.when(F.col("parent_id").isNull(), F.col("tag")).otherwise(F.concat("class", F.lit("["), F.col("_place").cast("string"), F.lit("]"))))
    pointers = rows.select(page, "node_id", F.when(named.isNull(), F.col("parent_id")).alias("up"), step.alias("xpath"))
    paths = double_up(pointers, page, "xpath", lambda above, own: F.concat(above, F.lit("/"), own))
    return paths.select(page, "node_id", F.concat(F.lit("//"), F.col("xpath")).alias("xpath"))


def said_words(text: Column, description: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.concat_ws(" ", text, description), "[;,.]", " "), r"\s+"), lambda w: w != "")


def merge_idle(nodes: DataFrame, page: str) -> DataFrame:
    """(page, node_id, parent_id, text): nodes (page, node_id, parent_id, actions, text, content_desc) without those that offer no
    action. Their children move up to the nearest node that is left, and in page order their words join its text, those that it has
    already left out. Nodes at the top stay, as they have no parent to join. A text that nothing joins stays as it is."""
    kept = F.col("parent_id").isNull() | (F.size(F.coalesce("actions", F.expr("cast(array() as array<string>)"))) > 0)
    rows = nodes.select(page, "node_id", "parent_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("content_desc", F.lit("")).alias("content_desc"), kept.alias("kept"))
    pointers = rows.select(page, "node_id", F.when(~F.col("kept"), F.col("parent_id")).alias("up"), F.col("node_id").alias("home"))
    home = double_up(pointers, page, "home", lambda above, own: above)
    rows = rows.join(home.hint("merge"), [page, "node_id"]).join(home.select(page, F.col("node_id").alias("parent_id"), F.col("home").alias("_parent")).hint("merge"), [page, "parent_id"], "left")
    joins = rows.filter(~F.col("kept")).groupBy(page, F.col("home").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", said_words(F.col("text"), F.col("content_desc")).alias("words")))).alias("joins"))
    own = rows.filter("kept").join(joins.hint("merge"), [page, "node_id"], "left")
    plain = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    words = F.aggregate("joins", plain, lambda known, x: F.concat(known, F.filter(x["words"], lambda w: ~F.array_contains(known, w))))
    return own.select(page, "node_id", F.col("_parent").alias("parent_id"), F.when(F.col("joins").isNull(), F.col("text")).otherwise(F.array_join(words, " ")).alias("text"))
