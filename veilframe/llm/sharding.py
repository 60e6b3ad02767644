"""Sharding by balanced label propagation.

Documents start in the shard of their id's hash. In each round linked documents vote: a document wants the shard that most
of its neighbours are in. Moves are granted under capacity quotas: between two shards as many as want the other way, and
beyond that what the wanted shard still has room for. A last step makes counts equal to within one: each shard keeps as
many documents as its quota, linked ones first and group by group, and what is over fills up the others.

Everything is joins and aggregates; the driver sees counts per shard (and per pair of shards), never documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, one_row_per_id, partitions, table

SHARDS, ROUNDS, SLACK, SALTS = 16, 10, 0.02, 16


def _salted(rows: DataFrame, lookup: DataFrame, key: str, by: str) -> DataFrame:
    """rows join lookup on key, where one key may hold a large share of rows: dealt over SALTS by another column. The copies
    of lookup are merged, not broadcast: a small file's rows are many."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("_salt", salt).join(lookup.withColumn("_salt", every).hint("merge"), [key, "_salt"]).drop("_salt")


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(doc_id, shard) for nodes (doc_id, unique) with links (a, b). Links with a null end or to themselves count nothing."""
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    total = nodes.count()
    both = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(both.select(F.col("a").alias("doc_id")).distinct().join(nodes, "doc_id", "left_semi").withColumn("shard", start), "shards")
    free = {r["shard"]: r["count"] for r in nodes.join(labels, "doc_id", "left_anti").groupBy(start.alias("shard")).count().collect()}
    capacity = total / shards * (1 + slack) + 1
    for turn in range(rounds):
        seen = _salted(both, labels.withColumnRenamed("doc_id", "b"), "b", "a")
        votes = seen.groupBy(F.col("a").alias("doc_id"), F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("doc_id").agg(F.max(F.struct("votes", (-F.col("to")).alias("less"))).alias("m"), F.map_from_entries(F.collect_list(F.struct("to", "votes"))).alias("all"))
        wants = labels.join(best, "doc_id").select("doc_id", "shard", (-F.col("m.less")).alias("to"), (F.col("m.votes") - F.coalesce(F.try_element_at("all", F.col("shard")), F.lit(0))).alias("gain"))
        # in each round a document moves or looks on, so that both ends of a link don't swap places
        wants = materialize(wants.withColumn("goes", (F.col("gain") > 0) & (F.col("to") != F.col("shard")) & (F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(2)) == 0)), "wants")
        held = dict(free)
        for r in wants.groupBy("shard").count().collect():
            held[r["shard"]] = held.get(r["shard"], 0) + r["count"]
        flows = {(r["shard"], r["to"]): r["count"] for r in wants.filter("goes").groupBy("shard", "to").count().collect()}
        if not flows:
            break
        share = {}
        for t in range(shards):
            into = {s: n for (s, u), n in flows.items() if u == t}
            swaps = {s: min(n, flows.get((t, s), 0)) for s, n in into.items()}
            room, rest = max(0.0, capacity - held.get(t, 0)), sum(n - swaps[s] for s, n in into.items())
            for s, n in into.items():
                extra = (n - swaps[s]) * min(1.0, room / rest) if rest else 0.0
                share[s * shards + t] = (swaps[s] + extra) / n
        granted = F.create_map(*[F.lit(x) for kv in share.items() for x in (int(kv[0]), float(kv[1]))])
        luck = F.pmod(F.xxhash64("doc_id", F.lit(turn + 1000)), F.lit(1_000_003)) / 1_000_003
        moves = F.col("goes") & (luck < F.coalesce(F.try_element_at(granted, F.col("shard") * shards + F.col("to")), F.lit(0.0)))
        labels = materialize(wants.select("doc_id", F.when(moves, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")), "shards")
    return nodes.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("shard", start).alias("shard"))


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with rank: gapless from 0 in each group, by order. Rows are dealt by range; a rank is the row's place in its
    partition plus an offset per partition and group, of which there are about as many as partitions and groups."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    rows = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    heads = sorted((r[group], r["_part"], r["least"], r["n"]) for r in rows.groupBy(group, "_part").agg(F.min("_at").alias("least"), F.count(F.lit(1)).alias("n")).collect())
    offsets, before, last = [], 0, None
    for g, p, least, n in heads:
        before = before if g == last else 0
        offsets.append((g, p, before - least))
        before, last = before + n, g
    lookup = spark.createDataFrame(offsets, f"{group} {dict(df.dtypes)[group]}, _part int, _offset long")
    return rows.join(F.broadcast(lookup), [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def balance_rows(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """df (with shard and rank in it) with shard and slot such that counts differ by one at most and slots have no gap."""
    held = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    sizes = [held.get(s, 0) for s in range(shards)]
    total = sum(sizes)
    # shards that hold more get the quotas that are one larger
    order = sorted(range(shards), key=lambda s: (-sizes[s], s))
    quota = [0] * shards
    for i, s in enumerate(order):
        quota[s] = total // shards + (i < total % shards)
    over, lack = [max(0, n - q) for n, q in zip(sizes, quota)], [max(0, q - n) for n, q in zip(sizes, quota)]
    numbers = lambda x: F.array(*[F.lit(int(v)).cast("long") for v in x])
    over_before, lack_before = [sum(over[:s]) for s in range(shards)], [sum(lack[:s]) for s in range(shards + 1)]
    at = lambda x, i: F.element_at(numbers(x), (i + 1).cast("int"))
    spare = at(over_before, F.col("shard")) + F.col("rank") - at(quota, F.col("shard"))
    target = sum((F.when(spare >= lack_before[s + 1], 1).otherwise(0) for s in range(shards - 1)), F.lit(0))
    moved = F.col("rank") >= at(quota, F.col("shard"))
    placed = df.withColumn("_moved", moved).withColumn("_spare", spare).withColumn("_to", F.when(moved, target).otherwise(F.col("shard")).cast("int"))
    slot = F.when(F.col("_moved"), at(sizes, F.col("_to")) + F.col("_spare") - at(lack_before[:shards], F.col("_to"))).otherwise(F.col("rank"))
    return placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.col("_to")).drop("_moved", "_spare", "_to", "rank")


def shard_documents(documents: DataFrame, links: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) with counts of rows at most one apart.

    Links are given (a, b), or else bind documents of equal text to the first of them. size: UTF-8 bytes plus 1; a null
    text has none and is linked with empty texts. Rows without a doc_id are left out, rows that repeat one count as one
    document. An empty table gives no row; with fewer documents than shards some shards stay empty.
    """
    text = F.coalesce("text", F.lit(""))
    docs = one_row_per_id(documents, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("same"))
    docs = materialize(docs, "documents")
    firsts = docs.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("same", "first")
    groups = materialize(_salted(docs.select("doc_id", "same"), firsts, "same", "doc_id"), "groups")
    if links is None:
        links = groups.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    labels = propagate(docs.select("doc_id"), links, shards)
    linked = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("linked", F.lit(0))
    rows = docs.drop("same").join(labels, "doc_id").join(groups.select("doc_id", "first"), "doc_id", "left").join(linked, "doc_id", "left")
    rows = rows.withColumn("linked", F.coalesce("linked", F.lit(1))).withColumn("first", F.coalesce("first", "doc_id"))
    return balance_rows(ranked(rows, "shard", "linked", "first", "doc_id"), shards).drop("linked", "first")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
