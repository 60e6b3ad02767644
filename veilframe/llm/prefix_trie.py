"""Conversation prefix trie: which conversations share their first turns, and what that saves.

A turn is known by a digest of role and text. The digest of a prefix is the exclusive or of hashes of its turns with their
places, in two lanes of 64 bits, so that it runs up over any number of tasks; as a check, all members of a node must have the
same parent and the same last turn, from which it follows by induction that a node is one sequence. Nodes link to parents by
digest once; from then on a node is (depth, its smallest member), two small numbers.

Rollup: in round k each node adds what it holds to its 2^k-th ancestor and takes that one's pointer, so leaf counts and savings
of whole subtrees reach all ancestors in a number of rounds that is logarithmic in the depth. Only nodes at least 2^k deep take
part in round k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_keys, join_heavy, materialize, partitions, table
from .running import running

#: Fixed values of the query's rebuilt conversations: ids in blocks of so many, and the remainder that says what is taken over.
BLOCK, TURNS = 5, 9
CHUNK = 1 << 20  # bytes of listed ids that a row holds
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digests(df: DataFrame) -> DataFrame:
    """(conv_id, turn, key, bytes): a digest of role and text, and the text's UTF-8 bytes. Rows without a conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return df.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))


def own_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, position, key, bytes, total), (conv_id, total)) of conversations as they are: turns by turn (null first), ties
    by digest; total is a conversation's number of turns."""
    rows = running(turn_digests(df), "conv_id", ["turn", "key"])
    convs = materialize(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), "conversations")
    turns = join_heavy(rows, convs, "conv_id", "rank", heavy_keys(convs, "conv_id", "total"))
    return turns.select("conv_id", F.col("rank").alias("position"), "key", "bytes", "total"), convs


def rebuilt_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As own_turns, of conversations rebuilt from two: the first h turns of the conversation that begins the block of BLOCK
    ids, then the own turns after the first h; h is the CRC-32 of the id in decimals, modulo TURNS. A conversation may end
    up without turns."""
    rows = running(turn_digests(df), "conv_id", ["turn", "key"])
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", taken)
    convs = materialize(convs, "conversations")
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("shift", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = materialize(convs.select("conv_id", "base", "n", "h", "shift", (F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "rebuilt")
    later = join_heavy(rows, convs.select("conv_id", "h", "shift", "total"), "conv_id", "rank", heavy_keys(convs, "conv_id", "n")).filter("rank > h")
    later = later.select("conv_id", (F.col("shift") + F.col("rank") - F.col("h")).alias("position"), "key", "bytes", "total")
    early = rows.filter((F.col("rank") < TURNS) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("base"), "rank", "key", "bytes")
    early = early.join(convs.select("conv_id", "base", "h", "total"), "base").filter("rank <= h")  # BLOCK * TURNS rows a base at most
    early = early.select("conv_id", F.col("rank").alias("position"), "key", "bytes", "total")
    return early.unionByName(later), convs.select("conv_id", "total")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, a, b, conv_id) to (depth, a, b, first, ids): ids that follow each other in a node, joined by commas."""
    names = ["depth", "a", "b", "first", "ids"]
    node, first, ids, size = None, 0, [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*node, first)] + [pa.array([",".join(ids).encode()], pa.binary())], names=names)

    for batch in batches:
        out = []
        for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if at != node or size > CHUNK:
                if node is not None:
                    out.append(row())
                node, first, ids, size = at, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if node is not None:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, a, b, first, ids) to (depth, a, b, ends): one digest a node; of its list no more than a row is held."""
    node, digest = None, None
    done: list[tuple] = []

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.string() if i == 3 else pa.int64()) for i in range(4)], names=["depth", "a", "b", "ends"])
        done.clear()
        return rows

    for batch in batches:
        for depth, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, a, b) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, a, b), hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        if len(done) > 1000:
            yield flush()
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends): SHA-256 of the ascending conv_ids of (depth, a, b, conv_id), joined by commas. Tasks that sorted
    a range list its ids; a node's lists then stream past one digest, which is all that order demands of a single task."""
    spark = ends.sparkSession
    dealt = ends.repartitionByRange("depth", "a", "b", "conv_id").sortWithinPartitions("depth", "a", "b", "conv_id").select("depth", "a", "b", "conv_id")
    lists = dealt.mapInArrow(_listed, "depth long, a long, b long, first long, ids binary")
    lists = lists.repartition(partitions(spark), "depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first")
    return lists.mapInArrow(_hashed, "depth long, a long, b long, ends string")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, conv_id, parent_conv_id, n_convs, n_children, saved, ends) of the trie's nodes, from (conv_id, position from 1 without gaps,
    key, bytes, total) and (conv_id, total). No conversation, no node."""
    lane = lambda seed: F.xxhash64(F.lit(seed), "position", "key")
    placed = running(turns.withColumn("a", lane(1)).withColumn("b", lane(2)), "conv_id", ["position"], xors=["a", "b"])
    placed = placed.select(
        "conv_id", F.col("position").alias("depth"), F.col("run_a").alias("a"), F.col("run_b").alias("b"), F.col("run_a").bitwiseXOR(F.col("a")).alias("pa"), F.col("run_b").bitwiseXOR(F.col("b")).alias("pb"), "key", "bytes", "total"
    )
    same = F.struct("pa", "pb", "key", "bytes")
    nodes = placed.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(same).alias("s"), F.max(same).alias("t"))
    nodes = materialize(nodes, "nodes")
    if nodes.filter("s <> t").limit(1).count():
        raise RuntimeError("two sequences of turns have one digest; change the seeds of the lanes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("bytes"))
    nodes = nodes.select("depth", "a", "b", "conv_id", "n_convs", "s.pa", "s.pb", "s.bytes").unionByName(root)
    ends = placed.filter("depth = total").select("depth", "a", "b", "conv_id").unionByName(convs.filter("total = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    nodes = nodes.join(end_digests(ends), ["depth", "a", "b"], "left")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["depth", "a", "b"], "left"), "nodes")
    # the parent's smallest member; a parent may have very many children
    below = nodes.withColumn("up", F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")))
    above = nodes.filter("n_children > 0").select(F.struct("depth", "a", "b").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    linked = join_heavy(below.filter("depth > 0"), above.drop("n_children"), "up", "a", heavy_keys(above, "up", "n_children"))
    every = linked.drop("up").unionByName(below.filter("depth = 0").drop("up").withColumn("parent_conv_id", F.lit(None).cast("long")))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    return materialize(every.select("depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), saved.alias("saved"), F.coalesce("ends", F.lit(NOTHING)).alias("ends")), "trie")


def rollup(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(depth, conv_id, *values) summed over subtrees, from nodes (depth, conv_id, parent_conv_id), by pointer jumping.

    A round's pointers, and what is added to whom, are written to the shared folder; sums to a node with very many descendants
    are aggregated where they arise, and its own pointer is looked up by salted rows."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = materialize(nodes.filter("depth > 0").select("depth", "conv_id", F.col("parent_conv_id").alias("up"), *(v.alias(k) for k, v in values.items())), "pointers")
    parts = [nodes.select("depth", "conv_id", *(v.alias(k) for k, v in values.items()))]
    step = 1
    while step <= deepest:
        target = [(F.col("depth") - step).alias("depth"), F.col("up").alias("conv_id")]
        given = materialize(active.groupBy(*target).agg(*(F.sum(k).alias(k) for k in values), F.count(F.lit(1)).alias("givers")), "given")
        parts.append(given.drop("givers"))
        if 2 * step <= deepest:
            added = given.select("depth", "conv_id", *(F.col(k).alias(f"_{k}") for k in values))
            held = active.filter(F.col("depth") >= 2 * step).join(added, ["depth", "conv_id"], "left")
            held = held.select("depth", "conv_id", F.struct((F.col("depth") - step).alias("depth"), F.col("up").alias("conv_id")).alias("node"), *((F.col(k) + F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in values))
            jump = active.select(F.struct("depth", "conv_id").alias("node"), "up")
            heavy = heavy_keys(given.select(F.struct("depth", "conv_id").alias("node"), "givers"), "node", "givers")
            active = materialize(join_heavy(held, jump, "node", "conv_id", heavy).drop("node"), "pointers")
        step *= 2
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("depth", "conv_id").agg(*(F.sum(k).alias(k) for k in values))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct
    sequence of first turns, the empty one included.

    Null role or text: empty. Turns that repeat are turns of their own; other columns are ignored; rows without a conv_id
    belong to no conversation. A conversation without turns is a member of the root only. An empty table gives no row.
    """
    nodes = prefix_nodes(turns, convs)
    sums = rollup(nodes, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved")})
    return nodes.join(sums, ["depth", "conv_id"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt_turns(table(spark, sf_dir, "conversations")))


OP12_SQL = """
with turns as (
  select conv_id, turn, strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '') as said, strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null),
ranked as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, md5(said)) as r from turns),
convs as materialized (
  select conv_id, count(*) as n, conv_id - conv_id % 5 as base, xor(list_reduce(
      [4294967295] || list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)),
      lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 as h
  from ranked group by conv_id),
sized as materialized (select c.*, least(c.h, coalesce(b.n, 0)) as shift from convs c left join convs b on b.conv_id = c.base),
rebuilt as materialized (
  select c.conv_id, r.r as d, said, bytes from sized c join ranked r on r.conv_id = c.base and r.r <= c.h
  union all select c.conv_id, c.shift + r.r - c.h, said, bytes from sized c join ranked r on r.conv_id = c.conv_id and r.r > c.h),
totals as (select c.conv_id, count(d) as total from convs c left join rebuilt using (conv_id) group by 1),
prefixes as (
  select conv_id, d, bytes, md5(string_agg(md5(said), '') over (partition by conv_id order by d rows unbounded preceding)) as p from rebuilt
  union all select conv_id, 0, 0, '' from convs),
members as materialized (select conv_id, d, bytes, min(conv_id) over (partition by d, p) as node from prefixes),
nodes as materialized (
  select node, d, count(*) as n_convs, (count(*) - 1) * min(bytes) as saved,
    sha256(coalesce(string_agg(m.conv_id::varchar, ',' order by m.conv_id) filter (t.total = d), '')) as ends_sha256
  from members m join totals t using (conv_id) group by node, d),
linked as materialized (select n.*, m.node as parent from nodes n left join members m on m.conv_id = n.node and m.d = n.d - 1),
children as materialized (select parent, d - 1 as d, count(*) as n from linked where d > 0 group by all),
counted as materialized (select l.*, coalesce(c.n, 0) as n_children from linked l left join children c on c.parent = l.node and c.d = l.d),
sums as (
  select m.node, m.d, count(*) filter (c.n_children = 0) as n_leaves, sum(c.saved) as saved_tokens
  from counted c join members m on m.conv_id = c.node and m.d <= c.d group by all)
select node as conv_id, d::bigint as depth, parent as parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from counted join sums using (node, d)
"""
